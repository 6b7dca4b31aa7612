"""Exact substring de-duplication: every byte covered by a `length`-byte string that also starts elsewhere goes.

A suffix array of a whole corpus cannot be spread over machines, so arrays are built where they matter:
1. Each start of a `length`-byte string names the least hash among the SEED-byte strings inside it (its anchor).
   Equal strings name equal anchors, so only anchors that occur more than once matter. Starts that share an
   anchor are neighbours; anchor and a digest of the stretch that its starts cover make one row.
2. Stretches whose digest repeats are repeated as a whole (the inside of copies, however many there are); one of
   each stands for them below. Digests are 64-bit, beside the anchor's 64-bit hash; their bytes are not compared.
3. Stretches meet by anchor in chunks of whole groups; anchors of over HOT stretches are split by the bytes around
   them first (crowded()). Over the chunk's suffix order (prefix doubling), previous and next smaller positions give
   each start's longest previous factor; where it reaches `length`, the string has an earlier copy. The contract
   removes the first copies too, which have a later one's rank; keep_first leaves them.

Work is on distinct texts: rows of equal text (64-bit hash and size) share a result and count as one another's copies.
Defined results: null is the empty text; texts shorter than `length` keep everything; repeated and null doc_ids are rows
of their own; a text of any length is cut in slices that overlap, so no string is passed over; extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, SEED = 200, 64
#: Stretches of one anchor that meet in one suffix array at most, and the bytes of one array.
HOT, ARRAY_BYTES = 2000, 1 << 20
#: Starts of a block in groups over HOT; starts of a text that are looked at at once.
EIGHT, PIECE = 8, 1 << 21
_POS = np.uint64((1 << 27) - 1)
_MULT = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_TABLE = common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _cache:
        _cache.clear()
        both = []
        for x in (_MULT, _INVERSE):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _cache[size] = tuple(both)
    return _cache[size]


class Rolling:
    """Hashes of any stretch of bytes from prefix sums."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return common.mix((self.sums[end] - self.sums[begin]) * self.down[begin])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return common.mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width + width, np.uint64(2**64 - 1))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def sliced(blob: bytes, length: int = LENGTH):
    """(offset, bytes) of a text in slices of at most PIECE starts; neighbours overlap by length - 1 bytes, so each string lies in one slice."""
    for at in range(0, max(1, len(blob) - length + 1), PIECE):
        yield at, blob[at : at + PIECE + length - 1]


def stretches(blobs: list[bytes], length: int = LENGTH, seed: int = SEED):
    """Arrays: text number, first start, number of starts less one, anchor hash, digest of the stretch from the first start to the last's end."""
    sizes = np.array([len(b) for b in blobs], np.int64)
    raw = np.frombuffer(b"".join(blobs), np.uint8)
    none = np.empty(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none
    rolling = Rolling(raw)
    hashes = rolling.every(seed)
    keys = (hashes & ~_POS) | (_POS - np.arange(len(hashes), dtype=np.uint64))
    anchor = (_POS - (sliding_min(keys, length - seed + 1) & _POS)).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    text = np.repeat(np.arange(len(blobs)), sizes)[: len(anchor)]
    starts = np.flatnonzero(np.arange(len(anchor)) + length <= begins[text + 1])
    if not len(starts):
        return none, none, none, none, none
    change = np.flatnonzero((anchor[starts][1:] != anchor[starts][:-1]) | (text[starts][1:] != text[starts][:-1])) + 1
    first, last = starts[np.concatenate([[0], change])], starts[np.concatenate([change - 1, [len(starts) - 1]])]
    place = anchor[first]
    digest = rolling.of(first, last + length) ^ common.mix(((place - first) * 1000 + last - first).astype(np.uint64))
    return text[first], first - begins[text[first]], last - first, hashes[place].view(np.int64), digest.view(np.int64)


def levels(raw: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(bytes, rank of each suffix by so many first bytes), from one byte to `length`, by prefix doubling; past the end counts as least."""
    out, have, rank = [(1, raw.astype(np.int64))], 1, raw.astype(np.int64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = padded[: len(raw)]
    while have < length:
        step = min(have, length - have)
        if have + step <= 8:  # up to eight bytes are their own rank
            for k in range(have, have + step):
                key = (key << np.uint64(8)) | padded[k : k + len(raw)]
            rank = key.view(np.int64)
        else:
            later = np.zeros(len(raw), np.uint64)
            if have <= 8:
                rank = _rank(key)
                out[-1] = (have, rank)
            later[: len(raw) - step] = rank[step:] + 1
            rank = _rank(rank.astype(np.uint64) * np.uint64(len(raw) + 2) + later)
        have += step
        out.append((have, rank))
    if have <= 8:
        out[-1] = (have, _rank(key))
    return out


def _rank(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    new = np.empty(len(key), np.int64)
    new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
    return new


def common_prefix(a: np.ndarray, b: np.ndarray, by: list[tuple[int, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b share, up to `most`: the highest levels first, each going on where the last one ended."""
    got, n = np.zeros(len(a), np.int64), len(by[0][1])
    for width, rank in reversed(by):
        i, j = a + got, b + got
        inside = (np.maximum(i, j) + width <= n) & (got < most)
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        got += np.where(inside & (rank[i] == rank[j]), width, 0)
    return np.minimum(got, most)


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place, the nearest one before it with a smaller value, or -1. Links jump over links, so a few rounds do."""
    link = np.arange(len(values)) - 1
    open_ = np.flatnonzero(link >= 0)
    while len(open_):
        open_ = open_[values[link[open_]] >= values[open_]]
        link[open_] = link[link[open_]]
        open_ = open_[link[open_] >= 0]
    return link


def longest_previous_factors(at: np.ndarray, most: np.ndarray, by: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """LPF of the positions `at` (ascending), capped at `most`: the longest match with an earlier one of them.

    In suffix order, the nearest smaller positions before and after a place hold its best earlier match.
    """
    order = np.argsort(by[-1][1][at], kind="stable")
    place = at[order]
    out = np.zeros(len(at), np.int64)
    for link in (smaller_before(place), len(place) - 1 - smaller_before(place[::-1])[::-1]):
        has = np.flatnonzero((link >= 0) & (link < len(place)))
        got = common_prefix(place[has], place[link[has]], by, most[order[has]])
        np.maximum.at(out, order[has], got)
    return out


def repeated_starts(contexts: list[bytes], starts: list[int], known: list[bool], length: int = LENGTH, keep_first: bool = False) -> list[np.ndarray]:
    """Of each context's first starts[i] suffixes, which share `length` bytes with another one of any context, or with a known repeated one.

    Longest previous factors tell those with an earlier copy. The first of equal strings has later ones only; it has their rank.
    keep_first: only those with an earlier copy; contexts come in their order.
    """
    sizes = np.array([len(c) for c in contexts])
    by = levels(np.frombuffer(b"".join(contexts), np.uint8), length)
    begin = np.cumsum(sizes) - sizes
    counts = np.array(starts)
    at = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    most = np.full(len(at), length)
    flags = longest_previous_factors(at, most, by) >= length
    if not keep_first:
        own = by[-1][1][at]
        flags |= np.isin(own, own[flags])
        flags |= np.repeat(np.array(known), counts)
    return np.split(flags, np.cumsum(counts)[:-1])


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


IDENTITY = ["tid", "size"]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"tid": F.xxhash64("text"), "size": F.octet_length("text").cast("long")})


def spans(rows: DataFrame, scratch: common.Scratch, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """rows: tid, size, text. Gives tid, size, s, e: stretches of repeated strings (they may overlap); keep_first: of those with an earlier copy."""

    def cut(stream):
        for batch in stream:
            blobs = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            tid, size = batch.column("tid").to_numpy(), batch.column("size").to_numpy()
            pieces = [(i, at, piece) for i, blob in enumerate(blobs) for at, piece in sliced(blob, length)]
            for begin, end in common.batches([x for _, _, x in pieces], 1 << 19):
                part = pieces[begin:end]
                of, offset = np.array([i for i, _, _ in part]), np.array([at for _, at, _ in part])
                text, first, more, anchor, digest = stretches([x for _, _, x in part], length)
                yield pa.RecordBatch.from_arrays([pa.array(tid[of[text]]), pa.array(size[of[text]]), pa.array((first + offset[text]).astype(np.int32)), pa.array(more.astype(np.int32)), pa.array(anchor), pa.array(digest)], ["tid", "size", "first", "more", "anchor", "digest"])

    found = scratch.table(rows.mapInArrow(cut, "tid long, size long, first int, more int, anchor long, digest long"), "stretches")
    # each step is written before the next, so that a join can split an anchor of very many stretches
    twice = scratch.table(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "twice")
    met = scratch.table(found.join(twice, "anchor", "left_semi"), "met")
    scratch.drop("stretches", "twice")
    kept = scratch.table(met.groupBy("anchor", "digest", "tid", "size", "first", "more").agg(F.count("*").alias("m")), "kept")
    scratch.drop("met")
    digests = kept.groupBy("anchor", "digest").agg(F.sum("m").alias("c"), F.min(F.struct("tid", "size", "first", "more")).alias("one"), F.count("*").alias("places"))
    digests = scratch.table(digests, "digests")
    if keep_first:  # rows of equal text are told apart by remove_repeats
        again = digests.where("places > 1").select("anchor", "digest", F.col("one.tid").alias("t"), F.col("one.size").alias("z"), F.col("one.first").alias("f"))
        whole = kept.join(again, ["anchor", "digest"]).where("tid <> t or size <> z or first <> f")
    else:
        whole = kept.join(digests.where("c > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi")
    whole = whole.select(*IDENTITY, F.col("first").alias("s"), (F.col("first") + F.col("more") + length).alias("e"))
    # anchors with several digests, one of them single: single ones are open, one of each repeated digest stands by as known
    several = digests.groupBy("anchor").agg(F.count("*").alias("digests"), F.min("c").alias("least")).where("digests > 1" if keep_first else "digests > 1 and least = 1")
    known = F.lit(False) if keep_first else F.col("c") > 1
    several = scratch.table(several.select("anchor", "digests"), "several")
    open_ = digests.join(several, "anchor").select("anchor", "digests", known.alias("known"), "one.*")
    open_ = scratch.table(open_, "open")
    n = open_.select(*IDENTITY).distinct().count()
    wanted = open_.select(*IDENTITY).distinct()
    texts = rows.join(F.broadcast(wanted) if n <= 500_000 else wanted, IDENTITY, "left_semi").groupBy(*IDENTITY).agg(F.first("text").alias("text"))
    per_text = open_.groupBy(*IDENTITY).agg(F.collect_list(F.struct("anchor", "digests", "known", "first", "more")).alias("cuts"))

    def contexts(stream):
        for batch in stream:
            out: list[list] = [[] for _ in range(8)]
            for tid, size, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("tid", "size", "text", "cuts")), strict=True):
                blob = text.encode("utf-8", "surrogatepass")
                for c in cuts:
                    row = (tid, size, c["anchor"], c["digests"], c["known"], c["first"], c["more"], blob[c["first"] : c["first"] + c["more"] + length])
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], ["tid", "size", "anchor", "digests", "known", "first", "more", "bytes"])

    pieces = texts.join(per_text, IDENTITY).mapInArrow(contexts, "tid long, size long, anchor long, digests long, known boolean, first int, more int, bytes binary")
    pieces = scratch.table(pieces, "pieces")

    def arrays(stream):
        names = ["tid", "size", "anchor", "known", "first", "more", "bytes"]

        def solve(group: list[tuple]):
            flags = repeated_starts([g[6] for g in group], [g[5] + 1 for g in group], [g[3] for g in group], length, keep_first)
            out = [(g[0], g[1], g[4] + a, g[4] + b - 1 + length) for g, f in zip(group, flags, strict=True) if not g[3] for a, b in runs_of(f)]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["tid", "size", "s", "e"])

        group, size, last = [], 0, None
        for batch in stream:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[2] != last and size >= ARRAY_BYTES:
                    yield solve(group)
                    group, size = [], 0
                group.append(row)
                size += len(row[6])
                last = row[2]
        if group:
            yield solve(group)

    def solved(groups: DataFrame) -> DataFrame:
        total = groups.agg(F.sum(F.length("bytes").cast("long"))).first()[0] or 0
        dealt = groups.repartition(common.parts(total, 8 << 20, 6), "anchor").sortWithinPartitions("anchor", "tid", "size", "first")
        return dealt.mapInArrow(arrays, "tid long, size long, s int, e int")

    edges = solved(pieces.where(F.col("digests") <= HOT))
    return whole.unionByName(edges).unionByName(crowded(pieces.where(F.col("digests") > HOT), scratch, length, keep_first, solved))


def crowded(pieces: DataFrame, scratch: common.Scratch, length: int, keep_first: bool, solved) -> DataFrame:
    """Spans (tid, size, s, e) of anchors with too many stretches for one array: they are split by the bytes around the anchor.

    Strings are taken EIGHT starts at a time, aligned by their distance from the anchor. All of a block share a
    core; equal strings lie in blocks of equal cores, so cores make smaller groups, each for one array (solved). Where a
    core is found once, none of its strings is repeated. Where very many different blocks share one core, strings
    are counted by fingerprints with partial sums, so that no task gathers them: whole blocks that repeat first,
    then the strings of what is left, beside one of each repeated block.
    """

    def digests(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, flat: Rolling, back: Rolling) -> tuple[np.ndarray, np.ndarray]:
        return flat.of(begin, end).view(np.int64), back.of(len(raw) - end, len(raw) - begin).view(np.int64)

    def both(blob: bytes) -> tuple[np.ndarray, Rolling, Rolling]:
        raw = np.frombuffer(blob, np.uint8)
        return raw, Rolling(raw), Rolling(255 - raw[::-1])

    def cut(stream):
        names = ("tid", "size", "anchor", "known", "first", "more", "bytes")
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in stream:
            out: list[list] = [[] for _ in types]
            for tid, size, anchor, known, first, more, blob in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                raw, flat, back = both(blob)
                place = int(np.flatnonzero(flat.every(SEED)[: length - SEED + 1].view(np.int64) == anchor)[-1])
                starts = np.arange(more + 1)
                block = (place - starts) // EIGHT
                low = np.maximum(0, place - np.unique(block) * EIGHT - EIGHT + 1)
                high = np.minimum(more, place - np.unique(block) * EIGHT)
                # the core begins where the block's last possible string begins and ends where its first one ends
                core = place - np.unique(block) * EIGHT
                c, d = digests(raw, core, core - EIGHT + 1 + length, flat, back)
                u, v = digests(raw, low, high + length, flat, back)
                whole = high - low == EIGHT - 1
                for i in range(len(core)):
                    row = (tid, size, 1 + known, c[i], d[i], u[i] if whole[i] else None, v[i] if whole[i] else None, first + low[i], high[i] - low[i], blob[low[i] : high[i] + length])
                    for o, x in zip(out, row, strict=True):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], ["tid", "size", "weight", "c", "d", "u", "v", "first", "more", "bytes"])

    def prints(stream):
        names = ("tid", "size", "weight", "first", "more", "bytes")
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        for batch in stream:
            out: list[list] = [[] for _ in types]
            for tid, size, weight, first, more, blob in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                raw, flat, back = both(blob)
                starts = np.arange(more + 1)
                p, q = digests(raw, starts, starts + length, flat, back)
                for o, x in zip(out, (p, q, np.full(more + 1, weight), np.full(more + 1, tid), np.full(more + 1, size), first + starts), strict=True):
                    o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), t) for o, t in zip(out, types, strict=True)], ["p", "q", "weight", "tid", "size", "s"])

    blocks = scratch.table(pieces.mapInArrow(cut, "tid long, size long, weight long, c long, d long, u long, v long, first int, more int, bytes binary"), "blocks")
    cores = scratch.table(blocks.groupBy("c", "d").agg(F.sum("weight").alias("n"), F.count("*").alias("blocks")).where("n > 1"), "cores")
    alive = scratch.table(blocks.join(cores.select("c", "d", "blocks"), ["c", "d"]), "alive")
    small = solved(alive.where(F.col("blocks") <= HOT).select("tid", "size", F.col("c").alias("anchor"), (F.col("weight") > 1).alias("known"), "first", "more", "bytes"))
    alive = alive.where(F.col("blocks") > HOT).drop("blocks")
    texts = "p long, q long, weight long, tid long, size long, s int"
    if keep_first:
        printed = scratch.table(alive.select("tid", "size", "weight", "first", "more", "bytes").mapInArrow(prints, texts), "prints")
        least = printed.groupBy("p", "q").agg(F.min(F.struct("tid", "size", "s")).alias("one"), F.count("*").alias("n")).where("n > 1").select("p", "q", F.col("one.tid").alias("t"), F.col("one.size").alias("z"), F.col("one.s").alias("f"))
        later = printed.join(scratch.table(least, "least"), ["p", "q"]).where("tid <> t or size <> z or s <> f")
        return small.unionByName(later.select(*IDENTITY, "s", (F.col("s") + length).alias("e")))
    united = alive.where("u is not null").groupBy("u", "v").agg(F.sum("weight").alias("n"), F.min(F.struct("tid", "size", "first", "more", "bytes")).alias("one")).where("n > 1")
    united = scratch.table(united.select("u", "v", "one.*"), "united")
    done = alive.join(united.select("u", "v"), ["u", "v"], "left_semi")
    left = alive.join(united.select("u", "v"), ["u", "v"], "left_anti").select("tid", "size", "weight", "first", "more", "bytes")
    known = united.select("tid", "size", F.lit(2).cast("long").alias("weight"), "first", "more", "bytes")
    printed = left.unionByName(known).mapInArrow(prints, texts)
    again = printed.groupBy("p", "q").agg(F.sum("weight").alias("n")).where("n > 1").select("p", "q")
    single = printed.where("weight = 1").join(again, ["p", "q"], "left_semi").select(*IDENTITY, "s", (F.col("s") + length).alias("e"))
    return small.unionByName(single).unionByName(done.where("weight = 1").select(*IDENTITY, F.col("first").alias("s"), (F.col("first") + F.col("more") + length).alias("e")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """doc_id, text (of null: empty), n_bytes, kept (the bytes left), removed (array of maximal runs s, e).

    keep_first: one copy of every string stays: that of the first text in a fixed order (by hash), at its first place;
    of rows of equal text, that of the smallest doc_id.
    """
    spark = docs.sparkSession
    common.tidy(spark)
    scratch = common.Scratch(spark, "substrings")
    rows = _texts(docs)
    long = F.col("size") >= length
    found = spans(rows.where(long).select(*IDENTITY, "text"), scratch, length, keep_first).groupBy(*IDENTITY).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    found = scratch.table(found, "spans")
    none = F.lit(None).cast("array<struct<s:int,e:int>>")
    if keep_first:
        rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        least = scratch.table(rows.where(long).groupBy(*IDENTITY).agg(F.min(F.struct("doc_id", "row")).alias("one"), F.count("*").alias("n")).where("n > 1").select(*IDENTITY, F.col("one.row").alias("one")), "least")
        joined = rows.where(long).join(found, IDENTITY, "left").join(least, IDENTITY, "left")
        again = F.col("one").isNotNull() & (F.col("row") != F.col("one"))
        joined = joined.withColumn("spans", F.when(again, F.array(F.struct(F.lit(0).alias("s"), F.col("size").cast("int").alias("e")))).otherwise(F.col("spans")))
    else:
        joined = rows.where(long).join(found, IDENTITY, "left")
    # texts under `length` have no such strings and stay out of the join, where empty ones would all meet
    joined = joined.select("doc_id", "text", "spans").unionByName(rows.where(~long).select("doc_id", "text", none.alias("spans")))

    def apply(stream):
        for batch in stream:
            n, kept, removed = [], [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                blob = text.encode("utf-8", "surrogatepass")
                n.append(len(blob))
                runs: list[list[int]] = []
                for s, e in sorted((x["s"], x["e"]) for x in own or ()):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                removed.append([{"s": s, "e": e} for s, e in runs])
                at, pieces = 0, []
                for s, e in runs:
                    pieces.append(blob[at:s])
                    at = e
                kept.append(b"".join([*pieces, blob[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], ["doc_id", "n_bytes", "kept", "removed"])

    return joined.mapInArrow(apply, "doc_id long, n_bytes long, kept binary, removed array<struct<s:int,e:int>>")


def report(cleaned: DataFrame) -> DataFrame:
    gone = F.expr("aggregate(removed, 0L, (a, x) -> a + x.e - x.s)")
    return cleaned.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


