"""Near-duplicates by HyperMinHash sketches, banding, collision-corrected estimates and exact verification.

1. Each text's set of word shingles gives a signature of the set and a HyperMinHash of `bands * ROWS` buckets: one
   hash deals each shingle to a bucket, whose register keeps the least rest of a hash as leading-zero count and
   mantissa bits. Buckets that stay empty (short sets) are filled by further rounds with another hash each, so
   that every register agrees with the chance of the Jaccard similarity. Equal sets collapse to one representative.
2. Bands of ROWS registers bucket the representatives. A pair at the threshold shares no bucket with
   probability (1 - t**ROWS)**bands, at most MISS.
3. First every representative is compared with its best-estimated bucket centres; confirmed links are merged.
   Then, in each bucket that still holds several components, sketches of every member outside the bucket's main
   component are compared with those of all members of other components (collision-corrected estimate,
   threshold less MARGIN); where one is likely, full sets decide against its whole neighbourhood, in blocks. So no link between components is passed over, and pairs within one
   component, however large, are never listed. Hot buckets and blocks are split by salt.
4. Components by alternating large and small stars; every round is written to the shared folder.

Defined results: texts without words (null too) have an empty set, link with nothing, and are kept; rows with
a null doc_id take no part (null component, kept); rows of one doc_id are one node; a text of any length is one set,
held whole in one task; equal texts are one node of the search, so ties between them cannot arise; extra columns,
whatever their names, are ignored by groups and kept by clean; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROWS, MISS, MARGIN, MANTISSA = 5, 1e-6, 0.15, 10
#: Members of a block, members of a bucket's sub-block, comparisons of one block in one task, ids that are broadcast at most.
BLOCK, SUB, SALT, BROADCAST_ROWS = 256, 512, 400, 500_000
#: Best-estimated centres that each representative is checked against at first.
TRIED = 3


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def shingle_sets(texts: list, width: int):
    """Sorted distinct 64-bit hashes of the `width`-word shingles of each text; fewer words are one shingle."""
    hashes, bounds = common.word_hashes(texts)
    n = max(0, len(hashes) - width + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = common.mix(mixed ^ hashes[k : n + k]) + np.uint64(k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(mixed[a : b - width + 1])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for h in hashes[a:b]:
                one = common.mix(one ^ h) + np.uint64(1)
            yield one
        else:
            yield np.empty(0, np.uint64)


_REST = np.uint64((1 << 48) - 1)


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A row of m registers for each set that is not empty: 6 bits of leading zeros and MANTISSA bits that follow the leading one.

    Rounds double while some bucket is empty; the earliest round that reaches a bucket fills it.
    """
    best = np.full(len(sets) * m, np.uint64(2**64 - 1))
    open_, turn, at_once = np.arange(len(sets)), 0, 1
    while len(open_):
        owner = np.repeat(open_, [len(sets[i]) for i in open_.tolist()])
        flat = np.concatenate([sets[i] for i in open_.tolist()])
        for number in range(turn, turn + at_once):
            h = common.mix(flat ^ np.uint64((number + 1) * 0x9E3779B97F4A7C15 % 2**64))
            place = owner * m + (((h >> np.uint64(48)) * np.uint64(m)) >> np.uint64(16)).astype(np.int64)
            np.minimum.at(best, place, (h & _REST) | np.uint64(number << 48))
        turn, at_once = turn + at_once, min(turn + at_once, 64)
        empty = (best == np.uint64(2**64 - 1)).reshape(-1, m).any(1)
        open_ = open_[empty[open_]]
    least = (best & _REST).astype(np.float64)
    mantissa, exponent = np.frexp(least)
    bits = np.clip(((mantissa - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64), 0, (1 << MANTISSA) - 1)
    return ((48 - exponent) * (1 << MANTISSA) + bits).astype(np.uint16).reshape(-1, m)


def shares(n: np.ndarray, m: int) -> np.ndarray:
    """For sets of these sizes, the chance of each number of leading zeros in a register; a row for each set, computed once for each size."""
    sizes, of = np.unique(n, return_inverse=True)
    edges, each = 0.5 ** np.arange(50), np.maximum(sizes[:, None] / m, 1.0)
    return ((1 - edges[1:]) ** each - (1 - edges[:-1]) ** each)[of]


def corrected(agree: np.ndarray, by_zeros: np.ndarray) -> np.ndarray:
    """Jaccard estimates from the share of agreeing registers, the accidental agreement taken out: equal zeros (by_zeros), then equal mantissas."""
    by_chance = by_zeros / (1 << MANTISSA)
    return (agree - by_chance) / (1 - by_chance)


def sketch(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, signature (of the set), registers."""

    def run(stream):
        for batch in stream:
            texts, n, signature, regs = batch.column("text").to_pylist(), [], [], []
            for begin, end in common.batches(texts):
                sets = list(shingle_sets(texts[begin:end], width))
                rows = iter(registers([s for s in sets if len(s)], bands * ROWS))
                for s in sets:
                    n.append(len(s))
                    turned = common.mix(s ^ np.uint64(0xA0761D6478BD642F))
                    signature.append(np.array([turned.sum(dtype=np.uint64), (turned * common.mix(s)).sum(dtype=np.uint64)], np.uint64).tobytes())
                    regs.append(next(rows).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(signature, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "signature", "registers"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, signature binary, registers binary")


def band_rows(reps: DataFrame, bands: int) -> DataFrame:
    def run(stream):
        for batch in stream:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(batch.num_rows, bands, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), regs.shape[:2])
            for k in range(ROWS):
                key = common.mix(key ^ (regs[:, :, k] + np.uint64(k << 32)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column("rep").to_numpy(), bands))], ["band", "rep"])

    return reps.mapInArrow(run, "band long, rep long")


def components(edges: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """(node, component) of every node of the edges (u, v): stars are redrawn until nothing changes."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, was, turn = scratch.table(edges, f"{name}0"), None, 0
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == was:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        was, turn = now, turn + 1
        edges = scratch.table(small.where("u <> v").distinct(), f"{name}{turn}")


def _sets(texts: pd.Series, width: int) -> list[np.ndarray]:
    return list(shingle_sets(texts.tolist(), width))


def confirm(wanted: DataFrame, blocks: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v): each wanted (x, block) against the block's (rep, component, block), on full sets; one for each x and component."""
    load = wanted.groupBy("block").agg(F.ceil(F.count("*") / F.lit(SALT)).cast("int").alias("salts"))
    left = wanted.join(load, "block").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts"))).join(texts.withColumnRenamed("rep", "x"), "x").select("block", "salt", "x", "text")
    right = blocks.join(load, "block").join(texts, "rep").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))).select(F.col("block").alias("b"), F.col("salt").alias("s"), F.col("rep").alias("y"), "component", F.col("text").alias("body"))

    def check(xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(xs) and len(ys):
            own = _sets(ys["body"], width)
            n, ids, component = np.array([len(s) for s in own]), ys["y"].to_numpy(), ys["component"].to_numpy()
            flat = np.concatenate(own)
            order = np.argsort(flat, kind="stable")
            flat, of = flat[order], np.repeat(np.arange(len(own)), n)[order]
            for x, s in zip(xs["x"].tolist(), _sets(xs["text"], width), strict=True):
                low, high = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                many = high - low
                at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                common_n = np.bincount(of[at], minlength=len(own))
                good = np.flatnonzero((100 * common_n >= percent * (n + len(s) - common_n)) & (ids != x))
                found += [(x, int(ids[good[i]])) for i in np.unique(component[good], return_index=True)[1]]
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return left.groupBy("block", "salt").cogroup(right.groupBy("b", "s")).applyInPandas(check, "u long, v long")


def _only(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The documents of these ids (doc_id): by broadcast up to BROADCAST_ROWS ids, by a shuffled semi join beyond."""
    return docs.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "doc_id", "left_semi")


def groups(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document: links where 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    common.tidy(spark)
    scratch, threshold = common.Scratch(spark, "near"), percent / 100
    bands = bands_for(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = scratch.table(sketch(docs, width, bands), "sketches")
    real = sketches.where("n_shingles > 0 and doc_id is not null")
    # written, so that the join below can split a key of very many copies
    same = scratch.table(real.groupBy("signature", "n_shingles").agg(F.min("doc_id").alias("rep")), "same")
    members = scratch.table(real.select("doc_id", "signature", "n_shingles").join(same, ["signature", "n_shingles"]).select("doc_id", "rep", "signature"), "members")
    reps = members.where("doc_id = rep").select("rep", "signature").distinct()
    reps = reps.join(real.select(F.col("doc_id").alias("rep"), "signature", F.col("n_shingles").alias("n"), "registers"), ["rep", "signature"]).dropDuplicates(["rep", "signature"]).select("rep", "n", "registers")
    reps = scratch.table(reps, "reps")
    bandrows = scratch.table(band_rows(reps, bands).distinct(), "bands", "none")
    # a bucket's centres: the member of the least hash, the same one in all buckets that hold it, and in every other band one of its own
    size = bandrows.groupBy("band").agg(F.count("*").alias("size"), F.min_by("rep", F.xxhash64("rep")).alias("centre"), F.min_by("rep", F.xxhash64("rep", "band")).alias("own")).where("size > 1")
    shared = scratch.table(bandrows.join(size, "band"), "shared")

    def rated(stream):
        for batch in stream:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("ra", "rb"))
                of = [shares(batch.column(c).to_numpy(), a.shape[1]) for c in ("na", "nb")]
                e = corrected((a == b).mean(1), (of[0] * of[1]).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(e)], ["x", "y", "e"])

    centres = F.explode(F.array_distinct(F.when(F.col("band") % 2 == 0, F.array("centre", "own")).otherwise(F.array("centre"))))
    pairs = shared.select(F.col("rep").alias("x"), centres.alias("y")).where("x <> y").distinct()
    side = lambda x, r, n: reps.select(F.col("rep").alias(x), F.col("registers").alias(r), F.col("n").alias(n))
    pairs = pairs.join(side("x", "ra", "na"), "x").join(side("y", "rb", "nb"), "y").mapInArrow(rated, "x long, y long, e double").where(F.col("e") >= threshold - MARGIN)
    likely = F.slice(F.sort_array(F.collect_list(F.struct("e", "y")), asc=False), 1, TRIED)  # at most 1.5 * bands centres in a list
    best = scratch.table(pairs.groupBy("x").agg(likely.alias("ys")).select("x", F.explode("ys.y").alias("y")), "best")

    needed = scratch.table(shared.select(F.col("rep").alias("doc_id")).distinct(), "needed")
    texts = scratch.table(_only(docs, needed, needed.count()).select(F.col("doc_id").alias("rep"), "text").distinct(), "texts")
    centres = best.select(F.col("y").alias("rep")).distinct().withColumns({"block": F.xxhash64("rep"), "component": F.col("rep")})
    links = scratch.table(confirm(best.select("x", F.xxhash64("y").alias("block")), centres, texts, width, percent), "links0")

    # what is still apart: members of a bucket in several components
    first = components(links, scratch, "first")
    hints = shared.groupBy("rep").agg(F.min_by("centre", F.xxhash64("centre")).alias("hint"))
    crowd = hints.groupBy("hint").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("blocks"))
    placed = hints.join(crowd, "hint").join(first.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), "hint", "blocks", F.xxhash64("hint", F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("block"))
    placed = scratch.table(placed, "placed")
    rows = shared.select("band", "rep", "size").join(placed, "rep")
    per = rows.groupBy("band", "component").agg(F.count("*").alias("k")).groupBy("band").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("band", "main")
    rows = rows.join(per, "band").withColumn("subs", F.ceil(F.col("size") / F.lit(SUB)))
    rows = scratch.table(rows.withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs"))).select("band", "rep", "component", "main", "hint", "subs", "sub"), "rows")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))
    # a large bucket is cut on both sides: a task gets one piece of each, so none holds a whole bucket
    ys = rows.withColumn("other", every).select("band", F.col("other").alias("left"), F.col("sub").alias("right"), F.lit(0).alias("side"), "rep", "component", "hint")
    xs = rows.where("component <> main").withColumn("other", every).select("band", F.col("sub").alias("left"), F.col("other").alias("right"), F.lit(1).alias("side"), "rep", "component", "hint")

    def candidates(stream):
        names = ("side", "rep", "component", "hint", "n")
        for table, starts in common.whole_groups(stream, ["band", "left", "right"]):
            side, rep, comp, hint, n = (table.column(c).to_numpy() for c in names)
            regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(len(rep), -1)
            by, m, found = shares(n, regs.shape[1]), regs.shape[1], set()
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                xs_from = a + int(np.searchsorted(side[a:b], 1))
                for x in range(xs_from, b):
                    k = n[x]
                    apart = a + np.flatnonzero((comp[a:xs_from] != comp[x]) & (100 * np.minimum(n[a:xs_from], k) >= percent * np.maximum(n[a:xs_from], k)))
                    if len(apart):
                        e = corrected(np.count_nonzero(regs[apart] == regs[x], axis=1) / m, by[apart] @ by[x])
                        found.update((int(rep[x]), h) for h in hint[apart[e >= threshold - MARGIN]].tolist())
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "hint"])

    # dealt by the number of rows, not by bytes: comparing, not reading, is the work
    least, key = int(spark.conf.get("spark.sql.shuffle.partitions")), ["band", "left", "right"]
    count = common.parts(rows.where("component <> main").agg(F.sum("subs")).first()[0] or 0, 2000, least)
    both = ys.unionByName(xs).join(reps, "rep").repartition(count, *key).sortWithinPartitions(*key, "side")
    wanted = both.select(*key, "side", "rep", "component", "hint", "n", "registers").mapInArrow(candidates, "x long, hint long").distinct()
    # each goes to all blocks of a neighbourhood that holds a likely partner
    of = placed.select("hint", "block").distinct()
    wanted = scratch.table(wanted.join(of, "hint").select("x", "block").distinct(), "wanted")
    blocks = placed.select("rep", "component", "block").join(wanted.select("block").distinct(), "block", "left_semi")
    more = scratch.table(confirm(wanted, blocks, texts, width, percent), "links1")
    # first components stand for the first links: stars are fewer than links
    stars = first.select(F.col("node").alias("u"), F.col("component").alias("v"))
    # rows of one doc_id with several sets are one node: its sets' representatives hang together
    joint = members.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    several = members.groupBy("doc_id").agg(F.countDistinct("rep").alias("sets")).where("sets > 1").select(F.col("doc_id").alias("u"))
    last = components(stars.unionByName(more).unionByName(joint.join(several, "u", "left_semi")), scratch, "last")
    named = members.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(last.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    result = sketches.select("doc_id", "n_shingles").join(named, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select("doc_id", "n_shingles", "component_id", "kept")


def clean(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: that of the smallest doc_id, once (the text of the least hash, where texts differ); columns as they came."""
    spark = docs.sparkSession
    gone = common.Scratch(spark, "gone")
    found = gone.table(groups(docs, width, percent).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_and("kept").alias("kept")), "groups")
    dropped = found.where("not kept").select("doc_id")
    n = dropped.count()
    kept = docs.join(F.broadcast(dropped) if n <= BROADCAST_ROWS else dropped, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
    if found.where("rows > 1 and kept").limit(1).count():
        whole = kept.select(F.struct(*(kept[f"`{c}`"] for c in docs.columns)).alias("doc"))  # no column can clash
        once = whole.where("doc.doc_id is not null").groupBy(F.col("doc.doc_id")).agg(F.min_by("doc", F.xxhash64("doc.text")).alias("doc")).select("doc")
        kept = once.unionByName(whole.where("doc.doc_id is null")).select("doc.*")
    return kept
