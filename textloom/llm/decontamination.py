"""Benchmark decontamination by spaced-seed hashing.

A document is contaminated where a window of WINDOW words equals a benchmark window in all but at most
MISMATCH of its positions (items shorter than WINDOW, down to SHORTEST words, are one window of their own
length; at least four fifths of the words must agree). Seeds are fixed masks that ignore some positions: the
window is cut into k + 2 blocks and every pair of blocks is a mask, so k substitutions always leave one mask
whole, and no such overlap is missed. Test hashes are sorted arrays, joined with the hashes of every
document position by lookup; a hit is verified word by word, so the result does not depend on the seeds.

The benchmark's windows are broadcast in slices of SLICE windows (about 120 bytes each); a larger
benchmark takes more passes over the documents, never a larger broadcast. One map-side pass, no shuffle; with
several slices, their hits are dealt by document, counted once and their stretches merged, so that figures do not
depend on where slices end.

Defined results: null or empty texts and items match nothing; items with a null id are searched like others, and
their hits count, but item_ids leaves the null out; items under SHORTEST words match nothing;
repeated items and documents are reported each; extra columns are ignored; an empty benchmark finds nothing.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW, SHORTEST, SLICE = 13, 5, 200_000
SCHEMA = "doc_id long, n_hits long, n_overlap_words long, item_ids array<long>"
#: Of a slice: each hit's first word in the document, its length and its window's key.
HITS = "doc_id long, at array<long>, words array<long>, window array<long>, item_ids array<long>"


def allowed(length: int) -> int:
    """Substitutions that leave at least four fifths of the words."""
    return length // 5


def masks(length: int) -> list[list[int]]:
    """Position lists, one of which any `allowed(length)` substitutions leave whole."""
    blocks = np.array_split(np.arange(length), allowed(length) + 2)
    return [[int(p) for b in pair for p in b] for pair in combinations(blocks, 2)]


def seed_hashes(words: np.ndarray, length: int, mask: list[int], number: int) -> np.ndarray:
    """The hash of the mask's words at every window start."""
    n = len(words) - length + 1
    out = np.full(n, np.uint64(number * 0x9E3779B97F4A7C15 % 2**64))
    for k, p in enumerate(mask):
        out = (out ^ words[p : p + n]) * np.uint64((0xD6E8FEB86659FD93 + 2 * k * 0x2545F4914F6CDD1D) % 2**64 | 1)
        out ^= out >> np.uint64(32)
    return out


class Index:
    """Benchmark windows of one length: their word hashes, their items, and for each mask the sorted seed hashes."""

    def __init__(self, windows: np.ndarray, items: list[list[int]]):
        self.windows, self.items, self.length = windows, items, windows.shape[1]
        self.keys = seed_hashes(windows.T, self.length, list(range(self.length)), self.length)[0].view(np.int64)
        self.seeds = []
        for number, mask in enumerate(masks(self.length)):
            hashes = np.array([seed_hashes(w, self.length, mask, number)[0] for w in windows], np.uint64)
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[hashes & np.uint64((1 << 20) - 1)] = True
            self.seeds.append((number, mask, hashes[order], order, bits))

    def matches(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Verified (position, window) pairs, each once."""
        none = np.empty(0, np.int64)
        if len(words) < self.length:
            return none, none
        found = []
        for number, mask, hashes, order, bits in self.seeds:
            h = seed_hashes(words, self.length, mask, number)
            at = np.flatnonzero(bits[h & np.uint64((1 << 20) - 1)])
            low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            n = high - low
            at = np.repeat(at, n)
            which = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            found.append(at * len(self.windows) + which)
        pairs = np.unique(np.concatenate(found))
        at, which = pairs // len(self.windows), pairs % len(self.windows)
        same = np.zeros(len(at), np.int64)
        for p in range(self.length):
            same += words[at + p] == self.windows[which, p]
        good = same >= self.length - allowed(self.length)
        return at[good], which[good]


def indexes(rows: list[tuple[int | None, str]]) -> list[Index]:
    """rows: item_id, text. Equal windows are kept once, with all their items that have an id."""
    by: dict[int, dict[bytes, set[int]]] = {}
    hashes, bounds = common.word_hashes([t for _, t in rows])
    for (item, _), a, b in zip(rows, bounds[:-1], bounds[1:], strict=True):
        length = min(WINDOW, int(b - a))
        if length >= SHORTEST:
            for i in range(a, b - length + 1):
                by.setdefault(length, {}).setdefault(hashes[i : i + length].tobytes(), set()).update([] if item is None else [item])
    return [Index(np.frombuffer(b"".join(w), np.uint64).reshape(-1, n), [sorted(x) for x in w.values()]) for n, w in sorted(by.items())]


def scan(stream, index: list[Index]):
    """Each document's figures (SCHEMA)."""
    for batch in stream:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        out: list[list] = [[], [], [], []]
        for begin, end in common.batches(texts):
            hashes, bounds = common.word_hashes(texts[begin:end])
            hits = np.zeros(end - begin, np.int64)
            covered = np.zeros(len(hashes) + 1, np.int64)
            items: list[set[int]] = [set() for _ in range(begin, end)]
            doc_of = np.repeat(np.arange(end - begin), np.diff(bounds))
            for x in index:
                at, which = x.matches(hashes)
                inside = (doc_of[at] == doc_of[at + x.length - 1]) if len(at) else np.empty(0, bool)
                at, which = at[inside], which[inside]
                np.add.at(hits, doc_of[at], 1)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + x.length, -1)
                for d, w in zip(doc_of[at].tolist(), which.tolist(), strict=True):
                    items[d].update(x.items[w])
            total = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
            out[0] += ids[begin:end]
            out[1] += hits.tolist()
            out[2] += (total[bounds[1:]] - total[bounds[:-1]]).tolist()
            out[3] += [sorted(s) for s in items]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["doc_id", "n_hits", "n_overlap_words", "item_ids"])


def scan_hits(stream, index: list[Index]):
    """The hits themselves (HITS) of the documents that have any."""
    for batch in stream:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        out: list[list] = [[], [], [], [], []]
        for begin, end in common.batches(texts):
            hashes, bounds = common.word_hashes(texts[begin:end])
            doc_of = np.repeat(np.arange(end - begin), np.diff(bounds))
            found: list[tuple] = [(np.empty(0, np.int64),) * 4]
            items: dict[int, set[int]] = {}
            for x in index:
                at, which = x.matches(hashes)
                inside = (doc_of[at] == doc_of[at + x.length - 1]) if len(at) else np.empty(0, bool)
                at, which = at[inside], which[inside]
                found.append((doc_of[at], at - bounds[doc_of[at]], np.full(len(at), x.length), x.keys[which]))
                for d, w in zip(doc_of[at].tolist(), which.tolist(), strict=True):
                    items.setdefault(d, set()).update(x.items[w])
            own, *values = (np.concatenate(v) for v in zip(*found, strict=True))
            order = np.argsort(own, kind="stable")
            docs, starts = np.unique(own[order], return_index=True)
            out[0] += [ids[begin + d] for d in docs.tolist()]
            for k, v in enumerate(values):
                out[k + 1] += np.split(v[order], starts[1:]) if len(docs) else []
            out[4] += [sorted(items[d]) for d in docs.tolist()]
        types = (pa.int64(), *[pa.list_(pa.int64())] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["doc_id", "at", "words", "window", "item_ids"])


def _summed(hits: DataFrame) -> DataFrame:
    """SCHEMA from the hits of several slices: a window at a place counts once, and stretches that share words are merged."""
    each = hits.selectExpr("doc_id", "inline(arrays_zip(at, words, window))").dropDuplicates(["doc_id", "at", "window"])
    reached = F.max(F.col("at") + F.col("words")).over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("at") + F.col("words") - F.greatest("at", F.coalesce(reached, "at")))
    figures = each.withColumn("new", new).groupBy("doc_id").agg(F.count("*").alias("n_hits"), F.sum("new").alias("n_overlap_words"))
    items = hits.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return figures.join(items, "doc_id")


def _slices(benchmark: DataFrame):
    """Benchmark rows in runs of at most SLICE words' worth of windows; the driver holds one run at a time."""
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        n = len(r[1].split()) + 1
        if rows and size + n > SLICE:
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    yield rows


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_hits (verified window pairs), n_overlap_words, item_ids, contaminated, kept of each document."""
    spark = docs.sparkSession
    common.tidy(spark)
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    slices = _slices(benchmark)
    first = spark.sparkContext.broadcast(indexes(next(slices)))
    result = docs.mapInArrow(lambda stream: scan(stream, first.value), SCHEMA)
    for number, rows in enumerate(slices):
        if not number:
            scratch = common.Scratch(spark, "overlaps")
            docs = scratch.table(docs.withColumn("_row", F.monotonically_increasing_id()), "docs")
            run = docs.selectExpr("_row doc_id", "text")
            hits = scratch.table(run.mapInArrow(lambda stream: scan_hits(stream, first.value), HITS), "hits0")
        shared = spark.sparkContext.broadcast(indexes(rows))
        more = run.mapInArrow(lambda stream, shared=shared: scan_hits(stream, shared.value), HITS)
        hits = hits.unionByName(scratch.table(more, f"hits{number + 1}"))
    if "_row" in docs.columns:
        summed = _summed(hits)
        none = F.expr("cast(array() as array<bigint>)")
        result = docs.select("_row", "doc_id").join(summed.withColumnRenamed("doc_id", "_row"), "_row", "left").select("doc_id", F.coalesce("n_hits", F.lit(0).cast("long")).alias("n_hits"), F.coalesce("n_overlap_words", F.lit(0).cast("long")).alias("n_overlap_words"), F.coalesce("item_ids", none).alias("item_ids"))
    flag = F.col("n_hits") > 0
    return result.withColumns({"contaminated": flag, "kept": ~flag})


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a contaminated window; columns as they came. A slice of the benchmark is one more filter."""
    spark = docs.sparkSession
    common.tidy(spark)
    names, schema = docs.columns, docs.schema
    for rows in _slices(benchmark):
        shared = spark.sparkContext.broadcast(indexes(rows))

        def keep(stream, shared=shared):
            for batch in stream:
                ids = pa.array(range(batch.num_rows), pa.int64())
                flags = next(scan([pa.RecordBatch.from_arrays([ids, batch.column(names.index("text"))], ["doc_id", "text"])], shared.value))
                yield batch.filter(pa.array([n == 0 for n in flags.column("n_hits").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, schema)
    return docs
