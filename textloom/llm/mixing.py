"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are laid out in a fixed pseudo-random order and cut into blocks of equally many
words. Slots are points of the golden-ratio sequence, mapped through the sources' cumulative shares; slots
are ranked within their source, and rank r takes the source's block r, going round once more after the last.
A source's slots end at its target, so no word is taken more than `cap` times (rounded up).

Nothing is collected but one row for each source (MOST_SOURCES at most). Layout: prefix sums within
ranges of about RANGE_ROWS documents, then over ranges, so a hot source or doc_id spreads over many tasks.
Slots: ranks within chunks of CHUNK points, plus the chunks' prefix counts.

Defined results: null text has size 0 and takes nothing; a null source is a source of its own, last; rows of equal or
null doc_id are laid out one after the other, smaller sizes first; a text of any length lies across as many
blocks as it fills; an empty table gives an empty mix; extra columns, whatever their names, are ignored by
`taken` and kept by `mixed`; over MOST_SOURCES sources are an error.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, CAP = (5, 2, 1), Fraction(3, 2), 2
BLOCK, CHUNK, RANGE_ROWS, MOST_SOURCES = 256, 1 << 16, 100_000, 1_000_000
#: Rows of small sums (about 30 bytes) that are broadcast at most.
BROADCAST_ROWS = 200_000
#: 2**64 divided by the golden ratio, made odd; its multiples modulo 2**64 are the points.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP) -> list[Fraction]:
    """Exact targets of the sources in their order: proportional to weight, stopped at cap times the size, the excess reshared."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left, total, out = share * sum(sizes), sum(weight), [Fraction(0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: Fraction(cap * sizes[i], weight[i])):
        level = left / total
        out[i] = min(Fraction(cap * sizes[i]), level * weight[i])
        left -= out[i]
        total -= weight[i]
    return out


def sized(docs: DataFrame) -> DataFrame:
    """_doc (all columns, so that none can clash), _size in words, _row: a row number that is kept once written."""
    words = F.regexp_count(F.coalesce(F.col("_doc.text").cast("string"), F.lit("")), F.lit(common.WORD)).cast("long")
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_doc")).select("_doc", words.alias("_size"), F.monotonically_increasing_id().alias("_row"))


def laid_out(keyed: DataFrame, scratch: common.Scratch, count: int) -> DataFrame:
    """keyed: _row, doc_id, _size, _no, _key. Gives _part and _end beside: a range of the layout, and the words of the source up to this row in it.

    Ranges end anywhere, also among rows of one doc_id; equal rows stand together, so that reruns agree.
    """
    order = ["_no", "_key", "doc_id", "_size", "_row"]
    schema = "_row long, doc_id long, _size long, _no int, _part int, _end long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(stream):
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in stream:
            if not batch.num_rows:
                continue
            no, ends = batch.column("_no").to_numpy(), np.cumsum(batch.column("_size").to_numpy())
            at = at if no[0] == last else 0
            first = np.concatenate([[0], np.flatnonzero(no[1:] != no[:-1]) + 1])
            before = np.concatenate([[-at], ends[first[1:] - 1]])
            ends = ends - np.repeat(before, np.diff([*first, len(no)]))
            last, at = no[-1], int(ends[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), pa.array(np.full(len(no), part, np.int32)), pa.array(ends)], names)

    ordered = keyed.select("_row", "doc_id", "_size", "_no", "_key").repartitionByRange(common.parts(count, RANGE_ROWS, 4), *order).sortWithinPartitions(*order)
    return scratch.table(ordered.mapInArrow(run, schema), "laid")


def plan(rows: DataFrame, scratch: common.Scratch, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP) -> DataFrame:
    """rows: _row, doc_id, source, _size, written. Gives _row, doc_id, _size, source_size, target, taken."""
    spark = rows.sparkSession
    common.tidy(spark)
    per_source = rows.groupBy("source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(per_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    per_source.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    sizes = [r["size"] for r in per_source]
    goal = targets(sizes, weights, share, cap)
    take = [min(cap * s, int(t + Fraction(1, 2))) for s, t in zip(sizes, goal, strict=True)]
    blocks = [common.parts(s, block, 0) for s in sizes]
    quota = [(t // s) * b + common.parts(t % s, block, 0) if s else 0 for s, t, b in zip(sizes, take, blocks, strict=True)]
    table = spark.createDataFrame(
        [(i, r.source, sizes[i], float(goal[i]), take[i], blocks[i]) for i, r in enumerate(per_source)],
        "_no int, source string, source_size long, target double, _take long, _blocks long",
    )
    table = F.broadcast(table) if len(per_source) <= 100_000 else table

    count = sum(r["n"] for r in per_source)
    keyed = rows.select("_row", "doc_id", "source", "_size", F.xxhash64("doc_id").alias("_key"))
    laid = laid_out(keyed.join(table, keyed["source"].eqNullSafe(table["source"])), scratch, count)
    sums = laid.groupBy("_no", "_part").agg(F.max("_end").alias("_sum"))
    sums = sums.select("_no", "_part", (F.sum("_sum").over(Window.partitionBy("_no").orderBy("_part")) - F.col("_sum")).alias("_base"))
    laid = laid.join(F.broadcast(sums) if count <= RANGE_ROWS * BROADCAST_ROWS // 2 else sums, ["_no", "_part"]).withColumn("_end", F.col("_end") + F.col("_base")).withColumn("_begin", F.col("_end") - F.col("_size"))
    first, last = F.expr(f"_begin div {block}"), F.expr(f"(_end - 1) div {block}")
    pieces = laid.where("_size > 0").withColumn("_block", F.explode(F.sequence(first, last)))

    slots = schedule(rows, scratch, quota).join(table.select("_no", "_take", "_blocks", "source_size"), "_no")
    ends = F.least(F.expr("source_size"), F.expr("_take - (rank div _blocks) * source_size"))
    slots = slots.select("_no", F.expr("rank % _blocks").alias("_block"), ends.alias("_stop"))
    low, high = F.greatest("_begin", F.expr(f"_block * {block}")), F.least("_end", F.expr(f"(_block + 1) * {block}"), "_stop")
    joined = pieces.join(slots, ["_no", "_block"], "left").withColumn("_got", F.when(F.col("_stop").isNotNull() & (high > low), high - low).otherwise(F.lit(0).cast("long")))
    got = joined.groupBy("_row", "doc_id", "_size", "_no").agg(F.sum("_got").alias("taken"))
    empty = laid.where("_size = 0").select("_row", "doc_id", "_size", "_no", F.lit(0).cast("long").alias("taken"))  # they would all meet in one block
    return got.unionByName(empty).join(table.select("_no", "source_size", "target"), "_no").drop("_no")


def schedule(rows: DataFrame, scratch: common.Scratch, quota: list[int]) -> DataFrame:
    """The slots: slot, _no (its source), rank (within the source). Points beyond a source's quota are skipped; what a quota lacks is appended."""
    spark, total = rows.sparkSession, sum(quota)
    if not total:
        return spark.createDataFrame([], "slot long, _no int, rank long")
    sums, at = [], 0
    for q in quota[:-1]:
        at += q
        sums.append(min(2**64 - 1, (at << 64) // total))
    edges = np.array(sums, np.uint64)

    def source_of(chunk: int) -> np.ndarray:
        j = np.arange(chunk * CHUNK + 1, min(total, (chunk + 1) * CHUNK) + 1, dtype=np.uint64)
        return np.searchsorted(edges, j * GOLDEN, side="right")

    def counts(stream):
        for batch in stream:
            for chunk in batch.column("id").to_pylist():
                n = np.bincount(source_of(chunk), minlength=len(quota))
                kept = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), chunk, np.int64)), pa.array(kept.astype(np.int32)), pa.array(n[kept].astype(np.int64))], ["chunk", "_no", "n"])

    chunks = common.parts(total, CHUNK)
    ids = spark.range(0, chunks, 1, min(chunks, 4096))
    found = scratch.table(ids.mapInArrow(counts, "chunk long, _no int, n long"), "slots")
    before = found.withColumn("base", F.sum("n").over(Window.partitionBy("_no").orderBy("chunk")) - F.col("n"))
    per_chunk = before.groupBy("chunk").agg(F.collect_list(F.struct("_no", "base")).alias("bases"))

    def ranks(stream):
        for batch in stream:
            for chunk, bases in zip(batch.column("chunk").to_pylist(), batch.column("bases").to_pylist(), strict=True):
                no = source_of(chunk)
                start, n = np.zeros(len(quota), np.int64), np.bincount(no, minlength=len(quota))
                for b in bases:
                    start[b["_no"]] = b["base"]
                order = np.argsort(no, kind="stable")
                rank = np.empty(len(no), np.int64)
                rank[order] = np.arange(len(no)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
                keep = rank < np.array(quota)[no]
                yield pa.RecordBatch.from_arrays([pa.array((chunk * CHUNK + np.arange(len(no)))[keep]), pa.array(no[keep].astype(np.int32)), pa.array(rank[keep])], ["slot", "_no", "rank"])

    drawn = per_chunk.repartition(min(chunks, 4096), "chunk").mapInArrow(ranks, "slot long, _no int, rank long")
    have = found.groupBy("_no").agg(F.sum("n").alias("n"))
    wanted = spark.createDataFrame([(i, q) for i, q in enumerate(quota) if q], "_no int, quota long")
    lacking = wanted.join(have, "_no", "left").where("coalesce(n, 0) < quota")
    tail = lacking.select(F.lit(total).alias("slot"), "_no", F.explode(F.expr("sequence(coalesce(n, 0L), quota - 1)")).alias("rank"))
    return drawn.unionByName(tail)


def _keys(sized_docs: DataFrame) -> DataFrame:
    return sized_docs.select("_row", F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_doc.source").cast("string").alias("source"), "_size")


def taken(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    scratch = common.Scratch(docs.sparkSession, "mix")
    rows = scratch.table(_keys(sized(docs.select("doc_id", "source", "text"))), "rows")
    return plan(rows, scratch, **settings).selectExpr("doc_id", "_size size", "source_size", "target", "taken")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: each as often as the mix takes it, rounded to whole documents (half up); columns as they came."""
    scratch = common.Scratch(docs.sparkSession, "mixed")
    whole = scratch.table(sized(docs), "docs")
    copies = plan(_keys(whole), scratch, **settings)
    copies = copies.where("_size > 0").select("_row", F.expr("(2 * taken + _size) div (2 * _size)").alias("_copies")).where("_copies > 0")
    return whole.join(copies, "_row").select("_doc", F.explode(F.expr("sequence(1L, _copies)"))).select("_doc.*")
