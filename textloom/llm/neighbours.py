"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Fit, on a bounded sample (rows of the least hashes, SAMPLE_BYTES at most, on the driver): a random rotation, k-means
centroids, as many as the square root of the rows up to LISTS, and the number of lists that hold RECALL of the
true neighbours within the sample. Every row is then indexed: it goes to its nearest centroid's list, whole. A list
is cut into blocks of about BLOCK rows by hash, so a list of very many equal vectors spreads over tasks.
A query visits the blocks of so many nearest lists, and of further ones, by nearness, until those visited hold
`k` rows and as many as any id has (all lists, if they hold fewer), so that none is short of neighbours. In a block,
unit vectors are rotated and lie in column blocks; after each column block a hypothesis test compares the partial
distance, scaled up, with the query's limit and abandons candidates that are farther with confidence. The limit
starts at the k-th best of a broadcast sample, and after each column block the k nearest so far are measured
whole to tighten it. Those left get the exact cosine of the original vectors in double precision. Each block
returns its best `k`, merged by rank.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; equal scores go to the smaller vec_id; repeated ids are rows of their own, and a
query's own row is every row of its id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Most lists (their number is the square root of the rows); bytes of the sample that rotation and centroids are fitted on; rows of a block.
LISTS, SAMPLE_BYTES, BLOCK = 1024, 128 << 20, 2048
#: Recall that the number of visited lists is set for, by so many of the sample's rows asked against the sample.
RECALL, ASKED = 0.97, 400
#: Sampled rows that give each query its first limit; queries that are held against a block at once.
BOUNDING, QUERIES = 4096, 256
#: Dimensions of a column block, the test's strictness (standard errors of the partial distance), and the share of alive pairs (one in FEW) that go one by one.
COLUMNS, EPSILON, FEW = 16, 3.0, 24


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    fine = F.col("v").isNotNull() & (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("id").isNotNull() & fine).where(F.exists("v", lambda x: x != 0))


def fit(sample: np.ndarray, lists: int, k: int = 5, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """A random rotation, centroids of the rotated unit vectors, and how many lists to visit for a recall of RECALL, measured on the sample.

    A larger table has nearer neighbours than the sample, which fewer lists hold; so the count errs to the safe side.
    """
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((sample.shape[1], sample.shape[1])))[0]
    points = unit(sample) @ rotation
    points = np.unique(points.round(6), axis=0)
    points = points[rng.permutation(len(points))]
    centroids = points[:lists].copy()
    for _ in range(12):
        near = nearest_lists(points, centroids, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        own, first = np.unique(near[order], return_index=True)
        centroids[own] = np.add.reduceat(points[order], first, axis=0) / np.diff([*first, len(near)])[:, None]
    asked = points[:ASKED]
    gap = -(asked @ points.T)
    gap[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    k = min(k, len(points) - 1)
    if k < 1:
        return rotation, centroids, 1
    true = np.argpartition(gap, k - 1, axis=1)[:, :k]
    rank = np.argsort(nearest_lists(asked, centroids, len(centroids)), axis=1)
    needed = np.sort(np.take_along_axis(rank, nearest_lists(points, centroids, 1)[:, 0][true], axis=1).ravel())
    return rotation, centroids, int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1


def nearest_lists(points: np.ndarray, centroids: np.ndarray, most: int) -> np.ndarray:
    """The nearest `most` centroids of each point, nearest first."""
    half = 0.5 * (centroids**2).sum(1)
    if most == 1:
        return np.concatenate([np.argmax(points[i : i + 4096] @ centroids.T - half, axis=1) for i in range(0, len(points), 4096)] or [np.empty(0, int)])[:, None]
    return np.argsort(half - points @ centroids.T, axis=1, kind="stable")[:, :most]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; scaled by their largest component first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kth(row: np.ndarray, value: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th least value of each of n rows; infinite where a row has fewer."""
    order = np.lexsort((value, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    out = np.full(n, np.inf)
    out[row[place == k - 1]] = value[order][place == k - 1]
    return out


def block_search(queries: np.ndarray, ids: np.ndarray, bounds: np.ndarray, original: np.ndarray, rotation: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query row, id, score): each query's best k of the block. bounds: squared distances that a query's k-th best does not exceed."""
    points = unit(original)
    rotated = points @ rotation
    dim, out = rotated.shape[1], []
    for begin in range(0, len(queries), QUERIES):
        part = slice(begin, begin + QUERIES)
        q, limit = unit(queries[part]), bounds[part].copy()
        turned, n, seen = q @ rotation, len(q), 0
        partial = np.where(ids[part][:, None] == own, np.inf, 0.0)
        alive, row = np.isfinite(partial), None
        while seen < dim:
            to = min(seen + COLUMNS, dim)
            if row is None:  # while many are alive: all pairs of the column block at once
                a, b = turned[:, seen:to], rotated[:, seen:to]
                partial += np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)
                best = np.argpartition(np.where(alive, partial, np.inf), k - 1, axis=1)[:, :k] if len(own) > k else np.tile(np.arange(len(own)), (n, 1))
                at, who = best.ravel(), np.repeat(np.arange(n), best.shape[1])
            else:  # few are left: pair by pair
                partial = partial + ((turned[row, seen:to] - rotated[at, seen:to]) ** 2).sum(1)
            seen = to
            wide = (limit * (1 + EPSILON / np.sqrt(seen)) ** 2) * (seen / dim) + 1e-9 if seen < dim else limit + 1e-9
            if row is None:
                # the k nearest so far are measured whole, for their k-th is never below the true k-th, and are never abandoned
                if seen < dim and best.shape[1] == k:
                    whole = ((q[who] - points[at]) ** 2).sum(1)
                    whole[~alive[who, at]] = np.inf
                    limit = np.minimum(limit, whole.reshape(n, k).max(1))
                stay = partial <= wide[:, None]
                stay[who, at] = True
                alive &= stay
                if np.count_nonzero(alive) * FEW < alive.size or seen == dim:
                    row, at = np.nonzero(alive)
                    partial = partial[row, at]
            else:
                stay = (partial <= wide[row]) | (partial <= kth(row, partial, n, k)[row])
                row, at, partial = row[stay], at[stay], partial[stay]
        stay = partial <= kth(row, partial, n, k)[row] + 1e-9
        row, at = row[stay], at[stay]
        scores = cosine(queries[part][row], original[at])
        order = np.lexsort((own[at], -scores, row))
        row, at, scores = row[order], at[order], scores[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out += zip((begin + row[keep]).tolist(), own[at[keep]].tolist(), scores[keep].tolist(), strict=True)
    return out


def cosine(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Cosines of the original vectors in double precision, each summed alone so that equal vectors score equally."""
    return (points * query).sum(axis=1) / (np.sqrt((points * points).sum(axis=1)) * np.sqrt((query * query).sum(axis=-1)))


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which the column `is_query` holds."""
    spark = vectors.sparkSession
    common.tidy(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    dims = rows.where("v is not null").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None or not dims["dim"]:
        return spark.createDataFrame([], schema)
    dim, total = dims["dim"], dims["count"]
    rows = usable(rows, dim)
    lists = min(LISTS, max(16, int(np.sqrt(total))))
    most = min(max(20_000, 32 * lists), max(1, SAMPLE_BYTES // (8 * dim)))
    key = F.xxhash64("id", "v")
    sample = rows.withColumn("key", key).where(common.rarer(F.col("key"), most, total)).groupBy("key").agg(F.first("id").alias("id"), F.first("v").alias("v")).orderBy("key").limit(most).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    sampled = sample.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    rotation, centroids, visits = fit(sampled, lists, k)
    model = spark.sparkContext.broadcast((rotation, centroids, unit(sampled[:BOUNDING]), sample.column("id").to_numpy()[:BOUNDING]))
    del sample, sampled

    def vectors_of(batch) -> np.ndarray:
        return batch.column("v").flatten().to_numpy().reshape(-1, dim)

    def assign(stream):
        turn, centres = model.value[:2]
        for batch in stream:
            near = nearest_lists(unit(vectors_of(batch)) @ turn, centres, 1)[:, 0] if batch.num_rows else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("q"), pa.array(near.astype(np.int32))], ["id", "v", "q", "list"])

    scratch = common.Scratch(spark, "ann")
    indexed = scratch.table(rows.mapInArrow(assign, "id long, v array<double>, q boolean, list int"), "index")
    sizes = np.zeros(len(centroids), np.int64)
    for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row for each of at most LISTS lists
        sizes[r["list"]] = r["n"]
    enough = k + (indexed.groupBy("id").count().agg(F.max("count")).first()[0] or 0)

    def visit(stream):
        turn, centres, known, known_ids = model.value
        for batch in stream:
            ids, points = batch.column("id").to_numpy(), unit(vectors_of(batch)) if batch.num_rows else np.empty((0, dim))
            order = nearest_lists(points @ turn, centres, len(centres))
            held = sizes[order]
            wanted = ((np.arange(len(centres)) < visits) | (np.cumsum(held, axis=1) - held < enough)) & (held > 0)
            # k sampled rows are candidates too: a query's k-th best is as near as theirs
            bound = np.full(len(ids), np.inf)
            if len(known) > k and len(ids):
                gap = np.maximum(2 - 2 * points @ known.T, 0)
                gap[ids[:, None] == known_ids] = np.inf
                bound = np.partition(gap, k - 1, axis=1)[:, k - 1] + 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(bound), pa.array([o[w].astype(np.int32) for o, w in zip(order, wanted, strict=True)], pa.list_(pa.int32()))], ["id", "v", "bound", "lists"])

    pieces = F.get(F.array(*[F.lit(common.parts(int(n), block)) for n in sizes]), F.col("list"))
    points = indexed.select("list", "id", "v").withColumn("block", F.pmod(F.xxhash64("id", "v"), pieces).cast("int"))
    queries = indexed.where("q").select("id", "v").mapInArrow(visit, "id long, v array<double>, bound double, lists array<int>").select(F.explode("lists").alias("list"), "id", "v", "bound")
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), pieces - 1))).select("list", "block", "id", "v", "bound")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            stack = lambda x: np.stack(x["v"].to_numpy()).astype(float)
            ids = left["id"].to_numpy()
            found = [(ids[i], j, s) for i, j, s in block_search(stack(left), ids, left["bound"].to_numpy(), stack(right), model.value[0], right["id"].to_numpy(), k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    pairs = queries.groupBy("list", "block").cogroup(points.groupBy("list", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
