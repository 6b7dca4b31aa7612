"""Neighbours against brute force: exact scores, ties, and recall."""

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(ids, points, k=5):
    out = {}
    for i, q in zip(ids, points, strict=True):
        if i % 50 == 0:
            score = neighbours.cosine(q, points)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_recall_and_ranks(spark):
    got = queries.op9_neighbours(spark, "/root/testdata/sf0.1").collect()
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, points = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, points)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(want) and all(len(v) == 5 for v in by.values())
    hit = np.mean([len({a for a, _ in by[q]} & {a for a, _ in want[q]}) / 5 for q in want])
    print("recall", hit)
    assert hit >= 0.9
    exact = {(q, int(ids[j])): neighbours.cosine(points[list(ids).index(q)], points[j : j + 1])[0] for q in list(by)[:3] for j in range(len(ids))}
    assert all(abs(exact[q, a] - s) < 1e-12 for q in list(by)[:3] for a, s in by[q])


def test_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0], None) for i in range(0, 400)] + [(1000, None, ""), (1050, [0.0, 0.0, 0.0], ""), (1100, [1.0, None, 2.0], ""), (1150, [1.0, float("nan"), 0.0], ""), (1200, [float("inf"), 1.0, 1.0], ""), (None, [1.0, 1.0, 1.0], ""), (1250, [1.0], "")]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, block=64).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {q: [i for i in range(7) if i != q][:5] for q in range(0, 400, 50)}


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0], ""), (1, [0.0, 1.0], ""), (2, [1.0, 1.0], "")]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r["rank"]) for r in got] == [(2, 1), (1, 2)]
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(1, [], "")], SCHEMA), F.lit(True)).count() == 0


def test_no_query_is_short_of_neighbours(spark):
    turn = lambda n, at=0: [(at + i, [float(np.cos(0.2 * i)), float(np.sin(0.2 * i))], "") for i in range(n)]
    far = [(100 + i, [-1.0, 0.0], "") for i in range(300)]
    again = [(0, [1.0, 0.1 * i], "") for i in range(1, 9)]
    for rows, want in [(turn(n), min(5, n - 1)) for n in range(4, 8)] + [(turn(5) + far, 5)]:
        got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).orderBy("rank").collect()
        assert [r["rank"] for r in got] == list(range(1, want + 1)), len(rows)
        assert [r.vec_id for r in got] == ([1, 2, 3, 4, 5] if len(rows) < 10 else [1, 2, 3, 4, 100])[:want]
    got = neighbours.nearest(spark.createDataFrame(again + turn(6), SCHEMA), F.col("vec_id") == 0).collect()
    assert {r.vec_id for r in got} >= {1, 2, 3} and len({r["rank"] for r in got}) == 5
