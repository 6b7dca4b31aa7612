"""Mixing: targets, bounds and determinism."""

import random
from collections import defaultdict
from fractions import Fraction

from textloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, target double, _extra int"


def test_targets_reshare():
    got = mixing.targets([100, 100, 100])
    assert got == [Fraction(200), Fraction(500, 3), Fraction(250, 3)] and sum(got) == 450
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def frame(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        source = rnd.choice(["a", "a", "a", "b", "c", "", None, "é"])
        rows.append((i, rnd.choice([None, "", "w " * rnd.randrange(1, 400)]), source, 1.0, 2))
    rows += [(5, "one two three", "a", None, None)] * 3 + [(None, "x y", "b", None, None), (700, "long " * 9000, "b", None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_mix(spark):
    docs, rows = frame(spark)
    got = mixing.taken(docs, block=32).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(docs.repartition(3), block=32).collect()), key=str)
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, map(float, mixing.targets([sizes[s] for s in order])), strict=True))
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = defaultdict(int)
    for r in got:
        by[(r.source_size, r.target)] += r.taken
    assert len(by) == len(order)
    for (size, target), taken in by.items():
        assert any(size == sizes[s] and abs(target - goal[s]) < 1e-9 for s in order)
        assert abs(taken - target) <= 1


def test_mixed_documents(spark):
    docs, rows = frame(spark)
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in got.collect())
    assert abs(words - 1.5 * sum(len((r[1] or "").split()) for r in rows)) < 2500


def test_mixed_keeps_clashing_columns(spark):
    rows = [(i, "w " * (10 + i), "ab"[i % 2], 777, -5, i, 0) for i in range(40)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, _size int, _row long, _doc int, taken int")).collect()
    assert {tuple(r) for r in got} <= set(rows) and len(got) > 40


def test_one_id_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    rows = [(7, "w " * (1 + i % 5), "a") for i in range(300)] + [(None, "w", "a")] * 50 + [(7, "", "b")] * 80 + [(i, "w " * 30, "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, again = ([tuple(r) for r in mixing.taken(d, block=32).collect()] for d in (docs, docs.repartition(7)))
    assert sorted(got, key=str) == sorted(again, key=str) and len(got) == len(rows)
    assert abs(sum(r[4] for r in got) - 1.5 * sum(r[1] for r in got)) <= 2 and all(r[4] <= 2 * r[1] for r in got)


def test_empty(spark):
    assert mixing.taken(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in mixing.taken(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect()] == [(1, 0, 0, 0.0, 0)]
