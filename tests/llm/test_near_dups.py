"""Near-duplicate groups against comparing all pairs."""

import random

import numpy as np
import pytest

from textloom.llm import near_dups

SCHEMA = "doc_id long, text string, component_id string, n int"


def shingles(text, k):
    w = (text or "").lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows, k, percent):
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingles(t, k)) for i, t in rows]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def corpus():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    base = [rnd.choice(words) for _ in range(150)]
    for _ in range(160):  # one star of variants, many of them unlinked with each other
        own = base[:]
        for _ in range(rnd.randrange(0, 14)):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        rows.append((at, " ".join(own)))
        at += 1
    for _ in range(60):
        own = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 6, 9, 30, 200]))]
        for _ in range(rnd.randrange(1, 4)):
            rows.append((at, " ".join(own).upper() if rnd.random() < 0.3 else " ".join(own)))
            at += 1
            if len(own) > 8:
                own = own[:]
                own[-1] = rnd.choice(words)
    chain = [rnd.choice(words) for _ in range(60)]
    for _ in range(12):  # a chain: only neighbours are alike
        rows.append((at, " ".join(chain)))
        chain = [*chain[2:], rnd.choice(words), rnd.choice(words)]
        at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \n")] + [(at + 3 + i, base_text) for i, base_text in enumerate(["copy of one text here now"] * 70)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, monkeypatch, width, percent):
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    monkeypatch.setattr(near_dups, "SUB", 32)
    monkeypatch.setattr(near_dups, "SALT", 20)
    rows = corpus()
    got = near_dups.groups(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), width, percent).collect()
    want = brute(rows, width, percent)
    sizes = {i: len(shingles(t, width)) for i, t in rows}
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == sizes[r.doc_id] for r in got)


def test_clean_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (None, "a b c d e f g"), (4, "x y z"), (4, "x y z")]
    kept = near_dups.clean(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA))
    assert kept.columns == ["doc_id", "text", "component_id", "n"]
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == [-1, 1, 3, 4]


def test_empty(spark):
    assert near_dups.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clean_keeps_clashing_columns(spark):
    rows = [(1, "a b c d e f", 5, "k", 9), (1, "a b c d e f", 5, "k", 9), (2, "x y z", 6, None, 8)]
    kept = near_dups.clean(spark.createDataFrame(rows, "doc_id long, text string, _first int, kept string, doc int"))
    assert sorted(map(tuple, kept.collect())) == sorted(set(rows))


def test_estimates():
    rng = np.random.default_rng(1)
    for n in (12, 100, 2000):
        m, kept = 600, []
        for share in (1.0, 0.9, 0.75, 0.0):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            shared = int(n * share)
            b = np.concatenate([a[:shared], rng.integers(0, 2**63, n - shared, dtype=np.uint64)])
            x, y = near_dups.registers([a, b], m)
            by = near_dups.shares(np.array([n, n]), m)
            e = near_dups.corrected((x == y).mean(), by[0] @ by[1])
            assert abs(e - shared / (2 * n - shared)) < 0.09
            kept.append(e)
        assert kept[0] == 1
    one = near_dups.registers([np.array([7], np.uint64), a], 120)
    assert (one[0] == near_dups.registers([np.array([7], np.uint64)], 120)[0]).all()
    assert (1 - 0.85**near_dups.ROWS) ** near_dups.bands_for(0.85) <= near_dups.MISS


def test_registers_agree_with_the_chance_of_the_similarity():
    """Over many pairs of short sets, the share of agreeing registers is the Jaccard similarity."""
    rng, m = np.random.default_rng(2), 120
    for n, shared in ((7, 6), (40, 36), (150, 138)):
        got = []
        for _ in range(300):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            x, y = near_dups.registers([a, np.concatenate([a[:shared], rng.integers(0, 2**63, n - shared, dtype=np.uint64)])], m)
            got.append((x == y).mean())
        assert abs(np.mean(got) - shared / (2 * n - shared)) < 0.02
