"""Removed bytes against marking every repeated string directly."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from textloom.llm import substrings

SCHEMA = "doc_id long, text string, spans string, n_bytes int"


def brute(texts, length):
    places = defaultdict(list)
    blobs = [(t or "").encode() for t in texts]
    for d, b in enumerate(blobs):
        for i in range(len(b) - length + 1):
            places[b[i : i + length]].append((d, i))
    masks = [np.zeros(len(b), bool) for b in blobs]
    for at in places.values():
        if len(at) > 1:
            for d, i in at:
                masks[d][i : i + length] = True
    out = []
    for b, m in zip(blobs, masks, strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~m])
        out.append((len(b), int(m.sum()), len(substrings.runs_of(m)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rnd = random.Random(8)
    make = lambda n: "".join(rnd.choice("abcdefgh éß\n") for _ in range(n))
    passages = [make(rnd.randrange(150, 700)) for _ in range(12)]
    texts = [None, "", "short", "z" * 1000, "ab" * 300, make(199), passages[0][:200]]
    for _ in range(60):
        t = make(rnd.randrange(0, 500))
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randrange(0, 60)
            p = p[a : len(p) - rnd.randrange(0, 60)]
            if rnd.random() < 0.4:
                k = rnd.randrange(len(p))
                p = p[:k] + "X" + p[k + 1 :]
            at = rnd.randrange(len(t) + 1)
            t = t[:at] + p + t[at:]
        texts.append(t)
    return texts + texts[20:26] + [texts[30][1:]]


@pytest.mark.parametrize("hot", [2000, 2])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    texts = corpus()
    rows = [(i if i != 9 else 8, t, "x", 1) for i, t in enumerate(texts)]
    got = substrings.report(substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA))).collect()
    want = sorted((r[0], *w) for r, w in zip(rows, brute(texts, 200), strict=True))
    assert sorted(map(tuple, got)) == want and sum(w[2] > 0 for w in want) > 20


def test_suffix_ranks():
    rnd = random.Random(2)
    raw = bytes(rnd.choice(b"ab") for _ in range(400))
    for length in (3, 8, 20, 200):
        rank = substrings.levels(np.frombuffer(raw, np.uint8), length)[-1][1]
        want = sorted({raw[i : i + length].ljust(length, b"\0") for i in range(400)})
        assert [want[r] for r in rank] == [raw[i : i + length].ljust(length, b"\0") for i in range(400)]


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh", b"a", bytes(range(256))])
def test_longest_previous_factors(letters):
    rnd = random.Random(3)
    raw = bytes(rnd.choice(letters) for _ in range(150))
    raw += raw[20:90] + raw[:10]
    length, n = 40, len(raw)
    by = substrings.levels(np.frombuffer(raw, np.uint8), length)
    at = np.arange(n)
    got = substrings.longest_previous_factors(at, np.minimum(length, n - at), by)

    def shared(i, j):
        k = 0
        while k < min(length, n - i) and raw[i + k] == raw[j + k]:
            k += 1
        return k

    assert got.tolist() == [max((shared(i, j) for j in range(i)), default=0) for i in range(n)]


@pytest.mark.parametrize("hot", [2000, 2])
def test_keeping_the_first(spark, monkeypatch, hot):
    """No string is left whole twice, and every byte that goes lies in a string with another copy."""
    monkeypatch.setattr(substrings, "HOT", hot)
    texts = corpus()
    got = substrings.remove_repeats(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), keep_first=True).collect()
    first = defaultdict(list)
    blobs, removed = [(t or "").encode() for t in texts], {r.doc_id: [(x.s, x.e) for x in r.removed] for r in got}
    for i, b in enumerate(blobs):
        for a in range(len(b) - 199):
            first[b[a : a + 200]].append(any(s <= a and a + 200 <= e for s, e in removed[i]))
    assert all(v.count(False) <= 1 for v in first.values())
    for i, b in enumerate(blobs):
        for s, e in removed[i]:
            repeated = [a for a in range(s, e - 199) if len(first[b[a : a + 200]]) > 1]
            assert repeated[0] == s and repeated[-1] + 200 == e and all(y - x <= 200 for x, y in zip(repeated, repeated[1:]))
    everything = substrings.remove_repeats(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sum(len(r.kept) for r in got) > sum(len(r.kept) for r in everything)


def test_empty_and_null_ids(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = substrings.report(substrings.remove_repeats(spark.createDataFrame([(None, "q" * 300, "", 1), (None, "r", "", 1)], SCHEMA))).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(1, 0), (300, 300)]


def test_long_texts_go_in_slices(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 64)
    texts = corpus()
    got = substrings.report(substrings.remove_repeats(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))).collect()
    assert sorted(map(tuple, got)) == [(i, *w) for i, w in enumerate(brute(texts, 200))]


def test_sql_against_brute_force():
    import duckdb
    import pyarrow as pa

    from textloom.llm import oracle

    texts = corpus()
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    got = sorted(db.execute(oracle.SUBSTRINGS).fetchall())
    assert [r[1:] for r in got] == brute(texts, 200)
