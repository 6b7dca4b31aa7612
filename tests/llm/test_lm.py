"""LM scores: the base against its formula, the model against normalisation and the base."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from textloom.llm import lm

SCHEMA = "doc_id long, text string, held_out string, c int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def check_base(rows, got):
    train = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(train.values()), len(train)
    want = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        want.append((-1 if i is None else i, held(i), len(own), sum(train[t] > 0 for t in own), n, round(base, 5)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)


@pytest.mark.parametrize("known", [50_000, 600])
def test_scores(spark, monkeypatch, known):
    monkeypatch.setattr(lm, "KNOWN", known)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, "Éa ÉA x WORD word"), (None, "of the"), (5, "of the"), (9004, "again " * 30000)]
    got = lm.score(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect()
    check_base(rows, got)
    out = [r for r in got if r.held_out]
    base, model = (sum(getattr(r, k) for r in out) / sum(r.n_tokens for r in out) for k in ("base_score", "score"))
    print(base, model)
    assert model > base + 0.05


def test_tables_are_normalised_and_learn():
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 50, (12, 1)) * rng.integers(0, 9, (12, 12)).astype(float)
    table = lm.train(pairs)
    assert np.allclose((10**table).sum(1), 1)
    unigram = np.log10((pairs.sum(0) + 0.5) / (pairs.sum() + 6))
    assert (pairs * table).sum() > (pairs * unigram).sum()


def test_no_training_text_and_none(spark):
    only = next(i for i in range(100) if held(i))
    row = lm.score(spark.createDataFrame([(only, "a b", "x", 1)], SCHEMA)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and abs(row.base_score) < 1e-9 and math.isfinite(row.score)
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
