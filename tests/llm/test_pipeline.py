"""The pipeline's stages, each on its own input, against brute force."""

import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from textloom.llm import common, mixing, queries, toxicity

from . import test_decontamination, test_near_dups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch = common.Scratch(spark, "stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(scratch.table(stage(spark, found[-1], SF), name))
    columns = docs.columns
    assert all(f.columns == columns for f in found[:-1])
    rows = [[tuple(r) for r in f.collect()] for f in found]
    start, clean, single, free, mix, tokens = rows

    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert sorted(clean) == sorted(r for r in start if not scores[r[0]])

    groups = test_near_dups.brute([(r[0], r[1]) for r in clean], 5, 80)
    assert sorted(single) == sorted(r for r in clean if groups[r[0]] == r[0])

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    shared = {w for _, t in items for w in t.lower().split()}
    likely = [r for r in single if sum(w in shared for w in r[1].lower().split()) >= 11 and len(r[1]) < 1500][:15]
    leaked = {r[0] for r in likely if test_decontamination.brute(r[1], items)[0]}
    looked = {r[0] for r in likely}
    assert {r[0] for r in single if r[0] in looked} - {r[0] for r in free if r[0] in looked} == leaked
    assert set(free) <= set(single)

    size = lambda r: len((r[1] or "").encode().split())
    times = Counter(r[0] for r in mix)
    assert set(mix) <= set(free) and max(times.values()) <= 2
    sources = sorted({r[3] for r in free})
    goal = mixing.targets([sum(size(r) for r in free if r[3] == s) for s in sources])
    longest = max(map(size, free))
    for s, g in zip(sources, goal, strict=True):
        assert abs(sum(size(r) for r in mix if r[3] == s) - float(g)) <= longest

    own, at, want = Tokenizer.from_file(str(queries.tokenizer_path())), 0, []
    for r in sorted(mix, key=lambda r: r[0]):
        ids = np.array(own.encode(r[1], add_special_tokens=False).ids + [1], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tokens) == sorted(want)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _size int, _doc string, kept int, score string, row_number int"


def test_edges(spark):
    extra = ("r", 7, "d", 1, "s", 2)
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))
    lines = [" ".join(f"word{k}x{i}" for i in range(30)) for k in range(4)]
    rows = [(1, None), (2, ""), (3, " \n"), (None, lines[0]), (None, lines[0]), (4, lines[1]), (4, lines[1]), (5, lines[1]), (6, lines[2]), (7, long), (None, None)]
    rows = [(i, t, None, None if i == 6 else "a", None, *extra) for i, t in rows] + [(8, lines[3], None, None, None, *[None] * 6)]
    scratch = common.Scratch(spark, "edges")
    docs, kept = spark.createDataFrame(rows, SCHEMA), []
    for name, stage in corpus_pipeline.STAGES:
        schema, docs = docs.schema, scratch.table(stage(spark, docs, SF), name)
        assert name == "token_files" or (docs.columns == schema.names and [f.dataType for f in docs.schema] == [f.dataType for f in schema])
        kept.append([tuple(r) for r in docs.collect()])
    clean, single, free, mix, tokens = kept
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert set(clean) <= set(rows) and {1, 2, 3} <= {r[0] for r in clean}
    assert sum(r[0] == 4 for r in single) == 1 and not any(r[0] == 5 for r in single)
    once = [r for r in clean if r[0] not in (4, 5)] + [r for r in clean if r[0] == 4][:1]
    assert sorted(single, key=key) == sorted(once, key=key)
    assert sorted(free, key=key) == sorted(single, key=key)
    assert set(mix) == {r for r in free if (r[1] or "").split()}
    assert len(tokens) == len(mix) and Counter(r[0] for r in tokens) == Counter(r[0] for r in mix)


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0 and docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
