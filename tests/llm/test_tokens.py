"""Token counts and token files against the library itself."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from textloom.llm import common, queries, token_counts, token_files, vocab

SCHEMA = "doc_id long, text string, lang string, extra int"
EDGE = [
    None, "", " ", "\n\t", "a", "Hello, WORLD! it's 2024's  don't", "x" * 5000, "ab " * 4000, "naïve café é ÉCOLE ß İ K K",
    "<|endoftext|> a<|startoftext|>b <|endoftext|", "tab\x1csep\x1fx", "nbsp\xa0next em　wide\x85line", "日本語 текст 🎉🎉 ½ ² Ⅷ", "́ lone", "a​b ﻿", "…»«—'ll 'S 'RE",
]


def library():
    return Tokenizer.from_file(str(queries.tokenizer_path()))


def noisy():
    rnd = random.Random(5)
    letters = "abcdeABC '’.,!?<|>0123 \n\t\x1c\xa0éñßüÇ中ж🎉́½"
    latin = "".join(map(chr, range(1, 256))) + "'"
    every = ["".join(rnd.choice(latin) for _ in range(60)) for _ in range(200)]
    return every + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(80))) for _ in range(300)]


@pytest.fixture(scope="module")
def frame(spark):
    texts = EDGE + noisy() + EDGE[4:6]
    return spark.createDataFrame([(i, t, "en", 7) for i, t in enumerate(texts)] + [(3, "twice", None, None), (3, "twice", None, None), (None, "no id", None, None)], SCHEMA)


def test_whole_tokens_are_proven():
    spec = open(queries.tokenizer_path()).read()
    whole, own = vocab.prove_whole(spec), library()
    assert len(whole) > 30_000
    for w in random.Random(1).sample(sorted(whole), 2000):
        if len(own.pre_tokenizer.pre_tokenize_str(w)) == 1 and own.normalizer.normalize_str(w) == w:
            assert len(own.encode(w, add_special_tokens=False).ids) == 1


def test_counts_equal_the_library(frame):
    own = library()
    rows = token_counts.token_counts(frame, str(queries.tokenizer_path())).collect()
    texts = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in frame.collect()), key=lambda x: x[:2])
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(rows) == len(texts)
    want = sorted((i, len(t.encode()), len(own.encode(t, add_special_tokens=False).ids)) for _, i, t in texts)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)


def test_counts_of_an_empty_table(spark):
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), str(queries.tokenizer_path())).count() == 0


def test_files_round_trip(spark, frame):
    own, path = library(), common.Scratch(spark, "t").path
    token_files.write(frame, path, str(queries.tokenizer_path()))
    rows = token_files.read(spark, path, with_ids=True).collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, own.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in frame.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    at, last = 0, -1
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and (-1 if r.doc_id is None else r.doc_id) >= last
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at, last = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id
    assert token_files.read_document(spark, path, 5) == [own.encode(EDGE[5], add_special_tokens=False).ids + [1]]
    assert len(token_files.read_document(spark, path, 3)) == 3 and token_files.read_document(spark, path, 10**9) == []


def test_files_of_an_empty_table(spark):
    path = common.Scratch(spark, "t").path
    token_files.write(spark.createDataFrame([], SCHEMA), path, str(queries.tokenizer_path()))
    assert token_files.read(spark, path).count() == 0


def test_files_refuse_another_dictionary():
    payload = token_files.pack([(1, 2, b"xy")], 2, bytes(32))
    with pytest.raises(ValueError):
        token_files.unpack(payload, b"\1" * 32)
