"""The sentence steps by batches give what the expressions give, on any text, for less work."""

import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import charclass as C
from textloom.functions import sentences as S
from textloom.functions import text as T
from textloom.operators import clean, pack
from textloom.plans import registry

from .test_speed import TEXTS

#: What the steps look for, and what stands around it.
BITS = [*" \n.,;:!?…-\"'”’»«)]}([$+=_/\t\r\x0b\x1c\x85\xa0 　aWЁя9é½ß漢ｶ", " ", "  ", ". ", ", ", "\r\n", " - ", ". - A", "...", " . . . ", "word ", "Слово ", "you ", "I ", "daß ", "İİa ", "o'clock ", "well-known ", "www.", "http://x", "r/abc", "u/", "n° 5", "I am. ", "We go there now. ", "Опубликованных материалов за неделю", "посмотреть ВСЕХ модераторов"]
ODD = ["\U0001f600 four good words here.", "ᲂпубликованных материалов за неделю", "four ꭰꭱꭲꭳ words here now.", "Ⴀ ⴀ Ა four good words here. a.b"]
LIMITS = [{}, {"max_lines": 2, "max_chars": 30, "max_plain": 12}, {"max_lines": 3, "max_chars": 9, "max_plain": 5}]


def texts(n):
    draw = random.Random(7)
    mixed = [f"{a}{gap}{b}" for a in TEXTS[:-1] for b in TEXTS[:-1] for gap in ("", "\n")]
    return TEXTS + ODD + mixed + ["".join(draw.choices(BITS, k=draw.randint(1, 40))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)


def test_classes_are_those_of_the_expressions(spark):
    each = spark.range(0x10000).where("id < 55296 or id > 57343").select("id", F.expr("substring(decode(unhex(concat('00000061', lpad(hex(id), 8, '0'))), 'UTF-32'), 2)").alias("x"))
    kinds = {"symbol": f"{C.SYMBOL_NOT_SPACE}", "letter": r"[\p{L}\p{Nl}\p{No}]", "ws": C.WS, "end": rf"(?:{C.LINE_END})", "cjk": C.CJK}
    rows = each.select("id", "x", T.casefold(F.col("x")).alias("low"), *[T.full(F.col("x"), p).alias(k) for k, p in kinds.items()]).collect()
    known, symbols, letters = set(S.KNOWN), set(S.SYMBOLS), set(S.LETTERS)
    assert len(known) > 40_000 and {ord(x) for x in "aéß漢Жあ한ع…»\n\x00"} <= known
    for r in rows:
        if r.id in known:
            assert ((r.id in symbols), (r.id in letters), S.casefold(r.x)) == (r.symbol, r.letter, r.low), hex(r.id)
            assert (r.x in C.WS_CHARS, len(f"a{r.x}b".splitlines()) == 2, bool(S.CJK.match(r.x))) == (r.ws, r.end, r.cjk), hex(r.id)


@pytest.mark.parametrize("symbols", [True, False])
def test_sentences_equal_the_expressions(spark, symbols):
    c = F.col("text")
    both = frame(spark, texts(3000)).select("text", *[x for n in (0, 1, 3) for x in (S.good_sentences(c, n, symbols).alias(f"got{n}"), clean.good_sentences(T.strip_symbols(c) if symbols else c, n).alias(f"want{n}"))])
    left = both.where("got3 is null").select("text").distinct().collect()
    assert None in {r.text for r in left} and all(r.text is None or S.UNKNOWN.search(r.text) for r in left)
    for n in (0, 1, 3):
        assert both.where(f"got{n} is not null and got{n} <> want{n} or want{n} is null and text is not null").select("text", f"got{n}", f"want{n}").head(3) == []


@pytest.mark.parametrize("limits", LIMITS)
def test_parts_equal_the_expressions(spark, limits):
    rows = [*texts(1500), "no end " * 20, "x" * 50 + " no end", "a good long sentence here. " * 700, "four good words there. " + "y" * 20_000 + ". more good words here."]
    docs = frame(spark, rows).cache()
    own = docs.select("doc_id", clean.good_sentences(T.strip_symbols(F.col("text"))).alias("own"))
    got, want = pack.sentence_parts(docs, **limits), pack.parts(own, "own", **limits)
    assert got.columns == want.columns and got.count() == want.count() > 1000
    assert got.exceptAll(want).head(3) == []


def test_other_forms_equal_the_expressions(spark):
    c, docs = F.col("text"), frame(spark, texts(1500)).cache()
    plain = T.split_sentences(T.strip_symbols(T.fold_newlines(c)))
    each = docs.select("doc_id", F.posexplode(plain).alias("sent_no", "sentence")).withColumn("n_sig", T.significant_words(F.col("sentence")))
    for n in (0, 3):
        got, want = clean.clean_sentences(docs, min_words=n), each.where((F.col("n_sig") >= n) & ~T.should_drop(F.col("sentence")))
        assert got.columns == want.columns and got.count() == want.count() > 1000 and got.exceptAll(want).head(3) == []
    split = docs.select("doc_id", F.posexplode(T.split_sentences(c)).alias("sent_no", "sentence"))
    assert clean.sentences(docs).exceptAll(split).head(3) == [] and clean.sentences(docs).count() == split.count()
    counts = docs.select("text", S.word_counts(c, symbols=True).alias("got"), F.transform(T.split_sentences(T.strip_symbols(c)), T.significant_words).alias("want"))
    assert counts.where("got <> want").head(3) == []
    own, good = T.split_sentences(c), clean.good_sentences(c)
    error = F.when(T.is_blank(c) | c.isNull(), "empty_input").when(F.size(own) == 0, "no_sentences").when(F.size(good) == 0, "all_filtered")
    judged = docs.select("doc_id", error.alias("error"), F.when(error.isNull(), F.array_join(good, "\n")).alias("text"))
    got = clean.filter_normalized(docs).select("doc_id", "error", "text")
    assert got.exceptAll(judged).head(3) == [] and {r.error for r in got.select("error").distinct().collect()} == {None, "empty_input", "no_sentences", "all_filtered"}


def test_bytes_that_are_no_text_are_left_to_the_expressions(spark):
    bad = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(unhex(concat(hex('four good words here. '), 'FF', hex(' and four good words'))) as string)").alias("text"))
    want = pack.parts(bad.select("doc_id", clean.good_sentences(T.strip_symbols(F.col("text"))).alias("own")), "own").collect()
    assert pack.sentence_parts(bad).collect() == want != []


def test_work_is_linear_in_a_text(spark):
    long = ["y" * 400_000, "y" * 200_000 + "-" + "!" * 200_000, "no end " * 60_000, "We go there now. " * 25_000, "».\n" * 130_000, "a … - " * 70_000, "…" * 400_000 + "-", ". " * 200_000, "\t \x0b" * 130_000]
    began = time.time()
    for x in long:
        S.pack_lines(S.good(S.decoded(x.encode(), True), 3), 6, 400, 60)
    assert time.time() - began < 30


@pytest.mark.parametrize("name", ["pack_parts", "pack_parts_small"])
def test_queries_take_a_fraction_of_the_expressions(spark, tmp_path, name):
    text = "A plain sentence, with some more words and nothing else to do. It goes on, and on. " * 20
    spark.range(0, 12_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.col("id").cast("string")).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")

    def took(body):
        def once():
            began = time.time()
            body().write.format("noop").mode("overwrite").save()
            return time.time() - began

        return min(once() for _ in range(2))

    docs = registry.table(spark, str(tmp_path), "documents")
    expressions = lambda: pack.parts(docs.select("doc_id", clean.good_sentences(T.strip_symbols(F.col("text"))).alias("own")), "own")
    assert took(lambda: registry.QUERIES[name](spark, str(tmp_path))) * 2 < took(expressions)
