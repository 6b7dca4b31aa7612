"""Literal rows for the string functions, with results worked out by hand."""

import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.functions import codec
from textloom.functions import text as T
from textloom.operators import clean, pack, part_files, regroup, transform, validate


def one(spark, value, body):
    return spark.createDataFrame([(value,)], "x string").select(body(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Title: Demo URL: https://www.youtube.com/watch?v=5xN3lN5UeXQ today", [("Title: Demo URL: https: //www.", 3), ("youtube.", 1), ("com/watch?", 1), ("v 5xN3lN5UeXQ today", 2)]),
        ("Pi is about 3.14 and tea at 12:30 costs 1,000 coins.", [("Pi is about 3.", 1), ("14 and tea at 12: 30 costs 1, 000 coins.", 2)]),
        ('He stopped there quietly. "You never listen to anyone," she said.', [('He stopped there quietly."', 4), ('You never listen to anyone," she said.', 6)]),
        ("Who goes there tonight? - Nobody important arrived yesterday.", [("Who goes there tonight?", 3), ("Nobody important arrived yesterday.", 4)]),
        ("Wait . . . something strange happened here", [("Wait.", 1), ("something strange happened here", 4)]),
        ("We saw it.", [("We saw it.", 2)]),
        ("Нет.\nОна очень любит старые книги.", [("Нет.", 0), ("Она очень любит старые книги.", 5)]),
        ("«Куда пошла молодая женщина?» спросил старый мужчина.", [("«Куда пошла молодая женщина?»", 4), ("спросил старый мужчина.", 3)]),
        ("It's state-of-the-art don't stop", [("It's state-of-the-art don't stop", 4)]),
        ("Alpha|Beta<b>Gamma</b> delta", [("Alpha Beta b Gamma /b delta", 4)]),
    ],
)
def test_sentences(spark, value, want):
    rows = clean.sentences(spark.createDataFrame([(value,)], "text string").withColumn("text", T.strip_symbols(F.col("text")))).withColumn("n", T.significant_words(F.col("sentence"))).orderBy("sent_no").collect()
    assert [(r.sentence, r.n) for r in rows] == want


@pytest.mark.parametrize(("value", "want"), [("a [b [c] d] e", "a  e"), ("a ] b", "a ] b"), ("a [ b [c] d", "a "), ("[" * 30 + "x" + "]" * 30 + "y", "y"), ("]]a[", "]]a")])
def test_brackets(spark, value, want):
    assert one(spark, value, T.remove_brackets) == want


def test_small_functions(spark):
    assert one(spark, "d/a.b.txt", lambda x: T.part_path(x, F.lit(2))) == "d/a.bS002.txt"
    assert one(spark, "a.txt", lambda x: T.part_path(x, F.lit(1000))) == "aS1000.txt"
    assert [one(spark, "", lambda x, s=s: T.format_seconds(F.lit(s))) for s in (0.0, 0.2, 59.1, 162.6, 162.0)] == ["0s", "1s", "1m 00s", "2m 43s", "2m 42s"]
    assert one(spark, "a\n \n\nb\n", T.remove_blank_lines) == "a\nb"
    assert one(spark, "we ran The dog sat Then left", T.split_unpunctuated) == ["we ran", "The dog sat", "Then left"]
    assert one(spark, "1\n00:00:01.500 --> 00:00:03.000 align:start\nText here\n", T.strip_subtitles) == "Text here"
    assert one(spark, "a\tb", T.strip_subtitles_if_needed) == "a\tb"
    own = "Аватар u/me\nme\n•\n3 ч. назад\nA long comment.\nНравится\n\n42\n7\nОтветить\n9"
    assert one(spark, own, T.strip_forum) == "A long comment.\n9"


def test_repair_and_normal_form(spark):
    texts = ["Привет, мир и добрый день", "plain", "Это проверка", None, ""]
    for name, wrong in (("latin1", lambda t: t.encode().decode("latin1")), ("cp866", lambda t: t.encode().decode("cp866"))):
        rows = [(i, None if t is None else wrong(t)) for i, t in enumerate(texts)]
        got = codec.repair_mojibake(spark.createDataFrame(rows, "i int, text string"), "text").orderBy("i").collect()
        assert [r.text for r in got] == texts, name
    parts = unicodedata.normalize("NFD", "é ü ñ ё")
    assert one(spark, parts, codec.nfc) == "é ü ñ ё"


def test_packing(spark):
    lines = "\n".join(f"Sentence number {i} is here today." for i in range(400))
    got = one(spark, lines, pack.pack)
    assert [len(p.split("\n")) for p in got] == [288, 112] and "\n".join(got) == lines
    assert [len(p) for p in one(spark, "Short.\n" + "X" * 11_000 + "\nTail.", pack.pack)] == [6, 11_000, 5]
    tokens = " ".join(f"word{i:04d}" for i in range(2400))
    got = one(spark, tokens, pack.pack)
    assert [p.count(" ") + 1 for p in got] == [1333, 1067] and " ".join(got) == tokens
    assert [len(p) for p in one(spark, "a " + "y" * 25 + " b", lambda x: pack.pack_chars(x, 10))] == [1, 10, 10, 5, 1]
    assert one(spark, " \n ", pack.pack) == []


def test_merging(spark):
    assert one(spark, "Раз.\n\nДва.\n\nТри.\n\nЧетыре.\n\nПять.", regroup.merge_text) == "Раз. Два. Три. Четыре.\nПять."
    assert one(spark, "  \n", regroup.merge_text) is None
    assert one(spark, "He went. home again", regroup.merge_text) == "He went home again"
    assert one(spark, "One two. Three four five six seven eight nine ten. Tail", regroup.split_wrapped) == ["One two. Three four five six seven eight nine ten.", "Tail"]


def test_validation(spark):
    rows = spark.createDataFrame([("a" * 10, "b" * 6), ("a" * 10, "b b" * 7), ("a" * 14, "b" * 6), ("a" * 14, "b" * 20), (" ", "b")], "s string, t string")
    got = validate.validate(rows, "s", "t").collect()
    assert [r.status for r in got] == ["ok", "ok", "too_short", "too_long", "zero_source"] and got[4].ratio is None
    e = validate.estimate(spark.createDataFrame([(4,)], "part_count int")).first()
    assert (e.launch_pause_count, round(e.launch_pause_seconds, 9), e.estimated_wall_seconds, e.estimate_text) == (3, 6.6, 162.6, "2m 43s")


def test_part_files(spark):
    rows = spark.createDataFrame([("t", n) for n in (0, 1, 2, 4, 7)] + [("u", 2)], "stem string, n int")
    got = {r.stem: r for r in part_files.run_summary(rows, "stem", "n").collect()}
    assert (got["t"].run_length, got["t"].orphans, got["u"].run_length, got["u"].orphans) == (2, "004,007", 0, "002")


def test_transform_outcomes(spark):
    calls = []

    def boom(path, text):
        calls.append(path)
        raise RuntimeError("boom")

    assert transform.attempt("p", "abc", boom) == (False, "attempt 3: boom", None) and len(calls) == 3
    assert transform.attempt("p", "abc", lambda p, t: "\n\nabc\n\n") == (True, "", "abc")
    assert transform.attempt("p", "abcd", lambda p, t: "a")[1] == "attempt 3: validation too_short (ratio 0.25)"


def test_pacing_and_time_limit():
    clock, slept = [10.0], []

    def sleep(seconds):
        slept.append(round(seconds, 6))
        clock[0] += seconds

    pacer = transform.Pacer(2.2, lambda: clock[0], sleep)
    pacer.wait()
    clock[0] += 0.2
    pacer.wait()
    clock[0] += 5
    pacer.wait()
    pacer.wait()
    assert slept == [2.0, 2.2]
    assert transform.attempt("p", "abc", lambda p, t: time.sleep(5) or t, 1, 0.05) == (False, "attempt 1: no result within 0.05 seconds", None)
    assert transform.attempt("p", "abc", lambda p, t: t, 1, 5.0) == (True, "", "abc")
    assert transform.attempt("p", "abc", lambda p, t: 1 / 0, 1, 5.0)[1] == "attempt 1: division by zero"


def test_errors_stay_with_their_document(spark):
    rows = spark.createDataFrame([(1, " "), (2, "..."), (3, "Too short."), (4, "This sentence has enough words."), (5, None)], "doc_id int, text string")
    got = {r.doc_id: (r.error, r.text) for r in clean.clean_text(rows).collect()}
    assert got == {1: ("empty_input", None), 2: ("no_sentences", None), 3: ("all_filtered", None), 4: (None, "This sentence has enough words."), 5: ("empty_input", None)}
