"""The sentence steps give what their plain forms give, for less work, and each expression is computed once."""

import re
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import charclass as C
from textloom.functions import codec
from textloom.functions import text as T
from textloom.operators import clean
from textloom.plans import registry

SF = "/root/testdata/sf0.001"
TEXTS = [
    "", " ", "\n", "a\r\n", "a\r\n\r\nb\n\n", "a\x0bb\x1cc\x85d e ", "  lead and trail　\t", "no-break\xa0space   wide", "one.two,three;four:five!six?seven", "Wait . . . what .. then ... end", "a , b ;c", "x. \"Quoted.\" 'y.' (z.) »w«", "!?!", "?", "...", '"', "a\n\"\n'b", "a.\n\"b.\n)\n]c", "Who? - Me. - \"You\" - no -- ok - 5", "- dash first. - Then",
    "visit www.\") now", "http:// x", "https://a.b c", "WWW.” x", "see www.　x", "r/abc", "u/", "漢字 here", "ｶ half", "посмотреть ВСЕХ модераторов", "Опубликованных  материалов за НЕДЕЛЮ", "ᲂпубликованных материалов за неделю", "daß mäßig Straße İİİ ﬁs We they a-b a-bc o'clock", "12 ½ Ⅷ x² 3.14 1,000", "\U0001f600 grin 𝔄𝔅", "tab\tin\x1fmiddle. next\x0cpage", "é ü.", "a.b\n-\nc - D", "»» a", ". a", " .a. b", "a . . .", "a  b", "end. ", "x .y", None,
]


def plain_normalize(c):
    c = T.replace(c, rf"(?:\.{C.WS}*){{3,}}", ". ")
    c = F.trim(T.replace(c, f"{C.WS}+", " "))
    c = T.replace(c, r" +([,.;:!?])", "$1")
    c = T.replace(c, rf"([,.;:!?])(?=[^{C.WS_BODY}\"'”’)\]}}])", "$1 ")
    return F.trim(T.replace(c, f"{C.WS}+", " "))


def plain_trim(c):
    return T.replace(c, rf"\A{C.WS}+|{C.WS}+\z", "")


def plain_lines(c):
    return F.split(T.replace(c, rf"(?:{C.LINE_END})\z", ""), C.LINE_END)


def plain_split_line(c):
    marked = T.replace(plain_normalize(c), rf"([{C.TERMINATORS}]+[{C.CLOSERS}]*){C.WS}*-{C.WS}+(?=[\"'«A-ZА-ЯЁ0-9])", "$1\n")
    chunk = lambda x: F.regexp_extract_all(plain_normalize(T.replace(x, rf"\A{C.WS}*-{C.WS}*", "")), F.lit(rf".+?(?:[{C.TERMINATORS}]+[{C.CLOSERS}]*|$)"), F.lit(0))
    found = F.flatten(F.transform(F.split(marked, "\n"), chunk))
    return F.filter(F.transform(found, plain_normalize), lambda x: (x != "") & ~T.full(x, f"[{C.TERMINATORS}]+"))


def plain_drop(c):
    n = plain_normalize(c)
    return (n == "") | (T.casefold(n) == C.MODERATORS) | T.full(n, C.WEEKLY) | T.full(n, C.COMMUNITY) | F.regexp_like(n, F.lit(C.URL)) | F.regexp_like(n, F.lit(C.CJK))


def plain_words(c):
    return F.size(F.filter(F.regexp_extract_all(c, F.lit(C.WORD), F.lit(0)), lambda w: T.casefold(w).isin(*C.SHORT_WORDS) | (F.length(T.casefold(w)) >= 4)))


PAIRS = {
    "normalize": (T.normalize_line, plain_normalize), "trim": (T.trim, plain_trim), "lines": (T.lines, plain_lines), "split_line": (T.split_line, plain_split_line), "drop": (T.should_drop, plain_drop),
    "words": (T.significant_words, plain_words), "symbols": (T.strip_symbols, lambda c: T.replace(c, C.SYMBOL, " ")), "blank": (T.is_blank, lambda c: ~F.regexp_like(c, F.lit(C.NOT_WS))),
}


@pytest.mark.parametrize("name", PAIRS)
def test_equals_plain_form(spark, name):
    mixed = [f"{a}{gap}{b}" for a in TEXTS[:-1] for b in TEXTS[:-1] for gap in ("", " ", ". ")]
    fast, plain = PAIRS[name]
    rows = spark.createDataFrame([(t,) for t in TEXTS + mixed], "x string").repartition(8).select("x", fast(F.col("x")).alias("fast"), plain(F.col("x")).alias("plain"))
    assert rows.where(~F.col("fast").eqNullSafe(F.col("plain"))).head(3) == []


def test_classes_hold_the_same_characters(spark):
    each = spark.range(0x110000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("x"))
    for fast, plain in ((C.FAST_WS, C.WS), (C.FAST_NOT_WS, C.NOT_WS), (C.FAST_LINE_END, C.LINE_END), (C.FAST_CJK, C.CJK), (C.FAST_WORD, C.WORD), (f"{C.SYMBOL_NOT_SPACE}| ", C.SYMBOL), (f"{C.FAST_WS_NOT_SPACE}| ", C.WS)):
        assert each.where(T.full(F.col("x"), fast) != T.full(F.col("x"), plain)).count() == 0
    assert {r.x for r in each.where(T.full(F.col("x"), C.WS)).collect()} == set(C.WS_CHARS)


def nodes(frame, kind):
    """The plan's nodes of a kind, each with all of its text."""
    return [n for n in re.split(r"\n(?=[ :]*[+*]- |[ :]*\+- )", frame._jdf.queryExecution().optimizedPlan().toString()) if re.match(rf"[ :+\-]*{kind}\b", n)]


@pytest.mark.parametrize("name", ["filter_min_words", "rebalance_closers", "transform_parts", "clean_sentences"])
def test_nothing_is_filtered_below_the_exchange(spark, name):
    assert not [n for n in nodes(registry.QUERIES[name](spark, SF), "Filter") if "regexp" in n.lower()]


def test_repaired_text_is_computed_once(spark):
    plan = clean.clean_text(spark.createDataFrame([("é",)], "text string"))._jdf.queryExecution().optimizedPlan().toString()
    once = codec.repair_mojibake(spark.createDataFrame([("é",)], "text string"), "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("╨╤") == once.count("╨╤")


def test_clean_sentences_are_looked_at_once(spark):
    rows = spark.range(0, 20_000, 1, 4).select(F.repeat(F.concat(F.lit("A plain sentence, number "), F.col("id"), F.lit(" of them, with nothing to do. ")), 10).alias("x")).cache()
    rows.count()

    def took(body):
        def once():
            began = time.time()
            rows.select(body(F.col("x"))).write.format("noop").mode("overwrite").save()
            return time.time() - began

        return min(once() for _ in range(3))

    assert took(T.split_line) * 1.5 < took(plain_split_line)
