"""Merging parts back: sentences found anew and short ones grouped (FOLD3, GEN5, GEN7, ORC7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import charclass as C
from ..functions import text as T
from .pack import grouped

#: Words that make a line, sentences that a line holds at most.
MIN_WORDS, MOST = 8, 4


def merge_short(c: Column, min_words: int = MIN_WORDS, most: int = MOST) -> Column:
    """FOLD3: an array of sentences to an array of lines."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("held"), F.lit(0).alias("words"), F.array().cast("array<int>").alias("starts"))

    def step(a, w):
        words, held = a["words"] + w, a["held"] + 1
        full = F.when(a["held"] == 0, w >= min_words).otherwise((words >= min_words) | (held >= most))
        starts = F.when(a["held"] == 0, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"])
        return F.struct((a["i"] + 1).alias("i"), F.when(full, 0).otherwise(held).alias("held"), F.when(full, 0).otherwise(words).alias("words"), starts.alias("starts"))

    return T.let(c, lambda own: grouped(own, F.aggregate(F.transform(own, T.word_count), start, step, lambda a: a["starts"]), " "))


def find_sentences(c: Column) -> Column:
    """GEN5."""
    return F.regexp_extract_all(c, F.lit(rf"[^{C.TERMINATORS}]+(?:[{C.TERMINATORS}]+[\"'”’)]*|$)"), F.lit(0))


def merge_text(c: Column) -> Column:
    """ORC7, of the parts joined by blank lines: lines of the merged text; null where nothing is left."""
    def merged(flat):
        found = F.when(T.has_terminator(flat), T.clean_sentences(find_sentences(flat))).when(flat != "", F.array(flat))
        return T.let(merge_short(found), lambda lines: F.when(F.size(lines) > 0, F.array_join(lines, "\n")))

    return T.let(T.normalize_wrapped(c), merged)


def split_wrapped(c: Column) -> Column:
    """GEN7."""
    return T.let(T.normalize_wrapped(c), _split_wrapped)


def _split_wrapped(flat: Column) -> Column:
    pattern = rf".+?(?:[{C.TERMINATORS}]+[\"'”’)]*|$)(?=\s+(?:[\"'“‘(]*[A-ZА-ЯЁ0-9])|$)"
    found = F.transform(F.regexp_extract_all(flat, F.lit(pattern), F.lit(0)), T.trim)
    return F.when(flat == "", F.array().cast("array<string>")).when(T.has_terminator(flat), merge_short(T.clean_sentences(found))).otherwise(merge_short(T.clean_sentences(T.split_unpunctuated(flat))))


def merge_parts(frame: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """key, n_parts, merged of each document's parts in order. One shuffle by key; the lists are sorted within their group."""
    own = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    return frame.groupBy(key).agg(own.alias("_parts")).select(key, F.size("_parts").alias("n_parts"), merge_text(F.array_join("_parts", "\n\n")).alias("merged"))
