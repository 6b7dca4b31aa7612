"""Packing lines into bounded parts (FOLD4, FOLD5, GEN8). Folds run over lengths only, within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import charclass as C
from ..functions import sentences as S
from ..functions import text as T
from . import clean

#: Lines and characters of a part, and characters of one without punctuation.
MAX_LINES, MAX_CHARS, MAX_PLAIN = 300, 10_000, 12_000


def grouped(values: Column, starts: Column, sep: str) -> Column:
    """Joins the values from each start to the next. Linear: each group is a slice."""
    def cut(both):
        values, at = both["v"], both["at"]
        return F.transform(at, lambda s, j: F.array_join(F.slice(values, s + 1, F.coalesce(F.get(at, j + 1), F.size(values)) - s), sep))

    return T.let(F.struct(values.alias("v"), starts.alias("at")), cut)


def greedy_starts(lengths: Column, max_items: int, max_chars: int, alone: int | None) -> Column:
    """Where parts begin: where lines or characters would exceed; items over `alone` stand for themselves. Only starts are kept in the fold."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("items"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("starts"))

    def step(a, n):
        big = F.lit(False) if alone is None else n > alone
        fresh = (a["items"] == 0) | big | (a["items"] + 1 > max_items) | (a["chars"] + n + 1 > max_chars)
        items = F.when(big, 0).when(fresh, 1).otherwise(a["items"] + 1)
        chars = F.when(fresh, n).otherwise(a["chars"] + n + 1)
        return F.struct((a["i"] + 1).alias("i"), items.alias("items"), chars.alias("chars"), F.when(fresh, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"]).alias("starts"))

    return F.aggregate(lengths, start, step, lambda a: a["starts"])


def slices(token: Column, width: int) -> Column:
    """GEN8."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.length(token) / F.lit(width)).cast("int") - 1), lambda i: F.substring(token, i * width + 1, F.lit(width)))


def pack_chars(c: Column, max_chars: int = MAX_PLAIN) -> Column:
    """FOLD5: tokens packed greedily; a longer token is cut into whole parts of its own."""
    none = F.array().cast("array<string>")

    def piece(t):
        whole = F.array(F.struct(t.alias("t"), F.length(t).alias("n")))
        return F.when(F.length(t) > max_chars, F.transform(slices(t, max_chars), lambda s: F.struct(s.alias("t"), F.lit(max_chars + 1).alias("n")))).otherwise(whole)

    def many(flat):
        pieces = F.flatten(F.transform(F.split(flat, " "), piece))
        return T.let(pieces, lambda p: grouped(F.transform(p, lambda x: x["t"]), greedy_starts(F.transform(p, lambda x: x["n"]), 1 << 30, max_chars, max_chars), " "))

    return T.let(T.trim(T.replace(c, f"{C.WS}+", " ")), lambda flat: F.when(flat == "", none).when(F.length(flat) <= max_chars, F.array(flat)).otherwise(many(flat)))


def by_chars(own: Column, max_plain: int = MAX_PLAIN) -> Column:
    """FLT14, AG3, on the lines of a text that are not blank."""
    few = (F.size(own) > 0) & (F.size(own) <= 3) & (F.array_max(F.transform(own, F.length)) > max_plain)
    return ~F.exists(own, T.has_terminator) | few


def pack_lines(own: Column, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, max_plain: int = MAX_PLAIN) -> Column:
    """FOLD4 on an array of lines that are not blank; of null: null."""
    def packed(own):
        plain = grouped(own, greedy_starts(F.transform(own, F.length), max_lines, max_chars, max_chars), "\n")
        return F.when(F.size(own) == 0, F.array().cast("array<string>")).when(by_chars(own, max_plain), pack_chars(F.array_join(own, " "), max_plain)).otherwise(plain)

    return T.let(own, packed)


def pack(c: Column, **limits: int) -> Column:
    """FOLD4: the parts of a normalised text."""
    return pack_lines(F.filter(T.lines(c), lambda x: ~T.is_blank(x)), **limits)


def _rows(frame: DataFrame, column: str, packed: Column) -> DataFrame:
    out = frame.select(*[c for c in frame.columns if c != column], F.posexplode(packed).alias("part_no", "part_text")).withColumn("part_no", F.col("part_no") + 1)
    return out.withColumns({"n_lines": F.size(F.split("part_text", "\n")), "n_chars": F.length("part_text")})


def parts(frame: DataFrame, column: str = "text", path: Column | None = None, **limits: int) -> DataFrame:
    """One row a part: part_no (from 1), part_text, n_lines, n_chars, and part_path where the source's path is given (STR15).

    `column` is a text, or an array of lines (as clean.good_sentences gives), which is then not split again.
    """
    packed = pack_lines if frame.schema[column].dataType.typeName() == "array" else pack
    out = _rows(frame, column, packed(F.col(column), **limits))
    return out if path is None else out.withColumn("part_path", T.part_path(path, F.col("part_no") - 1))


def sentence_parts(frame: DataFrame, column: str = "text", min_words: int = clean.MIN_WORDS, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, max_plain: int = MAX_PLAIN) -> DataFrame:
    """The parts of the sentences that stay of each text, its symbols stripped: by batches, by expression where these leave a text."""
    c, limits = F.col(column), {"max_lines": max_lines, "max_chars": max_chars, "max_plain": max_plain}
    own = pack_lines(clean.good_sentences(T.strip_symbols(c), min_words), **limits)
    return _rows(frame, column, F.coalesce(S.good_parts(c, min_words, **limits, symbols=True), own))
