"""Encoding repair and normal forms: no built-in does these, so they are Arrow-batched UDFs, for non-ASCII rows only."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T

#: Encodings that UTF-8 bytes may once have been read in, in the order they are tried.
CODECS = ("cp866", "cp1251", "latin1")


def _recode(codec: str):
    @F.pandas_udf(StringType())
    def run(column: pd.Series) -> pd.Series:
        def one(value):
            try:
                return None if value is None else value.encode(codec).decode("utf-8")
            except UnicodeError:
                return None

        return column.map(one)

    return run


def repair_mojibake(frame: DataFrame, column: str) -> DataFrame:
    """STR1: candidates from the codecs; the best score (STR2, JVM-side) wins, ties to the earlier one, the text itself first."""
    c = F.col(column)
    wide = F.regexp_like(c, F.lit(r"[^\x00-\x7F]"))
    names = [f"_as_{x}" for x in CODECS]
    tried = frame.withColumns({n: F.when(wide, _recode(x)(F.when(wide, c))) for n, x in zip(names, CODECS, strict=True)})
    rated = F.array(*[F.struct(T.quality_score(F.col(n)).alias("score"), F.lit(-i).alias("order"), F.col(n).alias("text")) for i, n in enumerate([column, *names])])
    best = F.array_max(F.filter(rated, lambda x: x["text"].isNotNull()))["text"]
    # most texts have no candidate but themselves, and need no score
    chosen = F.when(reduce(or_, [F.col(n).isNotNull() for n in names]), best).otherwise(c)
    # made by a generator, the text is computed once, not again wherever a later column names it
    made = tried.select(*[F.col(x) for x in frame.columns if x != column], F.inline(F.array(F.struct(chosen.alias(column)))))
    return made.select(*frame.columns)


@F.pandas_udf(StringType())
def _nfc(column: pd.Series) -> pd.Series:
    return column.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """STR3."""
    wide = F.regexp_like(c, F.lit(r"[^\x00-\x7F]"))
    return F.when(wide, _nfc(F.when(wide, c))).otherwise(c)
