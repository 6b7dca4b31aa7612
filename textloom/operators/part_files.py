"""Part files by number: consecutive runs, gaps, conflicts (SRC4, SRC5, FLT16, FLT17, FOLD7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def part_number(name: Column, stem: Column, suffix: Column) -> Column:
    """SRC4: the number of `<stem>S###<suffix>` with exactly three digits, or null."""
    digits = F.substr(name, F.length(stem) + 2, F.lit(3))
    fits = F.startswith(name, F.concat(stem, F.lit("S"))) & F.endswith(name, suffix) & (F.length(name) == F.length(stem) + 4 + F.length(suffix)) & F.regexp_like(digits, F.lit(r"\A[0-9]{3}\z"))
    return F.when(fits, digits.cast("int"))


def numbered(frame: DataFrame, stem: str, number: str) -> DataFrame:
    """SRC5, FLT16: in_run tells the run 1, 2, ... up to the first miss, orphan what lies behind it; number 0 is neither."""
    place = F.row_number().over(Window.partitionBy(stem).orderBy(number))
    own = frame.where(F.col(number) > 0).withColumn("_place", place)
    return own.withColumns({"in_run": F.col(number) == F.col("_place"), "orphan": F.col(number) > F.col("_place")}).drop("_place")


def run_summary(frame: DataFrame, stem: str, number: str) -> DataFrame:
    own = numbered(frame, stem, number)
    orphans = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("orphan"), F.col(number)))), lambda n: F.lpad(n.cast("string"), 3, "0")), ",")
    return own.groupBy(stem).agg(F.count_if("in_run").alias("run_length"), F.count_if("orphan").alias("n_orphans"), orphans.alias("orphans"))


def conflicts(existing: DataFrame, expected: DataFrame, stem: str, number: str, count: str) -> DataFrame:
    """FLT17, SET2: existing numbers beyond the expected count of suffix parts; a stem that expects none has none to keep."""
    return existing.join(expected, stem, "left").where(F.col(number) > F.coalesce(F.col(count), F.lit(0))).select(stem, number)
