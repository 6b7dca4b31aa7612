"""Length-ratio validation, outcomes and estimates (AG2, AG8 to AG12, FLT15, FLT18, FLT19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Bounds of the ratio; seconds of one part and between starts.
LEAST, MOST = 0.60, 1.40
PART_SECONDS, PAUSE_SECONDS = 156.0, 2.2


def ratio_columns(source: Column, translated: Column) -> dict[str, Column]:
    """AG2: source_size, translated_size, ratio, status; an empty source has status zero_source and no ratio."""
    a, b = T.non_blank_size(source), T.non_blank_size(translated)
    ratio = F.when(a > 0, b / F.nullif(a, F.lit(0).cast("long")))
    status = F.when(a == 0, "zero_source").when(ratio < LEAST, "too_short").when(ratio > MOST, "too_long").otherwise("ok")
    return {"source_size": a, "translated_size": b, "ratio": ratio, "status": status}


def validate(frame: DataFrame, source: str, translated: str) -> DataFrame:
    return frame.withColumns(ratio_columns(F.col(source), F.col(translated)))


def changed(before: Column, after: Column) -> Column:
    """FLT18: fingerprints differ; a missing one after counts as unchanged."""
    return after.isNotNull() & ~before.eqNullSafe(after)


def ready(before: Column, after: Column, status: Column) -> Column:
    """FLT19."""
    return changed(before, after) & (status == "ok")


def estimate(frame: DataFrame, parts: str = "part_count") -> DataFrame:
    """AG12: pauses and expected seconds of so many parts."""
    pauses = F.greatest(F.col(parts) - 1, F.lit(0))
    return frame.withColumns({
        "launch_pause_count": pauses, "launch_pause_seconds": pauses * PAUSE_SECONDS, "sample_part_seconds": F.lit(PART_SECONDS),
        "estimated_wall_seconds": PART_SECONDS + pauses * PAUSE_SECONDS, "estimate_text": T.format_seconds(PART_SECONDS + pauses * PAUSE_SECONDS),
    })


def start_times(frame: DataFrame, part_no: str = "part_no") -> DataFrame:
    """FOLD8 as a plan: when each part starts if starts are paced."""
    return frame.withColumn("start_seconds", (F.col(part_no) - 1) * PAUSE_SECONDS)


def outcome_summary(outcomes: DataFrame, by: str) -> DataFrame:
    """AG9, AG11: total, ok, failed, all_ok, and the failed parts with reasons in order, for each group."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("part_number", "reason"))))
    text = F.array_join(F.transform(failed, lambda x: F.concat(x["part_number"].cast("string"), F.lit(": "), x["reason"])), "; ")
    return outcomes.groupBy(by).agg(F.count("*").alias("total"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.bool_and("ok").alias("all_ok"), text.alias("failures"))
