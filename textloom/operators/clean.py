"""Cleaning: documents to filtered sentences (ORC8 to ORC10, STR22). Row-local, so there is no shuffle at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import sentences as S
from ..functions import text as T

MIN_WORDS = 3


def spread(frame: DataFrame) -> DataFrame:
    """Enough partitions for the cores where a small file came as fewer; larger inputs stay as they were split."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def split_sentences(c: Column) -> Column:
    """GEN4 of a column of a frame: by batches, by expression where these leave a text."""
    return F.coalesce(S.split_sentences(c), T.split_sentences(c))


def sentences(frame: DataFrame, column: str = "text") -> DataFrame:
    """GEN4: sent_no and sentence for each sentence, beside the other columns but the text."""
    rest = [c for c in frame.columns if c != column]
    return frame.select(*rest, F.posexplode(split_sentences(F.col(column))).alias("sent_no", "sentence"))


def kept(sentence: Column, min_words: int | Column = MIN_WORDS) -> Column:
    """FLT9 and FLT10, the cheap test last as it is seldom decisive."""
    return ~T.should_drop(sentence) & (T.significant_words(sentence) >= min_words)


def clean_sentences(frame: DataFrame, column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The flagship: symbols stripped, sentences cut, dropped or kept, with the significant words of each."""
    rest = [c for c in frame.columns if c != column]
    found = T.split_sentences(T.strip_symbols(T.fold_newlines(F.col(column))))
    counted = F.transform(found, lambda s, i: F.struct(i.alias("sent_no"), s.alias("sentence"), T.significant_words(s).alias("n_sig")))
    slow = F.filter(counted, lambda x: (x["n_sig"] >= min_words) & ~T.should_drop(x["sentence"]))
    # CR, LF and CRLF end lines all the same
    return frame.select(*rest, F.inline(F.coalesce(S.counted_sentences(F.col(column), min_words, symbols=True), slow)))


def kept_rows(frame: DataFrame, rest: list[str], value: Column, keep) -> DataFrame:
    """The columns `rest` and the fields of a struct, of rows where keep(struct) holds.

    The struct is computed once, where the rows lie: a filter on its fields would be pushed below the exchange of spread()
    and compute all of it there a second time, on the few tasks that read the file.
    """
    return frame.select(*rest, F.inline(F.filter(F.array(value), keep)))


def good_sentences(c: Column, min_words: int = MIN_WORDS) -> Column:
    """The sentences of a text that stay, as an array: what ORC9 keeps, for use within one expression."""
    return F.filter(T.split_sentences(c), lambda s: kept(s, min_words))


def filter_normalized(frame: DataFrame, column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """ORC9: column becomes one sentence a line; `error` tells empty_input, no_sentences or all_filtered (then the column is null)."""
    def judged(own):
        return T.let(F.filter(own, lambda s: kept(s, min_words)), lambda good: F.struct(
            F.when(F.size(own) == 0, "no_sentences").when(F.size(good) == 0, "all_filtered").alias("error"), F.array_join(good, "\n").alias("text")))

    blank = F.coalesce(T.is_blank(F.col(column)), F.lit(True))
    none = F.struct(F.lit("empty_input").alias("error"), F.lit("").alias("text"))
    slow = T.let(T.split_sentences(F.col(column)), judged)
    result = F.when(blank, none).otherwise(F.coalesce(S.filtered_text(F.col(column), min_words), slow))
    # made by a generator, so that no filter on the error is pushed into the computing
    made = frame.select("*", F.inline(F.array(result)).alias("_error", "_text"))
    return made.withColumn("error", F.col("_error")).withColumn(column, F.when(F.col("_error").isNull(), F.col("_text"))).drop("_error", "_text")


def clean_text(frame: DataFrame, column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """ORC8: repair, normal form, symbols, forum lines, subtitles, sentences. Adds `error`; a bad document never ends the job."""
    blank = F.coalesce(T.is_blank(F.col(column)), F.lit(True))
    repaired = codec.repair_mojibake(frame.withColumn("_empty", blank).withColumn(column, T.fold_newlines(F.col(column))), column)
    stripped = repaired.withColumn(column, T.strip_symbols(codec.nfc(F.col(column))))
    plain = stripped.withColumn(column, T.strip_forum(F.col(column)))
    plain = plain.withColumn(column, T.strip_subtitles_if_needed(F.col(column)))
    out = filter_normalized(plain, column, min_words)
    return out.withColumn("error", F.when(F.col("_empty"), "empty_input").otherwise(F.col("error"))).drop("_empty")


def normalize_batch(frame: DataFrame, column: str = "text") -> DataFrame:
    """Subsystem B: brackets and symbols first, then all of clean_text."""
    return clean_text(frame.withColumn(column, T.preprocess(T.fold_newlines(F.col(column)))), column)


def batch_summary(frame: DataFrame) -> DataFrame:
    """AG8: frame has `changed` and `error`; one row of files, changed, unchanged, failed."""
    failed = F.count_if(F.col("error").isNotNull())
    changed = F.count_if(F.col("changed") & F.col("error").isNull())
    return frame.agg(F.count("*").alias("files"), changed.alias("changed"), (F.count("*") - changed - failed).alias("unchanged"), failed.alias("failed"))


