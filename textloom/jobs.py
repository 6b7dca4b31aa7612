"""Whole jobs over files: cleaning in place, splitting, merging, the site (ORC1, ORC2, ORC6, ORC11, ORC12, SNK1 to SNK5, SNK7, SNK8, AG8 to AG12).

A job returns its report (a DataFrame) and its exit status. What a file gave is written as a table in `work`, a shared
folder, before anything is overwritten: what is written next comes from there, not from files that the job has changed.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import catalog, clean, pack, part_files, regroup, transform, validate
from .sources import text_files

NUMBERED = r"^(.*)S([0-9]{3})(\.[^./]*)$"


def _kept(frame: DataFrame, work: str) -> DataFrame:
    where = f"{work}/{uuid.uuid4().hex}"
    frame.write.parquet(where)
    return frame.sparkSession.read.schema(frame.schema).parquet(where)


def clean_files(spark: SparkSession, paths: list[str], work: str, recursive: bool = False, min_words: int = clean.MIN_WORDS, bracketed: bool = False) -> tuple[DataFrame, int]:
    """ORC11: cleans files in place, each on its own: path, status (changed, unchanged, failed), error. Status 1 where a file failed or none counts.

    bracketed: brackets and symbols go first (SNK2).
    """
    found = text_files.read(spark, paths, recursive)
    own = found.where("error is null").select("path", "text", "place").withColumn("was", F.col("text"))
    cleaned = clean.clean_text(own.withColumn("text", T.preprocess(F.col("text"))) if bracketed else own, min_words=min_words)
    done = cleaned.select("path", "place", "error", F.concat("text", F.lit("\n")).alias("text"), "was")
    bad = found.where("error is not null").select("path", "place", "error", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("was"))
    result = _kept(done.unionByName(bad).withColumn("changed", F.coalesce(F.col("error").isNull() & (F.col("text") != F.col("was")), F.lit(False))).drop("was"), work)
    written = _kept(text_files.write_files(result.where("changed")), work).withColumnRenamed("error", "failed")
    report = result.drop("text").join(written, "path", "left").withColumn("error", F.coalesce("error", "failed")).drop("failed")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("changed"), "changed").otherwise("unchanged")
    report = report.select("place", "path", status.alias("status"), "error")
    total = clean_summary(report).first()
    return report.orderBy("place", "path").drop("place"), int(total["files"] == 0 or total["failed"] > 0)


def clean_summary(report: DataFrame) -> DataFrame:
    """AG8 of a report: files, changed, unchanged, failed."""
    return clean.batch_summary(report.select((F.col("status") == "changed").alias("changed"), "error"))


def _numbered(files: DataFrame) -> DataFrame:
    """Files with the source they are a part of (path of number 0), and their number."""
    n = F.regexp_extract("path", NUMBERED, 2)
    source = F.when(n == "", F.col("path")).otherwise(F.concat(F.regexp_extract("path", NUMBERED, 1), F.regexp_extract("path", NUMBERED, 3)))
    return files.withColumns({"number": F.when(n == "", 0).otherwise(n.cast("int")), "source": source})


def split_files(spark: SparkSession, paths: list[str], work: str, **limits: int) -> tuple[DataFrame, int]:
    """SNK3: each source over its parts: the first in its place, others beside it as S###. Gives source, n_parts, error.

    A source without parts, or with more part files beside it than it now gives (FLT17), is left as it is, with an error.
    """
    report, _, status = _split(spark, text_files.read(spark, paths), work, limits)
    return report, status


def _split(spark: SparkSession, found: DataFrame, work: str, limits: dict[str, int]) -> tuple[DataFrame, DataFrame, int]:
    """found: path, text, error. The report of split_files, the parts, and the status."""
    parts = _kept(pack.parts(found.where("error is null").select(F.col("path").alias("source"), "text"), path=F.col("source"), **limits), work)
    made = parts.groupBy("source").agg(F.max("part_no").alias("n_parts"))
    folders = [r[0] for r in found.select(F.regexp_replace("path", "/[^/]*$", "").alias("d")).distinct().collect()]  # folders, not files
    beside = _numbered(text_files.listed(spark, folders).select("path")).where("number > 0") if folders else None
    report = found.select(F.col("path").alias("source"), F.col("error").alias("bad")).join(made, "source", "left")
    if beside is not None:
        over = part_files.conflicts(beside, made.select("source", (F.col("n_parts") - 1).alias("expected")), "source", "number", "expected").groupBy("source").agg(F.min("number").alias("over"))
        report = report.join(over, "source", "left")
    else:
        report = report.withColumn("over", F.lit(None).cast("int"))
    report = _kept(report.select("source", F.coalesce("n_parts", F.lit(0)).alias("n_parts"), F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("n_parts").isNull(), "no_parts").when(F.col("over").isNotNull(), "conflict").alias("error")), work)
    fine = parts.join(report.where("error is null").select("source"), "source", "left_semi")
    written = _kept(text_files.write_files(fine, "part_path", "part_text"), work).where("error is not null")
    failed = written.join(parts.select("source", F.col("part_path").alias("path")), "path").groupBy("source").agg(F.min("error").alias("failed"))
    report = report.join(failed, "source", "left").select("source", "n_parts", F.coalesce("error", "failed").alias("error"))
    return report, parts, int(bool(report.where("error is not null").limit(1).count()))


def translate_files(
    spark: SparkSession, source: str, context: str, template: str, run: Callable[[str, str], str], work: str,
    pause: float = validate.PAUSE_SECONDS, limit: float | None = None, say: Callable[[str], None] = print, **limits: int,
) -> int:
    """ORC1, ORC2: a source is cleaned and split over its part files, and each part goes through `run`, given its request (STR19) and text.

    A part that succeeds is written over; one that fails keeps what the split gave it. Says the estimate (AG12), a line for
    each part and the summary (AG11). Status 1 where the context, the source or a part fails. template: the path of the instructions.
    """
    try:
        prompt, wrong = T.system_prompt(F.lit(context), text_files.load_text(spark, template))
        wrong = spark.range(1).select(wrong.alias("wrong")).first().wrong
        if wrong:
            raise ValueError(wrong)
        found = text_files.read(spark, [source]).select("path", "text", "error")
        cleaned = clean.clean_text(found.where("error is null").select("path", "text")).select("path", "text", "error")
        report, parts, status = _split(spark, cleaned.unionByName(found.where("error is not null")), work, limits)
        if status:
            raise ValueError(report.where("error is not null").first().error)
    except (FileNotFoundError, ValueError) as error:
        say(f"failed: {error}")
        return 1
    parts = parts.select(F.col("part_no").cast("int").alias("part_number"), F.col("part_path").alias("path"), F.col("part_text").alias("text"))
    estimate = validate.estimate(parts.agg(F.count("*").alias("part_count"))).first()
    say(f"{estimate.part_count} parts, {estimate.launch_pause_count} pauses, about {estimate.estimate_text}")
    made = _kept(transform.transform_parts(parts.withColumn("request", T.user_message(F.col("path"), prompt)), run, limit=limit, pause=pause), work)
    written = _kept(text_files.write_files(made.where("ok")), work)
    unwritten = written.where("error is not null").select("path", F.col("error").alias("bad"))
    outcomes = made.join(unwritten, "path", "left").select("part_number", "path", (F.col("ok") & F.col("bad").isNull()).alias("ok"), F.coalesce("bad", "reason").alias("reason"))
    for row in outcomes.orderBy("part_number").toLocalIterator():
        say(f"{row.part_number} - {'done' if row.ok else f'fail ({row.reason})'}.")
    summary = validate.outcome_summary(outcomes.withColumn("source", F.lit(source)), "source").first()
    say(f"{summary.total} parts, {summary.n_ok} done, {summary.n_failed} failed")
    return int(not summary.all_ok)


def merge_files(spark: SparkSession, paths: list[str], work: str) -> tuple[DataFrame, int]:
    """ORC6, SNK4, AG10: sources and their parts 1, 2, ... become one text in the source's place; then the part files go.

    Gives source, n_parts (merged), n_deleted, error (no_source, gap: a part behind a missing one, invalid_utf8, empty).
    """
    own = _numbered(text_files.read(spark, paths).select("path", "text", "error"))
    place = F.expr("number = row_number() over (partition by source order by number) - 1")
    own = _kept(own.withColumn("in_run", place), work)
    bad = F.when(F.max(F.col("number") == 0) == F.lit(False), "no_source").when(F.bool_and("in_run") == F.lit(False), "gap").otherwise(F.min("error"))
    judged = own.groupBy("source").agg(bad.alias("error"))
    merged = regroup.merge_parts(own.join(judged.where("error is null").select("source"), "source", "left_semi"), "source", "number", "text")
    merged = _kept(judged.join(merged, "source", "left").select("source", "n_parts", "merged", F.coalesce("error", F.when(F.col("merged").isNull(), "empty")).alias("error")), work)
    written = _kept(text_files.write_files(merged.where("error is null"), "source", "merged"), work)
    gone = own.where("number > 0").join(written.where("error is null").select(F.col("path").alias("source")), "source", "left_semi").select("path", "source")
    deleted = _kept(text_files.delete_files(gone), work).join(gone, "path").groupBy("source").agg(F.count_if(F.col("error").isNull()).alias("n_deleted"), F.min("error").alias("undeleted"))
    failed = written.select(F.col("path").alias("source"), F.col("error").alias("unwritten"))
    report = merged.join(failed, "source", "left").join(deleted, "source", "left")
    report = report.select("source", F.coalesce("n_parts", F.lit(0)).alias("n_parts"), F.coalesce("n_deleted", F.lit(0).cast("long")).alias("n_deleted"), F.coalesce("error", "unwritten", "undeleted").alias("error"))
    return report, int(bool(report.where("error is not null").limit(1).count()))


def update_site(spark: SparkSession, root: str, work: str, say: Callable[[str], None] = print) -> int:
    """ORC12: pages of the folders under root/sources, without those whose folder is gone, and the list in root/index.html."""
    try:
        index = text_files.load_text(spark, f"{root}/index.html")
    except (FileNotFoundError, ValueError) as error:
        say(f"no index: {error}")
        return 1
    sources, system = text_files._hadoop(spark, f"{root}/sources")
    base = len(system.makeQualified(text_files._hadoop(spark, root)[0]).toUri().getPath()) + 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/sources").select(F.substring(F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", ""), base + 1, 1 << 30).alias("path")) if system.exists(sources) else None
    if files is None:
        files = spark.createDataFrame([], "path string")
    found = _kept(catalog.items(files), work)
    folders = [s.getPath().getName() for s in system.listStatus(sources) if s.isDirectory()] if system.exists(sources) else []  # names of one folder's entries
    pages, place = text_files._hadoop(spark, f"{root}/Pages")
    place.mkdirs(pages)
    old = [s.getPath().getName()[:-5] for s in place.listStatus(pages) if s.getPath().getName().endswith(".html")]
    stale = catalog.obsolete(spark.createDataFrame([(x,) for x in old], "stem string"), spark.createDataFrame([(x,) for x in folders], "name string"))
    text_files.delete_files(stale.select(F.concat(F.lit(f"{root}/Pages/"), "stem", F.lit(".html")).alias("path"))).collect()
    written = _kept(text_files.write_files(catalog.pages(found).select(F.concat(F.lit(f"{root}/"), "page_path").alias("path"), F.col("html").alias("text"))), work)
    listing = catalog.index_list(found)
    new, error = catalog.splice(F.lit(index), F.col("list_html"))
    told = listing.select("groups", "items", new.alias("text"), error.alias("error"), F.lit(f"{root}/index.html").alias("path")).first()
    if told.error:
        say(f"index left as it is: {told.error}")
        return 1
    text_files.write_files(spark.createDataFrame([(told.path, told.text)], "path string, text string")).collect()
    failed = written.where("error is not null").count()
    say(f"{told.groups} groups, {told['items']} files, {written.count() - failed} pages, {failed} failed")
    return int(failed > 0)


def main(argv: list[str] | None = None) -> int:
    """Command line: clean, split or merge files, or update a site; prints the report and returns the exit status."""
    import argparse

    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser(prog="textloom")
    parser.add_argument("job", choices=["clean", "normalize", "split", "merge", "site"])
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--recursive", action="store_true")
    parser.add_argument("--min-words", type=int, default=clean.MIN_WORDS)
    parser.add_argument("--work", required=True, help="a folder that driver and executors share")
    parser.add_argument("--root", default=os.getcwd(), help="what relative paths are relative to")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    paths = [text_files.resolve(x, args.root) for x in args.paths]
    if args.job == "site":
        return max(update_site(spark, x, args.work) for x in paths)
    try:
        if args.job in ("clean", "normalize"):
            report, status = clean_files(spark, paths, args.work, args.recursive, args.min_words, args.job == "normalize")
        else:
            report, status = (split_files if args.job == "split" else merge_files)(spark, paths, args.work)
    except FileNotFoundError as error:
        print(f"missing: {error}")
        return 1
    for row in report.toLocalIterator():
        print(*(x for x in row if x is not None), sep="\t")
    return status


if __name__ == "__main__":
    raise SystemExit(main())
