"""Text files: strict UTF-8 reading, staged writing and deleting (SRC1, SRC2, SRC6, SRC7, SRC9, SNK1 to SNK4, SNK7).

Contents never pass the driver: files are read by Spark, and written by tasks through the file system that their path
names. A file is written beside its place and moved there, so a task that is tried again leaves it whole.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

DONE = "path string, error string"


def resolve(path: str, root: str) -> str:
    """SRC9: ~ and absolute paths (and those with a scheme) stand, others are relative to the root."""
    path = os.path.expanduser(path)
    return path if "://" in path or os.path.isabs(path) else os.path.join(root, path)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def load_text(spark: SparkSession, path: str) -> str:
    """SRC6, SRC7: one small file, a template; missing or blank is an error."""
    where, system = _hadoop(spark, path)
    if not system.exists(where):
        raise FileNotFoundError(path)
    text = spark.read.text(path, wholetext=True).first()
    if text is None or not text[0].strip():
        raise ValueError(f"{path} is blank")
    return text[0]


def listed(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """SRC1, SRT1: path, size, content, place (of the argument that first named the file) of the files that count.

    A directory gives its *.txt, by case; a file that is named counts if its suffix is .txt in any case. A missing path is an error.
    """
    none = spark.createDataFrame([], "path string, size long, content binary, place int")
    found = []
    for place, path in enumerate(map(os.path.expanduser, paths)):
        where, system = _hadoop(spark, path)
        if not system.exists(where):
            raise FileNotFoundError(path)
        reader = spark.read.format("binaryFile")
        if system.getFileStatus(where).isDirectory():
            own = reader.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", recursive).load(path)
        elif path.lower().endswith(".txt"):
            own = reader.load(path)
        else:
            continue
        own = own.select("path", F.col("length").alias("size"), "content")
        # Spark reads no rows from empty files; its listing, which the driver holds anyway, names them
        names = [(unquote(x).replace("file:///", "file:/", 1),) for x in own.inputFiles()]
        empty = spark.createDataFrame(names, "path string").join(own.select("path"), "path", "left_anti")
        own = own.unionByName(empty.select("path", F.lit(0).cast("long").alias("size"), F.lit(b"").alias("content")))
        found.append(own.withColumn("place", F.lit(place)))
    if not found:
        return none
    every = reduce(DataFrame.unionByName, found)
    return every if len(found) == 1 else every.groupBy("path").agg(F.min_by(F.struct("size", "content"), "place").alias("f"), F.min("place").alias("place")).select("path", "f.*", "place")


def read(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """SRC2: path, size, text, error (invalid_utf8), place of the files that count, each once. Order by place, path for the reference order."""
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return listed(spark, paths, recursive).select("path", "size", F.when(valid, T.fold_newlines(text)).alias("text"), F.when(~valid, "invalid_utf8").alias("error"), "place")


def changed_only(before: DataFrame, after: DataFrame, key: str = "path", column: str = "text") -> DataFrame:
    """SNK1: rows whose cleaned text with a final newline differs from what was read; rows with an error are left out."""
    old = before.select(key, F.col(column).alias("_old"))
    new = F.concat(F.col(column), F.lit("\n"))
    return after.where(F.col("error").isNull()).join(old, key).where(new != F.col("_old")).withColumn(column, new).drop("_old")


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_files(frame: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Writes each row's text, UTF-8 with its newlines as they are, over the file at its path. Gives path, error; a bad file never ends the job."""

    def run(stream):
        for batch in stream:
            errors: list = []
            for where, content in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    system, at = _at(where)
                    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(staged := f"{at}.{uuid.uuid4().hex}.part") as out:
                        out.write(content.encode())
                    system.move(staged, at)
                    errors.append(None)
                except (OSError, ValueError) as error:
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(errors, pa.string())], ["path", "error"])

    return frame.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(run, DONE)


def delete_files(frame: DataFrame, path: str = "path") -> DataFrame:
    """Deletes the files; one that is gone already counts as deleted. Gives path, error."""

    def run(stream):
        for batch in stream:
            errors: list = []
            for where in batch.column("path").to_pylist():
                try:
                    system, at = _at(where)
                    if system.get_file_info(at).type == fs.FileType.File:
                        system.delete_file(at)
                    errors.append(None)
                except OSError as error:
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(errors, pa.string())], ["path", "error"])

    return frame.select(F.col(path).alias("path")).mapInArrow(run, DONE)


def write_parts(parts: DataFrame, path: str) -> None:
    """SNK3 as a table: to a new place, committed by Spark as a whole, so retried tasks leave nothing twice."""
    if not parts.limit(1).count():
        raise ValueError("no parts to write")
    parts.write.mode("errorifexists").parquet(path)
