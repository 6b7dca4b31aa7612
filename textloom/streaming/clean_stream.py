"""The same cleaning over a stream of documents: row-local, so it needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import clean


def read(spark: SparkSession, path: str, schema: StructType, files_each: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def start(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Clean sentences of each new document, appended once; takes what there is and ends."""
    found = clean.clean_sentences(docs)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
