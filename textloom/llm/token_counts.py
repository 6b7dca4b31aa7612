"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is merged once to prove whether it encodes alone as one token. Over the
corpus, a pre-token found among the proven ones counts one directly; only the rest go through the merges.
One map-side pass, no shuffle: each executor streams Arrow batches and holds a bounded table of runs.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; extra
columns are ignored; an empty table gives an empty result; texts are counted whole whatever their length.
"""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common, vocab

OVER = 2048


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; the vocabulary (of fixed size) is read on the driver and broadcast."""
    spark = docs.sparkSession
    common.tidy(spark)
    spec = Path(tokenizer_path).read_text()
    shared = spark.sparkContext.broadcast((spec, vocab.prove_whole(spec)))

    def count(stream):
        counter = vocab.worker(vocab.Counter, *shared.value)
        for batch in stream:
            texts = batch.column("text").fill_null("")
            n = pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
