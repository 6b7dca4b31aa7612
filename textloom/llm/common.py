"""Shared plumbing: scratch tables in the cluster's shared folder, and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: A word, for Java's and RE2's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; in a local session that names none (tests), a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.conf.get("textloom.scratch", None)
    if root is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("textloom.scratch", root)
    return root


class Scratch:
    """Written intermediate tables: they cut lineage, so a lost executor costs a re-read and no recomputation."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path = spark, f"{scratch_root(spark)}/textloom/{tag}-{uuid.uuid4().hex}"

    def where(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, frame: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        frame.write.mode("overwrite").option("compression", codec).parquet(self.where(name))
        return self.spark.read.schema(frame.schema).parquet(self.where(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.where(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Arrow batches small enough for long texts in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def rarer(column, wanted: int, total: int):
    """Holds for about a quarter more than `wanted` of `total` rows, by a 64-bit hash column: a sample without a sort."""
    share = min(1.0, (1.25 * wanted + 50) / max(1, total))
    return F.pmod(column, F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))


def parts(total: float, each: float, least: int = 1) -> int:
    """So many pieces of at most `each`."""
    return max(least, int(-(-total // each)))


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BYTE[_SPACE] = 0
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(n: int) -> np.ndarray:
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        p = np.full(size, _MULT, np.uint64)
        p[0] = 1
        _powers[size] = np.cumprod(p)
    return _powers[size]


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts (A-Z lowered), and where each text's words begin (one more entry than texts).

    Null and empty texts have no words. Work and memory are linear in the bytes.
    """
    blobs = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    sizes = np.fromiter((len(b) + 1 for b in blobs), np.int64, len(blobs))
    raw = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    space = _SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    ends_of_text = np.concatenate([[0], np.cumsum(sizes)])
    bounds = np.searchsorted(starts, ends_of_text)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    word_of = np.cumsum(begins)
    word_of[: starts[0]] = 1
    word_of -= 1
    offset = np.arange(len(raw)) - starts[word_of]
    np.maximum(offset, 0, out=offset)
    offset[space] = 0
    values = _BYTE[raw] * powers(int(offset.max()) + 1)[offset]
    return mix(np.add.reduceat(values, starts)), bounds


def batches(texts: list, most: int = 1 << 21):
    """Ranges of texts of about `most` characters, so that vector work stays small; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def whole_groups(stream, keys: list[str]):
    """Of batches sorted by integer key columns: tables of whole groups, and where each group begins (with the end of the last)."""
    held = None
    for batch in stream:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        values = [table.column(k).to_numpy() for k in keys]
        starts = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
        held = table.slice(starts[-1])
    if held is not None:
        yield held, np.array([0, held.num_rows])
