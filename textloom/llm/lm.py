"""LM scoring by a log-bilinear model with noise-contrastive estimation.

Words fall into classes: the FREQUENT most frequent ones and the end each their own, the others TAIL classes
by their last letters. The model gives the next class from the class before it: logits are products of
context and class vectors, trained in numpy to tell the corpus's class pairs from noise (in expectation over
the noise), and normalised by one product over all contexts and classes. A word in a tail class has its
smoothed share of the class, so token probabilities are normalised as the base's are.

All statistics cover every training text. Word counts: partial counts in each task, summed by word. Class
pairs: at most (FREQUENT + TAIL + 1)**2 cells, whatever the corpus. Scores: the KNOWN most frequent words'
counts are broadcast; the rarer words of each text are joined with the counts by word and summed by row.

Defined results: null and empty texts are one end token; rows of equal doc_id are rows of their own; a null
doc_id trains and scores like any other (as the empty string); words of equal count are ordered by their bytes, at the
limit of KNOWN by hash; a text of any length is scored whole, in one task; extra columns are ignored, whatever their
names; with no training text every base score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FREQUENT, TAIL, KNOWN = 511, 128, 50_000
DIM, NOISE, STEPS, RATE = 16, 10, 400, 0.05
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: The end of a text; no word holds white space.
END = b"\n"


def words_of(text: str | None) -> list[bytes]:
    """A-Z lowered, cut at the six ASCII white-space bytes (those that bytes.split cuts at)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes) -> int:
    return FREQUENT + 1 + zlib.crc32(word[-3:]) % TAIL


class Slots(dict):
    """Word -> slot: a known word's own, else that of its tail class, after the known ones."""

    def __init__(self, known: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(known))
        self.rare = len(known) - FREQUENT - 1

    def __missing__(self, word: bytes) -> int:
        return self.rare + tail_class(word)


def count_words(docs: DataFrame) -> DataFrame:
    """word, c over the given texts, an end for each."""

    def run(stream):
        held: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in stream:
            for text in batch.column("text").to_pylist():
                held.update(words_of(text))
            held[END] += batch.num_rows
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("c"))


def train(pairs: np.ndarray) -> np.ndarray:
    """log10 probabilities (contexts x classes) from counts of pairs; noise-contrastive estimation with Adam.

    The noise is the smoothed distribution of classes. Its NOISE samples for each pair enter by their expectation.
    """
    contexts, classes = pairs.shape
    rng = np.random.default_rng(5)
    freq = pairs.sum(0) + 0.5
    noise = freq / freq.sum()
    p = [rng.standard_normal((contexts, DIM)) * 0.1, rng.standard_normal((classes, DIM)) * 0.1, np.log(noise)]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    total = pairs.sum(1, keepdims=True)
    per = np.maximum(total, 1) ** 0.5  # rare contexts learn too
    shift = np.log(NOISE * noise)
    for step in range(1, (STEPS if total.sum() else 0) + 1):
        real = 1 / (1 + np.exp(-np.clip(p[0] @ p[1].T + p[2] - shift, -40, 40)))
        d = (NOISE * total * noise * real - pairs * (1 - real)) / per
        grad = [d @ p[1] / contexts + 1e-4 * p[0], d.T @ p[0] / contexts + 1e-4 * p[1], d.sum(0) / contexts]
        for x, g, m, v in zip(p, grad, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    logits = p[0] @ p[1].T + p[2]
    logits -= logits.max(1, keepdims=True)
    return (logits - np.log(np.exp(logits).sum(1, keepdims=True))) / np.log(10)


def fit(docs: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, dict]:
    """docs: the training texts. Gives the table of counts, and the model: known words and their counts, class table, class totals, N and V."""
    spark = docs.sparkSession
    counts = scratch.table(count_words(docs), "counts")
    # the KNOWN most frequent words, by eighths of a doubling of their counts; of the last such step, those of least hashes
    level, words = F.floor(F.log2("c") * 8), counts.where(F.col("word") != END)
    levels = sorted(((r.l, r.n) for r in words.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()), reverse=True) or [(0, 0)]
    reach = np.cumsum([n for _, n in levels])
    at = min(int(np.searchsorted(reach, KNOWN)), len(levels) - 1)
    least, n = levels[at]
    near = words.where((level > least) | ((level == least) & common.rarer(F.xxhash64("word"), KNOWN - int(reach[at]) + n, n)))
    top = sorted(near.collect(), key=lambda r: (-r.c, bytes(r.word)))[:KNOWN]
    known = [END] + [bytes(r.word) for r in top]
    c = {bytes(r.word): r.c for r in top}
    ends = counts.where(F.col("word") == END).collect()
    c[END] = ends[0].c if ends else 0
    while len(known) <= FREQUENT:  # a small vocabulary: slots that no word names
        known.append(b"\n" + str(len(known)).encode())
    classes = FREQUENT + 1 + TAIL
    frequent = frozenset(known[: FREQUENT + 1])

    def by_class(stream):
        n, v = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for batch in stream:
            for word, k in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), strict=True):
                if word not in frequent:
                    i = tail_class(word)
                    n[i] += k
                    v[i] += 1
        kept = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(n[kept]), pa.array(v[kept])], ["class", "n", "v"])

    totals = {r["class"]: (r.n, r.v) for r in counts.mapInArrow(by_class, "class int, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    shared = spark.sparkContext.broadcast(known)

    def pair(stream):
        slots = Slots(shared.value)
        of = class_of_slots(shared.value)
        sums = np.zeros((classes, classes), np.int64)
        for batch in stream:
            ids: list[int] = [0]
            for text in batch.column("text").to_pylist():
                ids += map(slots.__getitem__, words_of(text))
                ids.append(0)
            seq = of[np.array(ids)]
            sums += np.bincount(seq[:-1] * classes + seq[1:], minlength=classes * classes).reshape(classes, classes)
        a, b = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sums[a, b])], ["a", "b", "n"])

    pairs = np.zeros((classes, classes))
    cells = docs.select("text").mapInArrow(pair, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    pairs[cells["a"].to_numpy(), cells["b"].to_numpy()] = cells["n"].to_numpy()
    share = np.zeros(classes)  # log10 of each tail class's smoothed total
    for i in range(FREQUENT + 1, classes):
        n, v = totals.get(i, (0, 0))
        share[i] = np.log10(n + 0.5 * (v + 1))
    return counts, {"known": known, "c": [c.get(w, 0) for w in known], "table": train(pairs), "share": share, "n": whole.n or 0, "v": whole.v or 0}


def class_of_slots(known: list[bytes]) -> np.ndarray:
    """The class of each slot: the first FREQUENT + 1 known words their own, the others and the rare slots a tail class."""
    later = np.array([tail_class(w) for w in known[FREQUENT + 1 :]], np.int64)
    return np.concatenate([np.arange(FREQUENT + 1), later, FREQUENT + 1 + np.arange(TAIL)])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    spark = docs.sparkSession
    common.tidy(spark)
    scratch = common.Scratch(spark, "lm")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc % 5 == 1).alias("held_out"))
    counts, model = fit(rows.where("not held_out"), scratch)
    shared = spark.sparkContext.broadcast(model)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, modelled double, rare array<binary>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(stream):
        m = shared.value
        slots, of = Slots(m["known"]), class_of_slots(m["known"])
        known_c = np.concatenate([np.array(m["c"], np.int64), np.zeros(TAIL, np.int64)])
        log_c = np.log10(known_c + 0.5)
        first_rare = len(m["known"])
        log_c[first_rare:] = 0
        tail = of > FREQUENT
        extra = np.where(tail, log_c - m["share"][of], 0.0)
        total = np.log10(m["n"] + 0.5 * (m["v"] + 1))
        table = m["table"]
        for batch in stream:
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                ids = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
                ids = np.append(ids, 0)
                seq = of[ids]
                before = np.concatenate([[0], seq[:-1]])
                rare = np.flatnonzero(ids >= first_rare)
                for o, value in zip(out, (len(ids), int((known_c[ids] > 0).sum()), float(log_c[ids].sum() - len(ids) * total), float(table[before, seq].sum() + extra[ids].sum()), [words[i] for i in rare.tolist()]), strict=True):
                    o.append(value)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("held_out"), *(pa.array(o, t) for o, t in zip(out, types, strict=True))], names)

    scored = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode("rare").alias("word"))
    found = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0).cast("long")) + 0.5)).alias("rare_log"), F.count("c").alias("rare_known"))
    joined = scored.drop("rare").join(found, "row", "left")
    more = F.coalesce("rare_log", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(int(model["n"])).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("modelled") + more).alias("score"),
    )
