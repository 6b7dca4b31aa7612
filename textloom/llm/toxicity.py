"""Toxicity by a bidirectional gated recurrent network with attention pooling (see gru.py).

Every text is cut into windows of WINDOW words, each overlapping the last by a quarter; all windows are scored,
and the text's score is that of its worst window. A run of over LONGEST characters (a script without blanks, a URL)
counts as many words: overlapping pieces of PIECE characters, to its end. Training: at most PER_CLASS labelled rows of each class
(those of the least hashes, of up to TRAIN_CHARS characters), from the windows that look most telling; labels, language,
source and ids are never inputs. Scoring is one map-side pass; a worker holds a bounded table of words.

Defined results: null and empty texts are one empty window and score low but defined; equal rows score equally, and
repeated ids, null ones too, are rows of their own; a text of any length is scored whole, in pieces of memory;
with no labels of one class, all scores are 0.0; extra columns are ignored by score and kept by clean, whatever
their names; empty tables give none.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, gru

WINDOW, STRIDE = 48, 36
#: Longest run that is one word; length of the pieces of longer ones, and from start to start (n-grams have at most six characters).
LONGEST, PIECE, PIECE_STRIDE = 40, 24, 16
#: Labelled rows of each class that training reads at most, and the longest; rounds over the windows; windows in a step.
PER_CLASS, TRAIN_CHARS, ROUNDS, BATCH = 1500, 200_000, 6, 256
#: A wrong alarm costs as much as so many missed texts where the threshold is set.
ALARM_COST = 5
REMEMBERED = 500_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def normal(run: str) -> str:
    """A run of non-blank characters as the network sees it: lower case, without marks at its ends."""
    return _EDGES.sub("", run.lower())


def steps(text: str | None) -> list[str]:
    """The runs of a text, long ones in pieces."""
    runs = (text or "").split()
    if not any(len(r) > LONGEST for r in runs):
        return runs
    out = []
    for r in runs:
        out += [r] if len(r) <= LONGEST else [r[at : at + PIECE] for at in range(0, len(r) - PIECE + PIECE_STRIDE, PIECE_STRIDE)]
    return out


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n words; one at least."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def gather(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts: rows, mask, and the text of each."""
    starts = [windows(len(x)) for x in ids]
    owner = np.repeat(np.arange(len(ids)), [len(s) for s in starts])
    flat = np.concatenate([*ids, np.zeros(WINDOW, np.int64)])
    base = np.cumsum([0] + [len(x) for x in ids])[:-1]
    at = np.concatenate(starts)
    place = (at[:, None] + np.arange(WINDOW)).astype(np.int32)
    mask = place < np.array([len(x) for x in ids])[owner][:, None]
    return flat.astype(np.int32)[np.where(mask, place + base[owner][:, None], 0)], mask.astype(np.float32), owner


def train(texts: list[str], labels: list[int]) -> gru.Network | None:
    """A network from labelled texts; None without both classes."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(3)
    same: dict[str, str] = {}
    split = [[same.setdefault(w, w) for w in (normal(r) for r in steps(t))] for t in texts]
    del same
    docs = [Counter(), Counter()]
    for words, label in zip(split, labels, strict=True):
        docs[label].update(set(words))
    n = [int((y == k).sum()) for k in (0, 1)]
    words = [w for w in set(docs[0]) | set(docs[1]) if docs[0][w] + docs[1][w] >= 3]
    odds = lambda p, q: np.log((p + 1) / (n[1] + 2)) - np.log((q + 1) / (n[0] + 2))
    word_odds = {w: float(odds(docs[1][w], docs[0][w])) * 0.5 for w in words}
    in_class = np.zeros((2, gru.BUCKETS))
    for own, label in zip(split, labels, strict=True):
        in_class[label][np.unique(gru.grams(sorted({*own, ""}))[0])] += 1
    net = gru.Network({w: i for i, w in enumerate(sorted(words))})
    gram_odds = odds(in_class[1], in_class[0]).astype(np.float32)
    net.start_from(word_odds, gram_odds)

    every = sorted({w for own in split for w in own} | {""})
    number = {w: i for i, w in enumerate(every)}
    mean_odds = np.zeros(len(every))
    for at in range(0, len(every), 10_000):
        flat, sizes = gru.grams(every[at : at + 10_000])
        mean_odds[at : at + 10_000] = np.add.reduceat(gram_odds[flat], np.cumsum(sizes) - sizes) / sizes
    signal = np.maximum(np.array([word_odds.get(w, 0.0) * 2 for w in every]), mean_odds)
    rows, mask, owner = gather([np.array([number[w] for w in own], np.int64) for own in split])
    best = np.where(mask > 0, signal[rows], -9).max(1)
    order = np.lexsort((-best, owner))
    place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    rank = np.empty(len(order), int)
    rank[order] = place
    label = y[owner]
    chosen = np.flatnonzero(np.where(label == 1, rank < 1, (rank < 2) | (rng.random(len(rank)) < 0.02)))
    for turn in range(ROUNDS):
        for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // BATCH)):
            own, at = np.unique(rows[part], return_inverse=True)
            net.learn([every[i] for i in own], at.reshape(len(part), WINDOW), mask[part], label[part].astype(np.float32), 0.02 if turn < ROUNDS - 2 else 0.005)
    worst = np.full(len(y), -np.inf)
    for part in np.array_split(np.arange(len(rows)), max(1, len(rows) // 1024)):
        own, at = np.unique(rows[part], return_inverse=True)
        np.maximum.at(worst, owner[part], net.logits(at.reshape(len(part), WINDOW), mask[part], net.project(net.inputs([every[i] for i in own]))))
    cuts = np.unique(worst)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[:-1] + cuts[1:]) / 2, [cuts[-1] + 1]])
    high, low = np.sort(worst[y == 0]), np.sort(worst[y == 1])
    cost = ALARM_COST * (len(high) - np.searchsorted(high, cuts)) + np.searchsorted(low, cuts)
    good = np.flatnonzero(cost == cost.min())
    net.p["bias"] = net.p["bias"] - np.float32((cuts[good[0]] + cuts[good[-1]]) / 2)
    return net


class Scorer:
    """Scores texts; runs seen before keep their row in a bounded table."""

    def __init__(self, net: gru.Network):
        self.net, self.row = net, {}
        self.tables = [np.zeros((1024, 3 * gru.HIDDEN), np.float32) for _ in "fb"]

    def rows(self, texts: list) -> list[np.ndarray]:
        if len(self.row) > REMEMBERED:
            self.row.clear()
        split = [steps(t) for t in texts]
        new = list({r for own in split for r in own if r not in self.row})
        if new:
            first, last = len(self.row), len(self.row) + len(new)
            while last > len(self.tables[0]):
                self.tables = [np.concatenate([t, np.zeros_like(t)]) for t in self.tables]
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                for t, rows in zip(self.tables, self.net.project(self.net.inputs([normal(r) for r in part])), strict=True):
                    t[first + at : first + at + len(part)] = rows
            self.row.update(zip(new, range(first, last), strict=True))
        get = self.row.__getitem__
        return [np.fromiter(map(get, own), np.int64, len(own)) for own in split]

    def score(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), -np.inf)
        for begin, end in common.batches(texts, 1 << 20):
            rows, mask, owner = gather(self.rows(texts[begin:end]))
            for part in range(0, len(rows), 8192):
                own = slice(part, part + 8192)
                np.maximum.at(out, begin + owner[own], self.net.logits(rows[own], mask[own], tuple(self.tables)))
        return gru.sigmoid(out.astype(np.float64))


def crc(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def fit(docs: DataFrame, labels: DataFrame) -> gru.Network | None:
    """Trains in one task, on a bounded sample of labelled rows outside the held-out fifth.

    Sampled are PER_CLASS ids of each class, of least hashes, and for each the least of its texts that has up to
    TRAIN_CHARS characters. A hash threshold set by the class's size keeps what reaches the driver (ids) and the task bounded.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(crc() % 5 != 0).distinct()
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    key = F.xxhash64("doc_id")
    near = known.where(F.when(F.col("toxic") == 1, common.rarer(key, PER_CLASS, sizes[1])).otherwise(common.rarer(key, PER_CLASS, sizes[0])))
    ranked = sorted((r.key, r.doc_id, r.toxic) for r in near.withColumn("key", key).collect())
    chosen = [(i, t) for k in (0, 1) for _, i, t in [r for r in ranked if r[2] == k][:PER_CLASS]]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= TRAIN_CHARS)
    found = texts.join(wanted, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(stream):
        rows = sorted(r for batch in stream for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True))
        net = train([r[1] for r in rows], [r[2] for r in rows])
        if net:
            net.moments = {}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    trained = found.repartition(1).mapInArrow(run, "net binary").first()  # no row, no task
    return pickle.loads(trained.net) if trained else None


def _score(stream, net, names: list[str], keep_below: float | None):
    scorer = Scorer(net) if net else None
    for batch in stream:
        texts = batch.column("text").to_pylist()
        score = scorer.score(texts) if scorer else np.zeros(len(texts))
        if keep_below is not None:
            yield batch.filter(pa.array(score < keep_below))
        else:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    spark = docs.sparkSession
    common.tidy(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc() % 5 == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "held_out", "score", "predicted"]
    return rows.mapInArrow(lambda s: _score(s, shared.value, names, None), "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under one half; columns as they came."""
    spark = docs.sparkSession
    common.tidy(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels))
    names = docs.columns
    return docs.mapInArrow(lambda s: _score(s, shared.value, names, 0.5), docs.schema)
