"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

A word's index vector is a sparse ternary vector drawn from hashes of the word and its byte trigrams; its word vector adds
the normalised sum of the index vectors of its neighbours in the training sample. A document is the mean of its word
vectors together with the mean absolute step between neighbouring words. The network's logits are divided by a
temperature fitted on a part of the sample that the network didn't see.

The model is fitted in one executor task on at most `sample` labelled documents (chosen by hash of the id, never by
content) and has a bounded size; every document is scored whole. Labels, language, source and id never enter a score.

Defined results: null or empty text pools to the zero vector and gets that vector's score; rows without usable labels
are not learned from; with labels of one class only, or none, every score is the smoothed share of label 1; a document
with a null id is never held out and never learned from; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, arrow_rows, id_text, table, text_hash, tidy

SAMPLE = 12_000
DIM, NONZERO, REACH, HIDDEN, VOCABULARY = 64, 4, 2, 32, 40_000
ACCEPT = 0.7
CACHE = 200_000
#: Bytes of the model that one row brings to the driver.
SLICE = 1 << 18
_WORD = re.compile(WORD)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def index_vectors(words: list[str]) -> np.ndarray:
    """One unit row per word: signed hashed counts of its byte trigrams and of itself."""
    if not words:
        return np.zeros((0, DIM), np.float32)
    raw = [b"\x02" + w.encode() + b"\x03\x03" for w in words]
    sizes = np.array([len(r) for r in raw])
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    codes = np.zeros(len(flat), np.uint64)
    codes[:-2] = (flat[:-2] << np.uint64(16)) | (flat[1:-1] << np.uint64(8)) | flat[2:]
    ends = np.cumsum(sizes)
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = inside[ends - 2] = False
    place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    whole = np.bitwise_xor.reduceat(_mix(flat * np.uint64(0x10001) + place.astype(np.uint64) * np.uint64(0x9E3779B1)), ends - sizes)
    codes = np.concatenate([codes[inside], whole | np.uint64(1 << 63)])
    owner = np.concatenate([owner[inside], np.arange(len(words))])
    total = np.zeros(len(words) * DIM, np.float64)
    for k in range(NONZERO):
        h = _mix(codes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        total += np.bincount(owner * DIM + (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), len(words) * DIM)
    out = total.reshape(-1, DIM)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Vectors:
    """Word vectors: of known words, and on demand of others."""

    def __init__(self, known: dict[str, int] | None = None, context: np.ndarray | None = None):
        self.known, self.context = known or {}, context
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        self.matrix = np.zeros((0, DIM), np.float32)
        self.used = 0

    def rows(self, words: list[str]) -> np.ndarray:
        if self.used > CACHE:
            self.reset()
        new = list(set(words).difference(self.row))
        if new:
            own = index_vectors(new)
            if self.context is not None:
                at = [(i, self.known[w]) for i, w in enumerate(new) if w in self.known]
                if at:
                    i, j = np.array(at).T
                    own[i] += self.context[j]
            if self.used + len(new) > len(self.matrix):
                grown = np.zeros((max(1024, 2 * (self.used + len(new))), DIM), np.float32)
                grown[: self.used] = self.matrix[: self.used]
                self.matrix = grown
            self.matrix[self.used : self.used + len(new)] = own
            for w in new:
                self.row[w] = self.used
                self.used += 1
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def pool(self, text: str) -> np.ndarray:
        words = _WORD.findall(text)
        out = np.zeros(2 * DIM)
        if words:
            rows = self.rows(words)
            for k in range(0, len(rows), 1 << 14):  # long texts in bounded blocks
                block = self.matrix[rows[k : k + (1 << 14) + 1]]
                out[:DIM] += block[: 1 << 14].sum(0)
                out[DIM:] += np.abs(np.diff(block, axis=0)).sum(0)
            out[:DIM] /= len(rows)
            out[DIM:] /= max(1, len(rows) - 1)
        return out


def context_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Random indexing over the sample: for its most frequent words, the unit sum of their neighbours' index vectors.

    Texts are cut into words anew wherever they are read: lists of all words would take many times their size."""
    counts: Counter = Counter()
    for t in texts:
        counts.update(_WORD.findall(t))
    kept = sorted((w for w, n in counts.items() if n > 2), key=lambda w: (-counts[w], w))[:VOCABULARY]
    counts.clear()
    known = {w: i for i, w in enumerate(kept)}
    out = np.zeros((len(kept), DIM))
    vectors = Vectors()
    for text in texts:
        t = _WORD.findall(text)
        for k in range(0, len(t), 1 << 15):
            part = t[max(0, k - REACH) : k + (1 << 15)]
            rows, ids = vectors.rows(part), np.array([known.get(w, -1) for w in part])
            own = vectors.matrix[rows].astype(np.float64)
            around = np.zeros_like(own)
            for step in range(1, REACH + 1):
                around[step:] += own[:-step]
                around[:-step] += own[step:]
            place = np.flatnonzero(ids >= 0)
            order = place[np.argsort(ids[place], kind="stable")]
            if len(order):
                starts = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
                out[ids[order][starts]] += np.add.reduceat(around[order], starts)
    return known, (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def logits(net: dict, x: np.ndarray) -> np.ndarray:
    return np.maximum((x - net["mean"]) / net["scale"] @ net["w1"] + net["b1"], 0) @ net["w2"] + net["b2"]


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256) -> dict:
    """Adam on the logistic loss; a fifth of the rows, drawn by a fixed permutation, fits the temperature."""
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    held, seen = order[: len(x) // 5], order[len(x) // 5 :]
    net = {"mean": x[seen].mean(0), "scale": x[seen].std(0) + 1e-3}
    net |= {"w1": rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.2, HIDDEN), "b2": 0.0}
    z = (x - net["mean"]) / net["scale"]
    names = ("w1", "b1", "w2", "b2")
    first, second, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for _ in range(epochs):
        rng.shuffle(seen)
        for k in range(0, len(seen), batch):
            at = seen[k : k + batch]
            hidden = np.maximum(z[at] @ net["w1"] + net["b1"], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ net["w2"] + net["b2"], -30, 30))) - y[at]) / len(at)
            back = np.outer(error, net["w2"]) * (hidden > 0)
            grads = {"w2": hidden.T @ error + 1e-4 * net["w2"], "b2": error.sum(), "w1": z[at].T @ back + 1e-4 * net["w1"], "b1": back.sum(0)}
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                net[n] = net[n] - 2e-3 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    out, target = logits(net, x[held]), y[held]
    loss = lambda t: np.mean(np.logaddexp(0, -np.where(target > 0, 1, -1) * out / t)) if len(out) else t
    net["temperature"] = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


def sample_ids(labels: DataFrame, sample: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id, quality of at most `sample` labelled documents that aren't held out; of clashing labels the lower counts."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """The fitted model; docs: doc_id, text."""
    rows = docs.join(F.broadcast(sample_ids(labels, sample)), "doc_id")  # at most `sample` rows of two numbers

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        texts, y = [], []
        for b in batches:
            texts += b["text"]
            y += b["quality"]
        y = np.array(y, float)
        model: dict = {"prior": float((y.sum() + 1) / (len(y) + 2))}
        if 0 < y.sum() < len(y) and len(y) >= 10:
            known, context = context_vectors(texts)
            vectors = Vectors(known, context)
            x = np.stack([vectors.pool(t) for t in texts])
            model |= {"known": known, "context": context, "net": train(x, y)}
        raw = pickle.dumps(model)
        cuts = range(0, len(raw), SLICE)
        yield {"part": list(range(len(cuts))), "model": [raw[k : k + SLICE] for k in cuts]}

    one = rows.select("doc_id", "text", "quality").repartition(1).sortWithinPartitions("doc_id", "text")
    found = arrow_rows(one, run, "part int, model binary").collect()
    raw = b"".join(r["model"] for r in sorted(found, key=lambda r: r["part"]))
    del found
    tidy(docs.sparkSession)
    return raw or pickle.dumps({"prior": 0.5})


def classify(df: DataFrame, labels: DataFrame, accept: float = ACCEPT, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, text_hash (which tells rows that share an id apart)."""
    docs = id_text(df, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        model = pickle.loads(shared.value)
        vectors = Vectors(model.get("known"), model.get("context"))
        for b in batches:
            if "net" in model:
                x = np.stack([vectors.pool(t) for t in b["text"]]) if b["text"] else np.zeros((0, 2 * DIM))
                score = 1 / (1 + np.exp(-np.clip(logits(model["net"], x) / model["net"]["temperature"], -40, 40)))
            else:
                score = np.full(len(b["text"]), model["prior"])
            yield {"doc_id": b["doc_id"], "score": score, "text_hash": b["text_hash"]}

    scored = arrow_rows(docs.withColumn("text_hash", text_hash("text")), run, "doc_id long, score double, text_hash long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"), "text_hash")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLE: dict[str, str] = {}
