"""Words and runs of words, counted where texts are read: a task goes through its texts once and hands on sums, not occurrences.

Words are those of X.words_kept of three letters or more that aren't stop words; each row of docs (text) counts as a document."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as X

_LETTERS = b"abcdefghijklmnopqrstuvwxyz0123456789'-"
#: Bytes of UTF-8 in lower case: those of words stay, all others are spaces.
_TABLE = bytes(c if c in _LETTERS else 32 for c in bytes(range(256)).lower())
#: The characters outside ASCII that have a letter a-z in lower case: K (Kelvin) and I with a dot.
_KELVIN, _DOTTED = "\u212a".encode(), "\u0130".encode()
_SHORT = [bytes(w) for n in (1, 2) for w in product(_LETTERS, repeat=n)]
_LEFT_OUT, _UNKNOWN = -2, -1
#: Bytes of texts that a task takes at a time (one text at least), and words that it numbers, or takes along.
MOST_BYTES, MOST_WORDS = 8 << 20, 1 << 20
#: From so many texts on, runs that are rare in every task are told first; runs that a task sums up at a time, and candidates that tasks take along.
MANY_TEXTS, MOST_RUNS, MOST_CANDIDATES = 100_000, 1 << 21, 1 << 18


def _left_out(stop) -> dict[bytes, int]:
    return dict.fromkeys([*_SHORT, *(w.encode() for w in stop)], _LEFT_OUT)


class _Numbers(dict):
    """Numbers words as they come."""

    def __init__(self, stop):
        super().__init__(_left_out(stop))
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Texts, some at a time."""
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for t in batch.column("text").cast(pa.binary()).to_pylist():
            if t:
                texts.append(t)
                size += len(t)
            if size >= MOST_BYTES:
                yield texts
                texts, size = [], 0
    if texts:
        yield texts


def _sequence(texts: list[bytes], number) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words that aren't left out, and the place of each one's text."""
    numbers: list[int] = []
    ends = []
    for t in texts:
        numbers.extend(number(t.replace(_KELVIN, b"k").replace(_DOTTED, b"i ").translate(_TABLE).split()))
        ends.append(len(numbers))
    found = np.fromiter(numbers, np.int64, len(numbers))
    text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    kept = found != _LEFT_OUT
    return found[kept], text[kept]


def _texts_with(keys: np.ndarray, text: np.ndarray, texts: int, size: int) -> np.ndarray:
    """How many texts hold each of `size` keys."""
    both = np.sort(keys * texts + text)  # np.unique would hash them, which takes far longer
    return np.bincount(both[np.diff(both, prepend=-1) > 0] // texts, minlength=size)


def _names(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def word_counts(docs: DataFrame, stop=X.STOPWORDS) -> DataFrame:
    """word, total, docs."""
    stop = tuple(stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        numbers, total, docs = _Numbers(stop), none, none

        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_names(numbers.words), pa.array(total), pa.array(docs)], names=["word", "total", "docs"])

        for texts in _some(batches):
            found, text = _sequence(texts, lambda words: map(numbers.__getitem__, words))
            size = len(numbers.words)
            total = np.pad(total, (0, size - len(total))) + np.bincount(found, minlength=size)
            docs = np.pad(docs, (0, size - len(docs))) + _texts_with(found, text, len(texts), size)
            if size >= MOST_WORDS:
                yield sums()
                numbers, total, docs = _Numbers(stop), none, none
        yield sums()

    each = docs.select("text").mapInArrow(run, "word string, total long, docs long")
    return each.groupBy("word").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs"))


def _runs(found: np.ndarray, text: np.ndarray, texts: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of two and of three known words and how many texts hold each. A run's number has its words' numbers, each plus one, as digits of base + 1; a run of two ends in a zero."""
    size, digit = max(base, 1), base + 1
    two = (found[1:] >= 0) & (found[:-1] >= 0) & (text[1:] == text[:-1])
    pairs, which = np.unique((found[:-1] * size + found[1:])[two], return_inverse=True)
    rank = np.full(len(two), _UNKNOWN)
    rank[two] = which
    three = two[1:] & two[:-1]
    triples, whole = np.unique((rank[:-1] * size + found[2:])[three], return_inverse=True)
    first = np.stack([pairs // size, pairs % size, np.full(len(pairs), _UNKNOWN)])
    words = np.concatenate([first, np.stack([*first[:2, triples // size], triples % size])], axis=1) + 1
    docs = np.concatenate([_texts_with(which, text[1:][two], texts, len(pairs)), _texts_with(whole, text[2:][three], texts, len(triples))])
    return words, docs, (words[0] * digit + words[1]) * digit + words[2]


def _joined(groups: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of groups of texts: runs, docs, number of texts."""
    runs, which = np.unique(np.concatenate([runs for runs, _, _ in groups]), return_inverse=True)
    docs = np.bincount(which, np.concatenate([docs for _, docs, _ in groups]), minlength=len(runs)).astype(np.int64)
    return runs, docs, sum(n for _, _, n in groups)


def _phrases(names: pa.Array, words: np.ndarray) -> pa.Array:
    """Runs spelled out; words: their words' numbers plus one, the third 0 if there is none."""
    return pc.binary_join_element_wise(*(names.take(pa.array(w - 1, mask=w == 0)) for w in words), " ", null_handling="skip")


def run_counts(docs: DataFrame, words: DataFrame, least_docs: int, stop=X.STOPWORDS) -> DataFrame:
    """phrase, docs of the runs of two and three words that stand in least_docs documents or more. words: word_counts of docs.

    A run stands in no more documents than each of its words, so only words that stand in that many make runs. They go to the
    tasks if there are at most MOST_WORDS of them, and runs are summed as numbers; otherwise all words make runs. A run that stands
    in least_docs of all texts stands in that share of some group of them; so of many texts, only runs that do are counted, in a
    second pass."""
    stop, spark = tuple(stop), docs.sparkSession
    often = words.filter(F.col("docs") >= least_docs).select("word")
    shared = spark.sparkContext.broadcast([r["word"].encode() for r in often.collect()]) if often.count() <= MOST_WORDS else None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        known = _left_out(stop) | {w: n for n, w in enumerate(shared.value)}
        for texts in _some(batches):
            _, n, runs = _runs(*_sequence(texts, lambda words: map(known.get, words, repeat(_UNKNOWN))), len(texts), len(shared.value))
            yield runs, n, len(texts)

    def often_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs that stand in a share of least_docs / size of a group of this task's texts. The last group is not told apart from the one before, as it may be small."""
        told = lambda g: pa.RecordBatch.from_arrays([pa.array(g[0][g[1] * size >= least_docs * g[2]])], names=["run"])
        before, group = [], []
        for more in counted(batches):
            group.append(more)
            if sum(len(runs) for runs, _, _ in group) >= MOST_RUNS:
                if before:
                    yield told(before[0])
                before, group = [_joined(group)], []
        if before or group:
            yield told(_joined(before + group))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, n, _ in counted(batches):
            if candidates is not None:
                near = np.searchsorted(candidates.value, runs)
                kept = candidates.value[np.minimum(near, len(candidates.value) - 1)] == runs if len(candidates.value) else np.zeros(len(runs), bool)
                runs, n = runs[kept], n[kept]
            yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(n)], names=["run", "docs"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, digit = _names(shared.value), len(shared.value) + 1
        for b in batches:
            runs = b.column("run").to_numpy()
            yield pa.RecordBatch.from_arrays([_phrases(names, np.stack([runs // digit**2, runs // digit % digit, runs % digit])), b.column("docs")], names=["phrase", "docs"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _some(batches):
            numbers = _Numbers(stop)
            found, text = _sequence(texts, lambda words, n=numbers: map(n.__getitem__, words))
            words, n, _ = _runs(found, text, len(texts), len(numbers.words))
            yield pa.RecordBatch.from_arrays([_phrases(_names(numbers.words), words), pa.array(n)], names=["phrase", "docs"])

    summed = lambda df, key: df.groupBy(key).agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    if shared is None:
        return summed(docs.select("text").mapInArrow(spelled, "phrase string, docs long"), "phrase")
    candidates, size = None, docs.filter("text != ''").count()
    if size >= MANY_TEXTS:
        told = docs.select("text").mapInArrow(often_here, "run long").distinct().limit(MOST_CANDIDATES + 1).collect()
        if len(told) <= MOST_CANDIDATES:  # else all runs are counted
            candidates = spark.sparkContext.broadcast(np.sort(np.array([r["run"] for r in told], np.int64)))
    return summed(docs.select("text").mapInArrow(numbered, "run long, docs long"), "run").mapInArrow(named, "phrase string, docs long")
