"""Language-model scores by a subword lattice.

A text is its words (ASCII letters lowered) and one end. Every segmentation of a word, with the word-start mark in front,
into the pieces of an existing unigram vocabulary counts with the product of its pieces' probabilities; the forward
recursion in log space sums over all of them, and a document's score is the sum over its words and its end. Pieces stay
as the vocabulary has them (single bytes complete it); their probabilities start from the vocabulary's scores and are
re-estimated by expected counts over all training words. Beside it stands the add-one word model.

Plan: one scan counts words, the lattice runs once per distinct word, and a second scan adds up documents. The `hot` most
frequent words (a bounded table) are looked up in place; only the rest is joined by word, and none of those words can
hold more than one in `hot` tokens, so the join has no hot key.

Defined results: null or empty text is one end token; a null id is a training document; repeated rows are counted and
scored each; without training documents every count is 0 and piece probabilities are the vocabulary's own; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, id_text, materialize, table

HOT, ROUNDS, SMOOTH = 100_000, 2, 0.1
MARK = b"\xe2\x96\x81"


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


class Vocabulary:
    """The pieces of a SentencePiece model as byte strings, their first log probabilities, and a trie over bytes."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = [p for p in model.pieces if p.type == proto.ModelProto.SentencePiece.NORMAL]
        order = {p.piece: k for k, p in enumerate(sorted(normal, key=lambda p: (-p.score, p.piece)))}
        weight = {p.encode(): 1 / (k + 10) for p, k in order.items()}  # scores of a merge-type vocabulary are ranks
        for b in range(256):
            weight.setdefault(bytes([b]), 1e-6)
        self.pieces = sorted(weight)
        total = sum(weight.values())
        self.first = np.log([weight[p] / total for p in self.pieces])
        self.longest = max(map(len, self.pieces))
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, piece in enumerate(self.pieces):
            at = 0
            for b in piece:
                at = children[at].setdefault(b, len(children))
                if at == len(children):
                    children.append({})
                    ends.append(-1)
            ends[at] = k
        self.next = np.zeros((len(children), 256), np.int32)
        for at, own in enumerate(children):
            for b, to in own.items():
                self.next[at, b] = to
        self.ends = np.array(ends, np.int32)

    def steps(self, chars: np.ndarray, j: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Pieces that start at column j: (end, rows, piece of each row)."""
        rows, node = np.arange(len(chars)), np.zeros(len(chars), np.int32)
        for i in range(j, min(chars.shape[1], j + self.longest)):
            node = self.next[node, chars[rows, i]]
            alive = node > 0
            if not alive.all():
                rows, node = rows[alive], node[alive]
            if not len(rows):
                return
            piece = self.ends[node]
            has = piece >= 0
            yield i + 1, rows[has], piece[has]

    def forward(self, chars: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations of each row's prefixes."""
        alpha = np.full((len(chars), chars.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(chars.shape[1]):
            for i, rows, piece in self.steps(chars, j):
                alpha[rows, i] = np.logaddexp(alpha[rows, i], alpha[rows, j] + logp[piece])
        return alpha

    def expected(self, chars: np.ndarray, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, over weighted rows."""
        alpha = self.forward(chars, logp)
        beta = np.full_like(alpha, -np.inf)
        beta[:, -1] = 0
        pieces, uses = [], []
        for j in range(chars.shape[1] - 1, -1, -1):
            for i, rows, piece in self.steps(chars, j):
                behind = logp[piece] + beta[rows, i]
                beta[rows, j] = np.logaddexp(beta[rows, j], behind)
                pieces.append(piece)
                uses.append(weight[rows] * np.exp(alpha[rows, j] + behind - alpha[rows, -1]))
        return np.bincount(np.concatenate(pieces), np.concatenate(uses), len(self.pieces))


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def by_length(words: list[bytes], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of words of one length: (positions, bytes as a matrix)."""
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for n, at in sorted(groups.items()):
        each = max(1, most // (n + 1))
        for lo in range(0, len(at), each):
            own = at[lo : lo + each]
            yield np.array(own), np.frombuffer(b"".join(words[k] for k in own), np.uint8).reshape(len(own), n)


def _gathered(batches: Iterator[dict], least: int = 60_000) -> Iterator[dict]:
    """Batches joined until they hold enough rows to work on in blocks."""
    held: dict = {}
    for b in batches:
        held = b if not held else {k: held[k] + b[k] for k in b}
        if held and len(next(iter(held.values()))) >= least:
            yield held
            held = {}
    if held:
        yield held


def training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 != 2, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c: occurrences in training documents, for the words of all documents. docs: text, train."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counts: Counter = Counter()

        def out() -> dict:
            return {"word": [w.decode() for w in counts], "c": list(counts.values())}

        for b in batches:
            for text, train in zip(b["text"], b["train"], strict=True):
                if train:
                    counts.update(words_of(text))
                else:
                    for w in words_of(text):
                        if w not in counts:
                            counts[w] = 0
                if len(counts) > 300_000:
                    yield out()
                    counts.clear()
        yield out()

    return arrow_rows(docs.select("text", "train"), run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def expected_uses(words: DataFrame, path: str, logp: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over word, c."""
    shared = words.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        v = vocabulary(path)
        total = np.zeros(len(v.pieces))
        for b in _gathered(batches):
            weight = np.array(b["c"], float)
            for at, chars in by_length([MARK + w.encode() for w in b["word"]]):
                total += v.expected(chars, shared.value, weight[at])
        own = np.flatnonzero(total)
        yield {"piece": own, "uses": total[own]}

    out = np.zeros(len(logp))
    for r in arrow_rows(words.filter("c > 0"), run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # a row per piece at most
        out[r["piece"]] = r["uses"]
    return out


def word_scores(words: DataFrame, path: str, logp: np.ndarray) -> DataFrame:
    """word, c and logp: the base-10 log of the sum over all segmentations."""
    shared = words.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        v = vocabulary(path)
        for b in _gathered(batches):
            out = np.zeros(len(b["word"]))
            for at, chars in by_length([MARK + w.encode() for w in b["word"]]):
                out[at] = v.forward(chars, shared.value)[:, -1] / math.log(10)
            yield {**b, "logp": out}

    return arrow_rows(words, run, "word string, c long, logp double")


def score_documents(df: DataFrame, path: str, hot: int = HOT, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    docs = id_text(df, id_col, text_col).withColumn("train", training(F.col("doc_id")))
    words = materialize(word_counts(docs), "words")
    ends = docs.filter("train").count()
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).head()
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    v = vocabulary(path)
    logp, end = np.append(v.first, 0.0)[:-1], math.log(0.01)
    for _ in range(rounds if tokens else 0):
        uses = expected_uses(words, path, logp)
        total = uses.sum() + ends + SMOOTH * (len(uses) + 1)
        logp, end = np.log((uses + SMOOTH) / total), math.log((ends + SMOOTH) / total)
    scored = materialize(word_scores(words, path, logp), "word-scores")
    most = scored.filter("c > 0").orderBy(F.desc("c"), "word").limit(hot).toArrow()  # at most `hot` rows
    table_hot = (dict(zip((w.encode() for w in most.column("word").to_pylist()), range(most.num_rows), strict=True)), np.append(most.column("c").to_numpy(), 0), np.append(most.column("logp").to_numpy(), 0.0))
    shared = spark.sparkContext.broadcast(table_hot)
    low = math.log10(tokens + distinct + 1)
    first = (math.log10(ends + 1) - low, end / math.log(10), int(ends > 0))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        known, counts, logps = shared.value
        bases = np.log10(counts + 1.0) - low
        bases[-1] = 0
        for b in batches:
            for lo in range(0, len(b["text"]), 512):
                part = {k: x[lo : lo + 512] for k, x in b.items()}
                n, seen, base, score, rare_key, rare_word, rare_n = [], [], [], [], [], [], []
                for key, text in zip(part["key"], part["text"], strict=True):
                    words = words_of(text)
                    at = np.array([known.get(w, -1) for w in words], np.int64)
                    n.append(len(words) + 1)
                    seen.append(int((at >= 0).sum()) + first[2])
                    base.append(float(bases[at].sum()) + first[0])
                    score.append(float(logps[at].sum()) + first[1])
                    rare = Counter([words[k] for k in np.flatnonzero(at < 0)])
                    rare_key += [key] * len(rare)
                    rare_word += [w.decode() for w in rare]
                    rare_n += rare.values()
                more, none = len(rare_key), [None] * len(rare_key)
                yield {"key": part["key"] + rare_key, "doc_id": part["doc_id"] + none, "held_out": [not t for t in part["train"]] + none, "n": n + rare_n, "known": seen + none, "base": base + none, "score": score + none, "word": [None] * len(n) + rare_word} if more or n else {}

    sums = "key long, doc_id long, held_out boolean, n long, known long, base double, score double, word string"
    both = materialize(arrow_rows(docs.withColumn("key", F.monotonically_increasing_id()).select("key", "doc_id", "train", "text"), run, sums), "document-parts")
    rare = both.filter("word IS NOT NULL").select("key", "n", "word").join(scored, "word")
    rare = rare.groupBy("key").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_r"), F.sum(F.col("n") * (F.log10(F.col("c") + 1.0) - low)).alias("base_r"), F.sum(F.col("n") * F.col("logp")).alias("score_r"))
    whole = both.filter("word IS NULL").drop("word").join(rare, "key", "left").fillna(0, ["known_r", "base_r", "score_r"])
    return whole.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.col("known_r")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("base_r")).alias("base_score"), (F.col("score") + F.col("score_r")).alias("score"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
ORACLE: dict[str, str] = {}
