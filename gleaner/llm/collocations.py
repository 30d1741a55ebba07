"""Phrase collocations by prefix-free parsing.

A text is a sequence of words with a mark between pieces. Words whose hash falls on a fixed residue trigger a cut, so that
cuts depend on content only and texts that repeat a passage share its chunks. A chunk runs from one trigger to the next and
takes the OVERLAP tokens after it along. Distinct chunks of a language with the number of their occurrences form the
dictionary, a table; n-grams are counted inside distinct chunks, times that number. An n-gram belongs to the chunk in which it
starts before the overlap, so one that reaches into an overlap counts once.

Words and pairs are counted first. A phrase can't be more frequent than its parts, so three words are counted only where both
their pairs are among the pairs with LEAST or more. Tasks test this in a bitmap of a fixed number of hash bits, made from
the table of pairs; a bit may be set for another pair too, which costs work but loses nothing, and what is counted are the
phrases themselves, not hashes. Counts are combined in tasks before they are shuffled,
so neither a hot word nor a hot passage is many rows of one key.

Exactness: scores are worked out in decimals of 38 digits.

Defined results: null text is empty, null language is 'und'; empty pieces give nothing; repeated rows count each; ids aren't read;
other columns are ignored; an empty table, and a language without a candidate, give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, bit_map, bits_at, materialize, table
from .shingles import mix

LEAST, TOP, UNIT = 10, 2000, 1_000_000
#: One word in TRIGGER, by its hash, opens a chunk; words that a chunk takes along, for phrases of up to three words.
TRIGGER, OVERLAP = 16, 2
#: Entries, and bytes of chunks, that a task holds before it hands them on.
HELD, HELD_BYTES = 1_000_000, 1 << 26
#: Bits of a word's number in a task, and words that a task numbers before it starts again.
BITS_WORD, MOST_WORDS = 21, 1 << 20
#: Tokens that are numbered at once; with MOST_WORDS they stay below 2 ** BITS_WORD.
WINDOW = 1 << 19
#: Bits of the bitmap of frequent pairs.
BITS = 1 << 26
#: Fixed: pieces end at these, tabs part words, ASCII letters are lowered.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TOKENS = bytes(10 if c in _ENDS else 32 if c == 9 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Numbers of the words that a task has met, from 1, with their hashes; the mark between pieces is 0."""

    def __init__(self) -> None:
        self.clear()

    def __len__(self) -> int:
        return len(self.names)

    def clear(self) -> None:
        self.numbers, self.names, self.hashes = {b"\n": 0}, [b"\n"], np.zeros(1, np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        if new := list(set(words).difference(self.numbers)):
            self.numbers.update(zip(new, range(len(self.names), len(self.names) + len(new))))
            self.names += new
            room = len(self.hashes)
            if len(self.names) > room:
                self.hashes = np.concatenate([self.hashes, np.zeros(max(room, len(self.names)), np.uint64)])
            self.hashes[len(self.names) - len(new) : len(self.names)] = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))


def tokens(text: bytes) -> list[bytes]:
    """Words and, between pieces, marks."""
    return [w for w in text.translate(_TOKENS).replace(b"\n", b" \n ").split(b" ") if w]


def chunks(words: list[bytes], known: Words) -> Iterator[bytes]:
    """The chunks of a text, each with OVERLAP tokens more than are its own."""
    numbers = known.of(words)
    cuts = np.flatnonzero((known.hashes[numbers] % np.uint64(TRIGGER) == 1) & (numbers > 0))
    at = [0, *cuts[cuts > 0].tolist(), len(words)]
    words = [*words, *[b"\n"] * OVERLAP]
    for a, b in zip(at, at[1:]):
        yield b" ".join(words[a : b + OVERLAP])


def parse(docs: DataFrame) -> DataFrame:
    """lang, chunk, freq: the dictionary."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        known, held, size = Words(), {}, 0
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                if words := tokens(text):
                    held.setdefault(lang, Counter()).update(chunks(words, known))
                    size += len(text)
                if size >= HELD_BYTES:
                    yield from handed_on(held)
                    size = 0
                if len(known) > MOST_WORDS:
                    known.clear()
        yield from handed_on(held)

    rows = arrow_rows(docs, run, "lang string, chunk binary, freq long")
    return materialize(rows.groupBy("lang", "chunk").agg(F.sum("freq").alias("freq")), "parse")


def handed_on(held: dict[str, Counter]) -> Iterator[dict]:
    for lang, counts in held.items():
        names = list(counts)
        for lo in range(0, len(names), 50_000):
            part = names[lo : lo + 50_000]
            yield {"lang": [lang] * len(part), "chunk": part, "freq": [counts[k] for k in part]}
    held.clear()


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their weights."""
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(weights, starts) if len(keys) else weights


class Held:
    """Weighted phrases of one language, as keys of word numbers, summed again and again."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0  # entries, of which some may be of one phrase

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        self.parts.append(summed(keys, weights))
        self.size += len(self.parts[-1][0])

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        keys, weights = (np.concatenate([p[k] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for k in (0, 1))
        self.parts = [summed(keys, weights)]
        self.size = len(self.parts[0][0])
        return self.parts[0]


def counted(dictionary: DataFrame, starts: Callable, orders: tuple[int, ...], least: int) -> DataFrame:
    """lang, phrase, a: weighted occurrences of the phrases of `orders` words (1 and 2, or 3); only those of `least` or more. With single
    words comes a row with the empty phrase, for all words.

    starts(lang, hashes of the tokens): whether a phrase may start at a token, as far as its words go. A batch's chunks are worked on
    together; word numbers of 21 bits make one key of a phrase, so keys are equal only for equal phrases."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        known, held = Words(), {}

        def out() -> Iterator[dict]:
            names = pa.array([b"", *known.names[1:]], pa.binary())  # the mark's number stands for all words
            for lang, own in held.items():
                keys, weights = own.settle()
                singles = int(np.searchsorted(keys, 1 << BITS_WORD))
                for first, last, order in ((0, singles, 1), (singles, len(keys), max(orders))):
                    for lo in range(first, last, 50_000):
                        part = keys[lo : min(lo + 50_000, last)]
                        words = [names.take(pa.array((part >> (BITS_WORD * k)) & ((1 << BITS_WORD) - 1))) for k in reversed(range(order))]
                        phrases = words[0] if order == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary()))
                        yield {"lang": pa.repeat(lang, len(part)), "phrase": phrases, "a": weights[lo : lo + len(part)]}
            held.clear()
            known.clear()

        for b in batches:
            langs = np.array(b["lang"], object)
            for lang in dict.fromkeys(b["lang"]):
                for rows in np.array_split(np.flatnonzero(langs == lang), max(1, len(langs) // 4096)):
                    texts = [b["chunk"][i] for i in rows.tolist()]
                    sizes = np.fromiter((t.count(b" ") + 1 for t in texts), np.int64, len(texts))
                    tokens_ = b" ".join(texts).split(b" ") if texts else []
                    own = np.ones(len(tokens_), bool)  # tokens that aren't overlap
                    for k in range(OVERLAP):
                        own[np.cumsum(sizes) - 1 - k] = False
                    freq = np.repeat(np.array([b["freq"][i] for i in rows.tolist()], np.int64), sizes)
                    for lo in range(0, len(tokens_), WINDOW):
                        numbers = known.of(tokens_[lo : lo + WINDOW + OVERLAP])
                        here = np.flatnonzero(own[lo : lo + WINDOW])
                        hashes = known.hashes[numbers]
                        keys, weights = [], []
                        for order in orders:
                            at = here
                            for k in range(order):
                                at = at[numbers[at + k] > 0]
                            at = at[starts(lang, hashes, at)]
                            key = numbers[at]
                            for k in range(1, order):
                                key = (key << BITS_WORD) | numbers[at + k]
                            keys.append(key)
                            weights.append(freq[lo + at])
                        if 1 in orders:
                            keys.append(np.zeros(1, np.int64))
                            weights.append(weights[0].sum(keepdims=True))
                        held.setdefault(lang, Held()).add(np.concatenate(keys), np.concatenate(weights))
                        if len(known) > MOST_WORDS or sum(x.size for x in held.values()) > 2 * HELD:
                            for x in held.values():
                                x.settle()
                            if len(known) > MOST_WORDS or sum(x.size for x in held.values()) > HELD:
                                yield from out()
        yield from out()

    rows = arrow_rows(dictionary, run, "lang string, phrase binary, a long")
    return rows.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("a").alias("a")).filter((F.col("a") >= least) | (F.col("phrase") == ""))


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang) | 1)


def places(first: np.ndarray, lang: str) -> np.ndarray:
    """Bits of the hashed phrases of a language."""
    return (mix(first * _ODD + lang_hash(lang)) % np.uint64(BITS)).astype(np.int64)


def together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a) * _ODD + b


def bitmap(pairs: DataFrame) -> np.ndarray:
    """BITS bits, packed: those of the pairs are set."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            split = [p.encode().split(b" ") for p in b["phrase"]]
            whole = together(*(np.fromiter((xxhash.xxh3_64_intdigest(w[k]) for w in split), np.uint64, len(split)) for k in range(2)))
            langs = np.array(b["lang"], object)
            bits = np.zeros(len(split), np.int64)
            for lang in dict.fromkeys(b["lang"]):
                bits[langs == lang] = places(whole[langs == lang], lang)
            yield {"bit": np.unique(bits)}

    return bit_map(arrow_rows(pairs.select("lang", "phrase"), run, "bit long"), BITS)


def phrase_counts(dictionary: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words, pairs and triples with `least` occurrences or more (lang, phrase, a), and lang, n."""
    context = dictionary.sparkSession.sparkContext
    both = materialize(counted(dictionary, lambda lang, hashes, at: np.ones(len(at), bool), (1, 2), least), "words-and-pairs")
    n = both.filter("phrase = ''").select("lang", F.col("a").alias("n"))
    frequent, pairs = both.filter("phrase != '' AND NOT contains(phrase, ' ')"), both.filter("contains(phrase, ' ')")
    of_pairs = context.broadcast(bitmap(pairs))

    def triple(lang: str, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        ok = bits_at(of_pairs.value, places(together(hashes[:-1], hashes[1:]), lang))
        return ok[at] & ok[at + 1]

    triples = materialize(counted(dictionary, triple, (3,), least), "triples")
    return frequent, pairs, triples, n


def collocations(df: DataFrame, least: int = LEAST, top: int = TOP, covered: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    words, pairs, triples, n = phrase_counts(parse(docs), least)
    part = lambda k, m: F.array_join(F.slice(F.split("phrase", " "), k, m), " ")
    count = lambda df, key, name: df.select("lang", F.col("phrase").alias(key), F.col("a").alias(name))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = lambda l, r: F.call_function("div", wide("a") * wide("a") * F.lit(UNIT).cast("decimal(7,0)"), wide(l) * wide(r))

    two = pairs.select("lang", "phrase", "a", part(1, 1).alias("first"), part(2, 1).alias("last"))
    two = two.join(count(words, "first", "l"), ["lang", "first"]).join(count(words, "last", "r"), ["lang", "last"]).select("lang", "phrase", "a", "l", "r", score("l", "r").alias("score"))

    three = triples.select("lang", "phrase", "a", part(1, 1).alias("w1"), part(2, 2).alias("w23"), part(1, 2).alias("w12"), part(3, 1).alias("w3"))
    for frame, key in ((words, "w1"), (pairs, "w23"), (pairs, "w12"), (words, "w3")):
        three = three.join(count(frame, key, f"n_{key}"), ["lang", key])
    three = three.withColumn("s1", score("n_w1", "n_w23")).withColumn("s2", score("n_w12", "n_w3"))
    first = F.col("s1") <= F.col("s2")
    three = materialize(three.select("lang", "phrase", "w12", "w23", "a", F.when(first, F.col("n_w1")).otherwise(F.col("n_w12")).alias("l"), F.when(first, F.col("n_w23")).otherwise(F.col("n_w3")).alias("r"), F.least("s1", "s2").alias("score")), "triples-scored")

    longer = three.select("lang", F.explode(F.array("w12", "w23")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    two = two.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.lit(100) * F.col("most").cast("decimal(20,0)") < F.lit(covered) * F.col("a").cast("decimal(20,0)"))).drop("most")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three.drop("w12", "w23")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op11_collocations": op11_collocations}
ORACLE = {
    "op11_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
                unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        grams AS (
            SELECT lang, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) v(k))),
        f AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, min(g) AS g, count(*) AS a FROM grams GROUP BY ALL),
        n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        cand AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
        cuts AS (SELECT c.*, unnest(range(1, c.k)) AS cut FROM cand c),
        scored AS (
            SELECT c.lang, c.k, c.phrase, c.g, c.a, c.cut, l.a AS l, r.a AS r, ((1000000 * c.a::HUGEINT * c.a::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT))::BIGINT AS score
            FROM cuts c JOIN f l ON l.lang = c.lang AND l.k = c.cut AND l.phrase = array_to_string(list_slice(c.g, 1, c.cut), ' ')
            JOIN f r ON r.lang = c.lang AND r.k = c.k - c.cut AND r.phrase = array_to_string(list_slice(c.g, c.cut + 1, c.k), ' ')),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1),
        inside AS (SELECT lang, phrase, max(a) AS most FROM (
            SELECT lang, array_to_string(list_slice(g, 1, 2), ' ') AS phrase, a FROM cand WHERE k = 3 UNION ALL SELECT lang, array_to_string(list_slice(g, 2, 3), ' '), a FROM cand WHERE k = 3) GROUP BY ALL),
        kept AS (SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase AND s.k = 2 WHERE most IS NULL OR 100 * most < 50 * s.a),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
}
