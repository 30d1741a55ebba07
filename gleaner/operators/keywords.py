"""Keyphrases and capitalised names inside one document: sequential kernels, run on Arrow batches."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.sources.shared import dealt

_CAPITAL, _FIRST, _ENDS, _OPENS = re.compile("[A-Z]"), re.compile(r"\s*\S*"), re.compile(r"[.!?](\s+)"), re.compile("[^a-zA-Z0-9]*[A-Z]")
_EDGES, _QUOTED = re.compile("^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$"), re.compile("'s$|'")
_OTHERS = re.compile(r"[^a-zA-Z0-9'\s-]+")


def keyphrases(text: str, most: int = 5, longest: int = 3, stop=frozenset(X.STOPWORDS)) -> list[tuple[str, float]]:
    """(phrase, score), the best (lowest) first.

    A word's score falls with consistent case, frequency and spread over sentences, and rises with late median position
    and with the variety of its neighbours; a phrase's is the product of its words' over (n + 1) / 2. A phrase that holds
    a chosen one, or is held by it, is left out."""
    sentences = [s for s in re.split(r"[.!?]+", text or "") if s.strip()]
    words: list[str] = []
    upper_at: list[bool] = []
    sentence_of: list[int] = []
    bounds = [0]
    for k, sentence in enumerate(sentences):
        own = _OTHERS.sub("", sentence).split()
        words += map(str.lower, own)
        upper_at += [w[0].isupper() for w in own]
        sentence_of += [k] * len(own)
        if len(words) > bounds[-1]:
            bounds.append(len(words))
    places: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        places[w].append(i)
    plain = {w: len(w) >= 2 and w not in stop for w in places}
    said = {w: at for w, at in places.items() if plain[w]}
    if not said:
        return []
    counts = [len(p) for p in said.values()]
    mean = sum(counts) / len(counts)
    usual = mean + math.sqrt(sum((c - mean) ** 2 for c in counts) / len(counts)) + 1
    score: dict[str, float] = {}
    every, many = len(words), len(sentences)
    common = [w in stop for w in words]
    for w, at in said.items():
        tf = len(at)
        if tf == 1:
            i = at[0]
            upper, spread = upper_at[i], 1 / many
            near = (i > 0 and not common[i - 1]) + (i + 1 < every and not common[i + 1])
        else:
            upper = sum([upper_at[i] for i in at]) / tf
            left = {words[i - 1] for i in at if i and not common[i - 1]}
            right = {words[i + 1] for i in at if i + 1 < every and not common[i + 1]}
            near, spread = len(left) + len(right), len({sentence_of[i] for i in at}) / many
        variety = 1 + near / tf
        position = math.log(2 + at[tf // 2] / every)
        score[w] = position * variety / (max(upper, 1 - upper) + tf / usual / variety + 0.5 * spread + 1)
    best: dict[str, float] = {}
    value_of = [score.get(w) for w in words]
    prod, join = math.prod, " ".join
    for a, z in zip(bounds, bounds[1:], strict=False):
        cuts = [a - 1, *(i for i in range(a, z) if value_of[i] is None), z]
        runs = [(i + 1, j) for i, j in zip(cuts, cuts[1:], strict=False) if j - i > 1]
        for n in range(1, longest + 1):
            share = 0.5 * n + 0.5
            for b, e in runs:
                for i in range(b, e - n + 1):
                    phrase = words[i] if n == 1 else join(words[i : i + n])
                    # a phrase's value depends on its words only
                    if phrase not in best and (n > 1 or len(phrase) >= 3):
                        best[phrase] = prod(value_of[i : i + n]) / share
    out: list[tuple[str, float]] = []
    for phrase in sorted(best, key=best.__getitem__):
        value = best[phrase]
        if len(out) == most:
            break
        if not any(phrase in p or p in phrase for p, _ in out):
            out.append((phrase, value))
    return out


def tuned_keyphrases(text: str, most: int = 5, longest: int = 3, stop=frozenset(X.STOPWORDS), alike: float = 0.82) -> list[tuple[str, float]]:
    """keyphrases with a preference for phrases that are longer, repeated and spread, and against near doubles by Jaro similarity."""
    low = (text or "").lower()
    sentences = [s for s in re.split(r"[.!?]+", low) if s.strip()]
    wide = []
    for phrase, value in keyphrases(text, most * 6, longest, stop):
        n, seen = phrase.count(" ") + 1, low.count(phrase)
        spread = sum(phrase in s for s in sentences)
        for holds, factor in ((n > 1, 0.7), (n >= 3, 0.85), (seen >= 2, 0.85), (spread >= 2, 0.85), (spread >= 3, 0.9), (n == 1 and seen < 6, 1.8), (n == 1 and seen == 1, 1.4), (n == 1 and re.search("(ed|ing|ment|ness|tion|sion|ance|ence)$", phrase), 1.35)):
            value *= factor if holds else 1
        if n > 1 or (len(phrase) >= 5 and seen >= 2 and spread >= 2):
            wide.append((phrase, value, seen, n))
    out: list[tuple[str, float]] = []
    for phrase, value, _, _ in sorted(wide, key=lambda x: (x[1], -x[2], -x[3])):
        if len(out) < most and all(jaro(phrase, p) < alike for p, _ in out):
            out.append((phrase, value))
    return out


def jaro(a: str, b: str) -> float:
    """Jaro similarity."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [b[j] for j in range(len(b)) if used[j]]
    moved = sum(x != y for x, y in zip(first, second, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


MODES = {"naive": keyphrases, "tuned": tuned_keyphrases}


def document_keyphrases(docs: DataFrame, mode: str = "naive", most: int = 5, longest: int = 3, stop=X.STOPWORDS) -> DataFrame:
    """doc_id, rank, phrase, score."""
    kernel, words = MODES[mode], frozenset(stop)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, k + 1, p, round(v, 9)) for d, t in zip(b["doc_id"], b["text"], strict=True) for k, (p, v) in enumerate(kernel(t, most, longest, words))]
            yield pd.DataFrame(rows, columns=["doc_id", "rank", "phrase", "score"])

    return dealt(docs.select("doc_id", "text"), "doc_id").mapInPandas(run, "doc_id long, rank int, phrase string, score double")


def names(text: str, stop=frozenset(X.STOPWORDS), skip=frozenset()) -> list[tuple[str, str]]:
    """(name, reason) of capitalised runs: two or three words anywhere, one longer word only inside a sentence."""
    out, seen, at = [], set(), 0
    text = text or ""
    for begin, end in [*(m.span(1) for m in _ENDS.finditer(text)), (len(text), len(text))]:
        sentence, at = text[at:begin], end
        # a capital in the first word only makes no name
        if not _CAPITAL.search(sentence, _FIRST.match(sentence).end()):
            continue
        # only words whose first letter or digit is A-Z can count, so only these are trimmed
        words = [_QUOTED.sub("", _EDGES.sub("", w)) if _OPENS.match(w) else "" for w in sentence.split()]
        capital = [len(w) >= 2 and w[0].isupper() for w in words]
        i = 0
        while i < len(words):
            if not capital[i]:
                i += 1
                continue
            j = i
            while j < len(words) and capital[j]:
                j += 1
            run, start = words[i:j], i == 0
            i = j
            low = " ".join(run).lower()
            if low in seen or run[0].lower() in stop or run[0].lower() in skip:
                continue
            if 2 <= len(run) <= 3:
                out.append((low, "sentence_start_multiword" if start else "mid_sentence_multiword"))
                seen.add(low)
            elif len(run) == 1 and not start and len(low) > 3 and low not in skip:
                out.append((low, "mid_sentence_single_capitalized"))
                seen.add(low)
    return out


def document_names(docs: DataFrame, stop=X.STOPWORDS, skip: tuple[str, ...] = (), deal: bool = True) -> DataFrame:
    """doc_id, name, reason. deal: False where texts come in parts of like size."""
    words, skipped = frozenset(stop), frozenset(skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, n, r) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for n, r in names(t, words, skipped)]
            ids, found, why = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(why, pa.string())], names=["doc_id", "name", "reason"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (dealt(texts, "doc_id") if deal else texts).mapInArrow(run, "doc_id long, name string, reason string")


def known_entities(docs: DataFrame, gazetteer: DataFrame, deal: bool = True) -> DataFrame:
    """doc_id, name, form: entities of a bounded gazetteer (name, form, place) that a text mentions; of several forms the one listed first."""
    from gleaner.operators.phrases import contained

    found = contained(docs, gazetteer.select(F.col("form").alias("term")).distinct(), deal).withColumnRenamed("term", "form")
    return found.join(gazetteer.select("name", "form", "place"), "form").groupBy("doc_id", "name").agg(F.min(F.struct("place", "form"))["form"].alias("form"))


def decide(candidates: DataFrame, most: int = 5) -> DataFrame:
    """candidates (doc_id, slug, kind, rank_score) with decision: the best of each slug stays, entities always, others up to `most`."""
    from pyspark.sql import Window

    by_slug = Window.partitionBy("doc_id", "slug").orderBy(F.desc("rank_score"), "kind", "slug")
    rows = candidates.withColumn("double", F.row_number().over(by_slug) > 1)
    counted = ~F.col("double") & (F.col("kind") != "entity")
    order = Window.partitionBy("doc_id").orderBy(F.desc("rank_score"), "slug").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("so_far", F.sum(counted.cast("int")).over(order))
    decision = F.when(F.col("double"), "duplicate_slug").when(counted & (F.col("so_far") > most), "max_topics_reached").otherwise("accepted")
    return rows.withColumn("decision", decision).drop("double", "so_far")
