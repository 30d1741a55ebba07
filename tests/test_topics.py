"""The topic pipeline as a whole."""

import datetime

import pytest
from pyspark.sql import functions as F

from gleaner.plans import corpus as C


@pytest.fixture(scope="module")
def built(spark):
    texts = [f"Today the vibe coding trend met prompt injection in Ada Lovelace notes number{k}. Then vibe coding and prompt injection again." for k in range(12)]
    texts += [f"unrelated filler{k} sentence about other{k} matters entirely" for k in range(30)]
    docs = spark.createDataFrame([(k, t, f"e{k % 4}") for k, t in enumerate(texts)] + [(90, None, "e0"), (91, "", "e1")], "doc_id long, text string, episode_id string")
    gazetteer = spark.createDataFrame([("Ada Lovelace", "ada lovelace", 1), ("Ada Lovelace", "lovelace", 2)], "name string, form string, place int")
    return C.build(docs, gazetteer)


def test_topics(built):
    rows = {r["name"]: r for r in built.topics.collect()}
    assert rows["Ada Lovelace"]["kind"] == "entity" and rows["Ada Lovelace"]["usage"] == 12 and rows["Ada Lovelace"]["support"] == 4
    assert any("prompt injection" in n and r["usage"] == 12 for n, r in rows.items())  # alike phrases are merged into one of them
    slugs = {r["slug"]: r["topic_id"] for r in built.final.topics.collect()}
    merged = {a: b for a, b, *_ in map(tuple, built.final.merges.collect())}
    assert merged.get(slugs["prompt-injection"], slugs["prompt-injection"]) in {r["topic_id"] for r in rows.values()}


def test_nothing_hangs_loose(built):
    assert built.links.join(built.topics, "topic_id", "left_anti").count() == 0
    assert built.topics.join(built.links, "topic_id", "left_anti").count() == 0
    assert built.artifacts.filter(F.size("warnings") > 0).count() == 2
    assert {r["metric"]: r["value"] for r in C.characterization(built).collect()}["broken_links"] == 0


def test_finalising_twice_changes_nothing(built):
    f = built.final
    again = C.Z.finalized(C.Z.Corpus(f.rows, f.topics, f.links, f.audit, f.merges))
    key = lambda df: sorted((r["topic_id"], r["usage"], r["support"], r["reason"] or "") for r in df.collect())
    assert key(again.topics) == key(f.topics)
    assert sorted(map(tuple, again.links.collect())) == sorted(map(tuple, built.links.collect()))


def test_sentences_and_eras(spark):
    rows = spark.createDataFrame([("April 2025", 2, 1, ["a", "b", "c", "d"], 1), ("May 2025", 1, 5, [], 0)], "label string, episodes int, chunks int, top array<string>, new_topics int")
    got = {r["label"]: r["summary"] for r in C.period_sentences(rows).collect()}
    assert got["April 2025"] == "April 2025 has 2 episodes with 1 chunk. It is mostly about a, b, and c. 1 topic appears for the first time."
    assert got["May 2025"] == "May 2025 has 1 episode with 5 chunks."
    docs = spark.createDataFrame([(datetime.date(2025, 2, 1), "ai ai"), (datetime.date(2025, 5, 1), "ai")], "day date, text string")
    assert sorted((r["quarter"], r["hits"]) for r in C.era_markers(docs, "day", {"ai": "ai"}).collect()) == [("2025-Q1", 2), ("2025-Q2", 1)]


def test_lexicon_gates_before_it_cuts(spark):
    """A noise phrase of the best quality takes nobody's place, and a repeated three-word phrase becomes a candidate."""
    from gleaner.functions import gates as G

    noise = sorted(G.DEFAULT.starters, key=lambda w: (-len(w), w))[0]
    texts = [f"{noise} quagmire{k}z {noise} zebrafish" for k in range(5)] + [f"solid state battery cell{k}q" for k in range(6)] + [f"other{k} text{k}" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert C.G.is_noise is G.is_noise and C.P.phrase_lexicon(docs, most=1).collect()[0]["phrase"] == f"{noise} zebrafish"
    got = [r["phrase"] for r in C.gated_lexicon(docs, most=50).collect()]
    assert "solid state battery" in got and not any(noise in p for p in got)
    assert C.gated_lexicon(docs, most=1).count() == 1
    found = C.candidates(docs, lexicon=C.gated_lexicon(docs)).filter("source = 'phrase_lexicon' AND raw = 'solid state battery'")
    assert found.count() == 6


def test_words_and_runs_are_counted_where_texts_are(spark, monkeypatch):
    """Sums of tasks equal the counts of plain expressions, for odd letters too, with and without words that go along."""
    import random

    from gleaner.functions import text as X
    from gleaner.operators import tallies as T

    draw = random.Random(3)
    some = ["alpha", "Kelvin", "İstan bul", "it's", "x-y-z", "the", "ab", "über", "naïve", "9lives", "--", "Beta", "gamma", "''s"]
    rows = [(k, " ".join(draw.choice(some) + draw.choice(["", ".", ",", "\n"]) for _ in range(draw.randrange(25)))) for k in range(150)]
    docs = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string").repartition(3)
    kept = F.filter(X.words_kept(F.col("text")), lambda w: (F.length(w) >= 3) & ~w.isin(*X.STOPWORDS))
    plain = docs.select("doc_id", F.explode(kept).alias("word")).groupBy("word").agg(F.count("*").alias("total"), F.count_distinct("doc_id").alias("docs"))
    words = T.word_counts(docs).cache()
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, plain.collect()))
    for least in (1, 3, 12):
        told = sorted((r["phrase"], r["docs"]) for r in C.P.repeated_ngrams(docs, least).collect())
        # summed as numbers, spelled out as no word goes along, told first by groups of texts, by small groups, by too many
        for most in ({}, {"MOST_WORDS": 0}, {"MANY_TEXTS": 0}, {"MANY_TEXTS": 0, "MOST_RUNS": 1, "MOST_BYTES": 200}, {"MANY_TEXTS": 0, "MOST_CANDIDATES": 1}):
            with monkeypatch.context() as m:
                for name, value in most.items():
                    m.setattr(T, name, value)
                assert sorted(map(tuple, T.run_counts(docs, words, least).collect())) == told


def test_rare_phrases_are_counted_only_if_frequent_ones_are_too_few(spark, monkeypatch):
    texts = [f"solid state battery cell{k} with quantum annealing{k % 7}" for k in range(300)] + [f"carbon capture plant{k} number{k}" for k in range(200)] + [f"other{k} text{k}" for k in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = sorted(map(tuple, C.gated_lexicon(docs, most=1000).collect()), key=lambda r: (-r[3], -r[1], r[0]))
    counted = []
    monkeypatch.setattr(C.P, "phrase_lexicon", lambda *_: pytest.fail("pairs were counted"))
    monkeypatch.setattr(C.T, "run_counts", lambda docs, words, least, own=C.T.run_counts: counted.append(least) or own(docs, words, least))
    assert list(map(tuple, C.gated_lexicon(docs, most=4).collect())) == every[:4]
    assert counted and min(counted) > 3


def test_without_terms_no_text_is_read(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string").withColumn("text", F.when(F.raise_error(F.lit("read")).isNull(), F.col("text")))
    assert C.Z.matcher.with_bounds(docs, spark.createDataFrame([], "term string")).count() == 0
