"""Finalisation as a whole: merges in a chain, gates, validation, flags; and the matcher that it rests on."""

import datetime
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.operators import matcher
from gleaner.plans import finalization as Z

TOPICS = "topic_id long, name string, slug string, kind string, distinctiveness double, usage long, support long, hidden boolean, reason string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_closed(spark):
    df = lambda pairs: spark.createDataFrame(pairs, "topic_id long, keeper_id long")
    assert rows(Z.closed(df([(1, 2), (2, 3), (3, 4), (4, 5), (9, 5), (7, 7)]))) == [(1, 5), (2, 5), (3, 5), (4, 5), (9, 5)]
    with pytest.raises(ValueError):
        Z.closed(df([(1, 2), (2, 1)]), rounds=4)


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(8)
    parts = ["Ada", "Lovelace", "c++", "data", "model", "models", "a.b", "bigdata", "adam", "x", "", "Ünï"]
    out = [(k, "".join(rnd.choice(parts) + rnd.choice([" ", "", "-", ". ", "\n"]) for _ in range(30))) for k in range(60)] + [(100, None), (101, "")]
    return out, spark.createDataFrame(out, "doc_id long, text string")


def test_matcher(spark, texts):
    out, docs = texts
    terms = ["ada", "Ada Lovelace", "c++", "a.b", "data model", "data", "x", "model", "ünï", "", "zzz"]
    frame = spark.createDataFrame([(t,) for t in terms] + [(None,)], "term string")
    low = lambda t: (t or "").lower()
    form = lambda t: " " + re.sub("[^a-z0-9]+", " ", low(t)).strip() + " "
    assert set(rows(matcher.with_substrings(docs, frame))) == {(d, t) for d, x in out for t in terms if t and low(t) in low(x)}
    bound = lambda t: f"(^|[^a-z0-9]){re.escape(low(t))}($|[^a-z0-9])"
    assert set(rows(matcher.with_bounds(docs, frame))) == {(d, t) for d, x in out for t in terms if t and re.search(bound(t), low(x))}
    assert set(rows(matcher.with_words(docs, frame))) == {(d, t) for d, x in out for t in terms if form(t).strip() and form(t) in form(x)}


def test_matcher_in_parts(spark, texts):
    """Terms that are too many for one pass are dealt to several, with the same result."""
    _, docs = texts
    shaped = spark.createDataFrame([(t, t) for t in ("ada", "data", "model", "x", "c++")], "term string, form string")
    low = docs.select("doc_id", F.lower("text").alias("form"))
    assert rows(matcher.held(low, shaped, most_bytes=25)) == rows(matcher.held(low, shaped)) != []


@pytest.fixture(scope="module")
def corpus(spark):
    """Topics whose names are variants of each other, linked at random, with a wrong entity link, an orphan and a narrow topic."""
    rnd = random.Random(3)
    names = ["vector index", "vector indexes", "vector indexing", "agentic coding", "agentic codings", "sparse retrieval", "sparse retrievals", "retrieval quality", "Ada Lovelace", "Lovelace", "token budget", "tokens budget", "make thing", "narrow topic phrase", "orphan phrase"]
    kinds = ["entity" if n in ("Ada Lovelace", "Lovelace") else "phrase" for n in names]
    text = ["Ada Lovelace wrote about the vector index and token budget.", "Lovelace on sparse retrieval quality", "agentic coding with vector indexes", "nothing here", "ADA LOVELACE!", "unlovelaced words"]
    docs = [(d, d % 4, text[d % len(text)], datetime.date(2024, 1 + d % 12, 1)) for d in range(24)]
    links = {(d, t) for t in range(len(names) - 1) for d in rnd.sample(range(24), 9) if names[t] != "narrow topic phrase"} | {(0, 13), (4, 13)}
    slug = lambda n: re.sub("[^a-z0-9]+", "-", n.lower())
    usage = Counter(t for _, t in links)
    topics = [(t, n, slug(n), kinds[t], 30.0, usage[t], 1, False, None) for t, n in enumerate(names)]
    frames = lambda: Z.Corpus(
        spark.createDataFrame(docs, "doc_id long, episode_id long, text string, published date"),
        spark.createDataFrame(topics, TOPICS),
        spark.createDataFrame(sorted(links), "chunk_id long, topic_id long"),
        spark.createDataFrame([(d, t, slug(names[t]), "phrase_lexicon", "accepted") for d, t in sorted(links)], "doc_id long, topic_id long, slug string, source string, decision string"),
        spark.createDataFrame([], Z.MERGE_SCHEMA),
    )
    aliases = spark.createDataFrame([("lovelace", "Ada Lovelace", 1)], "alias string, canonical string, place int")
    return docs, names, links, frames, aliases


def test_finalized(spark, corpus):
    docs, names, links, frames, aliases = corpus
    c = Z.finalized(frames(), aliases=aliases)
    merges = {a: (b, stage) for a, b, stage, _ in rows(c.merges)}
    by_name = {n: t for t, n in enumerate(names)}
    stages = {names[a]: stage for a, (_, stage) in merges.items()}
    assert stages["Lovelace"] == "alias_merge" and merges[by_name["Lovelace"]][0] == by_name["Ada Lovelace"]
    assert {"canonicalize_topics", "alias_merge"} <= set(stages.values())
    assert len([s for n, s in stages.items() if n.startswith("vector")]) == 2  # three variants became one

    # links by hand: pruned topics have none, merged ones are their keeper's, entities only where the text names them
    def keeper(t):
        while t in merges:
            t = merges[t][0]
        return t

    topics = {r["topic_id"]: r for r in c.topics.collect()}
    gone = {t for t, r in topics.items() if r["hidden"] and t not in merges}
    assert {names[t] for t in gone} == {"make thing", "narrow topic phrase"} and {topics[t]["reason"] for t in gone} == {"noise_cleanup", "low_episode_spread"}
    text = {d[0]: d[2].lower() for d in docs}
    want = {(d, keeper(t)) for d, t in links if keeper(t) not in gone}
    want = {(d, t) for d, t in want if names[t] != "Ada Lovelace" or "ada lovelace" in text[d]}
    assert set(rows(c.links)) == want
    usage, support = Counter(t for _, t in want), {t: len({docs[d][1] for d, u in want if u == t}) for t in range(len(names))}
    for t, r in topics.items():
        assert (r["usage"], r["support"]) == (usage[t], support[t]), names[t]
        assert r["provenance_complete"] == (t not in merges and any(keeper(u) == t for _, u in links))
        assert r["entity_verified"] == (r["kind"] == "entity" and usage[t] > 0)
    assert by_name["orphan phrase"] not in topics
    assert set(rows(c.episode_topics)) == {(docs[d][1], t) for d, t in want}
    shown = {t for t, r in topics.items() if not r["suppressed"]}
    reach = {d[0]: sum(usage[t] for e, t in want if e == d[0] and t in shown) for d in docs}
    assert dict(rows(c.reach)) == reach and any(reach.values())

    again = Z.finalized(Z.Corpus(c.rows, c.topics, c.links, c.audit, c.merges), aliases=aliases)
    columns = ["topic_id", "name", "slug", "usage", "support", "hidden", "reason", "suppressed"]
    assert rows(again.topics.select(*columns)) == rows(c.topics.select(*columns)) and rows(again.links) == rows(c.links) and rows(again.merges) == rows(c.merges)


def test_backfill(spark, corpus):
    """Every chunk that holds a phrase anywhere gets a link, once, and an audit row only where its slug wasn't accepted."""
    docs, names, links, frames, _ = corpus
    c = frames()
    lexicon = spark.createDataFrame([("vector index", "vector-index", 9, 9, 5.0), ("lovelace", "lovelace", 9, 9, 5.0), ("new phrase", "new-phrase", 9, 9, 5.0), ("weak phrase", "weak-phrase", 1, 1, 0.1)], "phrase string, slug string, docs long, support long, quality double")
    before = set(rows(c.audit))
    Z.backfilled(c, lexicon)
    added = set(rows(c.audit)) - before
    accepted = {(d, s) for d, _, s, _, _ in before}
    slugs = {"vector index": "vector-index", "lovelace": "lovelace"}
    assert {(d, s) for d, _, s, _, _ in added} == {(d[0], s) for d in docs for p, s in slugs.items() if p in d[2].lower() and (d[0], s) not in accepted}
    by_slug = {r["slug"]: r["topic_id"] for r in c.topics.collect()}
    assert "new-phrase" in by_slug and "weak-phrase" not in by_slug
    assert set(rows(c.links)) == links | {(d, by_slug[s]) for d, _, s, _, _ in added}


def test_terms_are_made_once_and_texts_gone_through_once(spark, tmp_path):
    """A term and its wholeness come from one pass; the frame of terms, which may be dear, is worked out a single time."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    docs = spark.createDataFrame([(1, "Other themes, the"), (2, "theme x. other"), (3, None), (4, "")], "doc_id long, text string")
    terms = spark.createDataFrame([("the",), ("theme",)], "term string").mapInPandas(counted, "term string")
    assert sorted(map(tuple, matcher.with_wholeness(docs, terms).collect())) == [(1, "the", True), (1, "theme", False), (2, "the", False), (2, "theme", True)]
    assert seen.value == 2


def test_only_inside(spark):
    """Phrases that stand in a text, but not as words: the SQL's form of a text has no apostrophe, so a phrase with one is never words there."""
    docs = spark.createDataFrame([(1, "bathe themes"), (2, "the theme. the themes"), (3, "the, themes"), (4, "don't know"), (5, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("the theme",), ("don't know",)], "term string")
    assert sorted(map(tuple, matcher.only_inside(docs, terms).collect())) == [(1, "the theme"), (4, "don't know")]
