"""The stored index: phrases, fields, alternatives, filters, skipping of blocks, and what a query reads."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import index as I
from gleaner.operators.search import Query, parse_query

D = datetime.date


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rows = [
        (1, "Café notes", "the open source model and the closed model", D(2024, 1, 1)),
        (2, "open", "source of truth", D(2024, 2, 1)),
        (3, "Open Source", "models of language", D(2024, 3, 1)),
        (4, None, "cafe open open source open source", D(2025, 1, 1)),
        (5, "", None, D(2025, 2, 1)),
        (6, "llm", "large language model", D(2025, 3, 1)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, title string, content string, published date")
    return I.build_index(docs, str(tmp_path_factory.mktemp("index") / "small"), buckets=4, block=2)


def ids(df):
    return [r["doc_id"] for r in df.collect()]


def test_phrases_stay_in_one_field(small):
    assert set(ids(small.search(Query(phrases=["open source"])))) == {1, 3, 4}  # not 2, where it spans both fields
    assert set(ids(small.search(Query(text="CAFÉ")))) == {1, 4}
    assert ids(small.search(Query(text="no such word"))) == [] and ids(small.search(Query())) == []


def test_occurrences_and_weights(small):
    row = {r["doc_id"]: r["f"] for r in small.hits([("open", "source"), ("open",)], [5.0, 1.0]).collect()}
    assert row == {1: [1.0, 1.0], 2: [0.0, 5.0], 3: [5.0, 5.0], 4: [2.0, 3.0]}


def test_alternatives(small):
    assert I.expression(Query(text="llm OR large language model", phrases=["model"])) == [[("llm",)], [("large", "language", "model"), ("model",)]]
    assert set(ids(small.search(Query(text="llm OR truth")))) == {2, 6}
    q = I.with_aliases(Query(text="LLM"), [("Large Language Model", ["llm", "language model"])])
    assert q.text == "llm OR large language model OR language model"
    assert ids(small.search(q)) == [6]


def test_filters(spark, small):
    assert set(ids(small.search(parse_query("open after:2024-02-01 before:2024-12-31")))) == {2, 3}
    assert set(ids(small.search(parse_query("open year:2025")))) == {4}
    some = spark.createDataFrame([(1, "a", "A"), (1, "b", "B"), (4, "a", "A"), (3, "b", "B")], "doc_id long, slug string, name string")
    assert ids(small.search(parse_query("open"), allowed=I.topics_filter(some, ["a", "b", " a "]))) == [1]
    assert I.topics_filter(some, [" "]) is None
    assert set(ids(I.search_all(small, "open topic:a", assigned=some))) == {1, 4}


def test_score(small):
    """BM25 by hand: one phrase, fields weighted 5 and 1, lengths over both fields."""
    got = {r["doc_id"]: (r["raw"], r["score"]) for r in small.search(Query(text="model")).collect()}
    lengths, f = {1: 10, 2: 4, 3: 5, 4: 6, 5: 0, 6: 4}, {1: 2.0, 6: 1.0}
    mean, idf = sum(lengths.values()) / 6, math.log((6 - 2 + 0.5) / 2.5)
    want = {d: round(idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * lengths[d] / mean)), 6) for d, n in f.items()}
    assert {d: x for d, (x, _) in got.items()} == want
    assert sorted(s for _, s in got.values()) == [0.0, 1.0]


def test_boost_and_vectors(spark, small):
    some = spark.createDataFrame([(2, "open", "Open")], "doc_id long, slug string, name string")
    plain = {r["doc_id"]: r["score"] for r in I.search_all(small, "open").collect()}
    boosted = {r["doc_id"]: r["score"] for r in I.search_all(small, "open", assigned=some).collect()}
    assert boosted[2] == pytest.approx(plain[2] + 0.15) and boosted[4] == plain[4]
    vectors = spark.createDataFrame([(5, [1.0, 0.0]), (3, [0.8, 0.6]), (6, [0.0, 1.0])], "doc_id long, v array<double>")
    got = {r["doc_id"]: (r["fts"], r["vec"]) for r in I.search_all(small, "open", vectors=vectors, asked=[1.0, 0.0]).collect()}
    assert got[5] == (None, 1.0) and got[3][1] == 0.8 and 6 not in got
    assert 5 not in ids(I.search_all(small, '"open source"', vectors=vectors, asked=[1.0, 0.0]))


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    rnd = random.Random(2)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(40_000)]
    rows = [(k, " ".join(words[k * 20 : k * 20 + rnd.randint(0, 3)]), " ".join(words[k * 20 : k * 20 + rnd.randint(1, 20)]), D(2024, 1, 1) + datetime.timedelta(days=k % 400)) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, content string, published date")
    return I.build_index(docs, str(tmp_path_factory.mktemp("index") / "large"), buckets=8, block=25)


@pytest.mark.parametrize("raw", ["w7", "w1", "w3 OR w9 OR w40 year:2024", '"w1" "w2"', "w11 after:2024-06-01", '"w2" "w5" before:2024-03-01'])
def test_skipping_blocks_loses_nothing(large, raw):
    q = parse_query(raw)
    whole, skipped = (large.search(q, most=7, skip=s).collect() for s in (False, True))
    assert whole == skipped and whole


def test_blocks_are_skipped(large):
    phrases = [("w9",)]
    idf = large.rarity(phrases, None)
    best = lambda blocks: large.scored(large.hits(phrases, [5.0, 1.0], blocks), [phrases], phrases, idf, Query(), None, None).orderBy(F.desc("raw")).limit(3)
    assert large.promising([phrases], phrases, idf, [5.0, 1.0], best, 3).count() < 0.7 * large.rows_of("maxima", ["w9"]).count()
    assert idf == large.rarity(phrases, large.hits(phrases, [5.0, 1.0]))


def test_a_query_reads_only_its_terms(large):
    """The plan prunes folders and pushes the terms to the scan; the files read are those of the terms' folders."""
    rows = large.rows_of("postings", ["w7"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "In(term, [w7])" in plan.replace("EqualTo(term,w7)", "In(term, [w7])")
    folders = {r[0].split("bucket=")[1].split("/")[0] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert len(folders) == 1
    assert rows.select("term").distinct().count() == 1


def test_a_phrase_is_looked_up_once(spark, tmp_path, monkeypatch):
    """Its hits are stored for its frequency and its scores; a term's documents are counted without telling documents apart."""
    from gleaner.operators import index as I

    docs = spark.createDataFrame([(1, "of the", "of the sea the", None), (2, "sea", "the of", None), (3, "the", None, None)], "doc_id long, title string, content string, published date").coalesce(1)
    built = I.build_index(docs, str(tmp_path / "index"))
    assert {r["term"]: r["docs"] for r in built.rows_of("maxima", ["of", "the", "sea"]).collect()} == {"of": 2, "the": 3, "sea": 2}
    kept = []
    monkeypatch.setattr(I, "written", lambda df, name: kept.append(name) or df.localCheckpoint())
    assert [r["doc_id"] for r in built.search(I.parse_query('"of the"')).collect()] == [1] and kept == ["found"]
