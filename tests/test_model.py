"""Model answers: shapes, validation, replacement, boosts and promotion; phrases of episodes."""

import json

import pytest

from gleaner.operators import model as M

GOOD = json.dumps({"candidates": [
    {"name": " Ada  Lovelace ", "kind": "entity", "confidence": 3, "rank_position": 2, "aliases": ["Ada", ""], "evidence": [{"chunk_slug": "a-1", "quote": "Ada wrote"}, {"chunk_slug": "b-1", "quote": "of another episode"}, {"chunk_slug": "a-2", "quote": " "}]},
    {"name": "no evidence", "kind": "phrase", "evidence": [{"chunk_slug": "zz", "quote": "x"}]},
    {"name": "odd kind", "kind": "verb", "evidence": [{"chunk_slug": "a-1", "quote": "x"}]},
    {"name": "vector index", "kind": "phrase", "evidence": [{"chunk_slug": "a-2", "quote": "index"}, {"chunk_slug": "a-1", "quote": "the index"}]},
    {"name": "", "kind": "phrase", "evidence": [{"chunk_slug": "a-1", "quote": "x"}]},
]})
SHAPES = [GOOD, f"```json\n{GOOD}\n```", json.dumps(GOOD), *(json.dumps(x) for x in (
    {"response": GOOD}, {"result": {"response": GOOD}}, {"output_text": GOOD}, {"text": GOOD}, {"result": {"text": GOOD}}, {"content": GOOD}, {"result": {"content": GOOD}},
    {"choices": [{"message": {"content": GOOD}}]}, {"response": [{"content": [{"text": GOOD}]}]}, {"output": [{"content": [{"text": GOOD}]}]},
    {"result": {"output": [{"content": [{"text": GOOD}]}]}}, {"result": {"response": [{"content": [{"text": GOOD}]}]}}, {"x": [1, {"y": ["no", {"z": GOOD}]}]}))]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(1, 11, "a-1"), (1, 12, "a-2"), (2, 21, "b-1"), *((k, 100 * k, "a-1") for k in range(10, 40)), *((k, 100 * k + 1, "a-2") for k in range(10, 40))], "episode_id long, chunk_id long, slug string")


def test_every_shape_gives_the_same(spark, chunks):
    answers = spark.createDataFrame([(10 + k, s) for k, s in enumerate(SHAPES)] + [(38, "not json"), (39, None), (1, '{"other": 1}')], "episode_id long, raw string")
    got = M.candidates(answers, chunks).collect()
    by = {}
    for r in got:
        by.setdefault(r["episode_id"], []).append((r["place"], r["name"], r["slug"], r["kind"], r["confidence"], r["rank_position"], tuple(r["aliases"]), tuple((e["slug"], e["quote"]) for e in r["evidence"])))
    want = [(0, "Ada Lovelace", "ada-lovelace", "entity", 1.0, 2.0, ("Ada",), (("a-1", "Ada wrote"),)), (3, "vector index", "vector-index", "phrase", 0.5, 3.0, (), (("a-1", "the index"), ("a-2", "index")))]
    assert {k: sorted(v) for k, v in by.items()} == {10 + k: want for k in range(len(SHAPES))}


def test_too_deep_is_not_found():
    deep = GOOD
    for _ in range(M.DEEPEST + 1):
        deep = {"x": deep}
    assert M.answer_text(json.dumps({"x": deep})) is None
    assert M.answer_text(json.dumps({"a": {"b": {"c": GOOD}}})) == GOOD and M.answer_text("plain") == "plain" and M.answer_text(None) is None


def test_replacement_and_boosts(spark, chunks):
    first = M.candidates(spark.createDataFrame([(1, GOOD), (10, GOOD)], "episode_id long, raw string"), chunks)
    asked = spark.createDataFrame([(1, '{"candidates": []}')], "episode_id long, raw string")
    both = M.replaced(first, M.candidates(asked, chunks), asked)
    assert {r["episode_id"] for r in both.collect()} == {10}
    got = {(r["chunk_id"], r["slug"]): (r["kind"], r["confidence"]) for r in M.boosts(first.filter("episode_id = 1")).collect()}
    assert got == {(11, "ada-lovelace"): ("entity", 1.0), (11, "vector-index"): ("phrase", 0.5), (12, "vector-index"): ("phrase", 0.5)}


def test_boosts_reach_promotion(spark, chunks):
    found = M.candidates(spark.createDataFrame([(1, GOOD)], "episode_id long, raw string"), chunks)
    stats = spark.createDataFrame([("vector-index", "vector index", "phrase", 3, 1, 50.0, 9), ("other-words", "other words", "phrase", 3, 1, 50.0, 9)], "slug string, name string, kind string, chunks long, episodes long, distinctiveness double, usage long")
    got = {r["slug"]: r["reason"] for r in M.promoted_with(stats, found).collect()}
    assert got == {"vector-index": None, "other-words": "insufficient_episode_support"}


def test_prompts(spark):
    rows = spark.createDataFrame([(1, 2, "b", "B", "second &amp; last"), (1, 1, "a", "A", "first  text")], "episode_id long, position int, slug string, title string, text string")
    messages = M.prompts(rows, "be brief", "give names", excerpt=5).head()["messages"]
    body = json.loads(messages[1]["content"])
    assert messages[0]["content"] == "be brief" and body["normalized_episode_text"] == "first text second & last"
    assert body["chunks"] == [{"slug": "a", "title": "A", "excerpt": "first"}, {"slug": "b", "title": "B", "excerpt": "secon"}]


def test_episode_candidates(spark):
    """Phrases of the lexicon go before mined ones, these before entities; one slug counts once, and the cap holds."""
    from gleaner.operators import episodes as E

    text = ["Ada Lovelace built the vector index quickly.", "vector index again and Vector-Index, spectral harmonic engine", "nothing"]
    rows = spark.createDataFrame([(k, 1 if k < 3 else 2, text[k % 3]) for k in range(6)], "doc_id long, episode_id long, text string")
    lexicon = spark.createDataFrame([("vector index", 3.0)], "phrase string, quality double")
    gazetteer = spark.createDataFrame([("Ada Lovelace", "ada lovelace", 1)], "name string, form string, place int")
    found = E.episode_candidates(rows, ["real"], lexicon, gazetteer)
    got = [(r["name"], r["source"]) for r in found.filter("episode_id = 1").orderBy("rank").collect()]
    assert got[0] == ("vector index", "phrase_lexicon") and got[-1] == ("Ada Lovelace", "known_entity")
    assert {s for _, s in got[1:-1]} == {"episode_phrase"} and len({n for n, _ in got}) == len(got)
    assert E.episode_candidates(rows, ["real"], lexicon, gazetteer, most=3).groupBy("episode_id").count().filter("count = 3").count() == 2
    placed = {(r["doc_id"], r["name"]) for r in E.attributed(rows, found).filter("decision = 'accepted'").collect()}
    assert (0, "Ada Lovelace") in placed and (1, "vector index") in placed and not any(d in (2, 5) for d, _ in placed)
