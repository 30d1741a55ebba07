"""Column functions with values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.functions import gates as G
from gleaner.functions import text as X
from gleaner.functions.scores import weighted_delta, weighted_score
from gleaner.functions.vectors import blend, cosine, mean_pool, parse_vector
from gleaner.operators import analytics as A


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("word,want", [("systems", "system"), ("processes", "process"), ("llms", "llms"), ("bus", "bus"), ("policies", "policy"), ("boxes", "box"), ("analysis", "analysis"), ("series", "series")])
def test_singular(spark, word, want):
    assert one(spark, X.singular(F.lit(word))) == want


def test_normalize_term(spark):
    assert one(spark, X.normalize_term(F.lit("Grubby Truffles"))) == "grubby truffle"
    assert one(spark, X.normalize_term(F.lit("  Multi-word 'Agents'! "))) == "multi word agent"


@pytest.mark.parametrize("word,want", [("chatbots", "chatbot"), ("models", "model"), ("computing", "comput"), ("creating", "create"), ("created", "create"), ("policies", "policy"), ("relational", "relate"), ("automation", "automate"), ("the", "the"), ("agreed", "agreed"), ("glasses", "glass")])
def test_stem(spark, word, want):
    assert one(spark, X.stem(F.lit(word))) == want


@pytest.mark.parametrize("a,b,want", [("same", "same", 1.0), ("abc", "xyz", 0.0), ("OpenAI", "openai", 1.0), ("chatbot", "chatbots", 0.923077), ("model", "models", 0.888889), ("consumer ai", "consumer ai goes", 0.8), ("a", "b", 0.0)])
def test_dice(spark, a, b, want):
    assert one(spark, X.dice(F.lit(a), F.lit(b))) == pytest.approx(want, abs=1e-6)


def test_normalize_and_warnings(spark):
    text = f"&amp;lt; {chr(0x201C)}x{chr(0x201D)} a{chr(0x2014)}b{chr(0xA0)}c\t\n&apos;d&apos; &copy;"
    assert one(spark, X.normalize(F.lit(text))) == "< \"x\" a-b c 'd' &copy;"
    assert one(spark, X.warnings(X.normalize(F.lit(text)))) == ["residual_html_entity"]
    assert one(spark, X.normalize(F.lit(None).cast("string"))) == ""
    assert one(spark, X.warnings(F.lit(""))) == ["empty_after_normalization"]


def test_tokens(spark):
    assert one(spark, X.tokenize(F.lit("The agents don't över-think; models THINK about it"))) == ["agents", "don't", "ver-think", "models", "think"]


def test_slug(spark):
    assert one(spark, X.slugify(F.lit("  It's a Test -- Case! "))) == "its-a-test-case"


def test_kwic_and_excerpt(spark):
    k = one(spark, X.kwic(F.lit("aaa bbb Key ccc"), "key", 4))
    assert (k["left"], k["right"]) == (chr(0x2026) + "bbb ", " ccc")
    assert one(spark, X.kwic(F.lit("nothing"), "key")) is None
    assert one(spark, X.highlight(F.lit("a <b> Key & key"), "key")) == "a &lt;b&gt; <mark>Key</mark> &amp; <mark>key</mark>"


def test_html_parts(spark):
    page = '<html><title>A &amp; B</title><a href="x">l</a><a href="x">m</a></html>'
    assert one(spark, X.title_of(F.lit(page))) == "A & B"
    assert one(spark, X.hrefs(F.lit(page))) == ["x"]
    assert one(spark, X.strip_html(F.lit(page))) == "A & B l m"
    assert one(spark, X.unwrap_redirect(F.lit("https://www.google.com/url?q=https://a.b/c%3Fd&amp;sa=1"))) == "https://a.b/c?d"
    assert one(spark, X.host_label(F.lit("https://www.Example.com:80/x"))) == "example.com"


def test_lists(spark):
    for items, want in ((["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b, and c")):
        assert one(spark, X.oxford_list(F.array(*map(F.lit, items)))) == want


@pytest.mark.parametrize("text,want", [("4/6/26", datetime.date(2026, 4, 6)), ("12/31/1999", datetime.date(1999, 12, 31)), ("2/30/24", None), ("13/1/24", None), ("x", None), ("1/2/345", None)])
def test_dates(spark, text, want):
    assert one(spark, D.parse_episode_date(F.lit(text))) == want


def test_periods(spark):
    assert D.period_bounds(2024, 2) == (datetime.date(2024, 2, 1), datetime.date(2024, 2, 29))
    assert D.period_bounds(2025, 12)[1] == datetime.date(2025, 12, 31)
    assert D.previous_period(2025, 1) == (2024, 12) and D.previous_period(2025) == (2024, None)
    assert D.parse_period_path("/2025/4") == (2025, 4) and D.parse_period_path("/2025/13") is None and D.parse_period_path("/25") is None
    assert D.period_label(2025, 4) == "April 2025"
    day = lambda *x: F.lit(datetime.date(*x))
    assert one(spark, D.quarters(day(2025, 5, 1), day(2026, 2, 1))) == ["2025-Q2", "2025-Q3", "2025-Q4", "2026-Q1"]
    assert one(spark, D.quarters(day(2026, 5, 1), day(2026, 2, 1))) == []
    assert one(spark, D.human(day(2024, 4, 8))) == "April 8, 2024"
    assert one(spark, D.month_name(F.lit(3))) == "March" and one(spark, D.month_name(F.lit(13))) == ""


@pytest.mark.parametrize("n,want", [(1, 2), (2, 2), (3, 2), (4, 2), (5, 3), (8, 3), (9, 4)])
def test_support_threshold(spark, n, want):
    assert one(spark, A.support_threshold(F.lit(n))) == want


def test_vectors(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    assert one(spark, cosine(v(1, 0), v(1, 1))) == pytest.approx(0.70710678)
    assert one(spark, cosine(v(1, 0), v(1))) is None and one(spark, cosine(v(0, 0), v(1, 1))) is None
    assert one(spark, blend(F.lit(0.984822), F.lit(5 / 6))) == pytest.approx(0.931801, abs=1e-6)
    assert one(spark, blend(F.lit(None).cast("double"), F.lit(0.5))) == 0.5
    pooled = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0]), (2, [1.0]), (2, [1.0, 2.0])], "k int, v array<double>")
    assert {r["k"]: r["pooled"] for r in mean_pool(pooled, "k", "v").collect()} == {1: [2.0, 4.0], 2: None}
    assert one(spark, parse_vector(F.lit("[1, 2.5]"))) == [1.0, 2.5] and one(spark, parse_vector(F.lit("[]"))) is None and one(spark, parse_vector(F.lit("x"))) is None


def test_scores(spark):
    assert one(spark, weighted_score(F.lit(0), F.lit(-5.0))) == pytest.approx(0.693147, abs=1e-6)
    assert one(spark, weighted_delta(F.lit(-2), F.lit(1), F.lit(3), F.lit(10.0))) == pytest.approx(2 * 1.386294 * 2, abs=1e-5)


@pytest.mark.parametrize("name,want", [("quickly", True), ("optimize", True), ("moment", True), ("goes", True), ("abc", True), ("someone else", True), ("make take", True), ("prompt injection", False), ("compiler", False), ("thing", True)])
def test_noise(spark, name, want):
    assert one(spark, G.is_noise(F.lit(name))) is want


def test_promotion(spark):
    reason = lambda *a, **k: one(spark, G.promotion_reason(*map(F.lit, a), **{x: F.lit(y) for x, y in k.items()}))
    assert reason("compiler", "concept", 5, 2, 25.0, 0) is None
    assert reason("compiler", "concept", 5, 1, 25.0, 0) == "insufficient_episode_support"
    assert reason("compiler", "concept", 4, 1, 25.0, 0, model=1) is None
    assert reason("compiler", "concept", 9, 9, 5.0, 1) == "low_distinctiveness_support"
    assert reason("vibe coding", "concept", 3, 2, 0.0, 0) == "insufficient_chunk_support"
    assert reason("vibe coding", "entity", 0, 0, 0.0, 0) is None


def test_escapes(spark):
    assert one(spark, X.escape_xml(F.lit("<a b='c\"'> & d"))) == "&lt;a b=&apos;c&quot;&apos;&gt; &amp; d"
    assert one(spark, X.escape_regex(F.lit("1+1 (a.b) [c]\\"))) == "1\\+1 \\(a\\.b\\) \\[c\\]\\\\"
    assert one(spark, X.json_for_html(F.struct(F.lit("</script>").alias("x"), F.lit(None).cast("int").alias("y")))) == '{"x":"<\\/script>","y":null}'
    assert one(spark, X.quoted_phrase(F.lit(' say "hello" '))) == '"say hello"'


@pytest.mark.parametrize("text,want", [("12", 12), ("7abc", 7), ("-3", 9), ("x", 9), ("", 9), (None, 9), ("99999999999999999999", 9)])
def test_whole_number(spark, text, want):
    assert one(spark, X.whole_number(F.lit(text).cast("string"), 9)) == want


def test_topic_tokens(spark):
    assert one(spark, X.topic_tokens(F.lit("Open-source AI, open models"))) == ["open-source", "ai,", "open", "models"]
