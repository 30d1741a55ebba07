"""Plans: filters and columns reach the scan, and no join is without a key but those with one-row or bounded sides."""

import pytest
from oracle import SF
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.queries()["chunks_in_period"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp" in text and "o_totalprice" not in text
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text


@pytest.mark.parametrize("name", ["topic_counts_in_period", "tokenize_counts", "corpus_ngrams", "adjacent_pmi_lexicon", "curate_topics", "related_topics_cooccurrence", "dice_pairs", "phrase_containment"])
def test_no_cartesian_product_and_no_python(spark, name):
    text = plan(catalog.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "Python" not in text and "ArrowEval" not in text


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(catalog.queries()["topic_rank_history"](spark, SF))
    assert "TakeOrderedAndProject" in plan(catalog.queries()["top_topics_weighted"](spark, SF))


def test_orphan_audit_reads_all_links(spark, tmp_path):
    """A topic that only an old chunk has is no orphan; one that no chunk has is."""
    from oracle import SF

    from gleaner.plans.relational import QUERIES

    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    part = read("part").limit(2).withColumn("p_partkey", F.row_number().over(Window.orderBy("p_partkey")).cast("long"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    read("orders").limit(1).withColumns({"o_orderkey": F.lit(7).cast("long"), "o_orderdate": F.lit("1995-02-03").cast(dict(read("orders").dtypes)["o_orderdate"])}).write.parquet(f"{tmp_path}/orders.parquet")
    read("lineitem").limit(1).withColumns({"l_orderkey": F.lit(7).cast("long"), "l_partkey": F.lit(1).cast("long")}).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r["topic_id"] for r in QUERIES["orphan_audit"](spark, str(tmp_path)).collect()] == [2]


def test_pairs_of_topics_go_to_their_topic_once(spark):
    """They are counted and ranked by one exchange on the topic; names and sizes come along instead of being joined to each pair."""
    import re

    text = plan(catalog.queries()["topic_similarity"](spark, SF))
    assert not re.search(r"hashpartitioning\(topic_id#\d+L?, related_id", text)


def test_phrases_are_counted_where_texts_are(spark):
    """Documents' texts are shuffled by id, not what is made of them: no exchange on id and phrase, and none after the count of a document."""
    for name in ("heuristic_phrases", "corpus_ngrams", "tokenize_counts"):
        assert "hashpartitioning(phrase" not in plan(catalog.queries()["heuristic_phrases"](spark, SF))
        assert "hashpartitioning(doc_id" in plan(catalog.queries()[name](spark, SF)) and ", doc_id#" not in "".join(x for x in plan(catalog.queries()[name](spark, SF)).splitlines() if "Exchange" in x)


def test_phrases_of_episodes_are_mined_once(spark):
    text = plan(catalog.queries()["episode_candidates"](spark, SF))
    assert "Join" not in text and "hashpartitioning(doc_id" not in text
    text = plan(catalog.queries()["episode_attribution"](spark, SF))
    assert "Generate" not in text  # candidates are read, not mined again


def test_words_of_runs_are_made_once(spark):
    """A long text's word pairs take time in proportion to it: its words aren't made anew for each pair."""
    import time

    from gleaner.functions import text as X

    docs = spark.createDataFrame([("the long road home again " * 4000,)], "text string")
    start = time.perf_counter()
    assert docs.select(F.size(X.word_ngrams(X.tokenize(F.col("text")), 2)).alias("n")).head()["n"] == 11_999
    assert time.perf_counter() - start < 20


def test_documents_that_share_an_id_are_one(spark):
    from gleaner.operators import phrases as P

    docs = spark.createDataFrame([(1, "amber river stone amber river"), (1, "amber river"), (2, None), (3, "amber river")], "doc_id long, text string")
    counts = {(r["doc_id"], r["phrase"]): r["n"] for r in P.phrase_candidates(docs, []).collect()}
    assert counts[1, "amber river"] == 3 and counts[3, "amber river"] == 1 and all(d != 2 for d, _ in counts)
    assert [(r["phrase"], r["total"], r["docs"]) for r in P.ngrams(docs, 4, 2).collect()] == [("amber river", 4, 2)]


def test_lexicon_names_are_made_once(spark):
    """Gates read written names: before, each mention of a name in a gate made it anew."""
    from gleaner.plans.corpus import gated_lexicon

    rows = spark.createDataFrame([(k, "amber river stone. Amber river stone again") for k in range(12)], "doc_id long, text string")
    found = gated_lexicon(rows)
    assert "translate(" not in plan(found) and {r["phrase"] for r in found.collect()} >= {"amber river", "river stone"}


def test_names_of_odd_words():
    from gleaner.operators.keywords import names

    assert [n for n, _ in names("We met 'Ada Byron's mother, 9Ada and (Carl) there. all lower. Émile Zola wrote")] == ["ada byron", "carl", "zola"]


def test_parts_grow_with_the_links(spark, tmp_path):
    """Pairs and links are dealt in parts whose size doesn't grow with the table: twice the rows of a part make more parts."""
    from gleaner.plans.roles import Corpus
    from gleaner.sources import shared

    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert shared.parts_of(spark, 10) == few and shared.parts_of(spark, 100 * shared.ROWS_A_PART + 1) == 101
    (tmp_path / "t").mkdir()
    for t in ("orders", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(tmp_path / "t" / f"{t}.parquet"))
    spark.range(6 * shared.ROWS_A_PART).selectExpr("id % 1000 AS l_orderkey", "id % 7 AS l_partkey").write.parquet(str(tmp_path / "t" / "lineitem.parquet"))
    c = Corpus(spark, str(tmp_path / "t"))
    assert c.parts == 6 and c.dealt_links.rdd.getNumPartitions() == 6


def test_mined_counts_sources_without_telling_them_apart_twice(spark):
    """Sources of a name are rows, null sources aren't one; texts of a table of one piece are dealt."""
    from gleaner.plans.gating import mined

    docs = spark.createDataFrame([(1, "a", "whale watching"), (2, "a", "whale whale"), (3, None, "Whale"), (4, "b", None)], "doc_id long, source string, text string").coalesce(1)
    assert {r["name"]: (r["usage"], r["support"]) for r in mined(docs).collect()} == {"whale": (3, 1)}
    assert mined(docs)._jdf.queryExecution().toString().count("RepartitionByExpression") >= 1
