"""The pipeline's stages, each judged on its own input."""

import random
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name))
        out.append((name, docs, stage(spark, docs, SF)))
        out[-1][2].write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        out[-1] = (*out[-1][:2], docs)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    """Documents with null ids, repeated rows, ids shared by different texts, null texts and columns whose names clash with those inside operators."""
    rnd = random.Random(9)
    base = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    own = [" ".join(f"{rnd.choice('abcdefgh')}{rnd.randint(0, 900)}" for _ in range(60)) for _ in range(3)]
    texts = [(i, t) for i, t in enumerate(base)] + [(i, t) for i, t in enumerate(base[:20])]
    texts += [(None, own[0]), (None, own[0]), (None, own[1]), (50, own[1]), (60, own[2]), (60, own[0] + " x"), (60, None), (61, ""), (61, "")]
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), d, "n", 1, 2) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long, decided_id long, node string, leader int, row int").repartition(4)


def counted(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_columns_and_flow(kept):
    for name, before, after in kept[:-1]:
        assert after.columns == before.columns, name
        assert 0 < after.count() <= before.count(), name


@pytest.mark.parametrize("name", ["quality_classifier", "quality_rules"])
def test_filters_follow_their_operators(spark, kept, rows, name):
    from gleaner.llm.classifier import classify
    from gleaner.llm.quality_rules import quality_rules

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdicts = (lambda d: classify(d, labels).filter("predicted = 1")) if name == "quality_classifier" else (lambda d: quality_rules(d, labels).filter("kept"))
    stage = next((before, after) for k, before, after in kept if k == name)
    for before, after in (stage, (rows, STAGES[name](spark, rows, SF))):
        want = Counter((r["doc_id"], r["text_hash"]) for r in verdicts(before).collect())
        got = Counter((r["doc_id"], r["h"]) for r in after.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect())
        assert got == want and got


def test_one_of_each_group_stays(kept):
    from test_corpus import components

    _, before, after = kept[2]
    texts = [(r["doc_id"], r["text"] or "") for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, _, c in components(texts)})


def test_one_of_each_group_stays_with_odd_rows(spark, rows):
    """Groups of rows linked by their texts: exactly one row of each stays, one with the least id; rows without words all stay."""
    from test_corpus import components, shingles

    out = STAGES["jaccard_join"](spark, rows, SF)
    assert out.columns == rows.columns
    texts = [(r["doc_id"], r["text"]) for r in rows.collect()]
    group = dict(enumerate(c for _, _, c in sorted(components([(i, t or "") for i, (_, t) in enumerate(texts)]))))
    last = 1 << 60
    least = {}
    for i, (d, t) in enumerate(texts):
        if shingles(t or ""):
            least[group[i]] = min(least.get(group[i], last), last if d is None else d)
    stayed = [(d, t) for (d, t), n in counted(out).items() for _ in range(n) if shingles(t or "")]
    at = {x: group[i] for i, x in enumerate(texts)}
    assert Counter(at[x] for x in stayed) == Counter(least.keys())
    assert all((last if d is None else d) == least[at[d, t]] for d, t in stayed)
    assert sum(n for (d, t), n in counted(out).items() if not shingles(t or "")) == sum(not shingles(t or "") for _, t in texts)


def test_no_repeat_stays_but_character_edges(kept):
    _, before, after = kept[3]
    from test_corpus import removed

    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    gone = {d: n for d, _, n, _, _ in removed(sorted(texts.items()), 100)}
    for r in after.collect():
        lost = len(texts[r["doc_id"]].encode()) - len(r["text"].encode())
        assert gone[r["doc_id"]] - 8 <= lost <= gone[r["doc_id"]] and r["n_chars"] == len(r["text"])


def test_all_documents_are_packed(kept):
    _, before, after = kept[4]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}


def test_odd_rows_go_through_the_last_stages(spark, rows):
    out = STAGES["suffix_dedup"](spark, rows, SF)
    assert out.columns == rows.columns and Counter(r[0] for r in out.select("doc_id").collect()) == Counter(r[0] for r in rows.select("doc_id").collect())
    packed = STAGES["packing"](spark, rows, SF)
    assert Counter(r[0] for r in packed.filter("piece = 0").select("doc_id").collect()) == Counter(r[0] for r in rows.select("doc_id").collect())


def test_empty_table(spark, rows):
    none = rows.filter("n_chars < 0")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns), name


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
