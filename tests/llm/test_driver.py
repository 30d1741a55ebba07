"""What goes to the driver: in few and small rows, whatever the documents."""

import pickle
import random

import numpy as np
import pytest

from gleaner.llm import classifier, jaccard
from gleaner.llm.shingles import shingle_set


@pytest.fixture
def gathered(spark, monkeypatch):
    """Rows and largest value of each collect()."""
    seen, frame = [], type(spark.range(0))
    whole = frame.collect

    def collect(self):
        out = whole(self)
        seen.append((len(out), max((len(v) for r in out for v in r if isinstance(v, bytes | bytearray)), default=0)))
        return out

    monkeypatch.setattr(frame, "collect", collect)
    return seen


def test_shingle_counts_come_packed(spark, gathered):
    rnd = random.Random(3)
    texts = [" ".join(str(rnd.randint(0, 10**6)) for _ in range(300)) for _ in range(40)]
    expected = np.zeros(jaccard.BUCKETS, np.int64)
    for t in [*texts, texts[0]]:
        np.add.at(expected, (shingle_set(t) >> np.uint64(46)).astype(np.int64), 1)
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string").repartition(3)
    hits = jaccard.describe(docs).filter("bucket IS NOT NULL")
    assert hits.select("bucket").distinct().count() > 8000
    assert (jaccard.bucket_counts(hits.select("bucket", "hits")) == expected).all()
    assert (jaccard.bucket_counts(hits.select("bucket", "hits").filter("hits < 0")) == 0).all()
    assert jaccard.jaccard_components(docs).filter("component_id = 0").count() == 2
    assert max(n for n, _ in gathered) <= jaccard.BUCKETS // jaccard.SLICE


def test_model_comes_in_slices(spark, gathered):
    rnd = random.Random(4)
    words = [f"word{k}" for k in range(2500)] * 4
    rnd.shuffle(words)
    docs = spark.createDataFrame([(k, " ".join(words[k::40])) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    raw = classifier.fit(docs, labels)
    model = pickle.loads(raw)
    assert len(raw) > 2 * (1 << 18) and model["context"].shape == (len(model["known"]), classifier.DIM)
    assert max(size for _, size in gathered) <= 1 << 18
