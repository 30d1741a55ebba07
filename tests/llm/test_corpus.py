"""Near duplicates, repeated strings, rules, classifier, archives, neighbours: against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import classifier, jaccard, neighbours, quality_rules, suffixes, warc


def shingles(text):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(texts):
    sets = [shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(texts))


def test_jaccard(odd, texts):
    assert sorted(tuple(r)[:3] for r in jaccard.jaccard_components(odd).collect()) == components(texts)


def test_jaccard_chains(spark):
    """Versions in a row: ends are unlike, but linked through those between; and one group in which all meet on frequent shingles."""
    rnd = random.Random(3)
    rows = []
    for chain in range(3):
        words = [f"w{rnd.randint(0, 500)}" for _ in range(80)]
        for step in range(30):
            words = list(words)
            words[rnd.randrange(80)] = f"n{chain}x{step}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r)[:3] for r in jaccard.jaccard_components(df).collect()) == components(rows)


def test_jaccard_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (3, t + " more"), (None, ""), (9, "alone here")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert got == {(None, 26): 3, (3, 27): 3, (None, 0): None, (9, 1): 9}


def removed(texts, length):
    """Marks of all bytes under a window that starts earlier; the documents are told apart by (id, text)."""
    seen, out = set(), {}
    for d, t in sorted(set(texts), key=lambda x: (x[0], hashlib.sha256(x[1].encode()).hexdigest())):
        raw = t.encode()
        mark = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                mark[p : p + length] = True
            seen.add(w)
        out[d, t] = mark
    rows = []
    for d, t in texts:
        mark, raw = out[d, t], t.encode()
        kept = bytes(b for b, m in zip(raw, mark, strict=True) if not m)
        rows.append((d, len(raw), int(mark.sum()), int((np.diff(np.r_[0, mark.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(rows)


@pytest.mark.parametrize("large", [2, 4096])
def test_repeats(odd, texts, large, monkeypatch):
    monkeypatch.setattr(suffixes, "LARGE", large)
    monkeypatch.setattr(suffixes.compared, "__defaults__", (large,))
    assert sorted(tuple(r) for r in suffixes.remove_repeats(odd).collect()) == removed(texts, 100)


def test_repeats_unique_ids(odd, texts):
    rows = sorted({d: t for d, t in texts}.items())
    assert sorted(tuple(r) for r in suffixes.remove_repeats(odd.dropDuplicates(["doc_id"])).collect()) == removed(rows, 100)


def test_chunked_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 500)
    rnd = random.Random(1)
    part = "".join(rnd.choice("abcdé ") for _ in range(700))
    rows = [(1, part + "".join(rnd.choice("abc") for _ in range(900)) + part), (2, "".join(rnd.choice("xyz") for _ in range(300)) + part)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = suffixes.settled(suffixes.anchored(df.withColumnRenamed("doc_id", "key"), 100), 2)
    assert found.count() > 0
    assert sorted(tuple(r) for r in suffixes.remove_repeats(df).collect()) == removed(rows, 100)


def test_strip_keeps_columns_and_characters(odd):
    out = suffixes.strip_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.filter("text IS NULL").count() == odd.filter("text IS NULL").count()
    for r in out.collect():
        if r["text"] is not None:
            r["text"].encode().decode()


def test_multikey_order():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 4, 500) for _ in range(3)] + [rng.permutation(500)]
    order = suffixes.multikey_order(columns)
    assert order.tolist() == np.lexsort(columns[::-1]).tolist()


def labels_of(odd):
    return odd.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality"), F.lit(None).cast("int").alias("toxic")).filter("doc_id < 25")


def test_rules(odd, texts):
    got = sorted(tuple(r)[:7] for r in quality_rules.quality_rules(odd, labels_of(odd), 256).collect())
    want = []
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    assert got == sorted(want)


def test_rules_without_trusted(odd):
    none = labels_of(odd).filter("doc_id < 0")
    rows = quality_rules.quality_rules(odd, none, 256).collect()
    assert all(r["ratio"] == 0 and r["kept"] != r["base_failed"] for r in rows)


def test_rules_reject_odd_words(spark):
    rnd = random.Random(2)
    good = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eta"]) + str(rnd.randint(0, 9)) for _ in range(60))) for i in range(60)]
    bad = [(100 + i, " ".join(rnd.choice(["zz", "yy", "xx", "ww", "vv"]) + "%" * rnd.randint(1, 9) + str(rnd.randint(0, 9)) for _ in range(60))) for i in range(20)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df, labels, 4096).collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in bad)


def test_rules_keep_ngrams_apart(spark):
    """1.6 million distinct n-grams of trusted documents don't hide those of 30 bad ones; of trusted ones a thousandth may go."""
    good = spark.range(800).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("w"), F.col("id"), F.lit("x"), i))).alias("text"))
    bad = spark.createDataFrame([(1000 + i, " ".join(f"bad{i % 10}y{j}" for j in range(40))) for i in range(30)], "doc_id long, text string")
    labels = spark.range(800).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(good.union(bad), labels).collect()}
    assert len(kept) == 830 and all(kept[i] for i in range(800)) and not any(kept[i] for i in range(1000, 1030))


def test_classifier(spark, odd, nothing):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["river", "stone", "valley", "forest", "bridge"]) + rnd.choice("aeiou") for _ in range(40)) if i % 2 else " ".join("@@" + rnd.choice("xyzwv") * 3 for _ in range(40))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    out = classifier.classify(df, labels).collect()
    unseen = [r for r in out if r["held_out"]]
    assert len(unseen) > 50 and sum(r["predicted"] == r["doc_id"] % 2 for r in unseen) / len(unseen) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    few = classifier.classify(odd, labels_of(odd).filter("quality = 1")).collect()
    assert len(few) == odd.count() and len({r["score"] for r in few}) == 1
    assert classifier.classify(nothing, labels).count() == 0


@pytest.fixture()
def pages(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2 x", "same"), (9, None, "same"), (3, "http://b", None), (4, "http://b\n", ""), (5, "http://ü", "é" * 100_000), (6, "http://c", "other"), (6, "http://c", "other"), (None, "http://d", "same")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


def test_archive(spark, pages, tmp_path):
    index = warc.write_archive(pages, f"file://{tmp_path}/w")
    out = warc.read_records(index).collect()
    own = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    holder = {}
    for d, p in own:
        if d is not None:
            holder[p] = max(holder.get(p, d), d)
    want = Counter()
    for d, p in own:
        to = holder[p] if d is not None and d < holder[p] else None
        want[d, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == want
    assert all(bytes(r["payload"]) in dict.fromkeys(p for _, p in own) for r in out if r["record_type"] == "response")
    some = warc.read_records(index.filter("page_id = 5")).collect()
    assert [r["page_id"] for r in some] == [5]
    assert warc.read_records(warc.write_archive(pages.filter("page_id = 77"), f"file://{tmp_path}/n")).count() == 0


def test_coalesce():
    assert warc.coalesce([("a", 0, 10), ("a", 12, 5), ("a", 500, 5), ("b", 505, 1)], gap=4) == [("a", 0, 17, [(0, 10), (12, 5)]), ("a", 500, 5, [(500, 5)]), ("b", 505, 1, [(505, 1)])]


def test_damage_is_seen():
    raw = warc.record(1, "http://a", b"payload", None, warc.digest(b"payload"))
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))


def brute(rows, k):
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in {i: v for i, v in sorted(use, key=lambda x: (x[0], x[1].tobytes()), reverse=True)}.items():
        if q % 10 == 0:
            near = sorted((round(float(np.sqrt(((x - v) ** 2).sum())), 9), i) for i, x in use if i != q)[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("many", [0, 5, 300])
def test_neighbours(spark, many):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * (1 + i % 3)).tolist()) for i in range(many)]
    if many > 100:
        hot = rows[7][1]
        rows += [(1000 + i, hot) for i in range(200)]
        rows += [(None, hot), (2001, None), (2002, []), (2003, [0.0] * 8), (2004, [float("nan")] * 8), (2005, [None] * 8), (2006, [1.0] * 7), (2010, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, v string").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.knn(df, df.filter("vec_id % 10 = 0")).collect())
    assert got == brute(rows, 10)  # tables this small are probed whole


def test_neighbours_of_the_common_length(spark):
    """One odd vector with the smallest id, or as the first query, takes nothing away from the rest."""
    rng = np.random.default_rng(3)
    rows = [(0, [1.0] * 5), *((i, rng.normal(size=8).tolist()) for i in range(1, 60))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.knn(df, df.filter("vec_id % 10 = 0")).collect())
    assert got == brute(rows, 10) and len(got) == 50


def test_neighbour_recall_with_production_probes(spark):
    """Clustered vectors, 8 of 256 axes probed in each table: recall over all queries."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(300, 64))
    vectors = centres[rng.integers(0, 300, 12_000)] + 0.5 * rng.normal(size=(12_000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for r in neighbours.knn(df, df.filter("vec_id % 100 = 0"), least=0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 12_000, 100):
        d = ((vectors - vectors[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 1200


def test_neighbour_fallback(spark):
    """Few probes and tiny blocks: queries that meet too few candidates get theirs from all rows."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.knn(df, df.filter("vec_id % 10 = 0"), tables=1, probes=1, least=1, block=7).collect()
    assert Counter(r["query_id"] for r in got) == {q: 10 for q in range(0, 200, 10)}
    want = {(q, i): d for q, _, i, d in brute(rows, 199)}
    assert all(abs(want[r["query_id"], r["vec_id"]] - r["score"]) < 1e-9 for r in got)


def test_empty(nothing):
    assert jaccard.jaccard_components(nothing).count() == 0
    assert suffixes.remove_repeats(nothing).count() == 0
    assert quality_rules.quality_rules(nothing, labels_of(nothing), 64).count() == 0


def near_copies(rnd, many, edits, size=120):
    words = [f"w{rnd.randint(0, 10_000)}" for _ in range(size)]
    out = []
    for k in range(many):
        own = list(words)
        for _ in range(rnd.randint(1, edits)):
            own[rnd.randrange(size)] = f"n{k}x{rnd.randint(0, 99)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("edits, many, most", [(1, 500, 5_000), (3, 500, 15_000), (10, 250, 1_500)])
def test_jaccard_near_group_meets_centres(spark, edits, many, most, monkeypatch):
    """Few of a group's pairs are verified; with three edits many copies are too unlike to be linked with most others, with ten nearly all."""
    met = []
    plain = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, docs, known: met.append(pairs.count()) or plain(pairs, docs, known))
    rows = list(enumerate(near_copies(random.Random(8), many, edits)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r)[:3] for r in jaccard.jaccard_components(df).collect()) == components(rows)
    assert sum(met) <= most, met
