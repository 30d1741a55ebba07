"""Collocations, source divergence and exact dedup against brute force, and against the SQL of their queries."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest

SF = os.environ.get("GLEANER_SF", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, p long, digest string, phrase string, value double"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those that the operators use within."""
    return spark.createDataFrame([(*r, 1, "t", 2, "d", "p", 0.5) for r in rows], SCHEMA).repartition(3)


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    words = "new york city of the open source Öl data_set don't a b".split()
    out = []
    for k in range(120):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "! "]) for _ in range(rnd.randint(1, 90)))
        out.append((k, text, rnd.choice(["en", "en", "de", None]), rnd.choice(["s1", "s1", "s2", "s3", None])))
    out += [(200, None, "en", "s1"), (201, "", "xx", "s9"), (202, " \t\n", "xx", "s8"), (203, "only once", "yy", "s1"), (None, "new york city", "en", "s2"), (3, out[3][1], "en", "s1"), (3, out[3][1], "en", "s1")]
    out += [(300 + k, "new york city. new york city " * 30 + "tail of the " * (k % 2), "en", "s2") for k in range(25)]
    out.append((400, "the open source " * 70_000, "de", "s1"))  # over 1 MB
    out.append((401, "x" * 1_200_000, "de", "s2"))
    return out


@pytest.mark.parametrize("name", ["op11_collocations", "op12_source_divergence", "op13_exact_dedup"])
def test_matches_sql(spark, name):
    from oracle import differences

    from gleaner.llm import registry

    assert differences(spark, registry.queries()[name], registry.oracle_sql()[name], SF) == ""


def expected_collocations(rows, least=10, top=2000, covered=50):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if len(p) == 2 and any(100 * b >= covered * a for q, b in counts.items() if len(q) == 3 and b >= least and p in (q[:2], q[1:])):
                continue
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top, covered", [(10, 2000, 50), (2, 7, 90)])
def test_collocations(spark, rows, least, top, covered):
    from gleaner.llm.collocations import collocations

    got = collocations(frame(spark, rows), least=least, top=top, covered=covered)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == expected_collocations(rows, least, top, covered)


def test_chunks_cover_each_ngram_once():
    from gleaner.llm.collocations import OVERLAP, Words, chunks, tokens

    rnd = random.Random(3)
    words = tokens(" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randint(0, 30)) + rnd.choice(["", "", "."]) for _ in range(2000)).encode())
    found = [tuple(c[i : i + 3]) for c in (c.split(b" ") for c in chunks(words, Words())) for i in range(len(c) - OVERLAP)]
    padded = [*words, *[b"\n"] * OVERLAP]
    assert found == [tuple(padded[i : i + 3]) for i in range(len(words))]
    passage = words[500:700]  # a shared passage gives shared chunks
    once, twice = (set(chunks(w, Words())) for w in (words, [*words[:100], *passage]))
    assert len(once & twice) > 5


def test_collocations_small_buffers(spark, rows, monkeypatch):
    """Counts that a task hands on many times add up."""
    import gleaner.llm.collocations as C

    whole = sorted(map(tuple, C.collocations(frame(spark, rows)).collect()))
    monkeypatch.setattr(C, "HELD", 5)
    monkeypatch.setattr(C, "HELD_BYTES", 50)
    assert sorted(map(tuple, C.collocations(frame(spark, rows)).collect())) == whole


def expected_divergence(rows, min_df=3, top=200):
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        groups.add((lang, source))
        n[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        vocab = sorted(t for t, c in df[lang].items() if c >= min_df)
        sources = sorted(s for g, s in groups if g == lang)

        def shares(counts, vocab=vocab):
            total = sum(counts[t] for t in vocab)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (total + len(vocab)) for t in vocab}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in vocab), o) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in vocab if n[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1)] + [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms, 1)]
    return sorted(out)


@pytest.mark.parametrize("min_df, top", [(3, 200), (1, 2), (1000, 5)])
def test_divergence(spark, rows, min_df, top):
    from gleaner.llm.divergence import source_divergence

    got = source_divergence(frame(spark, rows), min_df=min_df, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == expected_divergence(rows, min_df, top)


def expected_groups(rows):
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    members = defaultdict(list)
    for k, t in enumerate(texts):
        members[t].append((rows[k][0] is None, rows[k][0] or 0))
    out = []
    for (doc_id, *_), t in zip(rows, texts, strict=True):
        none, low = min(members[t])
        out.append((doc_id, None if none else low, len(members[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan, partitions", [(16, 4), (2, 8), (4, 1)])
def test_exact_groups(spark, rows, fan, partitions):
    from gleaner.llm.exact_dedup import exact_groups

    rows = rows + [(500 + k, f"copy\n\n of \t{k % 2}", "en", "s1") for k in range(300)] + [(None, "no id", "en", "s"), (None, "no  id", "en", "s"), (7, "seven", "a", "b"), (7, " seven", "a", "b"), ((1 << 63) - 1, "most", "a", "b"), (None, "most", "a", "b")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = exact_groups(frame(spark, rows), fan=fan).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == expected_groups(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_a_run_out_of_order_fails():
    import pyarrow as pa

    from gleaner.llm.exact_dedup import one_each

    digests = [b"b" * 32, b"a" * 32]
    t = pa.table({"part": pa.array([0, 0], pa.int32()), "digest": digests, "n_bytes": [1, 1], "second": [1, 1], "no_id": pa.array([0, 0], pa.int32()), "low_id": [1, 2], "low_row": [1, 2], "size": [1, 1]})
    with pytest.raises(ValueError):
        one_each(t)
    # equal digests of unlike length or second hash stay apart
    same = pa.table({"part": pa.array([0] * 3, pa.int32()), "digest": [b"a" * 32] * 3, "n_bytes": [1, 1, 2], "second": [1, 2, 2], "no_id": pa.array([0] * 3, pa.int32()), "low_id": [3, 2, 1], "low_row": [1, 2, 3], "size": [1, 1, 1]})
    assert one_each(same).num_rows == 3


def test_empty(spark, nothing):
    from gleaner.llm.collocations import collocations
    from gleaner.llm.divergence import source_divergence
    from gleaner.llm.exact_dedup import exact_groups

    for f in (collocations, source_divergence, exact_groups):
        assert f(nothing).collect() == []
