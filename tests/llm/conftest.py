import random

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with all that may go wrong: nulls, empty, blank and long texts, repeats, ties, clashing extra columns."""
    rnd = random.Random(5)
    words = "der quick brown fox jumps over lazy dogs while seven wizards brew potent juice under waning moonlight near old stone bridges".split()
    passage = " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(60))
    base = [" ".join(rnd.choice(words) + str(rnd.randint(0, 40)) for _ in range(rnd.randint(25, 60))) for _ in range(12)]
    near = base[0].split()
    near[7] = "changed"
    texts = [None, "", "  \t\n", "one", "One two three", "A B C D", *base, base[1], base[1].upper(), " ".join(near), base[2] + " " + passage, passage + " " + base[3], "x" * 3000, "Aé" * 400, "ab" * 5000, "<|endoftext|> special <s> <|startoftext|>", "don't   stop\n\nline\nline\nline", "tail " * 200, "öß ▁ İ mixed 中文 \U0001f600"]
    rows = [(i, t, "en", "s", None if t is None else len(t), "node", 1, "words", 2.0) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s", 7, "x", 1, "y", 0.0), (40, base[4], "en", "s", 7, "x", 1, "y", 0.0), (41, base[4], "en", "s", 7, None, 1, "y", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int, words string, score double").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("doc_id < 0")


@pytest.fixture(scope="session")
def texts(odd):
    return [(r["doc_id"], r["text"] or "") for r in odd.collect()]
