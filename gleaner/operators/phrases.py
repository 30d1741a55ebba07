"""Corpus statistics of words and phrases. docs: doc_id, text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.functions.scores import distinctiveness
from gleaner.operators.matcher import with_words
from gleaner.sources.shared import written


def tokens(docs: DataFrame, stop=X.STOPWORDS) -> DataFrame:
    """doc_id, words."""
    return docs.select("doc_id", X.tokenize(F.col("text"), stop).alias("words"))


def whole_texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, texts, first values of keep: a row for each document, so that its words and phrases are counted where it is read. Only texts are shuffled, not what is made of them."""
    return docs.groupBy("doc_id", *keep).agg(F.collect_list("text").alias("texts"))


def tallied(items: Column) -> Column:
    """Array of (x, n): the distinct items of an array and how often each stands in it."""
    in_order = F.sort_array(items)
    # a lambda's argument is a value, computed once
    return F.flatten(F.transform(F.array(in_order), _runs))


def _runs(s: Column) -> Column:
    begins = F.filter(F.sequence(F.lit(0), F.size(s)), lambda k: (k == 0) | (k == F.size(s)) | (F.get(s, k) != F.get(s, k - 1)))
    of = lambda b: F.zip_with(F.slice(b, 1, F.size(b) - 1), F.slice(b, 2, F.size(b) - 1), lambda i, j: F.struct(F.get(s, i).alias("x"), (j - i).cast("long").alias("n")))
    return F.when(F.size(s) > 0, F.flatten(F.transform(F.array(begins), of)))


def chunk_words(docs: DataFrame, stop=X.STOPWORDS) -> DataFrame:
    """doc_id, word, n. A document's words are counted where its texts are."""
    words = F.flatten(F.transform("texts", lambda t: X.tokenize(t, stop)))
    return whole_texts(docs).select("doc_id", F.explode_outer(tallied(words)).alias("w")).filter("w IS NOT NULL").select("doc_id", F.col("w.x").alias("word"), "w.n")


def word_stats(docs: DataFrame, stop=X.STOPWORDS) -> DataFrame:
    """word, total, docs."""
    each = chunk_words(docs, stop)
    return each.groupBy("word").agg(F.sum("n").alias("total"), F.count("*").alias("docs"))


def word_distinctiveness(docs: DataFrame, baseline: DataFrame, stop=X.STOPWORDS) -> DataFrame:
    """word, total, docs, score against a ranked baseline (word, rank) of bounded size."""
    return distinct_words(word_stats(docs, stop), baseline)


def distinct_words(stats: DataFrame, baseline: DataFrame) -> DataFrame:
    """word, total, docs, score of words (word, total, docs) against a ranked baseline (word, rank) of bounded size."""
    size = stats.agg(F.sum("total").alias("size"))
    rows = stats.join(F.broadcast(baseline), "word", "left").crossJoin(F.broadcast(size))
    return rows.select("word", "total", "docs", F.round(distinctiveness(F.col("total"), F.col("size"), F.col("rank")), 6).alias("score"))


def ngrams(docs: DataFrame, least_count: int = 5, least_docs: int = 3, stop=X.STOPWORDS) -> DataFrame:
    """Bigrams and trigrams: phrase, total, docs."""
    grams = lambda w: F.concat(X.word_ngrams(w, 2), X.word_ngrams(w, 3))
    each = F.flatten(F.transform(F.transform("texts", lambda t: X.tokenize(t, stop)), grams))
    per = whole_texts(docs).select(F.explode_outer(tallied(each)).alias("p")).filter("p IS NOT NULL").select(F.col("p.x").alias("phrase"), "p.n")
    return per.groupBy("phrase").agg(F.sum("n").alias("total"), F.count("*").alias("docs")).filter((F.col("total") >= least_count) & (F.col("docs") >= least_docs))


def pmi_pairs(docs: DataFrame, least: int = 5, most: int = 100, floor: float = 3.0, stop=X.STOPWORDS) -> DataFrame:
    """The `most` word pairs of one document with the highest pointwise mutual information of at least floor: a, b, both, pmi.

    A pair that co-occurs `least` times has words in that many documents, and its pmi is at most log(N / df) of the more
    frequent word. So rare words go first: once `most` pairs are found, only words that could still beat the last of them
    take part. Nothing is lost, and frequent words, whose pairs are many, never meet."""
    size = docs.count()
    words = chunk_words(docs, stop).select("doc_id", "word")
    df = words.groupBy("word").agg(F.count("*").alias("df")).filter((F.col("df") >= least) & (F.col("df") <= size * math.exp(-floor) + 1e-9))
    kept = written(words.join(df, "word"), "pair-words")

    def best(cap: float) -> DataFrame:
        rows = kept.filter(F.col("df") <= cap)
        a, b = (rows.select("doc_id", F.col("word").alias(x), F.col("df").alias(f"df_{x}")) for x in "ab")
        pairs = a.join(b, "doc_id").filter("a < b").groupBy("a", "b", "df_a", "df_b").agg(F.count("*").alias("both")).filter(F.col("both") >= least)
        pairs = pairs.withColumn("pmi", F.round(F.log(F.col("both") * size / (F.col("df_a") * F.col("df_b"))), 6)).filter(F.col("pmi") >= floor)
        return pairs.orderBy(F.desc("pmi"), "a", "b").limit(most).select("a", "b", "both", "pmi")

    cap = 2.0 * least
    while cap < size * math.exp(-floor):
        found = best(cap).agg(F.count("*").alias("n"), F.min("pmi").alias("last")).head()
        if found["n"] == most:
            return best(max(cap, size * math.exp(-found["last"] + 1e-6)))
        cap *= 4
    return best(size)


def phrase_lexicon(docs: DataFrame, least_docs: int = 3, floor: float = 1.5, most: int | None = 200, stop=X.STOPWORDS) -> DataFrame:
    """Adjacent pairs by pmi * (1 + log2(support + 1)), gated and cut to the best if most is given: phrase, docs, support, quality."""
    words = F.transform("texts", lambda t: X.tokenize(t, stop))
    of = whole_texts(docs)
    pairs = of.select(F.explode_outer(tallied(F.flatten(F.transform(words, lambda w: X.word_ngrams(w, 2))))).alias("p")).filter("p IS NOT NULL")
    per = pairs.groupBy(F.col("p.x").alias("phrase")).agg(F.count("*").alias("docs"), F.sum("p.n").alias("support")).filter(F.col("docs") >= least_docs)
    df = of.select(F.explode_outer(F.array_distinct(F.flatten(words))).alias("word")).filter("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("df"))
    size = docs.agg(F.count("*").alias("size"))
    split = per.withColumn("a", F.element_at(F.split("phrase", " "), 1)).withColumn("b", F.element_at(F.split("phrase", " "), 2))
    rows = split.join(df.toDF("a", "df_a"), "a").join(df.toDF("b", "df_b"), "b").crossJoin(F.broadcast(size))
    pmi = F.log(F.col("docs") * F.col("size") / (F.col("df_a") * F.col("df_b")))
    rows = rows.withColumn("quality", F.round(pmi * (1 + F.log2(F.col("support") + 1)), 6)).filter(F.col("quality") >= floor)
    rows = rows if most is None else rows.orderBy(F.desc("quality"), "phrase").limit(most)
    return rows.select("phrase", "docs", "support", "quality")


def repeated_ngrams(docs: DataFrame, least_docs: int = 3, stop=X.STOPWORDS) -> DataFrame:
    """Runs of two and three of the kept words of three letters or more, once per document, by count times documents: phrase, docs, support, quality."""
    words = docs.select(F.filter(X.words_kept(F.col("text")), lambda w: (F.length(w) >= 3) & ~w.isin(*stop)).alias("words"))
    runs = words.select(F.explode_outer(F.array_distinct(F.concat(X.word_ngrams(F.col("words"), 2), X.word_ngrams(F.col("words"), 3)))).alias("phrase"))
    return run_lexicon(runs.filter("phrase IS NOT NULL").groupBy("phrase").agg(F.count("*").alias("docs")).filter(F.col("docs") >= least_docs))


def run_lexicon(counts: DataFrame) -> DataFrame:
    """phrase, docs, support, quality of runs (phrase, docs): count times documents."""
    return counts.select("phrase", "docs", F.col("docs").alias("support"), (F.col("docs") * F.col("docs")).cast("double").alias("quality"))


def improbable_phrases(docs: DataFrame, common: list[str], least: int = 3, stop=X.STOPWORDS) -> DataFrame:
    """Adjacent pairs seen `least` times or more in which neither word is common."""
    rows = tokens(docs, stop).select(F.explode(X.word_ngrams(F.col("words"), 2)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    a, b = F.element_at(F.split("phrase", " "), 1), F.element_at(F.split("phrase", " "), 2)
    return rows.filter(~a.isin(*common) & ~b.isin(*common))


def terminology_drift(docs: DataFrame, order: str, least: float = 0.0005, most: int = 5, stop=X.STOPWORDS) -> DataFrame:
    """Phrases whose share changes between the earlier and the later half: phrase, early, late, delta, way, rank.

    The halves are cut at the exact middle of `order`, found by an aggregate instead of a window over everything."""
    middle = docs.agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {order})").alias("middle"))
    rows = docs.crossJoin(F.broadcast(middle)).select((F.col(order) <= F.col("middle")).alias("early"), F.explode_outer(X.word_ngrams(X.tokenize(F.col("text"), stop), 2)).alias("phrase")).filter("phrase IS NOT NULL")
    counts = rows.groupBy("phrase").agg(F.count_if("early").alias("e"), F.count_if(~F.col("early")).alias("l"))
    sizes = counts.agg(F.sum("e").alias("all_e"), F.sum("l").alias("all_l"))
    shares = counts.crossJoin(F.broadcast(sizes)).select("phrase", F.round(F.col("e") / F.col("all_e"), 9).alias("early"), F.round(F.col("l") / F.col("all_l"), 9).alias("late"))
    moved = shares.withColumn("delta", F.round(F.col("late") - F.col("early"), 9)).filter(F.abs("delta") >= least).withColumn("way", F.when(F.col("delta") > 0, "late").otherwise("early"))
    w = Window.partitionBy("way").orderBy(F.desc(F.abs("delta")), "phrase")
    return moved.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def inverse_frequencies(docs: DataFrame, stop=X.STOPWORDS) -> DataFrame:
    """word, df, idf."""
    size = docs.agg(F.count("*").alias("size"))
    df = tokens(docs, stop).select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(size)).select("word", "df", F.round(F.log(F.col("size") / F.col("df")), 6).alias("idf"))


def group_tfidf(docs: DataFrame, group: str, most: int = 5, least: int = 2, stop=X.STOPWORDS) -> DataFrame:
    """The words that set groups of documents apart."""
    rows = docs.select(group, F.explode(X.tokenize(F.col("text"), stop)).alias("word")).groupBy(group, "word").agg(F.count("*").alias("n"))
    df = rows.groupBy("word").agg(F.count("*").alias("df"))
    size = docs.agg(F.count_distinct(group).alias("size"))
    scored = rows.filter(F.col("n") >= least).join(df, "word").crossJoin(F.broadcast(size)).withColumn("tfidf", F.round(F.col("n") * F.log(F.col("size") / F.col("df")), 6))
    w = Window.partitionBy(group).orderBy(F.desc("tfidf"), "word")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select(group, "rank", "word", "n", "df", "tfidf")


def contained(docs: DataFrame, terms: DataFrame, deal: bool = True) -> DataFrame:
    """doc_id, term of all terms that stand in a text between word boundaries; terms: term, of any number of words. deal: False where texts come in parts of like size."""
    return with_words(docs, terms, deal)


def phrase_runs(text: Column, starters: list[str], stop=X.STOPWORDS) -> Column:
    """Phrases of a text, each occurrence: runs of two to four content words of four letters or more that no stop word breaks. Texts are
    cut at other words first, so only such runs are made."""
    fit = lambda w: (F.length(w) >= 4) & ~w.isin(*stop)
    marked = F.array_join(F.transform(X.words_kept(text), lambda w: F.when(fit(w), w).otherwise("\n")), " ")
    runs = F.transform(F.split(marked, r"\s*\n\s*"), lambda r: F.split(F.trim(r), " "))
    says = lambda g: ~F.substring_index(g, " ", 1).isin(*starters)
    return F.flatten(F.transform(runs, lambda r: F.concat(X.word_ngrams(r, 2), F.filter(F.concat(X.word_ngrams(r, 3), X.word_ngrams(r, 4)), says))))


def phrase_counts(docs: DataFrame, starters: list[str], stop=X.STOPWORDS) -> DataFrame:
    """doc_id, phrase, n of the phrases of each document."""
    each = F.flatten(F.transform("texts", lambda t: phrase_runs(t, starters, stop)))
    return whole_texts(docs).select("doc_id", F.explode_outer(tallied(each)).alias("p")).filter("p IS NOT NULL").select("doc_id", F.col("p.x").alias("phrase"), "p.n")


#: Endings that results depend on.
GOOD_ENDING = "(ion|ment|ness|ity|ship|ware|code|model|attack|labor|evidence|industry|software|tool|system|issue|law|effect|models|systems)$"


def phrase_shape(phrase: Column, n: Column, starters: list[str]) -> Column:
    """A phrase's count with gains and losses for its length, its first and its last word."""
    parts = F.split(phrase, " ")
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    return n * 5 + F.when(F.size(parts) == 4, 2).otherwise(5) - F.when(first.isin(*starters), 4).otherwise(0) - F.when(first.rlike("(ing|ed|ly)$"), 1).otherwise(0) - F.when(last.rlike("(ing|ed|ly)$"), 2).otherwise(0) + F.when(last.rlike(GOOD_ENDING), 2).otherwise(0)


def phrase_candidates(docs: DataFrame, starters: list[str], most: int = 8, stop=X.STOPWORDS) -> DataFrame:
    """The best phrases of each document by a score of their shape: doc_id, phrase, n, score, rank. A document's phrases are counted and ranked where its texts are."""
    each = F.flatten(F.transform("texts", lambda t: phrase_runs(t, starters, stop)))
    keyed = lambda p: F.struct((-phrase_shape(p["x"], p["n"], starters)).alias("less"), (-F.length(p["x"])).alias("shorter"), p["x"].alias("phrase"), p["n"].alias("n"))
    best = F.slice(F.sort_array(F.transform(tallied(each), keyed)), 1, most)
    rows = whole_texts(docs).select("doc_id", F.posexplode_outer(best).alias("at", "p")).filter("p IS NOT NULL")
    return rows.select("doc_id", "p.phrase", "p.n", (-F.col("p.less")).alias("score"), (F.col("at") + 1).alias("rank"))
