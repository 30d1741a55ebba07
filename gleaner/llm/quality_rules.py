"""Native quality rules: repetition and symbol counts, and a hashed n-gram log-likelihood ratio.

Unigrams and bigrams of words are hashed into BUCKETS buckets. Two multinomials with add-one smoothing over the buckets are
counted over whole tables: the trusted target (documents that the labels call good and not toxic) and the raw corpus (all
documents). A document's score is the mean over its n-grams of log p_target - log p_raw, in thousandths; it is kept if the
score reaches the threshold and no base rule failed. Unless one is given, the threshold is set from all trusted documents
that no base rule fails: the highest thousandth that `KEEP` of them reach; so it follows the load of the buckets as the
corpus grows. Only DataFrame functions.

Weights are a table of BUCKETS / BLOCK rows whatever the corpus, so it is broadcast and texts aren't shuffled to be scored.
Counts are combined before their shuffle, over COMBINE splits a task where that leaves every core one. Trusted ids are broadcast up to SMALL of them, else both sides are sorted and
merged; the result is the same. With buckets=None n-grams are told apart by their 64-bit hashes instead, and texts are joined
with the table of n-grams; n-grams seen once and never in a trusted document share one weight and aren't stored, and those
with 1/HOT of all occurrences (at most HOT) are broadcast, so that no task gets all occurrences of a common one.

Defined results: null or empty text has no words, fails and scores 0; without trusted documents every ratio is 0, so the
base rules decide; repeated rows each get their row; a document with a null id is never trusted; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import WORD, id_text, materialize, table

#: Share of the trusted documents that the threshold keeps.
KEEP = 0.999
HOT = 1 << 14
#: Buckets of n-grams, and how many of them (2 ** SHIFT) one row of the weights holds.
SHIFT = 5
BUCKETS, BLOCK = 1 << 22, 1 << SHIFT
#: Neighbouring input splits that one task counts, so that more n-grams are combined before the shuffle.
COMBINE = 4
#: Most trusted ids (8 bytes each) that are broadcast.
SMALL = 4_000_000
#: The separators of words, and the characters counted as symbols.
SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def neighbours_hashed(hashes: Column, apart: int) -> Column:
    """Hashes of each element with the one so many places on."""
    many = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, many), F.slice(hashes, apart + 1, many), lambda a, b: F.xxhash64(a, b))


def features(hashes: Column, pairs: Column, buckets: int | None = None) -> Column:
    """Hashed unigrams and bigrams, folded into so many buckets if given; hashes: of the words, in order; pairs: of neighbouring words."""
    fold = (lambda h: F.pmod(h, F.lit(buckets)).cast("int")) if buckets else lambda h: h
    return F.concat(F.transform(hashes, lambda h: fold(F.xxhash64(h))), F.transform(pairs, fold) if buckets else pairs)


def hashed_words(df: DataFrame) -> DataFrame:
    df = df.withColumn("words", words_of(F.col("text")))
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    return df.withColumn("pairs", neighbours_hashed(F.col("hashes"), 1))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(F.col(id_col).cast("long").alias("doc_id")).distinct()


def ngram_counts(docs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, int, int, int]:
    """key, raw, target of all n-grams but those seen once and never in a trusted document; occurrences in all and in trusted documents; distinct n-grams."""
    each = hashed_words(marked(docs, trusted)).select("trusted", F.explode(features(F.col("hashes"), F.col("pairs"))).alias("key"))
    seen = Observation()
    counted = each.groupBy("key").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    counted = counted.observe(seen, F.sum("raw").alias("raws"), F.sum("target").alias("targets"), F.count("*").alias("distinct"))
    counts = materialize(counted.filter((F.col("raw") > 1) | (F.col("target") > 0)), "ngrams")
    return counts, seen.get["raws"] or 0, seen.get["targets"] or 0, seen.get["distinct"]


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """docs with a column trusted: 1 or null."""
    small = trusted.limit(SMALL + 1).count() <= SMALL
    return docs.join(trusted.withColumn("trusted", F.lit(1)).hint("broadcast" if small else "merge"), "doc_id", "left")


def log_ratio(raws: float, targets: float, distinct: int):
    """Thousandths of log p_target - log p_raw of the columns raw and target."""
    log = F.log((F.col("target") + 1) / F.lit(float(targets + distinct))) - F.log((F.col("raw") + 1) / F.lit(float(raws + distinct)))
    return F.round(1000 * log).cast("int").alias("milli")


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame | None:
    """block, weights: the thousandths of BLOCK neighbouring buckets a row, of all blocks with n-grams; None without words in trusted documents."""
    splits = docs.select(F.spark_partition_id()).distinct().count()  # reads no column
    docs = docs.coalesce(max(splits // COMBINE, docs.sparkSession.sparkContext.defaultParallelism))
    each = hashed_words(marked(docs, trusted)).select(F.explode(features(F.col("hashes"), F.col("pairs"), buckets)).alias("key"), "trusted")
    counts = materialize(each.groupBy("key").agg(F.count("*").alias("raw"), F.count("trusted").alias("target")), "buckets")
    raws, targets = counts.agg(F.sum("raw"), F.sum("target")).head()
    if not targets:
        return None
    none = F.lit(round(1000 * (math.log(raws + buckets) - math.log(targets + buckets))))  # of a bucket without n-grams
    rated = counts.select(F.shiftright("key", SHIFT).alias("block"), F.col("key").bitwiseAND(F.lit(BLOCK - 1)).alias("place"), log_ratio(raws, targets, buckets))
    dense = F.array(*(F.coalesce(F.max(F.when(F.col("place") == k, F.col("milli"))), none) for k in range(BLOCK)))
    return materialize(rated.groupBy("block").agg(dense.alias("weights")), "weights")


def bucket_ratios(ruled: DataFrame, weights: DataFrame, buckets: int) -> DataFrame:
    """ruled (doc_id, text_hash, other columns and hashes, pairs) with ratio for hashes and pairs; rows that repeat id and text come out as many times as they came in.

    Texts are split and hashed once for the rules and the ratio; a row's n-grams meet the weights where it is read."""
    names = [c for c in ruled.columns if c not in ("doc_id", "text_hash", "hashes", "pairs")]
    each = ruled.select("doc_id", "text_hash", *names, F.explode_outer(F.concat(F.array(F.lit(-1)), features(F.col("hashes"), F.col("pairs"), buckets))).alias("key"))  # -1 opens a row
    each = each.withColumn("block", F.shiftright("key", SHIFT)).join(F.broadcast(weights), "block", "left")
    weight = F.get("weights", F.col("key").bitwiseAND(F.lit(BLOCK - 1)))
    opens = F.count_if(F.col("key") == -1)
    summed = each.groupBy("doc_id", "text_hash").agg(*(F.max(c).alias(c) for c in names), opens.alias("opens"), F.sum(F.when(F.col("key") >= 0, weight)).alias("total"), F.count("*").alias("n"))
    ratio = F.coalesce(F.col("total") / (1000.0 * (F.col("n") - F.col("opens"))), F.lit(0.0)).alias("ratio")
    return summed.select("doc_id", "text_hash", *names, ratio, F.explode(F.sequence(F.lit(1).cast("long"), F.col("opens"))).alias("copy")).drop("copy")


def ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame | None:
    """doc_id, text_hash, ratio of each document with words, all n-grams apart; None without words in trusted documents."""
    counts, raws, targets, distinct = ngram_counts(docs, trusted)
    if not targets:
        return None
    milli = log_ratio(raws, targets, distinct)
    once = counts.sparkSession.range(1).select(F.lit(1).alias("raw"), F.lit(0).alias("target")).select(milli).head()["milli"]
    common = F.broadcast(counts.filter(F.col("raw") * HOT >= raws).select("key", milli))
    each = hashed_words(docs.withColumn("text_hash", F.xxhash64("text"))).select("doc_id", "text_hash", F.explode(features(F.col("hashes"), F.col("pairs"))).alias("key"))
    rare = each.join(common, "key", "left_anti").join(counts.filter(F.col("raw") * HOT < raws).select("key", milli).hint("merge"), "key", "left")
    both = [x.groupBy("doc_id", "text_hash").agg(F.sum(F.coalesce("milli", F.lit(once))).alias("total"), F.count("*").alias("n")) for x in (each.join(common, "key"), rare)]
    return both[0].unionByName(both[1]).groupBy("doc_id", "text_hash").agg((F.sum("total") / (1000.0 * F.sum("n"))).alias("ratio"))


def threshold_of(scored: DataFrame, trusted: DataFrame, keep: float = KEEP) -> float | None:
    """The highest thousandth that a share `keep` of the trusted documents without a failed base rule reaches. One row per thousandth goes to the driver, some ten thousand at most."""
    mine = scored.filter(~F.col("base_failed")).join(trusted.hint("merge"), "doc_id", "left_semi")
    steps = mine.groupBy(F.floor(F.col("ratio") * 1000).alias("milli")).count().orderBy("milli").collect()
    spare = int((1 - keep) * sum(r["count"] for r in steps) + 1e-9)
    for r in steps:
        spare -= r["count"]
        if spare < 0:
            return r["milli"] / 1000
    return None


def base_rules(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to doc_id, text, words, hashes, pairs."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumn("n_words", F.size("words")).withColumn("lines", lines)
    df = df.withColumn("fours", neighbours_hashed(F.col("pairs"), 2)).withColumn("windows", neighbours_hashed(F.col("fours"), 4))  # runs of WINDOW words
    df = df.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("placed", F.when(F.col("repeats"), placed))
    at = lambda k: F.get("placed", k)
    alike = lambda a, b: a["h"].eqNullSafe(b["h"])
    same = F.filter(F.sequence(F.lit(0), F.size("placed") - 1), lambda k: alike(at(k), at(k - 1)) | alike(at(k), at(k + 1)))
    df = df.withColumn("begins", F.when(F.col("repeats"), F.array_sort(F.transform(same, lambda k: at(k)["i"]))))
    gaps = F.zip_with(F.slice("begins", 1, F.size("begins") - 1), F.slice("begins", 2, F.size("begins") - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda s, x: s + x)
    df = df.withColumn("n_repeat_words", F.when(F.col("repeats"), covered).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def quality_rules(df: DataFrame, labels: DataFrame, buckets: int | None = BUCKETS, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, ratio (mean log-likelihood ratio), text_hash (which tells rows that share an id apart) and kept. buckets=None keeps all n-grams apart; threshold: None sets it from the trusted documents."""
    docs, trusted = id_text(df, id_col, text_col), materialize(trusted_ids(labels), "trusted")
    columns = ["doc_id", F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.xxhash64("text").alias("text_hash")]
    ruled = base_rules(hashed_words(docs))
    if buckets:
        weights = bucket_weights(docs, trusted, buckets)
        rated = weights is not None
        out = bucket_ratios(ruled.select(*columns, "hashes", "pairs"), weights, buckets) if rated else ruled.select(*columns).withColumn("ratio", F.lit(0.0))
    else:
        score = ratios(docs, trusted)
        rated = score is not None
        out = ruled.select(*columns)
        if rated:
            score = materialize(score, "ratios").withColumnsRenamed({"doc_id": "scored_id", "text_hash": "scored_hash"}).hint("merge")
            out = out.join(score, F.col("doc_id").eqNullSafe(F.col("scored_id")) & (F.col("text_hash") == F.col("scored_hash")), "left")
        out = out.withColumn("ratio", F.coalesce("ratio", F.lit(0.0)) if rated else F.lit(0.0))
    out = materialize(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "text_hash"), "scored")
    if threshold is None and rated:
        threshold = threshold_of(out, trusted)
    return out.withColumn("kept", ~F.col("base_failed") & (F.lit(True) if threshold is None else F.col("ratio") >= threshold))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE: dict[str, str] = {}
