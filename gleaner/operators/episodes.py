"""Topic candidates of whole episodes, and their way back to the chunks.

An episode's phrases are the sums over its chunks, so no episode is put together in one task, however large; what would run
across the end of a chunk isn't a phrase. The best candidates of an episode go to those of its chunks whose text holds one
of their forms between boundaries, found in one pass over each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import keywords as K
from gleaner.operators import matcher
from gleaner.operators.phrases import phrase_runs, phrase_shape
from gleaner.sources.shared import written

#: Phrases and candidates that an episode keeps, and candidates that a chunk takes.
PHRASES, KEPT, PER_CHUNK = 8, 14, 5


def candidate_rank(kind: Column, source: Column, name: Column, score: Column) -> Column:
    """Entities first, then phrases, those of the lexicon before others; the score decides among equals. The steps are fixed values."""
    step = lambda when, n: F.when(when, n).otherwise(0)
    kinds = step(kind == "entity", 1_000_000) + step(kind == "phrase", 750_000)
    sources = step(source == "phrase_lexicon", 500_000) + step(source == "episode_phrase", 450_000)
    return kinds + sources + step(name.contains(" "), 200_000) + step(name == "llms", 150_000) + score


def episode_phrases(rows: DataFrame, starters: list[str], most: int = PHRASES) -> DataFrame:
    """episode_id, phrase, n, score, rank: the best phrases of each episode by shape and count. rows: doc_id, episode_id, text."""
    each = rows.select("episode_id", F.explode_outer(phrase_runs(F.col("text"), starters)).alias("phrase")).filter("phrase IS NOT NULL")
    counts = each.groupBy("episode_id", "phrase").agg(F.count("*").alias("n")).withColumn("score", phrase_shape(F.col("phrase"), F.col("n"), starters))
    best = Window.partitionBy("episode_id").orderBy(F.desc("score"), F.desc(F.length("phrase")), "phrase")
    return counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)


def episode_candidates(rows: DataFrame, starters: list[str], lexicon: DataFrame | None = None, gazetteer: DataFrame | None = None, most: int = KEPT) -> DataFrame:
    """episode_id, name, slug, kind, source, score, rank_score, rank: of candidates with one slug the best, and of these the best `most`.

    lexicon: phrase, quality; gazetteer: name, form, place."""
    shaped = lambda df, source, name, kind, score: df.select("episode_id", F.col(name).alias("name"), F.lit(kind).alias("kind"), F.lit(source).alias("source"), score.cast("double").alias("score"))
    of = rows.select("doc_id", "episode_id")
    found = shaped(episode_phrases(rows, starters), "episode_phrase", "phrase", "phrase", F.col("score"))
    if lexicon is not None:
        hits = matcher.with_words(rows, lexicon.select(F.col("phrase").alias("term"))).join(of, "doc_id").select("episode_id", "term").distinct()
        found = found.unionByName(shaped(hits.join(lexicon.select(F.col("phrase").alias("term"), "quality"), "term"), "phrase_lexicon", "term", "phrase", F.col("quality")))
    if gazetteer is not None:
        named = K.known_entities(rows, gazetteer).join(of, "doc_id").select("episode_id", "name").distinct()
        found = found.unionByName(shaped(named, "known_entity", "name", "entity", F.lit(200)))
    found = found.withColumn("slug", X.slugify(F.col("name"))).filter("slug != ''").withColumn("rank_score", candidate_rank(F.col("kind"), F.col("source"), F.lower("name"), F.col("score")))
    order = [F.desc("rank_score"), F.asc("name"), F.asc("source")]
    one = found.withColumn("r", F.row_number().over(Window.partitionBy("episode_id", "slug").orderBy(*order))).filter("r = 1").drop("r")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("episode_id").orderBy(*order))).filter(F.col("rank") <= most)


def attributed(rows: DataFrame, candidates: DataFrame, most: int = PER_CHUNK) -> DataFrame:
    """doc_id, name, slug, kind, source, rank_score, decision: each episode's candidates in those of its chunks that name them, up to `most` a chunk."""
    candidates = written(candidates, "episode-candidates")  # read for the terms and for their episodes: mined once
    named = matcher.with_bounds(rows, candidates.select(F.col("name").alias("term")).distinct()).join(rows.select("doc_id", "episode_id"), "doc_id")
    met = named.withColumnRenamed("term", "name").join(candidates, ["episode_id", "name"])
    return K.decide(met.select("doc_id", "name", "slug", "kind", "source", "rank_score"), most)
