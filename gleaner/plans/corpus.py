"""From documents to gated topics, end to end: enrichment per document, then corpus-wide finalisation.

Every step is a function of frames, so a rerun from the same documents gives the same topics; nothing is updated in place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import gates as G
from gleaner.functions import text as X
from gleaner.operators import keywords as K
from gleaner.operators import phrases as P
from gleaner.operators import tallies as T
from gleaner.plans import finalization as Z
from gleaner.sources.shared import dealt, written

#: Ranking of candidates' sources; scores only decide within a source.
PRIORITY = {"known_entity": 4, "phrase_lexicon": 3, "heuristic_entity": 2, "keyphrase": 1}


@dataclass
class Topics:
    artifacts: DataFrame  # doc_id, episode_id, text, warnings
    audit: DataFrame  # every candidate with its decision
    topics: DataFrame  # topic_id, name, slug, kind, usage, support, distinctiveness, reason of the topics with links
    links: DataFrame  # chunk_id, topic_id
    final: Z.Corpus  # what finalisation left: all topics, the merge audit, reach, steps


def artifacts(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, episode_id."""
    rows = docs.select("doc_id", "episode_id", X.normalize(F.col("text")).alias("text"))
    return rows.withColumn("warnings", X.warnings(F.col("text")))


def candidates(rows: DataFrame, gazetteer: DataFrame | None = None, lexicon: DataFrame | None = None, mode: str | None = None, deal: bool = True) -> DataFrame:
    """doc_id, source, raw, name, slug, kind, score from all sources. deal: False where texts come in parts of like size."""
    shaped = lambda df, source, raw, kind, score: df.select("doc_id", F.lit(source).alias("source"), F.col(raw).alias("raw"), F.lit(kind).alias("kind"), score.cast("double").alias("score"))
    named = lambda df: df.withColumn("name", F.when(F.col("kind") == "entity", F.col("raw")).otherwise(X.normalize_term(F.col("raw")))).withColumn("slug", X.slugify(F.col("name")))
    found = [shaped(K.document_names(rows, deal=deal), "heuristic_entity", "name", "concept", F.lit(100))]
    if gazetteer is not None:
        found.append(shaped(K.known_entities(rows, gazetteer, deal), "known_entity", "name", "entity", F.lit(200)))
    if mode:
        found.append(shaped(K.document_keyphrases(rows, mode), "keyphrase", "phrase", "concept", -F.col("score")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = named(out)
    if lexicon is not None:
        # a phrase's name and slug are made once, not for each document that holds it
        phrases = written(named(lexicon.select("phrase", "quality", F.col("phrase").alias("raw"), F.lit("phrase").alias("kind"))).select("phrase", "quality", "name", "slug"), "lexicon-named")
        hits = P.contained(rows, lexicon.select(F.col("phrase").alias("term")), deal).withColumnRenamed("term", "phrase").join(phrases, "phrase")
        out = out.unionByName(hits.select("doc_id", F.lit("phrase_lexicon").alias("source"), F.col("phrase").alias("raw"), F.lit("phrase").alias("kind"), F.col("quality").cast("double").alias("score"), "name", "slug"))
    return out


def decided(found: DataFrame, most: int = 5, t: G.Tuning = G.DEFAULT) -> DataFrame:
    """Candidates with a decision: a reject reason, a place too late, or accepted."""
    first = F.create_map(*(x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))))
    found = written(found, "candidates")  # read for both outcomes
    rows = found.withColumn("reject", G.reject_reason(F.lower("name"), F.col("slug"), F.col("kind"), t)).withColumn("rank_score", first[F.col("source")] * 1e6 + F.col("score"))
    good = K.decide(rows.filter("reject IS NULL"), most)
    return good.unionByName(rows.filter("reject IS NOT NULL").withColumn("decision", F.col("reject")))


def promoted(audit: DataFrame, rows: DataFrame, stats: DataFrame, t: G.Tuning = G.DEFAULT) -> DataFrame:
    """slug, name, kind of accepted candidates with enough support; stats: word, score."""
    accepted = audit.filter("decision = 'accepted'").join(rows.select("doc_id", "episode_id"), "doc_id")
    kinds = F.max_by("kind", F.when(F.col("kind") == "entity", 2).when(F.col("kind") == "phrase", 1).otherwise(0))
    by_slug = accepted.groupBy("slug").agg(F.min("name").alias("name"), kinds.alias("kind"), F.count_distinct("doc_id").alias("chunks"), F.count_distinct("episode_id").alias("episodes"))
    scored = by_slug.join(stats.select(F.col("word").alias("name"), F.col("score").alias("distinctiveness")), "name", "left").fillna(0.0, ["distinctiveness"])
    prior = G.prior_reason(F.col("name"), F.col("kind"), F.col("chunks"), F.col("distinctiveness"), F.col("chunks"), t)
    reason = F.coalesce(prior, G.promotion_reason(F.col("name"), F.col("kind"), F.col("chunks"), F.col("episodes"), F.col("distinctiveness"), F.col("chunks"), t=t))
    return scored.filter(reason.isNull()).select(F.xxhash64("slug").alias("topic_id"), "slug", "name", "kind", "distinctiveness")


def gated_lexicon(rows: DataFrame, t: G.Tuning = G.DEFAULT, most: int = 200, words: DataFrame | None = None) -> DataFrame:
    """phrase, docs, support, quality: adjacent pairs and repeated n-grams, of each slug the best; the best `most` of those that pass all gates. words: word_counts of the rows with a text.

    An n-gram's quality is the square of its documents, so those of `cap` documents or more and the pairs of that quality hold
    all phrases down to it; once they give `most`, all others rank behind. Rare n-grams, which are many, are counted only if
    caps down to the least give fewer. Pairs are counted once a cap comes down to what a pair can reach: its log is at
    most that of size / least, its support at most that of a word."""
    filled = rows.filter("text != ''")
    size = filled.count()
    least = 3 if size >= 10 else 2
    words = words if words is not None else written(T.word_counts(filled), "words")
    said = words.agg(F.max("total")).head()[0] or 0
    reach = math.log(max(size, least) / least) * (1 + math.log2(said + 1)) + 1  # one more than any pair's quality
    cap, pairs = max(least, size // 256, min(size // 64, math.isqrt(int(reach)) + 1)), None
    while True:
        runs = P.run_lexicon(T.run_counts(filled, words, cap))
        both = written(runs, "runs").withColumn("first", F.lit(0))
        if cap == least or cap * cap <= reach:
            pairs = pairs if pairs is not None else written(P.phrase_lexicon(filled, least, 1e-6, None), "pairs").withColumn("first", F.lit(1))
            both = both.unionByName(pairs if cap == least else pairs.filter(F.col("quality") >= cap * cap))
        best = written(_gated(both.filter(F.lit(size >= 2)), t).orderBy(F.desc("quality"), F.desc("docs"), "phrase").limit(most), "lexicon")
        if cap == least or best.count() == most:
            return best
        cap = max(least, cap // 4)


def _gated(both: DataFrame, t: G.Tuning) -> DataFrame:
    """Of each slug the best phrase, if it passes all gates."""
    # names and slugs are written before gates read them: else each mention of a name in a gate makes it anew
    both = written(both.withColumn("phrase", X.normalize_term(F.col("phrase"))), "lexicon-names").withColumn("slug", X.slugify(F.col("phrase")))
    both = written(both, "lexicon-slugs")
    both = both.filter((F.length("slug") >= 3) & ~G.is_noise(F.col("phrase"), t))
    best = both.groupBy("slug").agg(F.max(F.struct("quality", "first", "docs", "support", "phrase")).alias("x")).select("x.phrase", "x.docs", "x.support", "x.quality")
    return best.filter(G.phrase_reason(F.col("phrase"), F.col("docs"), F.col("support"), F.col("quality"), t).isNull())


def build(docs: DataFrame, gazetteer: DataFrame | None = None, baseline: DataFrame | None = None, mode: str | None = None, t: G.Tuning = G.DEFAULT) -> Topics:
    """The whole way from documents (doc_id, text, episode_id) to topics."""
    # texts are dealt once; steps that read the artifacts find them in parts of like size
    rows = written(artifacts(dealt(docs.select("doc_id", "text", "episode_id"), "doc_id")), "artifacts")
    words = written(T.word_counts(rows), "words")
    lexicon = gated_lexicon(rows, t, words=words)
    audit = written(decided(candidates(rows, gazetteer, lexicon, mode, deal=False), t=t), "audit")
    baseline = baseline if baseline is not None else docs.sparkSession.createDataFrame([], "word string, rank int")
    topics = written(promoted(audit, rows, P.distinct_words(words.filter("length(word) > 3"), baseline), t), "topics")
    accepted = audit.filter("decision = 'accepted'").join(topics.select("slug", "topic_id"), "slug")
    found = written(accepted.select(F.col("doc_id").alias("chunk_id"), "topic_id").distinct(), "links")
    zero = F.lit(0).cast("long")
    full = topics.select("topic_id", "name", "slug", "kind", "distinctiveness", zero.alias("usage"), zero.alias("support"), F.lit(False).alias("hidden"), F.lit(None).cast("string").alias("reason"))
    published = docs.select("doc_id", "published") if "published" in docs.columns else rows.select("doc_id", F.lit(None).cast("date").alias("published"))
    dated = rows.join(published, "doc_id", "left")
    traced = written(audit.join(topics.select("slug", "topic_id"), "slug", "left").select("doc_id", "topic_id", "slug", "source", "decision"), "traced")
    aliases = gazetteer.select(F.col("form").alias("alias"), F.col("name").alias("canonical"), "place") if gazetteer is not None else None
    phrases = lexicon.select("phrase", X.slugify(F.col("phrase")).alias("slug"), "docs", "support", "quality").join(topics.select("slug"), "slug", "left_semi")
    final = Z.finalized(Z.Corpus(dated, full, found, traced, docs.sparkSession.createDataFrame([], Z.MERGE_SCHEMA)), phrases, aliases, t=t)
    return Topics(rows, audit, final.topics.filter("usage > 0"), final.links, final)


_BUILT: dict[tuple[str, str], Topics] = {}


def of_documents(spark, sf_dir: str) -> Topics:
    """Built by the first query of a session over these tables, read by the others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        d = spark.read.parquet(f"{sf_dir}/documents.parquet")
        published = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod("doc_id", F.lit(730)).cast("int"))
        _BUILT[key] = build(d.select("doc_id", "text", F.col("source").alias("episode_id"), published.alias("published")))
    return _BUILT[key]


def characterization(built: Topics) -> DataFrame:
    """metric, value of a built corpus."""
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    t = built.topics
    return (
        one(built.artifacts, "chunks")
        .unionByName(one(built.audit, "candidates"))
        .unionByName(one(built.audit.filter("decision = 'accepted'"), "accepted"))
        .unionByName(one(t, "topics"))
        .unionByName(one(t.filter("reason IS NULL"), "visible"))
        .unionByName(one(t.filter("usage = 1"), "singletons"))
        .unionByName(one(built.links, "links"))
        .unionByName(one(built.links.join(t, "topic_id", "left_anti"), "broken_links"))
    )


def period_sentences(counts: DataFrame) -> DataFrame:
    """label, summary of periods (label, episodes, chunks, top: array of names, new_topics): up to four sentences."""
    plural = lambda n, word: F.concat(n.cast("string"), F.when(n == 1, f" {word}").otherwise(f" {word}s"))
    first = F.concat(F.col("label"), F.lit(" has "), plural(F.col("episodes"), "episode"), F.lit(" with "), plural(F.col("chunks"), "chunk"), F.lit("."))
    second = F.when(F.size("top") > 0, F.concat(F.lit("It is mostly about "), X.oxford_list(F.slice("top", 1, 3)), F.lit(".")))
    third = F.when(F.col("new_topics") > 0, F.concat(plural(F.col("new_topics"), "topic"), F.when(F.col("new_topics") == 1, " appears").otherwise(" appear"), F.lit(" for the first time.")))
    return counts.select("label", F.array_join(F.array_compact(F.array(first, second, third)), " ").alias("summary"))


def era_markers(docs: DataFrame, date: str, markers: dict[str, str]) -> DataFrame:
    """quarter, marker, hits, first: how often regular expressions match per quarter."""
    from gleaner.functions.dates import quarter_key, quarter_ordinal

    each = F.explode(F.array(*(F.struct(F.lit(k).alias("marker"), F.regexp_count("text", F.lit(v)).alias("hits")) for k, v in markers.items())))
    rows = docs.select(date, each.alias("m")).filter("m.hits > 0")
    return rows.groupBy(quarter_key(quarter_ordinal(date)).alias("quarter"), F.col("m.marker").alias("marker")).agg(F.sum("m.hits").alias("hits"), F.min(date).alias("first"))


QUERIES = {
    "corpus_topics": lambda spark, sf_dir: of_documents(spark, sf_dir).topics,
    "corpus_links": lambda spark, sf_dir: of_documents(spark, sf_dir).links,
    "candidate_audit": lambda spark, sf_dir: of_documents(spark, sf_dir).audit.groupBy("source", "decision").agg(F.count("*").alias("n")),
    "merge_audit": lambda spark, sf_dir: of_documents(spark, sf_dir).final.merges,
    "corpus_reach": lambda spark, sf_dir: of_documents(spark, sf_dir).final.reach,
    "pipeline_characterization": lambda spark, sf_dir: characterization(of_documents(spark, sf_dir)),
}
ORACLE: dict[str, str] = {}
