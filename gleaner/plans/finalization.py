"""Finalisation of a topic corpus: backfill, merges, gates, validation, flags and display, each step with its counts.

Merges are maps from topics to the topics that stay. Each step's map may lead from topic to topic; it is closed before it is
applied, and each merge leaves a row in the audit. Topics that were merged or pruned stay as rows without use, hidden, with
the reason, so that their history can be told; only topics that nothing refers to are dropped. Running it again on its own
result changes nothing but the audit of the first run, which stays.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import gates as G
from gleaner.functions import text as X
from gleaner.operators import analytics as A
from gleaner.operators import matcher
from gleaner.operators import merges as M
from gleaner.sources.shared import written

MERGE_SCHEMA = "from_id long, to_id long, stage string, reason string"


@dataclass
class Corpus:
    """rows: doc_id, episode_id, text, published; topics: topic_id, name, slug, kind, distinctiveness, usage, support, hidden, reason;
    links: chunk_id, topic_id; audit: doc_id, topic_id, slug, source, decision; merges: from_id, to_id, stage, reason."""

    rows: DataFrame
    topics: DataFrame
    links: DataFrame
    audit: DataFrame
    merges: DataFrame
    steps: list[tuple[str, dict[str, int]]] = field(default_factory=list)
    episode_topics: DataFrame | None = None
    reach: DataFrame | None = None


def closed_in_steps(merges: DataFrame, rounds: int = 40) -> DataFrame:
    """topic_id, keeper_id, steps, with keepers that go nowhere themselves: each round doubles the merges that a topic has gone."""
    own = merges.filter("topic_id != keeper_id").select("topic_id", "keeper_id", F.lit(1).cast("long").alias("steps"))
    current = written(own, "merges")
    for _ in range(rounds):
        on = current.select(F.col("topic_id").alias("keeper_id"), F.col("keeper_id").alias("further"), F.col("steps").alias("more"))
        joined = current.join(on, "keeper_id", "left")
        step = written(joined.select("topic_id", F.coalesce("further", "keeper_id").alias("keeper_id"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved")), "merges")
        current = step.select("topic_id", "keeper_id", "steps")
        if step.filter("moved").isEmpty():
            return current
    raise ValueError("merges go in a circle")


def closed(merges: DataFrame, rounds: int = 40) -> DataFrame:
    return closed_in_steps(merges, rounds).drop("steps")


def active(topics: DataFrame) -> DataFrame:
    return topics.filter("usage > 0")


def recounted(c: Corpus) -> None:
    dated = c.links.join(c.rows.select(F.col("doc_id").alias("chunk_id"), "episode_id"), "chunk_id")
    counts = dated.groupBy("topic_id").agg(F.count("*").alias("usage"), F.count_distinct("episode_id").alias("support"))
    c.topics = written(c.topics.drop("usage", "support").join(counts, "topic_id", "left").fillna(0, ["usage", "support"]), "topics")


def merged(c: Corpus, merges: DataFrame, stage: str, reason: str) -> None:
    """Links go to the keepers, merged topics are hidden, the audit has a row for each."""
    final = closed(merges)
    n = final.count()
    c.steps.append((stage, {"topics_merged": n}))
    if not n:
        return
    c.links = written(M.relink(c.links, final), "links")
    c.audit = written(c.audit.join(final, "topic_id", "left").withColumn("topic_id", F.coalesce("keeper_id", "topic_id")).drop("keeper_id"), "audit")
    c.merges = written(c.merges.unionByName(final.select(F.col("topic_id").alias("from_id"), F.col("keeper_id").alias("to_id"), F.lit(stage).alias("stage"), F.lit(reason).alias("reason"))), "merge-audit")
    gone = final.select("topic_id", F.lit(True).alias("gone"))
    c.topics = written(_hidden(c.topics.join(gone, "topic_id", "left"), F.col("gone"), reason).drop("gone"), "topics")


def _hidden(topics: DataFrame, which, reason: str) -> DataFrame:
    which = F.coalesce(which, F.lit(False))
    return (
        topics.withColumn("usage", F.when(which, 0).otherwise(F.col("usage")).cast("long"))
        .withColumn("hidden", which | F.col("hidden"))
        .withColumn("reason", F.when(which, reason).otherwise(F.col("reason")))
    )


def pruned(c: Corpus, ids: DataFrame, stage: str, reason: str) -> None:
    """Topics lose their links and are hidden."""
    gone = written(ids.select("topic_id").distinct(), "pruned")
    c.steps.append((stage, {"topics_pruned": gone.count()}))
    c.links = written(c.links.join(gone, "topic_id", "left_anti"), "links")
    c.topics = written(_hidden(c.topics.join(gone.withColumn("gone", F.lit(True)), "topic_id", "left"), F.col("gone"), reason).drop("gone"), "topics")


def backfilled(c: Corpus, lexicon: DataFrame, t: G.Tuning = G.DEFAULT) -> None:
    """Each phrase that passes its gate is linked to all chunks whose text holds it anywhere and in which its slug isn't accepted yet; topics
    that don't exist are made. lexicon: phrase, slug, docs, support, quality."""
    good = lexicon.filter(G.phrase_reason(F.col("phrase"), F.col("docs"), F.col("support"), F.col("quality"), t).isNull()).select("phrase", "slug")
    held = matcher.with_substrings(c.rows, good.select(F.col("phrase").alias("term")), deal=False).withColumnRenamed("term", "phrase").join(good, "phrase")
    known = c.audit.filter("decision = 'accepted'").select("doc_id", "slug").distinct()
    fresh = written(held.join(known, ["doc_id", "slug"], "left_anti").select("doc_id", "phrase", "slug").distinct(), "backfill")
    new = good.join(c.topics.select("slug"), "slug", "left_anti").groupBy("slug").agg(F.min("phrase").alias("name"))
    zero = F.lit(0).cast("long")
    made = new.select(F.xxhash64("slug").alias("topic_id"), "name", "slug", F.lit("phrase").alias("kind"), F.lit(0.0).alias("distinctiveness"), zero.alias("usage"), zero.alias("support"), F.lit(False).alias("hidden"), F.lit(None).cast("string").alias("reason"))
    c.topics = written(c.topics.unionByName(made, allowMissingColumns=True), "topics")
    placed = fresh.join(c.topics.select("slug", "topic_id"), "slug")
    rows = placed.select("doc_id", "topic_id", "slug", F.lit("phrase_lexicon").alias("source"), F.lit("accepted").alias("decision"))
    c.audit = written(c.audit.unionByName(rows), "audit")
    accepted = c.audit.filter("decision = 'accepted' AND source = 'phrase_lexicon'").join(good.select("slug").distinct(), "slug", "left_semi")
    before = c.links.count()
    c.links = written(c.links.unionByName(accepted.select(F.col("doc_id").alias("chunk_id"), "topic_id")).distinct(), "links")
    c.steps.append(("phrase_lexicon_backfill", {"audit_rows_inserted": fresh.count(), "chunk_topic_links_inserted": c.links.count() - before}))


def renamed(c: Corpus) -> None:
    """Topics take the canonical form of their name; those that come to one slug are merged into the most used."""
    named = c.topics.filter("NOT hidden").withColumn("new_name", F.when(F.col("kind") == "entity", F.col("name")).otherwise(X.normalize_term(F.col("name")))).withColumn("new_slug", X.slugify(F.col("new_name")))
    named = named.filter("new_name != '' AND new_slug != ''")
    merged(c, M.merge_by(named.select("topic_id", "usage", "new_slug"), F.col("new_slug")), "canonicalize_topics", "canonicalized_duplicate")
    c.topics = written(
        c.topics.join(named.select("topic_id", "new_name", "new_slug"), "topic_id", "left")
        .withColumn("name", F.when(~F.col("hidden"), F.coalesce("new_name", "name")).otherwise(F.col("name")))
        .withColumn("slug", F.when(~F.col("hidden"), F.coalesce("new_slug", "slug")).otherwise(F.col("slug")))
        .drop("new_name", "new_slug"),
        "topics",
    )


def alias_merges(c: Corpus, aliases: DataFrame) -> DataFrame:
    """topic_id, keeper_id of entities whose name is an alias; canonical topics that don't exist are made. aliases: alias, canonical, place."""
    found = M.alias_merge(active(c.topics).filter("kind = 'entity'").select("topic_id", "name"), aliases).withColumn("slug", X.slugify(F.col("canonical")))
    new = found.join(c.topics.select("slug"), "slug", "left_anti").groupBy("slug").agg(F.min("canonical").alias("name"))
    zero = F.lit(0).cast("long")
    made = new.select(F.xxhash64("slug").alias("topic_id"), "name", "slug", F.lit("entity").alias("kind"), F.lit(0.0).alias("distinctiveness"), zero.alias("usage"), zero.alias("support"), F.lit(False).alias("hidden"), F.lit(None).cast("string").alias("reason"))
    c.topics = written(c.topics.unionByName(made, allowMissingColumns=True), "topics")
    return found.join(c.topics.select("slug", F.col("topic_id").alias("keeper_id")), "slug").select("topic_id", "keeper_id")


def validated(c: Corpus) -> None:
    """Links of entities to chunks whose text doesn't name them go; entity_verified says which entities still have one."""
    entities = active(c.topics).filter("kind = 'entity'").select("topic_id", F.lower("name").alias("term"))
    named = matcher.with_bounds(c.rows, entities.select("term").distinct(), deal=False).join(entities, "term").select(F.col("doc_id").alias("chunk_id"), "topic_id")
    wrong = written(c.links.join(entities, "topic_id", "left_semi").join(named, ["chunk_id", "topic_id"], "left_anti"), "wrong-links")
    c.links = written(c.links.join(wrong, ["chunk_id", "topic_id"], "left_anti"), "links")
    c.steps.append(("entity_validation", {"invalid_links_removed": wrong.count()}))
    recounted(c)
    c.topics = written(c.topics.withColumn("entity_verified", (F.col("kind") == "entity") & (F.col("usage") > 0)), "topics")


def displayed(topics: DataFrame, least_support, t: G.Tuning = G.DEFAULT) -> DataFrame:
    """Adds suppressed and the reason for it: hidden topics, too few episodes, and what curation leaves out."""
    low, plain = F.lower("name"), (F.col("kind") != "entity") & ~G._in(F.lower("name"), t.protected)
    kept = G.curate(topics.filter("NOT hidden"), t=t).select("topic_id", "keep")
    why = F.when(G.is_noise(low, t), "noise_or_structural_filter").when(G.is_weak_single(low, F.col("usage"), F.col("distinctiveness"), t), "weak_singleton_filter").when(F.col("name").contains(" "), "phrase_quality_filter").otherwise("subsumed_by_phrase")
    shown = topics.join(kept, "topic_id", "left")
    why = F.when(F.col("hidden"), F.coalesce("reason", F.lit("hidden_topic"))).when(plain & (F.col("support") < least_support), "low_episode_spread").when(plain & ~F.coalesce("keep", F.lit(False)), why)
    return shown.withColumn("reason", why).withColumn("suppressed", F.col("reason").isNotNull()).drop("keep")


def finalized(c: Corpus, lexicon: DataFrame | None = None, aliases: DataFrame | None = None, stats: DataFrame | None = None, least_similar: float = 0.7, t: G.Tuning = G.DEFAULT) -> Corpus:
    """All steps in order. lexicon: phrase, slug, docs, support, quality; aliases: alias, canonical, place; stats: word, score."""
    if lexicon is not None:
        backfilled(c, lexicon, t)
    renamed(c)
    recounted(c)
    episodes = c.rows.select("episode_id").distinct().count()
    least = A.support_threshold(F.lit(episodes))

    def distinct_again() -> None:
        if stats is not None:
            scored = c.topics.drop("distinctiveness").join(stats.select(F.col("word").alias("name"), F.col("score").alias("distinctiveness")), "name", "left")
            c.topics = written(scored.fillna(0.0, ["distinctiveness"]), "topics")

    distinct_again()
    plain = lambda: active(c.topics).filter("kind != 'entity'")
    pruned(c, plain().filter(G.is_noise(F.col("name"), t)), "noise_cleanup", "noise_cleanup")
    pruned(c, plain().filter("support < 2"), "episode_spread_gate", "low_episode_spread")
    pruned(c, plain().filter(F.col("support") < least), "df_quality_gate", "low_support")
    if aliases is not None:
        merged(c, alias_merges(c, aliases), "alias_merge", "entity_alias_merge")
    merged(c, M.stem_merge(plain().select("topic_id", "name", "usage")), "stem_merge", "stem_equivalent")
    merged(c, M.best_partners(plain().select("topic_id", "name", "usage"), least_similar), "similarity_cluster", "near_duplicate_string")
    merged(c, M.canonical_merge(plain().select("topic_id", "name", "usage")), "phrase_dedup", "canonical_plural_duplicate")
    referred = c.links.select("topic_id").union(c.audit.select("topic_id")).union(c.merges.select("from_id")).union(c.merges.select("to_id")).filter("topic_id IS NOT NULL").distinct()
    before = c.topics.count()
    c.topics = written(c.topics.join(referred, "topic_id", "left_semi"), "topics")
    c.steps.append(("delete_orphans", {"orphan_topics_deleted": before - c.topics.count()}))
    recounted(c)
    distinct_again()
    validated(c)
    dated = c.links.join(c.rows.select(F.col("doc_id").alias("chunk_id"), "episode_id", "published"), "chunk_id")
    burst = A.burst(dated.filter("published IS NOT NULL"))
    c.topics = c.topics.drop("burst", "peak_quarter").join(burst, "topic_id", "left")
    c.episode_topics = written(dated.select("episode_id", "topic_id").distinct(), "episode-topics")
    accepted = c.audit.filter("decision = 'accepted'").select("topic_id").distinct().withColumn("provenance_complete", F.lit(True))
    c.topics = c.topics.drop("provenance_complete").join(accepted, "topic_id", "left").fillna(False, ["provenance_complete"])
    c.topics = written(displayed(c.topics, least, t), "topics")
    c.steps.append(("display_curation", {"display_suppressed": c.topics.filter("suppressed").count()}))
    shown = c.topics.filter("NOT suppressed AND NOT hidden").select("topic_id", "usage")
    sums = c.links.join(shown, "topic_id").groupBy("chunk_id").agg(F.sum("usage").alias("reach"))
    c.reach = c.rows.select(F.col("doc_id").alias("chunk_id")).join(sums, "chunk_id", "left").fillna(0, ["reach"])
    return c
