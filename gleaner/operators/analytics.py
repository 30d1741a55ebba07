"""Read-side analytics over chunks, episodes, topics and links.

links: chunk_id, topic_id; dated: links with episode_id and published; used: topics with usage and support. Ties are
broken by ids everywhere, so results are the same on every run.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.dates import quarter_key, quarter_ordinal
from gleaner.functions.scores import phrase_weight, weighted_delta, weighted_score
from gleaner.sources.shared import written


def visible(prefix: str = "") -> Column:
    return ~F.col(f"{prefix}hidden")


def within(column: str, first: datetime.date, last: datetime.date) -> Column:
    """Inclusive bounds; reaches the scan as a range."""
    return F.col(column).between(F.lit(first), F.lit(last))


def ranked(df: DataFrame, by: list[str], order: list[Column], most: int | None = None, name: str = "rank") -> DataFrame:
    """Row numbers within groups; most keeps the first of each group (pushed below the shuffle by Spark's group limit)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if most is None else out.filter(F.col(name) <= most)


def topic_counts(dated: DataFrame, first, last) -> DataFrame:
    return dated.filter(within("published", first, last)).groupBy("topic_id").agg(F.count("*").alias("n"))


def top_topics(used: DataFrame, most: int, least_support: int = 0) -> DataFrame:
    """Visible topics by usage times weight: distinctiveness if positive, 20 for phrases, else 1."""
    score = F.col("usage") * phrase_weight(F.col("name"), F.col("distinctiveness"))
    rows = used.filter(visible() & (F.col("support") >= least_support)).withColumn("score", F.round(score, 6))
    return rows.orderBy(F.desc("score"), "topic_id").limit(most).select("topic_id", "name", "usage", "score")


def rank_history(dated: DataFrame, most: int) -> DataFrame:
    """The rank of topics by links in each year."""
    yearly = dated.groupBy(F.year("published").alias("year"), "topic_id").agg(F.count("*").alias("n"))
    return ranked(yearly, ["year"], [F.desc("n"), F.asc("topic_id")], most)


def neighbours_in_rank(used: DataFrame, most: int | None = None) -> DataFrame:
    """Rank by usage with the topics above and below; `most` takes the first rows only, as they are. All rows are ranked in ranges of the order, whose sizes and edge rows (one row for each range) go over the boundaries."""
    order = [F.desc("usage"), F.desc("distinctiveness"), F.asc("name"), F.asc("topic_id")]
    if most is not None:
        w = Window.orderBy(*order)
        return used.orderBy(*order).limit(most).select("topic_id", F.row_number().over(w).alias("rank"), F.lag("topic_id").over(w).alias("above"), F.lead("topic_id").over(w).alias("below"))
    rows = used.select("topic_id", "usage", "distinctiveness", "name").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    rows = written(rows, "ranges")  # the ranges are sampled: read them again, don't draw them anew
    w, all_of = Window.partitionBy("part").orderBy(*order), Window.partitionBy("part")
    here = rows.withColumns({"at": F.row_number().over(w), "above": F.lag("topic_id").over(w), "below": F.lead("topic_id").over(w), "size": F.count("*").over(all_of)})
    edges = here.groupBy("part").agg(F.count("*").alias("size"), F.max(F.when(F.col("at") == 1, F.col("topic_id"))).alias("first"), F.max(F.when(F.col("at") == F.col("size"), F.col("topic_id"))).alias("last"))
    ranges = Window.orderBy("part")
    edges = edges.select("part", (F.sum("size").over(ranges) - F.col("size")).alias("before"), F.lag("last").over(ranges).alias("last_before"), F.lead("first").over(ranges).alias("first_after"))
    placed = here.join(F.broadcast(edges), "part")
    return placed.select("topic_id", (F.col("before") + F.col("at")).alias("rank"), F.coalesce("above", "last_before").alias("above"), F.coalesce("below", "first_after").alias("below"))


def sparkline(dated: DataFrame, episodes: DataFrame, topics: DataFrame) -> DataFrame:
    """Dense series: one row for each of topics and episode, zero where there is no link. topics: a bounded choice."""
    grid = episodes.crossJoin(F.broadcast(topics.select("topic_id")))
    counts = dated.join(F.broadcast(topics.select("topic_id")), "topic_id", "left_semi").groupBy("topic_id", "episode_id").agg(F.count("*").alias("n"))
    return grid.join(counts, ["topic_id", "episode_id"], "left").select("topic_id", "episode_id", F.coalesce("n", F.lit(0)).alias("n"))


def interest(dated: DataFrame, used: DataFrame) -> DataFrame:
    """Variation of non-zero counts times log2(usage + 1), half as much again for phrases."""
    per = dated.groupBy("topic_id", "episode_id").agg(F.count("*").alias("n")).groupBy("topic_id").agg((F.stddev_pop("n") / F.avg("n")).alias("cv"))
    factor = F.when(F.col("name").contains(" "), 1.5).otherwise(1.0)
    return per.join(used, "topic_id").select("topic_id", F.round(F.col("cv") * F.log2(F.col("usage") + 1) * factor, 6).alias("interest"))


def movers(dated: DataFrame, used: DataFrame, now: tuple, before: tuple, most: int) -> DataFrame:
    """Topics whose count changed most between two periods, those that vanished included; each way by weighted change."""
    a, b = topic_counts(dated, *now).withColumnRenamed("n", "current"), topic_counts(dated, *before).withColumnRenamed("n", "previous")
    both = a.join(b, "topic_id", "full_outer").fillna(0, ["current", "previous"]).join(used.filter(visible()).select("topic_id", "distinctiveness"), "topic_id")
    both = both.withColumn("delta", F.col("current") - F.col("previous")).filter("delta != 0")
    both = both.withColumn("way", F.when(F.col("delta") > 0, "up").otherwise("down"))
    score = weighted_delta(F.col("delta"), F.col("current"), F.col("previous"), F.col("distinctiveness"))
    return ranked(both.withColumn("score", F.round(score, 6)), ["way"], [F.desc("score"), F.asc("topic_id")], most).select("way", "rank", "topic_id", "current", "previous", "delta", "score")


def first_seen(dated: DataFrame) -> DataFrame:
    return dated.groupBy("topic_id").agg(F.min("published").alias("first_seen"))


def new_topics(dated: DataFrame, used: DataFrame, first, last, most: int) -> DataFrame:
    """Topics first seen in the period, by weighted score of their count in it."""
    inside = dated.groupBy("topic_id").agg(F.min("published").alias("first_seen"), F.count_if(within("published", first, last)).alias("n"))
    rows = inside.filter(within("first_seen", first, last)).join(used.filter(visible()), "topic_id")
    rows = rows.withColumn("score", F.round(weighted_score(F.col("n"), F.col("distinctiveness")), 6))
    return rows.orderBy(F.desc("score"), "topic_id").limit(most).select("topic_id", "first_seen", "n", "score")


def archive_contrast(dated: DataFrame, episodes: DataFrame, used: DataFrame, first, last, most: int, least: float = 1.5) -> DataFrame:
    """Topics denser in the period than in the archive: (count / period episodes) / (usage / all episodes)."""
    sizes = episodes.agg(F.count("*").alias("total"), F.count_if(within("published", first, last)).alias("inside"))
    rows = topic_counts(dated, first, last).join(used.filter(visible()).select("topic_id", "usage"), "topic_id").crossJoin(F.broadcast(sizes))
    rows = rows.withColumn("ratio", F.round((F.col("n") / F.col("inside")) / (F.col("usage") / F.col("total")), 6)).filter(F.col("ratio") > least)
    return rows.orderBy(F.desc("ratio"), "topic_id").limit(most).select("topic_id", "n", "usage", "ratio")


def novel_history(dated: DataFrame, months: int = 12) -> DataFrame:
    """New topics per episode of the last months of the corpus; a topic is new where it first occurs."""
    latest = dated.agg(F.max("published").alias("latest"))
    starts = dated.groupBy("topic_id").agg(F.min(F.struct("published", "episode_id")).alias("s")).select("topic_id", "s.*")
    recent = starts.crossJoin(F.broadcast(latest)).filter(F.col("published") >= F.add_months("latest", -months))
    return recent.groupBy("episode_id").agg(F.count("*").alias("novel"))


def blended_topics(dated: DataFrame, episodes: DataFrame, most_main: int, most_distinct: int, least: int = 2) -> DataFrame:
    """Per episode its most frequent topics, and by tf-idf the distinctive ones that aren't among them."""
    counts = dated.groupBy("episode_id", "topic_id").agg(F.count("*").alias("n"))
    main = ranked(counts, ["episode_id"], [F.desc("n"), F.asc("topic_id")], most_main).select("episode_id", "topic_id", F.lit("main").alias("tier"), "rank")
    df = counts.groupBy("topic_id").agg(F.count("*").alias("df"))
    total = episodes.agg(F.count("*").alias("total"))
    scored = counts.filter(F.col("n") >= least).join(df, "topic_id").crossJoin(F.broadcast(total)).withColumn("tfidf", F.round(F.col("n") * F.log(F.col("total") / F.col("df")), 6))
    rest = scored.join(main.select("episode_id", "topic_id"), ["episode_id", "topic_id"], "left_anti")
    other = ranked(rest, ["episode_id"], [F.desc("tfidf"), F.asc("topic_id")], most_distinct).select("episode_id", "topic_id", F.lit("distinctive").alias("tier"), "rank")
    return main.unionByName(other)


def pairs(links: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Unordered topic pairs of each chunk: a < b. Chunks hold few topics, so the join is on a short key."""
    extra = keep or []
    a, b = links.select("chunk_id", *extra, F.col("topic_id").alias("a")), links.select("chunk_id", F.col("topic_id").alias("b"))
    return a.join(b, "chunk_id").filter("a < b")


def by_pair(pairs_of: DataFrame, parts: int | None):
    """Groups of equal a and b. With parts, pairs are dealt first: nearly all are different, so adding up before would only take memory."""
    return (pairs_of if parts is None else pairs_of.repartition(parts, "a", "b")).groupBy("a", "b")


def unexpected_pairs(dated: DataFrame, episode: int, most: int, least: int = 1, parts: int | None = None) -> DataFrame:
    """Pairs of one episode that the rest of the corpus has least often."""
    inside = F.col("episode_id") == episode
    every = pairs(dated.select("chunk_id", "topic_id", "episode_id"), ["episode_id"]).select("a", "b", "episode_id")
    counts = by_pair(every, parts).agg(F.count_if(inside).alias("here"), F.count_if(~inside).alias("elsewhere")).filter(F.col("here") >= least)
    return counts.orderBy("elsewhere", F.desc("here"), "a", "b").limit(most)


def novelty(dated: DataFrame, episodes: DataFrame, episode_date, most: int) -> DataFrame:
    """Chunks of one episode by mean log((N + 1) / (earlier uses + 1)) of their topics."""
    total = episodes.filter(F.col("published") < F.lit(episode_date)).agg(F.count("*").alias("total"))
    prior = dated.filter(F.col("published") < F.lit(episode_date)).groupBy("topic_id").agg(F.count_distinct("episode_id").alias("prior"))
    rows = dated.filter(F.col("published") == F.lit(episode_date)).join(prior, "topic_id", "left").fillna(0, ["prior"]).crossJoin(F.broadcast(total))
    out = rows.groupBy("chunk_id").agg(F.round(F.avg(F.log((F.col("total") + 1) / (F.col("prior") + 1))), 6).alias("novelty"))
    return out.orderBy(F.desc("novelty"), "chunk_id").limit(most)


def since_last(dated: DataFrame, used: DataFrame, now, before, most: int) -> DataFrame:
    """Against the episode before: new, intensified, downshifted and disappeared topics, by weighted change."""
    a, b = topic_counts(dated, now, now).withColumnRenamed("n", "current"), topic_counts(dated, before, before).withColumnRenamed("n", "previous")
    both = a.join(b, "topic_id", "full_outer").fillna(0, ["current", "previous"]).filter("current != previous").join(used.select("topic_id", "distinctiveness"), "topic_id")
    group = F.when(F.col("previous") == 0, "new").when(F.col("current") == 0, "disappeared").when(F.col("current") > F.col("previous"), "intensified").otherwise("downshifted")
    score = weighted_delta(F.col("current") - F.col("previous"), F.col("current"), F.col("previous"), F.col("distinctiveness"))
    return ranked(both.withColumn("change", group).withColumn("score", F.round(score, 6)), ["change"], [F.desc("score"), F.asc("topic_id")], most).select("change", "rank", "topic_id", "current", "previous", "score")


def related(links: DataFrame, most: int, parts: int | None = None) -> DataFrame:
    """For each topic the topics it shares most chunks with. With parts, a topic's pairs are dealt once, then counted and ranked where they are."""
    if parts is not None:
        a, b = links.select("chunk_id", "topic_id"), links.select("chunk_id", F.col("topic_id").alias("other_id"))
        directed = a.join(b, "chunk_id").filter("topic_id != other_id").select("topic_id", "other_id").repartition(parts, "topic_id")
        return ranked(directed.groupBy("topic_id", "other_id").agg(F.count("*").alias("shared")), ["topic_id"], [F.desc("shared"), F.asc("other_id")], most)
    p = pairs(links).groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = p.union(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared")).toDF("topic_id", "other_id", "shared")
    return ranked(both, ["topic_id"], [F.desc("shared"), F.asc("other_id")], most)


def jaccard_blend(links: DataFrame, vectors: DataFrame | None, most: int, parts: int | None = None) -> DataFrame:
    """Topic pairs with overlap: Jaccard of their chunk sets, cosine of their vectors if given (topic_id, v), and the blend."""
    from gleaner.functions.vectors import blend, cosine

    sizes = links.groupBy("topic_id").agg(F.count("*").alias("size"))
    p = by_pair(pairs(links).select("a", "b"), parts).agg(F.count("*").alias("overlap"))
    p = p.join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
    p = p.withColumn("jaccard", F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap")))
    if vectors is None:
        p = p.withColumn("cos", F.lit(None).cast("double"))
    else:
        p = p.join(vectors.toDF("a", "va"), "a", "left").join(vectors.toDF("b", "vb"), "b", "left").withColumn("cos", cosine("va", "vb"))
    p = p.withColumn("score", F.round(blend(F.col("cos"), F.col("jaccard")), 6)).select("a", "b", "overlap", F.round("jaccard", 6).alias("jaccard"), "score")
    both = p.union(p.select(F.col("b"), F.col("a"), "overlap", "jaccard", "score")).toDF("topic_id", "other_id", "overlap", "jaccard", "score")
    return ranked(both, ["topic_id"], [F.desc("score"), F.asc("other_id")], most)


def thread(links: DataFrame, chunk: int, most: int) -> DataFrame:
    """Other chunks that share topics with one chunk, by how many."""
    own = links.filter(F.col("chunk_id") == chunk).select("topic_id")
    shared = links.filter(F.col("chunk_id") != chunk).join(F.broadcast(own), "topic_id", "left_semi")
    return shared.groupBy("chunk_id").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "chunk_id").limit(most)


def reach(links: DataFrame, used: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sum of the usage of each chunk's visible topics; chunks without links have 0."""
    sums = links.join(used.filter(visible()).select("topic_id", "usage"), "topic_id").groupBy("chunk_id").agg(F.sum("usage").alias("reach"))
    return chunks.select("chunk_id").join(sums, "chunk_id", "left").fillna(0, ["reach"])


def burst(dated: DataFrame) -> DataFrame:
    """Peak quarter over the mean of the gap-filled span; the earliest quarter of the highest count is the peak."""
    per = dated.groupBy("topic_id", quarter_ordinal("published").alias("q")).agg(F.count("*").alias("n"))
    agg = per.groupBy("topic_id").agg(F.sum("n").alias("total"), F.max(F.struct(F.col("n"), -F.col("q"))).alias("peak"), (F.max("q") - F.min("q") + 1).alias("span"))
    return agg.select("topic_id", F.round(F.col("peak.n") / (F.col("total") / F.col("span")), 6).alias("burst"), quarter_key(-F.col("peak.col2")).alias("peak_quarter"))


def support_threshold(n: Column) -> Column:
    """max(2, ceil(log2(max(1, floor n))))."""
    return F.greatest(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1), F.floor(n)))).cast("int"))


def all_topics(links: DataFrame, wanted: list[int]) -> DataFrame:
    """Chunks that have every wanted topic (relational division)."""
    return links.filter(F.col("topic_id").isin(wanted)).groupBy("chunk_id").agg(F.count_distinct("topic_id").alias("n")).filter(F.col("n") == len(set(wanted))).select("chunk_id")


def drift_sample(dated: DataFrame, topic: int, most: int) -> DataFrame:
    """The first and the last chunks of a topic by time; none stands in both."""
    rows = dated.filter(F.col("topic_id") == topic)
    early, late = Window.partitionBy("topic_id").orderBy("published", "chunk_id"), Window.partitionBy("topic_id").orderBy(F.desc("published"), F.desc("chunk_id"))
    both = rows.select("chunk_id", F.row_number().over(early).alias("e"), F.row_number().over(late).alias("l")).filter((F.col("e") <= most) | (F.col("l") <= most))
    return both.select("chunk_id", F.when(F.col("e") <= most, "early").otherwise("late").alias("part"))


def adjacent(df: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """The rows before and after within a group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


def trending(dated: DataFrame, used: DataFrame, episodes: DataFrame, episode: int, most: int, least: float = 2.0, least_support: int = 1) -> DataFrame:
    """Topics of an episode whose count is over `least` times their mean per episode."""
    total = episodes.agg(F.count("*").alias("total"))
    here = dated.filter(F.col("episode_id") == episode).groupBy("topic_id").agg(F.count("*").alias("n"))
    rows = here.join(used.filter(visible() & (F.col("support") >= least_support)).select("topic_id", "usage"), "topic_id").crossJoin(F.broadcast(total))
    rows = rows.withColumn("ratio", F.round(F.try_divide(F.col("n"), F.col("usage") / F.col("total")), 6)).filter(F.col("ratio") > least)
    return rows.orderBy(F.desc("ratio"), "topic_id").limit(most).select("topic_id", "n", "usage", "ratio")


def year_cards(dated: DataFrame, chunks: DataFrame, year: int) -> DataFrame:
    """Twelve months with chunks and new topics, zeros included."""
    months = chunks.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    here = chunks.filter(F.year("published") == year).groupBy(F.month("published").alias("month")).agg(F.count("*").alias("chunks"))
    fresh = first_seen(dated).filter(F.year("first_seen") == year).groupBy(F.month("first_seen").alias("month")).agg(F.count("*").alias("new_topics"))
    return months.join(here, "month", "left").join(fresh, "month", "left").fillna(0, ["chunks", "new_topics"])


def baseline_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Key-wise comparison of two (key, value) frames."""
    both = left.toDF("key", "left").join(right.toDF("key", "right"), "key", "full_outer")
    return both.withColumn("delta", F.coalesce("right", F.lit(0)) - F.coalesce("left", F.lit(0))).withColumn("missing", F.when(F.col("left").isNull(), "left").when(F.col("right").isNull(), "right").otherwise("none"))


def compact_lineage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: first and last time, number of rows, id of the latest (ties to the larger id)."""
    return rows.groupBy(*keys).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("archived"), F.max(F.struct("at", "id"))["id"].alias("last_id"))


def keep_least(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Of rows with equal keys the one with the least id."""
    return ranked(rows, keys, [F.asc(id_col)], 1).drop("rank")


def invariants(chunks: DataFrame, links: DataFrame, topics: DataFrame) -> DataFrame:
    """Broken references and empty topics, one row each with its count; all zero means healthy."""
    named = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("invariant"), "n")
    return (
        named("links_without_chunk", links.join(chunks, "chunk_id", "left_anti"))
        .unionByName(named("links_without_topic", links.join(topics, "topic_id", "left_anti")))
        .unionByName(named("topics_without_links", topics.join(links, "topic_id", "left_anti")))
        .unionByName(named("chunks_without_links", chunks.join(links, "chunk_id", "left_anti")))
    )


def corpus_invariants(chunks: DataFrame, episodes: DataFrame, links: DataFrame, topics: DataFrame, episode_topics: DataFrame, chunk_words: DataFrame, word_stats: DataFrame) -> DataFrame:
    """One row: seven counts of what doesn't hang together in stored tables, and whether all are zero.

    chunks: chunk_id, episode_id; episodes: episode_id, chunk_count; topics: topic_id, usage, support as stored; word_stats: word, total."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    of_links = links.groupBy("topic_id").agg(F.count("*").alias("links"))
    of_episodes = episode_topics.groupBy("topic_id").agg(F.count_distinct("episode_id").alias("episodes"))
    per_episode = episodes.join(chunks.groupBy("episode_id").agg(F.count("*").alias("chunks")), "episode_id", "left")
    differ = lambda df, a, b: df.filter(F.coalesce(F.col(a), F.lit(0)) != F.coalesce(F.col(b), F.lit(0)))
    total = lambda df, c, name: df.agg(F.coalesce(F.sum(c), F.lit(0)).alias(name))
    # words are gone through once for both of their counts
    marked = chunk_words.join(chunks.select("chunk_id", F.lit(True).alias("known")).distinct(), "chunk_id", "left")
    words = marked.agg(F.count_if(F.col("known").isNull()).alias("orphan_chunk_words"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    parts = [
        count(links.join(chunks, "chunk_id", "left_anti"), "orphan_chunk_topics"),
        count(episode_topics.join(episodes, "episode_id", "left_anti"), "orphan_episode_topics"),
        words,
        count(differ(topics.join(of_links, "topic_id", "left"), "usage", "links"), "usage_mismatches"),
        count(differ(topics.join(of_episodes, "topic_id", "left"), "support", "episodes"), "support_mismatches"),
        count(differ(per_episode, "chunk_count", "chunks"), "drifted_episodes"),
        total(word_stats, "total", "stats"),
    ]
    row = parts[0]
    for more in parts[1:]:
        row = row.crossJoin(more)  # one row each
    row = row.withColumn("word_total_delta", F.col("words") - F.col("stats")).drop("words", "stats")
    return row.withColumn("healthy", sum((F.abs(c) for c in row.columns), F.lit(0)) == 0)
