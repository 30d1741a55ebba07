"""What pages tell of topics, for all topics at once: span, densest episode, yearly ranks, neighbours in rank, companions, and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import oxford_list
from gleaner.operators import analytics as A


def topic_pages(links: DataFrame, dated: DataFrame | None, used: DataFrame, most_related: int = 3, per: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """A row for each visible topic with links.

    links: chunk_id, topic_id; dated: these with episode_id and published, or per: their number n by topic_id, episode_id, published; used: topic_id, name, usage, distinctiveness, hidden. Ties: the
    densest episode is the earliest of the most chunks; ranks in a year go by chunks, then by id."""
    seen = used.filter(A.visible()).select("topic_id", "name")
    per = per if per is not None else dated.groupBy("topic_id", "episode_id", "published").agg(F.count("*").alias("n"))
    span = per.groupBy("topic_id").agg(F.sum("n").alias("chunks"), F.count_distinct("episode_id").alias("episodes"), F.min("published").alias("first"), F.max("published").alias("last"))
    peak = per.groupBy("topic_id").agg(F.max_by(F.struct("episode_id", "published", "n"), F.struct("n", -F.unix_date("published"), -F.col("episode_id"))).alias("peak"))
    yearly = per.groupBy(F.year("published").alias("year"), "topic_id").agg(F.sum("n").alias("n"))
    ranked = yearly.withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("n"), "topic_id")))
    ends = ranked.groupBy("topic_id").agg(F.min_by(F.struct("year", "rank"), "year").alias("start"), F.max_by(F.struct("year", "rank"), "year").alias("end"))
    near = A.neighbours_in_rank(used.filter(A.visible()))
    name = lambda column: seen.select(F.col("topic_id").alias(column), F.col("name").alias(f"{column}_name"))
    near = near.join(name("above"), "above", "left").join(name("below"), "below", "left").select("topic_id", "above_name", "below_name")
    others = A.related(links.join(seen.select("topic_id"), "topic_id", "left_semi"), most_related, parts).join(name("other_id"), "other_id")
    others = others.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other_id_name"))), lambda s: s["other_id_name"]).alias("related"))
    rows = seen.join(span, "topic_id").join(peak, "topic_id").join(ends, "topic_id").join(near, "topic_id", "left").join(others, "topic_id", "left")
    return rows.withColumn("related", F.coalesce("related", F.array().cast("array<string>"))).withColumn("summary", summary())


def _many(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def summary() -> Column:
    """Up to three sentences on a row of topic_pages."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    once = F.concat("name", F.lit(" appears in "), _many(F.col("chunks"), "chunk"), F.lit(" from "), day("first"), F.lit("."))
    spread = F.concat("name", F.lit(" appears in "), _many(F.col("chunks"), "chunk"), F.lit(" across "), _many(F.col("episodes"), "episode"), F.lit(", from "), day("first"), F.lit(" to "), day("last"), F.lit("."))
    dense = F.concat(F.lit("Its densest episode is "), F.col("peak.episode_id").cast("string"), F.lit(" ("), day("peak.published"), F.lit("), with "), _many(F.col("peak.n"), "observation"), F.lit(" on this topic."))
    moved = F.when(F.col("start.year") != F.col("end.year"), F.concat(F.lit("its yearly rank moved from #"), F.col("start.rank"), F.lit(" in "), F.col("start.year"), F.lit(" to #"), F.col("end.rank"), F.lit(" in "), F.col("end.year")))
    between = oxford_list(F.array_compact(F.array("above_name", "below_name")))
    company, near = oxford_list(F.col("related")), F.coalesce("above_name", "below_name").isNotNull()
    tail = F.coalesce(F.concat(F.lit("; "), moved), F.lit(""))
    last = (
        F.when((F.size("related") > 0) & near, F.concat(F.lit("Semantically it travels with "), company, F.lit(", while by chunk count it sits between "), between, tail, F.lit(".")))
        .when(F.size("related") > 0, F.concat(F.lit("It most often travels with "), company, tail, F.lit(".")))
        .when(near, F.concat(F.lit("By chunk count it sits between "), between, tail, F.lit(".")))
        .otherwise(F.concat(F.lit("I"), F.substring(moved, 2, 1000), F.lit(".")))
    )
    return F.array_compact(F.array(F.when(F.col("first") == F.col("last"), once).otherwise(spread), dense, last))
