"""Corpus roles over relational tables: orders are chunks, their months episodes, parts topics, order lines links."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.shared import parts_of


class Corpus:
    """The frames that read-side analytics work on; each is lazy and reads only its columns."""

    def __init__(self, spark: SparkSession, sf_dir: str, first: datetime.date | None = None, last: datetime.date | None = None):
        """first and last: keep only chunks of these whole months; the bounds are on the stored date, so they reach the scan."""
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        self.spark, self.sf_dir = spark, sf_dir
        orders = read("orders")
        if first and last:
            orders = orders.filter((F.col("o_orderdate") >= F.lit(first).cast("timestamp")) & (F.col("o_orderdate") < F.lit(last + datetime.timedelta(days=1)).cast("timestamp")))
        self.chunks = orders.select(
            F.col("o_orderkey").alias("chunk_id"),
            (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("episode_id"),
            F.trunc("o_orderdate", "month").alias("published"),
        )
        self.episodes = self.chunks.select("episode_id", "published").distinct()
        self.links = read("lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("topic_id")).distinct()
        self.topics = read("part").select(
            F.col("p_partkey").alias("topic_id"),
            F.col("p_name").alias("name"),
            F.when(F.col("p_type") == "ECONOMY", "entity").otherwise("concept").alias("kind"),
            (F.col("p_size") % 10 == 0).alias("hidden"),
            (F.col("p_retailprice") / 100).alias("distinctiveness"),
        )

    @property
    def parts(self) -> int:
        """In how many parts links, and what is made of them, are dealt: more with more order lines, whose number stands in the files' footers."""
        return parts_of(self.spark, self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet").count())

    @property
    def dealt_links(self) -> DataFrame:
        """links by chunk in parts of a bounded size; joins and pairs by chunk need no other deal."""
        lines = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet")
        return lines.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("topic_id")).repartition(self.parts, "chunk_id").distinct()

    @property
    def dealt_dated(self) -> DataFrame:
        """dated by chunk in parts of a bounded size."""
        return self.dealt_links.join(self.chunks.repartition(self.parts, "chunk_id"), "chunk_id")

    def within(self, first: datetime.date, last: datetime.date) -> Corpus:
        return Corpus(self.spark, self.sf_dir, first, last)

    @property
    def dated(self) -> DataFrame:
        """chunk_id, topic_id, episode_id, published."""
        return self.links.join(self.chunks, "chunk_id")

    @property
    def used(self) -> DataFrame:
        """Topics with usage (links) and support (episodes)."""
        counts = self.dated.groupBy("topic_id").agg(F.count("*").alias("usage"), F.count_distinct("episode_id").alias("support"))
        return self.topics.join(counts, "topic_id", "left").fillna(0, ["usage", "support"])


#: The same roles for the SQL side; every query's SQL starts with it.
SQL = """WITH chunks AS (SELECT o_orderkey AS chunk_id, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS episode_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS published FROM orders),
episodes AS (SELECT DISTINCT episode_id, published FROM chunks),
links AS (SELECT DISTINCT l_orderkey AS chunk_id, l_partkey AS topic_id FROM lineitem),
topics AS (SELECT p_partkey AS topic_id, p_name AS name, CASE WHEN p_type = 'ECONOMY' THEN 'entity' ELSE 'concept' END AS kind, p_size % 10 = 0 AS hidden, p_retailprice / 100 AS distinctiveness FROM part),
dated AS (SELECT l.chunk_id, l.topic_id, c.episode_id, c.published FROM links l JOIN chunks c USING (chunk_id)),
used AS (SELECT t.*, coalesce(n.usage, 0) AS usage, coalesce(n.support, 0) AS support FROM topics t LEFT JOIN (SELECT topic_id, count(*) AS usage, count(DISTINCT episode_id) AS support FROM dated GROUP BY topic_id) n USING (topic_id))
"""
