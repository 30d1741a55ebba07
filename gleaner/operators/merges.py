"""Identity of topics: which topics are one, which one stays, and what follows for links. topics: topic_id, name, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators.search import dice_pairs


def merge_by(topics: DataFrame, key: Column) -> DataFrame:
    """topic_id, keeper_id: of topics with one key the most used stays, then the one with the least id. The groups' keepers are an aggregate, so no group is gathered."""
    keyed = topics.withColumn("key", key)
    best = F.max(F.struct("usage", (-F.col("topic_id")).alias("less")))
    keepers = keyed.groupBy("key").agg((-best["less"]).alias("keeper_id"))
    return keyed.join(keepers, "key").select("topic_id", "keeper_id")


def stem_key(name: Column) -> Column:
    return F.array_join(F.transform(F.split(F.lower(name), " "), X.stem), " ")


def stem_merge(topics: DataFrame) -> DataFrame:
    return merge_by(topics, stem_key(F.col("name")))


def canonical_merge(topics: DataFrame) -> DataFrame:
    """Topics whose singular forms have one slug."""
    return merge_by(topics, X.slugify(X.normalize_term(F.col("name"))))


def alias_merge(topics: DataFrame, aliases: DataFrame) -> DataFrame:
    """topic_id, canonical of topics whose name is an alias; aliases (alias, canonical, place): the last place wins."""
    last = aliases.groupBy(F.lower("alias").alias("low")).agg(F.max_by("canonical", "place").alias("canonical"))
    rows = topics.withColumn("low", F.lower("name")).join(F.broadcast(last), "low")  # a gazetteer of bounded size
    return rows.filter(F.lower("canonical") != F.col("low")).select("topic_id", "canonical")


def best_partners(topics: DataFrame, least: float = 0.7) -> DataFrame:
    """topic_id, keeper_id: each topic goes to its best partner that is used more, then longer, then first by name. As a partner's rank is
    always higher the map has no cycles, but a partner may go on to another."""
    named = topics.groupBy(F.lower("name").alias("name")).agg(F.max("usage").alias("usage"), F.min("topic_id").alias("topic_id"))
    pairs = dice_pairs(named.select("name"), least)
    both = pairs.union(pairs.select(F.col("b"), F.col("a"), "score")).toDF("name", "other", "score")
    rank = lambda p: F.struct(F.col(f"{p}usage").alias("u"), F.length(f"{p}name").alias("n"), F.lit(0).alias("z"))
    other = named.select(F.col("name").alias("other"), F.col("name").alias("o_name"), F.col("usage").alias("o_usage"), F.col("topic_id").alias("o_id"))
    rows = both.join(named, "name").join(other, "other")
    higher = (rank("o_") > rank("")) | ((rank("o_") == rank("")) & (F.col("o_name") < F.col("name")))
    w = Window.partitionBy("topic_id").orderBy(F.desc("score"), F.desc("o_usage"), F.desc(F.length("o_name")), "o_name")
    return rows.filter(higher).withColumn("r", F.row_number().over(w)).filter("r = 1").select("topic_id", F.col("o_id").alias("keeper_id"))


def similarity_merge(topics: DataFrame, least: float = 0.7) -> DataFrame:
    """The best partners that go nowhere themselves, so that the map is one step deep."""
    best = best_partners(topics, least)
    return best.join(best.select(F.col("topic_id").alias("keeper_id")), "keeper_id", "left_anti").select("topic_id", "keeper_id")


def leader_clusters(names: DataFrame, least: float = 0.7) -> DataFrame:
    """name, leader: the longest names lead; a name joins the first earlier leader that is alike. names: a bounded topic table.

    The greedy order is sequential, so only the pairs that are alike go through it, in one task."""
    import pandas as pd

    pairs = dice_pairs(names.select("name"), least).select("a", "b")
    both = names.select("name").join(pairs.union(pairs.select("b", "a")).toDF("name", "other"), "name", "left")

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, set] = {}
        for n, o in zip(pdf["name"], pdf["other"], strict=True):
            near.setdefault(n, set())
            if isinstance(o, str):
                near[n].add(o)
        leaders: list[str] = []
        out = {}
        for n in sorted(near, key=lambda x: (-len(x), x)):
            out[n] = next((x for x in leaders if x in near[n]), n)
            if out[n] == n:
                leaders.append(n)
        return pd.DataFrame({"name": list(out), "leader": list(out.values())})

    return both.groupBy(F.lit(1).alias("all")).applyInPandas(lambda pdf: lead(pdf), "name string, leader string")


def relink(links: DataFrame, merges: DataFrame) -> DataFrame:
    """Links after a merge: each topic replaced by its keeper, double links gone."""
    moved = links.join(merges, "topic_id", "left")
    return moved.select("chunk_id", F.coalesce("keeper_id", "topic_id").alias("topic_id")).distinct()


def affected(links: DataFrame, dirty: DataFrame) -> DataFrame:
    """Dirty topics and those that share a chunk with one."""
    chunks = links.join(dirty.select("topic_id").distinct(), "topic_id", "left_semi").select("chunk_id").distinct()
    return links.join(chunks, "chunk_id", "left_semi").select("topic_id").union(dirty.select("topic_id")).distinct()
