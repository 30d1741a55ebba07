"""Evaluation of rankings against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(rows: DataFrame, by: list[str], order: list[Column], gold: DataFrame, item: str, cuts: list[int]) -> DataFrame:
    """k, precision, recall, micro-averaged over groups: hits among the first k of each group, over what is shown and over all gold items.

    gold: the groups' columns and the item."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= max(cuts))
    marked = ranked.join(gold.select(*by, item).distinct().withColumn("hit", F.lit(1)), [*by, item], "left")
    sums = marked.agg(*(F.count_if((F.col("rank") <= k) & F.col("hit").isNotNull()).alias(f"hits_{k}") for k in cuts), *(F.count_if(F.col("rank") <= k).alias(f"shown_{k}") for k in cuts))
    total = gold.select(*by, item).distinct().agg(F.count("*").alias("gold"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"hits_{k}").alias("hits"), F.col(f"shown_{k}").alias("shown")) for k in cuts)))
    one = sums.crossJoin(total).select("gold", each.alias("x"))
    return one.select("x.k", F.round(F.try_divide(F.col("x.hits"), F.col("x.shown")), 6).alias("precision"), F.round(F.try_divide(F.col("x.hits"), F.col("gold")), 6).alias("recall"))
