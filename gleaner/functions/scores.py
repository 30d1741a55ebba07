"""Scores of topics as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def phrase_weight(name: Column, distinctiveness: Column) -> Column:
    return F.when(distinctiveness > 0, distinctiveness).when(name.contains(" "), 20.0).otherwise(1.0)


def weighted_score(count: Column, distinctiveness: Column) -> Column:
    """log(1 + max(count, 1)) * (1 + max(distinctiveness, 0) / 10)."""
    return F.log1p(F.greatest(count, F.lit(1)).cast("double")) * (1 + F.greatest(distinctiveness, F.lit(0.0)) / 10)


def weighted_delta(delta: Column, current: Column, previous: Column, distinctiveness: Column) -> Column:
    return F.abs(delta) * weighted_score(F.greatest(current, previous), distinctiveness)


def distinctiveness(count: Column, total: Column, rank: Column) -> Column:
    """Words outside the baseline: 10 + 0.1 * count; others: share of the corpus times half their rank."""
    return F.when(rank.isNull(), 10 + 0.1 * count).otherwise(count / total * rank * 0.5)
