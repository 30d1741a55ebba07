"""Registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans import corpus, gating, refreshing, relational, searching, sequential, textual

MODULES = (relational, textual, searching, refreshing, gating, sequential, corpus)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["adjacent_pmi_lexicon"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
