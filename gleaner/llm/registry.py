"""All queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import classifier, collocations, divergence, exact_dedup, jaccard, lm_scoring, neighbours, packing, pieces, quality_rules, suffixes, token_counts, warc

MODULES = (token_counts, neighbours, pieces, lm_scoring, packing, warc, suffixes, jaccard, quality_rules, classifier, collocations, divergence, exact_dedup)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
