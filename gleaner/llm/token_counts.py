"""Exact token counts by prefix dynamic programming.

Every prefix of a pre-token has one possible last token; count(prefix) = count(prefix without it) + 1. From these counts
and the counts before each pre-token follow the whole text's count, any prefix's count and the longest prefix within a
budget, without encoding again.

Defined results: a null text is empty (0 tokens, 0 bytes); special strings inside a text count one token each, as the
library has it by default; repeated rows each get their row; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .bpe import prefix_counter
from .common import arrow_rows, id_text, table


def token_counts(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_bytes: the bytes of the longest prefix of whole characters within limit tokens."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counter = prefix_counter(path)
        for b in batches:
            out: dict = {k: [] for k in ("n_bytes", "n_tokens", "over_limit", "fit_bytes")}
            for text in b["text"]:
                size = len(text) if text.isascii() else len(text.encode())
                lengths = counter.lengths(counter.split(text))
                n = sum(lengths)
                fit = size if n <= limit else len(text[: counter.table(text).longest(limit)].encode())
                for k, v in zip(out, (size, n, n > limit, fit), strict=True):
                    out[k].append(v)
            yield {"doc_id": b["doc_id"], **out}

    return arrow_rows(id_text(df, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE: dict[str, str] = {}
