"""SentencePiece encoding and decoding of merge-type models, by backtracking.

Aho-Corasick gives the pieces that start at each position; the longest goes first, a piece stands only if merging it
again together with the piece before gives back both, and positions from which nothing fits are marked in a bit field.

Defined results: a null or empty text has only the begin and end ids; characters outside the vocabulary become byte
pieces; a literal mark (U+2581) decodes to a space, as the library has it; repeated rows each get their row; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .bpe import piece_codec
from .common import arrow_rows, id_text, table


def encode_pieces(df: DataFrame, path: str, ends: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        codec = piece_codec(path)
        for b in batches:
            for k in range(0, len(b["text"]), 256):  # ids take more room than texts
                yield {"doc_id": b["doc_id"][k : k + 256], "ids": [codec.encode(t, ends) for t in b["text"][k : k + 256]]}

    return arrow_rows(id_text(df, id_col, text_col), run, "doc_id long, ids array<int>")


def decode_pieces(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text; null ids decode to an empty text."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        codec = piece_codec(path)
        for b in batches:
            yield {"doc_id": b["doc_id"], "text": [codec.decode(x or []) for x in b["ids"]]}

    return arrow_rows(df.selectExpr(f"{id_col} AS doc_id", f"{ids_col} AS ids"), run, "doc_id long, text string")


def piece_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass over the texts: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        codec = piece_codec(path)
        for b in batches:
            out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in b["text"]:
                ids = codec.encode(text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield {"doc_id": b["doc_id"], **out}

    return arrow_rows(id_text(df, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op3_pieces": op3_pieces}
ORACLE: dict[str, str] = {}
