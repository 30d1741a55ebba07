"""Best-fit packing planned on a histogram of lengths.

Pieces are counted by length; best-fit decreasing runs over (length, count) on the driver, where at most `capacity`
lengths exist whatever the corpus; its plan maps ranks within a length to (sequence, offset) runs. Pieces then get their
exact rank within their length from per-bucket ranks plus bucket offsets, so no length is gathered in one task, and take
the slot planned for that rank.

Defined results: a null or empty text still holds the closing token; documents longer than the capacity are cut every
`capacity` tokens; repeated rows are packed each for itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import word_encoder
from .common import arrow_rows, id_text, materialize, table

CAPACITY = 4096


def cut_pieces(df: DataFrame, path: str, close: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids followed by `close`."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = word_encoder(path)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.append(encoder.encode(text), np.array([close], "<u4"))
                for k, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((doc, k, start, len(own), zlib.crc32(own.tobytes())))
            yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), map(list, zip(*rows, strict=True)), strict=True)) if rows else {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        encoder.forget()

    return arrow_rows(id_text(df, id_col, text_col), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts. Rows (length, first rank, first sequence, offset, how many), sorted by length and rank; and the number of sequences.

    Sequences with equal room are kept as runs of consecutive numbers, so each step moves a whole run or splits one.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rows, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            fitting = min((r for r in room if r >= length), default=None)
            if fitting is None:
                each = capacity // length
                full, rest = divmod(left, each)
                for slot in range(each):  # fresh sequences, filled with this length as best fit would fill them
                    many = full
                    if many:
                        rows.append((length, rank, sequences, slot * length, many))
                        rank += many
                if full:
                    if capacity - each * length:
                        room.setdefault(capacity - each * length, []).append((sequences, full))
                    sequences += full
                for slot in range(rest):
                    rows.append((length, rank, sequences, slot * length, 1))
                    rank += 1
                if rest:
                    if capacity - rest * length:
                        room.setdefault(capacity - rest * length, []).append((sequences, 1))
                    sequences += 1
                left = 0
                continue
            first, many = room[fitting].pop()
            if not room[fitting]:
                del room[fitting]
            take = min(many, left)
            if many > take:
                room.setdefault(fitting, []).append((first + take, many - take))
            rows.append((length, rank, first, capacity - fitting, take))
            if fitting > length:
                room.setdefault(fitting - length, []).append((first, take))
            rank, left = rank + take, left - take
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))], sequences


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset. The frame is read twice: hand in a materialised one."""
    spark = pieces.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "bucket").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    rows, _ = plan(histogram, capacity)
    base = counts.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("own", F.row_number().over(order)).join(base, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("own") - 1)
    shared = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        lengths, ranks, first, offsets = (np.ascontiguousarray(shared.value[:, k]) for k in range(4))
        starts = np.searchsorted(lengths, np.arange(capacity + 2))
        for b in batches:
            length, rank = np.array(b["length"], np.int64), np.array(b["rank"], np.int64)
            at = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own, lo, hi = length == x, starts[x], starts[x + 1]
                at[own] = lo + np.searchsorted(ranks[lo:hi], rank[own], "right") - 1
            yield {k: b[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": first[at] + rank - ranks[at], "offset": offsets[at]}

    return arrow_rows(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, close: int = 1, capacity: int = CAPACITY) -> DataFrame:
    return best_fit(materialize(cut_pieces(df, path, close, capacity), "pieces"), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op5_packing": op5_packing}
ORACLE: dict[str, str] = {}
