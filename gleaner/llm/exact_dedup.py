"""Exact dedup: sorted digest runs, merged over rounds in which partitions exchange runs.

A text's key is the SHA-256 of its normalised form (each run of ASCII white space is one space), and beside it the form's
length and a second hash. Keys are written once with a number for each row. Each input split then gives one run: its keys in
order, one entry a key with the smallest identifier and the number of rows. `width` partitions, a power of two, exchange
entries in rounds: in round r, partitions whose numbers differ only in the r-th group of bits form a group, and each
takes from the others the entries whose digests have its own value in those bits. It merges the runs that meet
in it and keeps one entry a key. After the last round all of a key's entries have met. With FAN = 2 the rounds are those of
a binomial exchange; a larger FAN merges more runs a round, with fewer rounds. A group of copies of any size is one entry a
run from the first round on, so no task sees a group's rows.

Verified: an entry is taken into another only where length and second hash are equal too, else both stay apart; and a
merge fails if a partition isn't given its entries in order, as the smallest identifier would be in doubt.

Defined results: a null text counts as empty; of equal texts the row with the smallest id stays, a null id only if
all of the group are null, then keep_id is null; of rows that repeat the smallest id, the first read stays; other columns are
ignored; an empty table gives no rows. Texts of any length are hashed whole, where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, materialize, table

#: Runs that meet in a round; a power of two.
FAN = 16
BLANK = r"[\x20\x09-\x0D]+"
RUN = "part int, digest binary, n_bytes long, second long, no_id int, low_id long, low_row long, size long"
KEY = ("digest", "n_bytes", "second")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row, digest, n_bytes, second: a key for each document; rows are numbered once, so that ties fall alike wherever the table is read."""
    normal = F.regexp_replace("text", BLANK, " ")
    text = docs.select("doc_id", normal.alias("text"))
    key = [F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("second")]
    return materialize(text.select("doc_id", F.monotonically_increasing_id().alias("row"), *key), "digests")


def merged(rows: DataFrame) -> DataFrame:
    """One entry a key of each part: its smallest identifier and the sum of sizes; rows come sorted by part and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the entry of the last key so far, which may go on
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = one_each(t if held is None else pa.concat_tables([held, t]))
            if t.num_rows:
                yield from t.slice(0, t.num_rows - 1).to_batches()
                held = t.slice(t.num_rows - 1).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return rows.mapInArrow(run, RUN)


def one_each(t: pa.Table) -> pa.Table:
    """Neighbouring entries of one part and key become one."""
    t = t.combine_chunks()
    if not t.num_rows:
        return t
    digest = np.frombuffer(b"".join(t.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
    part, n_bytes, second, no_id, low_id, low_row, size = (t.column(c).to_numpy() for c in ("part", "n_bytes", "second", "no_id", "low_id", "low_row", "size"))
    head = digest[:, :8].copy().view(">u8")[:, 0]
    if not ((part[1:] > part[:-1]) | (part[1:] == part[:-1]) & (head[1:] >= head[:-1])).all():
        raise ValueError("a run isn't in order")
    same = (part[1:] == part[:-1]) & (digest[1:] == digest[:-1]).all(1) & (n_bytes[1:] == n_bytes[:-1]) & (second[1:] == second[:-1])
    starts = np.flatnonzero(np.r_[True, ~same])
    group = np.cumsum(np.r_[True, ~same])
    least = np.lexsort((low_row, low_id, no_id, group))[starts]
    kept = t.take(starts)
    for name, values in (("no_id", no_id[least]), ("low_id", low_id[least]), ("low_row", low_row[least]), ("size", np.add.reduceat(size, starts))):
        at = kept.column_names.index(name)
        kept = kept.set_column(at, kept.schema.field(at), pa.array(values, kept.schema.field(at).type))
    return kept


def merged_runs(keys: DataFrame, fan: int = FAN) -> DataFrame:
    """digest, n_bytes, second, no_id, low_id, low_row, size: a row a key, after all rounds; no_id is 1 where all ids of the key are null."""
    spark = keys.sparkSession
    bits = max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    width, step = 1 << bits, max(1, fan.bit_length() - 1)
    identifier = [F.col("doc_id").isNull().cast("int").alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("low_id"), F.col("row").alias("low_row")]
    entry = keys.select(F.pmod(F.spark_partition_id(), F.lit(width)).alias("part"), *KEY, *identifier, F.lit(1).cast("long").alias("size"))
    runs = merged(entry.sortWithinPartitions("part", *KEY))
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")  # evenly spread
    for low in range(0, bits, step):
        mask = ((1 << min(step, bits - low)) - 1) << low
        target = F.col("part").bitwiseAND(F.lit(width - 1 - mask)).bitwiseOR(head.bitwiseAND(F.lit(mask)).cast("int"))
        runs = merged(runs.withColumn("part", target).repartitionById(width, F.col("part")).sortWithinPartitions("part", *KEY))
    return runs.drop("part")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, row: a row per document; row numbers the rows as read, and the kept one of repeats."""
    keys = keyed(id_text(df, id_col, text_col))
    groups = materialize(merged_runs(keys, fan), "groups")
    out = keys.join(groups, list(KEY))  # a key with many rows stands once in groups, so Spark may split its rows
    return out.select("doc_id", F.when(F.col("no_id") == 0, F.col("low_id")).alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("low_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("row")


QUERIES = {"op13_exact_dedup": op13_exact_dedup}
ORACLE = {
    "op13_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST)"""
}
