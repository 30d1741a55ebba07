"""Shared helpers: tables, the shared folder, materialised intermediates, Arrow loops."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python pattern of a word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a fresh local one if there are no other machines (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("gleaner.shared.dir", None)
        if not path:
            if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = "file://" + tempfile.mkdtemp(prefix="gleaner-")
            spark.conf.set("gleaner.shared.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, so a lost executor never recomputes what lies before it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    tidy(spark)  # the shuffle files behind the table are free now; Spark drops them once the driver collects its garbage
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage, which also gives back heap that it grew for a step now done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read, under fixed names; a null text is empty, other columns are ignored."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_hash(text_col: str) -> Column:
    """64-bit hash of a text; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def arrow_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, flush: int = 4096) -> DataFrame:
    """mapInArrow over lists of columns: fn gets {column: list} per batch and yields {column: list}."""
    spark_schema = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(spark_schema)
        columns = ({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches)
        for out in fn(columns):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def bit_map(places: DataFrame, bits: int) -> np.ndarray:
    """bits bits, packed: those in places (bit long) are set. Tasks pack slices of 4096 bytes, so bits / 8 bytes go to the driver at most."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = []
            for own in b["bits"]:
                flags = np.zeros(1 << 15, np.uint8)
                flags[np.array(own, np.int64) & 0x7FFF] = 1
                out.append(np.packbits(flags).tobytes())
            yield {"slice": b["slice"], "packed": out}

    slices = places.distinct().groupBy(F.shiftright("bit", 15).cast("int").alias("slice")).agg(F.collect_list("bit").alias("bits"))
    out = np.zeros(max(bits >> 3, 1 << 12), np.uint8)
    for r in arrow_rows(slices, run, "slice int, packed binary").collect():
        out[r["slice"] << 12 : (r["slice"] + 1) << 12] = np.frombuffer(r["packed"], np.uint8)
    return out


def bits_at(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
