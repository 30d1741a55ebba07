"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Each table turns vectors by three rounds of random signs and fast Hadamard transforms and assigns them to the nearest
signed axis. Vectors are first lifted by one coordinate that gives all the same norm, so that near vectors fall together
whatever their norms. A query probes the axes nearest to it; buckets meet their queries in blocks of bounded size, and a
block hands on only each query's nearest, by exact double-precision distance. Queries that met fewer than k candidates
are compared with all rows, in blocks of queries.

Of equal vectors only the k + 1 with the smallest ids can be among any query's k nearest (ties go to smaller ids, and one
of them may be the query), so later copies are left out before hashing: exact, and no bucket swells with copies.

Defined results: rows with a null id and vectors that are null, empty, zero, not finite, hold a null or aren't of
the most common length take no part; a repeated query id asks once, with its smallest vector; candidates
exclude all rows with the query's own id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, table

TABLES, PROBES, LEAST, BLOCK = 16, 8, 4096, 16_384


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix, in n log n steps."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class CrossPolytope:
    def __init__(self, dim: int, radius2: float, tables: int, seed: int = 17):
        self.size = 1 << max(1, (dim).bit_length())  # room for the lifted coordinate
        self.radius2, self.tables = radius2, tables
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.size))

    def lift(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.size))
        out[:, : x.shape[1]] = x
        out[:, x.shape[1]] = np.sqrt(np.maximum(self.radius2 - (x**2).sum(1), 0))
        return out

    def axes(self, lifted: np.ndarray, t: int, probes: int = 1) -> np.ndarray:
        """The signed axes nearest to each row: axis j is j, its opposite size + j."""
        for signs in self.signs[t]:
            lifted = hadamard(lifted * signs)
        both = np.concatenate([lifted, -lifted], 1)
        if probes == 1:
            return both.argmax(1)[:, None]
        return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def nearest(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k nearest of rows: (position, ids, distances). Products choose, exact differences decide."""
    norms = (rows**2).sum(1)
    for lo in range(0, len(queries), 512):
        q = queries[lo : lo + 512]
        rough = (q**2).sum(1)[:, None] + norms[None] - 2 * (q @ rows.T)
        for i in range(len(q)):
            d = np.where(ids == own[lo + i], np.inf, rough[i])
            many = np.count_nonzero(np.isfinite(d))
            if not many:
                continue
            slack = 1e-9 * (1 + norms.max() + (q[i] ** 2).sum())
            at = np.flatnonzero(d <= np.partition(d, min(k, many) - 1)[min(k, many) - 1] + slack)
            exact = np.sqrt(((rows[at] - q[i]) ** 2).sum(1))
            best = np.lexsort((ids[at], exact))[:k]
            yield lo + i, ids[at][best], exact[best]


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> tuple[DataFrame, int, float, int]:
    """(vec_id, v: doubles as bytes) of the vectors of length dim, or of the most common length (the larger of two equally common ones); that length, the largest squared norm and the number of rows."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    if dim is None:
        lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
        dim = lengths["n"] if lengths else 0
    rows = rows.filter(F.size("v") == F.lit(dim))
    most, many = rows.agg(F.max(square), F.count("*")).head()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"vec_id": b["vec_id"], "v": [np.array(x, "<f8").tobytes() for x in b["v"]]}

    return arrow_rows(rows, run, "vec_id long, v binary"), dim or 0, most or 0.0, many


def knn(df: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES, least: int = LEAST, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of queries (rows of the same table).

    probes rises where tables are so small that the probed buckets would hold fewer than `least` rows."""
    spark = df.sparkSession
    rows, dim, radius2, many = usable(df, id_col, vec_col)
    schema = "query_id long, vec_id long, score double"
    if not many:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashing = CrossPolytope(dim, radius2, tables)
    axes = 2 * hashing.size
    probes = min(axes, max(probes, math.ceil(least * axes / (tables * many))))
    kept = rows.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("copy") <= k + 1).drop("copy")
    kept = materialize(kept, "vectors")
    asked = usable(queries, id_col, vec_col, dim)[0].groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialize(asked.withColumnRenamed("vec_id", "query_id"), "queries")

    def hashed(name: str, each: int):
        def run(batches: Iterator[dict]) -> Iterator[dict]:
            for b in batches:
                for lo in range(0, len(b[name]), 2048):
                    ids, v = b[name][lo : lo + 2048], b["v"][lo : lo + 2048]
                    lifted = hashing.lift(np.frombuffer(b"".join(v)).reshape(-1, dim))
                    for t in range(tables):
                        at = hashing.axes(lifted, t, each)
                        yield {name: np.repeat(np.array(ids), each), "v": [x for x in v for _ in range(each)], "bucket": at.ravel() + t * axes}

        return run

    index = arrow_rows(kept, hashed("vec_id", 1), "vec_id long, v binary, bucket int")
    probed = arrow_rows(asked, hashed("query_id", probes), "query_id long, v binary, bucket int")
    blocks = index.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).join(probed.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("turns")), "bucket")
    blocks = spark.createDataFrame(blocks.collect(), "bucket int, parts int, turns int")  # a row per bucket: tables times axes at most
    split = lambda df, own, other, salt: df.join(F.broadcast(blocks), "bucket").withColumn(own[0], F.pmod(F.xxhash64(salt), F.col(own[1])).cast("int")).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1)))
    left = split(index, ("part", "parts"), ("turn", "turns"), "vec_id").select("bucket", "part", "turn", "vec_id", "v")
    right = split(probed, ("turn", "turns"), ("part", "parts"), "query_id").select("bucket", "part", "turn", "query_id", "v")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(a) and len(b):
            vectors = lambda x: np.frombuffer(b"".join(x["v"])).reshape(-1, dim)
            own = b["query_id"].to_numpy()
            for i, ids, d in nearest(vectors(b), own, vectors(a), a["vec_id"].to_numpy(), k):
                out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids, "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    key = ["bucket", "part", "turn"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, schema)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    top = lambda x: x.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    found = materialize(top(met).select("query_id", "rank", "vec_id", "score"), "found")
    full = found.groupBy("query_id").count().filter(F.col("count") == k)
    short = materialize(asked.join(full, "query_id", "left_anti").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(1 << 30))), "short")
    out = found.join(full, "query_id", "left_semi")
    for rest in _turns(short, 4096):
        ids, vectors = np.array([r["query_id"] for r in rest]), np.frombuffer(b"".join(bytes(r["v"]) for r in rest)).reshape(-1, dim)
        shared = spark.sparkContext.broadcast((ids, vectors))

        def scan(batches: Iterator[dict], shared=shared) -> Iterator[dict]:
            ids, vectors = shared.value
            for b in batches:
                if b["vec_id"]:
                    for i, near, d in nearest(vectors, ids, np.frombuffer(b"".join(b["v"])).reshape(-1, dim), np.array(b["vec_id"]), k):
                        yield {"query_id": [int(ids[i])] * len(near), "vec_id": near, "score": d}

        out = out.unionByName(top(arrow_rows(kept, scan, schema)).select("query_id", "rank", "vec_id", "score"))
    return out


def _turns(short: DataFrame, size: int):
    """Blocks of at most `size` rows, by the order of a hash; each block is one bounded collect."""
    last = (-1, None)
    while True:
        after = F.col("turn") > last[0] if last[1] is None else (F.col("turn") > last[0]) | ((F.col("turn") == last[0]) & (F.col("query_id") > last[1]))
        rows = short.filter(after).orderBy("turn", "query_id").limit(size).collect()
        if rows:
            yield rows
        if len(rows) < size:
            return
        last = (rows[-1]["turn"], rows[-1]["query_id"])


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return knn(rows, rows.filter("vec_id % 100 = 0"))


QUERIES = {"op2_neighbours": op2_neighbours}
ORACLE: dict[str, str] = {}
