"""Suffix-array removal of repeated byte strings.

A byte goes if a window of `length` bytes over it also starts earlier, in a document with a smaller id or earlier in the
same one. Every window is covered by an anchored suffix (see anchors), and equal windows have equal anchors, so the sparse
array of anchored suffixes is enough. Sampled splitters range-partition the suffixes by their leading token, the hash of
their first 32 bytes, ties by what follows and by place, so that one frequent suffix spreads over many buckets. Buckets
sort locally by multikey quicksort. Suffixes whose runs of windows are equal settle at once: all but the first are
repeats. Groups that reach a bucket's edge are compared across the boundary. Where a leading token is followed by different
texts, the windows themselves are compared, within the token's group or, where the group is large, as keys of their own.

Defined results: a null or empty text has no bytes; documents shorter than the window lose nothing; rows with the same id
and text are one document and get the same result; rows with the same id and different texts are ordered by text; null
ids come first; other columns are ignored by the digest and kept by strip_repeats; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import runs
from .common import arrow_rows, id_text, materialize, table

LENGTH = 100
BUCKET_ROWS, CHUNK, LARGE = 1_000_000, 1 << 20, 4096
COPY, MIXED, EDGE = 0, 1, 2


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, ...) with key, in the order of (doc_id, text); and key, text of each different document. Ids that are unique serve as they are."""
    slim = docs.select("doc_id")
    n, distinct, nulls = slim.agg(F.count("*"), F.count_distinct("doc_id"), F.count_if(F.col("doc_id").isNull())).head()
    if n == distinct and not nulls:
        docs = docs.withColumn("key", F.col("doc_id"))
        return docs, docs.select("key", "text")
    pairs = docs.select("doc_id", F.sha2("text", 256).alias("sha")).distinct().orderBy(F.asc_nulls_first("doc_id"), "sha")
    schema = T.StructType([*pairs.schema.fields, T.StructField("key", T.LongType())])
    numbered = materialize(docs.sparkSession.createDataFrame(pairs.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema), "keys")
    numbered = numbered.withColumnRenamed("doc_id", "other_id")
    shaded = docs.withColumn("sha", F.sha2("text", 256))
    docs = shaded.join(numbered, shaded["doc_id"].eqNullSafe(numbered["other_id"]) & (shaded["sha"] == numbered["sha"])).select(*(shaded[c] for c in docs.columns), "key")
    return docs, docs.select("key", "text").dropDuplicates(["key"])


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """gram, context, key, place: a row per run of windows; place packs first window, anchor offset and width of the run."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        def rows(held: list[tuple[int, int, bytes]]) -> dict:
            raw = b"".join(x[2] for x in held)
            sizes = np.array([len(x[2]) for x in held])
            starts = np.cumsum(sizes) - sizes
            at, first, last, gram = runs(np.frombuffer(raw, np.uint8), starts, length)
            owner = np.searchsorted(starts, first, "right") - 1
            digest = xxhash.xxh3_64_intdigest
            shape = ((at - first) << 7) | (last - first)
            context = np.array([digest(raw[a : b + length], seed) for a, b, seed in zip(first.tolist(), last.tolist(), shape.tolist(), strict=True)], np.uint64)
            place = first - starts[owner] + np.array([x[1] for x in held])[owner]
            return {"gram": gram.view(np.int64), "context": context.view(np.int64), "key": np.array([x[0] for x in held], np.int64)[owner], "place": (place << 14) | shape}

        for b in batches:
            held: list = []
            size = 0
            for key, text in zip(b["key"], b["text"], strict=True):
                raw = text.encode()
                for lo in range(0, max(0, len(raw) - length + 1), CHUNK):  # windows that start in one chunk
                    part = raw[lo : lo + CHUNK + length - 1]
                    if size + len(part) >= CHUNK + length:
                        if held:
                            yield rows(held)
                        held, size = [], 0
                    held.append((key, lo, part))
                    size += len(part)
            if held:
                yield rows(held)

    return arrow_rows(docs.select("key", "text"), run, "gram long, context long, key long, place long")


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort: sort by the first column; only rows that are still equal go on to the next one."""
    order = np.argsort(columns[0], kind="stable")
    group = np.zeros(len(order), np.int64)
    if len(order):
        group[1:] = np.cumsum(columns[0][order][1:] != columns[0][order][:-1])
    for column in columns[1:]:
        sizes = np.bincount(group, minlength=1)
        open_rows = np.flatnonzero(sizes[group] > 1)
        if not len(open_rows):
            break
        own = order[open_rows]
        inner = np.lexsort((column[own], group[open_rows]))
        order[open_rows] = own[inner]
        value = column[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        group = np.cumsum(fresh) - 1
    return order


def settled(suffixes: DataFrame, buckets: int) -> DataFrame:
    """kind and the suffix's columns: copies of an earlier run, runs to compare window by window, and of groups at a bucket's edge the first row of each run."""
    spread = suffixes.repartitionByRange(buckets, "gram", "context", "key", "place")
    names = ("gram", "context", "key", "place")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        parts: list = [[] for _ in names]
        for b in batches:
            for x, n in zip(parts, names, strict=True):
                x.append(np.array(b[n], np.int64))
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts]
        if not len(columns[0]):
            return
        order = multikey_order(columns)
        gram, context, key, place = (c[order] for c in columns)
        fresh_gram = np.r_[True, gram[1:] != gram[:-1]]
        fresh = fresh_gram | np.r_[True, context[1:] != context[:-1]]
        group = np.cumsum(fresh_gram) - 1
        kinds = np.full(len(gram), -1)
        kinds[~fresh] = COPY
        kinds[fresh & (np.bincount(group, fresh)[group] > 1)] = MIXED
        kinds[fresh & ((group == 0) | (group == group[-1]))] = EDGE  # later rows of a run have its first one before them in this bucket
        at = np.flatnonzero(kinds >= 0)
        for lo in range(0, len(at), 200_000):
            own = at[lo : lo + 200_000]
            yield {"kind": kinds[own], "gram": gram[own], "context": context[own], "key": key[own], "place": place[own]}

    return materialize(arrow_rows(spread, run, "kind int, gram long, context long, key long, place long"), "suffixes")


def across_boundaries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The copies and the runs to compare among the groups at bucket edges."""
    edge = rows.filter(F.col("kind") == EDGE).drop("kind")
    firsts = edge.groupBy("gram", "context").agg(F.min(F.struct("key", "place")).alias("first"))
    copies = edge.join(firsts, ["gram", "context"]).filter(F.struct("key", "place") != F.col("first")).select("key", "place")
    many = firsts.groupBy("gram").count().filter("count > 1").select("gram")
    mixed = firsts.join(many, "gram", "left_semi").select("gram", F.col("first.key").alias("key"), F.col("first.place").alias("place"))
    return copies, mixed


def with_bytes(docs: DataFrame, mixed: DataFrame, length: int) -> DataFrame:
    """gram, key, place, raw: the bytes that the run's windows cover."""
    lists = mixed.groupBy("key").agg(F.collect_list(F.struct("gram", "place")).alias("runs"))  # as many as a document has
    joined = docs.select("key", "text").join(lists, "key")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for key, text, own in zip(b["key"], b["text"], b["runs"], strict=True):
                raw = text.encode()
                places = [r["place"] for r in own]
                cut = [raw[p >> 14 : (p >> 14) + (p & 127) + length] for p in places]
                for lo in range(0, len(own), 10_000):
                    part = slice(lo, lo + 10_000)
                    yield {"gram": [r["gram"] for r in own[part]], "key": [key] * len(places[part]), "place": places[part], "raw": cut[part]}

    return materialize(arrow_rows(joined.select("key", "text", "runs"), run, "gram long, key long, place long, raw binary"), "runs")


def compared(cut: DataFrame, length: int, large: int = LARGE) -> DataFrame:
    """key, first, last: runs of windows that also start earlier, among runs with the same leading token."""
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = materialize(cut.groupBy("gram").count().filter(F.col("count") > large).select("gram"), "large")
    small = cut.join(hot, "gram", "left_anti").repartition(parts, "gram").sortWithinPartitions("gram", "key", "place")

    def by_group(batches: Iterator[dict]) -> Iterator[dict]:
        seen: set[bytes] = set()
        last = None
        for b in batches:
            keys, firsts, lasts = [], [], []
            for gram, key, place, raw in zip(b["gram"], b["key"], b["place"], b["raw"], strict=True):
                if gram != last:
                    last, seen = gram, set()
                begin, width, open_at = place >> 14, place & 127, -1
                for w in range(width + 1):
                    window = raw[w : w + length]
                    if window in seen:
                        if open_at < 0:
                            open_at = w
                    else:
                        seen.add(window)
                        if open_at >= 0:
                            keys.append(key)
                            firsts.append(begin + open_at)
                            lasts.append(begin + w - 1)
                            open_at = -1
                if open_at >= 0:
                    keys.append(key)
                    firsts.append(begin + open_at)
                    lasts.append(begin + width)
            yield {"key": keys, "first": firsts, "last": lasts}

    def windows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for key, place, raw in zip(b["key"], b["place"], b["raw"], strict=True):
                each = range((place & 127) + 1)
                yield {"window": [xxhash.xxh3_128_digest(raw[w : w + length]) for w in each], "key": [key] * len(each), "at": [(place >> 14) + w for w in each]}

    settled_small = arrow_rows(small.select("gram", "key", "place", "raw"), by_group, "key long, first long, last long")
    each = arrow_rows(cut.join(hot, "gram", "left_semi").select("key", "place", "raw"), windows, "window binary, key long, at long")
    firsts = each.groupBy("window").agg(F.min(F.struct("key", "at")).alias("first"))
    settled_large = each.join(firsts, "window").filter(F.struct("key", "at") != F.col("first")).select("key", F.col("at").alias("first"), F.col("at").alias("last"))
    return materialize(settled_small.unionByName(settled_large), "repeats")


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, first, last: runs of windows of docs (key, text; keys unique) that also start earlier; together they are all such windows."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (30 * BUCKET_ROWS)))
    rows = settled(anchored(docs, length), buckets)
    edge_copies, edge_mixed = across_boundaries(rows)
    copies = rows.filter(F.col("kind") == COPY).select("key", "place").union(edge_copies)
    mixed = rows.filter(F.col("kind") == MIXED).select("gram", "key", "place").union(edge_mixed)
    more = compared(with_bytes(docs, mixed, length), length)
    begin = F.shiftright("place", 14)
    return copies.select("key", begin.alias("first"), (begin + F.col("place").bitwiseAND(127)).alias("last")).unionByName(more)


def merged(own: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Byte spans [start, end) covered by runs of windows (first, last), joined where they touch or overlap."""
    out: list = []
    for first, last in sorted(own):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def with_windows(docs: DataFrame, found: DataFrame) -> DataFrame:
    lists = found.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("found"))  # as many as a document has
    return docs.join(lists, "key", "left")


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs, distinct = keyed(id_text(df, id_col, text_col))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for text, found in zip(b["text"], b["found"], strict=True):
                raw = text.encode()
                spans = merged([(x["first"], x["last"]) for x in found or ()], length)
                digest, at = hashlib.sha256(), 0
                for a, z in spans:
                    digest.update(raw[at:a])
                    at = z
                digest.update(raw[at:])
                for k, v in zip(out, (len(raw), sum(z - a for a, z in spans), len(spans), digest.hexdigest()), strict=True):
                    out[k].append(v)
            yield {"doc_id": b["doc_id"], **out}

    joined = with_windows(docs, repeated_windows(distinct, length)).select("doc_id", "text", "found")
    return arrow_rows(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """raw without spans, each shrunk to whole characters, so that the rest stays valid UTF-8."""
    kept, at = [], 0
    for a, z in spans:
        while a < z and raw[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        kept.append(raw[at:a])
        at = z
    return b"".join([*kept, raw[at:]]).decode()


def strip_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with repeated strings cut out of its text, by whole characters; all columns stay, and a null text stays null."""
    named = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs, distinct = keyed(named)
    joined = with_windows(docs, repeated_windows(distinct, length)).select("row", "text", "found")

    @F.pandas_udf("string")
    def cut(text, found):
        import pandas as pd

        return pd.Series([t if f is None else whole_characters(t.encode(), merged([(x["first"], x["last"]) for x in f], length)) for t, f in zip(text, found, strict=True)])

    out = joined.select("row", F.when(F.col("found").isNull(), F.col(f"row.{text_col}")).otherwise(cut("text", "found")).alias("left_text"))
    return out.select(*(F.col("left_text").alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in df.columns))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLE: dict[str, str] = {}
