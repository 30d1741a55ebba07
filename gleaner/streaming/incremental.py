"""Incremental enrichment and event windows with Structured Streaming.

enrich_stream is the engine's micro-batch consumer: each batch of new or changed documents replaces its documents' words
in a table of batch folders, so replaying a batch changes nothing. The window functions are an extension on event tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions import text as X
from gleaner.operators import phrases as P
from gleaner.sources.store import latest


def enrich_stream(documents: DataFrame, out: str, checkpoint: str, stop=X.STOPWORDS) -> StreamingQuery:
    """Words of each arriving document, written once per batch; documents: a stream of doc_id, text, version."""

    def batch(df: DataFrame, epoch: int) -> None:
        newest = latest(df, ["doc_id"], "version")
        words = newest.select("doc_id", "version", F.explode_outer(X.tokenize(F.col("text"), stop)).alias("word")).groupBy("doc_id", "version", "word").agg(F.count("word").alias("n"))
        words.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # replaying an epoch overwrites its folder

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_words(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, word, n of the latest version of each document."""
    rows = spark.read.option("basePath", out).parquet(out)
    newest = rows.groupBy("doc_id").agg(F.max(F.struct("version", "epoch")).alias("last"))
    joined = rows.join(newest, "doc_id").filter((F.col("version") == F.col("last.version")) & (F.col("epoch") == F.col("last.epoch")))
    return joined.filter("word IS NOT NULL").select("doc_id", "word", "n")


def dirty_or_all(changed: DataFrame, topics: DataFrame, cache: DataFrame) -> DataFrame:
    """The topics to refresh: those changed, or all that the cache lacks when none is."""
    none = changed.limit(1).agg((F.count("*") == 0).alias("none"))
    missing = topics.select("topic_id").join(cache.select("topic_id"), "topic_id", "left_anti").crossJoin(F.broadcast(none)).filter("none").select("topic_id")
    return changed.select("topic_id").union(missing).distinct()


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def late_safe_counts(stream: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Windowed counts of a stream; events later than delay are dropped, each event_id counts once."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))


def batch_tokens(docs: DataFrame) -> DataFrame:
    """What the stream converges to."""
    return P.chunk_words(docs)
