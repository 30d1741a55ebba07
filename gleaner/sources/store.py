"""Sinks and sources of the corpus: idempotent ingest, upserts, purges, artifacts in pieces, run records. Frames in, frames out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.sources.shared import written


def new_episodes(parsed: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose (source_id, published) isn't there yet; ingesting twice adds nothing."""
    return parsed.dropDuplicates(["source_id", "published"]).join(existing.select("source_id", "published").distinct(), ["source_id", "published"], "left_anti")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key: upsert by rewriting."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows, and old rows whose key isn't among them."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def backfill(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """Stored chunks with text replaced where the same (published, position) was parsed anew; changed ones wait for enrichment."""
    fresh = parsed.select("published", "position", F.col("text").alias("fresh"))
    rows = stored.join(fresh, ["published", "position"], "left")
    changed = F.col("fresh").isNotNull() & (F.col("fresh") != F.col("text"))
    return rows.withColumn("enriched", F.when(changed, False).otherwise(F.col("enriched"))).withColumn("text", F.coalesce("fresh", "text")).drop("fresh")


def purge(frames: dict[str, DataFrame], source_id: int) -> dict[str, DataFrame]:
    """The frames sources, episodes, chunks and links without one source and all that hangs on it."""
    gone = frames["episodes"].filter(F.col("source_id") == source_id).select("episode_id")
    chunks = frames["chunks"].join(gone, "episode_id", "left_anti")
    return {
        "sources": frames["sources"].filter(F.col("source_id") != source_id),
        "episodes": frames["episodes"].filter(F.col("source_id") != source_id),
        "chunks": chunks,
        "links": frames["links"].join(chunks.select("chunk_id"), "chunk_id", "left_semi"),
    }


def split_artifact(rows: DataFrame, key: str, text: str, size: int = 50_000) -> DataFrame:
    """key, place, piece: long texts in pieces of `size` characters; an empty text is one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col(text), k * size + 1, F.lit(size)))
    return rows.select(key, F.posexplode(pieces).alias("place", "piece"))


def join_artifact(pieces: DataFrame, key: str) -> DataFrame:
    """The texts again, pieces in order."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "piece")))
    return pieces.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["piece"]), "").alias("text"))


def pending(chunks: DataFrame, version: int) -> Column:
    """Whether a chunk needs enrichment."""
    return ~F.col("enriched") | (F.coalesce("version", F.lit(0)) < version)


def refreshable(sources: DataFrame, trusted: list[str]) -> DataFrame:
    return sources.filter(F.col("active") & F.col("doc").isin(trusted) & ~F.col("title").contains("(Empty)"))


def least_recent(sources: DataFrame) -> DataFrame:
    """Never fetched sources come first."""
    return sources.orderBy(F.asc_nulls_first("last_fetched"), "source_id").limit(1)


def health(events: DataFrame) -> DataFrame:
    """Per source: last start, last success, failures since the last success. events: source_id, at, status."""
    good = events.filter("status = 'succeeded'").groupBy("source_id").agg(F.max("at").alias("last_success"))
    rows = events.join(good, "source_id", "left")
    late = (F.col("status") == "failed") & (F.col("last_success").isNull() | (F.col("at") > F.col("last_success")))
    return rows.groupBy("source_id").agg(F.max(F.when(F.col("status") == "started", F.col("at"))).alias("last_start"), F.max("last_success").alias("last_success"), F.count_if(late).alias("failures"))


def run_record(spark: SparkSession, run_id: str, stages: list[dict], error: str | None = None) -> DataFrame:
    """A run's stages as rows, with its totals; errors keep their first 500 characters."""
    rows = [(run_id, k, s["name"], int(s["ms"]), {a: int(b) for a, b in s.get("counts", {}).items()}, (error or "")[:500] or None) for k, s in enumerate(stages)]
    return spark.createDataFrame(rows, "run_id string, place int, stage string, ms long, counts map<string,long>, error string")


def stage_totals(runs: DataFrame) -> DataFrame:
    """Stages by name: time and counts added up."""
    counts = runs.select("stage", F.explode_outer("counts").alias("k", "v")).groupBy("stage", "k").agg(F.sum("v").alias("v")).filter("k IS NOT NULL").groupBy("stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("counts"))
    return runs.groupBy("stage").agg(F.sum("ms").alias("ms"), F.count("error").alias("errors")).join(counts, "stage", "left")


def parse_links(text: Column) -> Column:
    """A JSON list of strings or of {href, text} as structs; anything else is empty."""
    plain = F.transform(F.from_json(text, "array<string>"), lambda s: F.struct(s.alias("href"), F.lit(None).cast("string").alias("text")))
    rich = F.from_json(text, "array<struct<href:string,text:string>>")
    usable = F.size(F.filter(rich, lambda x: x["href"].isNotNull())) > 0
    empty = F.array().cast("array<struct<href:string,text:string>>")
    return F.when(usable, rich).otherwise(F.coalesce(F.filter(plain, lambda x: ~x["href"].startswith("{")), empty))


def model_candidates(response: str, chunk_ids: set[int], kinds: tuple[str, ...] = ("entity", "phrase", "concept")) -> list[dict]:
    """Candidates of a model's JSON answer: fences gone, kinds from the list, evidence only from known chunks, confidence within 0..1."""
    body = response.strip().removeprefix("```json").removeprefix("```").removesuffix("```")
    try:
        found = json.loads(body)
    except ValueError:
        return []
    out = []
    for c in found.get("candidates", []) if isinstance(found, dict) else []:
        evidence = [e for e in c.get("evidence", []) if e.get("chunk_id") in chunk_ids]
        if c.get("kind") in kinds and c.get("name") and evidence:
            out.append({"name": c["name"], "kind": c["kind"], "confidence": min(1.0, max(0.0, float(c.get("confidence", 0)))), "evidence": evidence})
    return out


def all_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("source_id")


def source_of(sources: DataFrame, doc: str) -> DataFrame:
    """The source of one document id: a point lookup that reaches the scan."""
    return sources.filter(F.col("doc") == doc)


def source_tag(doc: Column) -> Column:
    """The first six characters of a document id, as slugs use them."""
    return F.substring(doc, 1, 6)


def enrichment_done(chunks: DataFrame, version: int) -> bool:
    """Whether no chunk waits; reading stops at the first one that does."""
    return chunks.filter(pending(chunks, version)).limit(1).isEmpty()


#: Parts of messages of failures that pass.
PASSING = (
    "Network connection lost",
    "storage caused object to be reset",
    "reset because its code was updated",
    "SQLITE_BUSY",
    "SQLITE_BUSY_RECOVERY",
    "SQLITE_LOCKED",
    "Too Many Requests",
    "429",
    "503",
    "504",
)


def retryable(message: Column) -> Column:
    """Whether a failure is passing, so that its batch is tried again."""
    found = F.lit(False)
    for part in PASSING:
        found = found | message.contains(part)
    return F.coalesce(found, F.lit(False))


def retried(failures: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """failures (batch, attempt, message) that are tried again, with the next attempt, and those that are set aside for good."""
    again = retryable(F.col("message")) & (F.col("attempt") < most)
    return failures.filter(again).withColumn("attempt", F.col("attempt") + 1), failures.filter(~again)


def id_batches(ids: DataFrame, id_col: str, size: int = 90) -> DataFrame:
    """batch (from 0) and its ids, `size` of them in the order of the ids; the same whatever the number of partitions.

    Ranges of ids are numbered each by itself; the sizes of the ranges, a row for each, say where each begins."""
    ranges = written(ids.select(id_col).distinct().repartitionByRange(F.col(id_col)).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("size"))
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    placed = ranges.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(id_col)) - 1).join(F.broadcast(starts), "part")
    numbered = placed.withColumn("batch", F.floor((F.col("start") + F.col("at")) / size))
    return numbered.groupBy("batch").agg(F.array_sort(F.collect_list(id_col)).alias("ids"))


def latest_runs(runs: DataFrame, started: DataFrame, most: int = 20) -> DataFrame:
    """The latest runs with their stages in order. runs: as run_record gives them; started: run_id, at."""
    top = started.orderBy(F.desc("at"), "run_id").limit(most)
    stages = runs.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("place", "stage", "ms"))).alias("stages"), F.sum("ms").alias("ms"), F.max("error").alias("error"))
    return top.join(stages, "run_id", "left")


def health_view(chunks: DataFrame, topics: DataFrame, links: DataFrame, version: int, invariants: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """One row: chunks, chunks that wait, topics, links, links without a chunk, and whether all is well; with the seven counts of
    corpus_invariants and the last run (run_id, at, error) if given."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = chunks.agg(F.count("*").alias("chunks"), F.count_if(pending(chunks, version)).alias("waiting"))
    out = out.crossJoin(count(topics, "topics")).crossJoin(count(links, "links"))  # one row each
    out = out.crossJoin(count(links.join(chunks, "chunk_id", "left_anti"), "orphans"))
    well = (F.col("waiting") == 0) & (F.col("orphans") == 0)
    if invariants is not None:
        out = out.crossJoin(invariants.withColumnRenamed("healthy", "consistent"))
        well = well & F.col("consistent")
    if runs is not None:
        last = runs.agg(F.max_by(F.struct("run_id", "at", "error"), F.struct("at", "run_id")).alias("last_run"))
        out = out.crossJoin(last)
        well = well & F.col("last_run.error").isNull()
    return out.withColumn("healthy", well)


def archived_lineage(topics: DataFrame, links: DataFrame, audit: DataFrame, merges: DataFrame, archive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics without use and links that a candidate or a merge tells of go to the archive: a row for each slug, keeper and stage (nulls are equal there).

    topics: topic_id, slug, name, usage; audit: topic_id; merges: from_id, to_id, stage, place; archive: slug, name, merged_into, merge_stage,
    topic_id (the first one archived), last_topic_id, archive_count. A topic's keeper and stage are those of its last merge. Returns (left, archive)."""
    last = merges.groupBy(F.col("from_id").alias("topic_id")).agg(F.max_by(F.struct(F.col("to_id").alias("merged_into"), F.col("stage").alias("merge_stage")), "place").alias("m")).select("topic_id", "m.*")
    told = audit.select("topic_id").union(merges.select("from_id")).union(merges.select("to_id")).filter("topic_id IS NOT NULL").distinct()
    gone = topics.filter("usage = 0").join(links, "topic_id", "left_anti").join(told, "topic_id", "left_semi")
    keys = ["slug", "merged_into", "merge_stage"]
    fresh = gone.join(last, "topic_id", "left").select(*keys, "name", "topic_id", F.col("topic_id").alias("last_topic_id"), F.lit(1).cast("long").alias("archive_count"), F.lit(1).alias("turn"))
    both = archive.select(*keys, "name", "topic_id", "last_topic_id", F.col("archive_count").cast("long").alias("archive_count"), F.lit(0).alias("turn")).unionByName(fresh)
    latest_first = F.struct("turn", "last_topic_id")
    merged = both.groupBy(*keys).agg(  # grouping takes nulls as equal
        F.max_by("name", latest_first).alias("name"), F.min_by("topic_id", F.struct("turn", "topic_id")).alias("topic_id"), F.max_by("last_topic_id", latest_first).alias("last_topic_id"), F.sum("archive_count").alias("archive_count")
    )
    return topics.join(gone.select("topic_id"), "topic_id", "left_anti"), merged


def stale_removed(links: DataFrame, chunks: DataFrame, topics: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """Links of outdated chunks go, then topics without links that aren't entities. Returns (links, topics)."""
    kept = links.join(chunks.filter(~pending(chunks, version)).select("chunk_id"), "chunk_id", "left_semi")
    used = kept.select("topic_id").distinct()
    orphans = topics.filter("kind != 'entity'").join(used, "topic_id", "left_anti").select("topic_id")
    return kept, topics.join(orphans, "topic_id", "left_anti")
