"""Registered queries of document kernels, sources and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import keywords as K
from gleaner.sources import html as H
from gleaner.sources import store as T
from gleaner.streaming import incremental as I

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _q(name: str, sql: str | None, *tables: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables or ("documents",)))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@_q("keyphrases_naive", None)
def _(d):
    return K.document_keyphrases(d)


@_q("keyphrases_tuned", None)
def _(d):
    return K.document_keyphrases(d, "tuned")


@_q("capitalised_names", None)
def _(d):
    return K.document_names(d)


@_q("parse_pages", None, "pages")
def _(p):
    return H.parse_pages(p)


_FORM = "' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' '"


@_q("known_entities", f"WITH g(name, form, place) AS (VALUES ('Anchor', 'the of', 1), ('Anchor', 'of the', 2), ('License', 'mit license', 1), ('License', 'apache license', 2)) SELECT doc_id, name, arg_min(form, place) AS form FROM documents JOIN g ON contains({_FORM}, ' ' || form || ' ') GROUP BY doc_id, name")
def _(d):
    rows = [("Anchor", "the of", 1), ("Anchor", "of the", 2), ("License", "mit license", 1), ("License", "apache license", 2)]
    return K.known_entities(d, d.sparkSession.createDataFrame(rows, "name string, form string, place int"))


@_q("candidate_decisions", "WITH c AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 7 AS VARCHAR) AS slug, CASE WHEN l_returnflag = 'A' THEN 'entity' ELSE 'concept' END AS kind, CAST(l_partkey * 10 + l_linenumber AS BIGINT) AS rank_score FROM lineitem), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY rank_score DESC, kind, slug) > 1 AS twice FROM c), e AS (SELECT *, sum(CASE WHEN NOT twice AND kind != 'entity' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rank_score DESC, slug ROWS UNBOUNDED PRECEDING) AS so_far FROM d) SELECT doc_id, slug, kind, rank_score, CASE WHEN twice THEN 'duplicate_slug' WHEN kind != 'entity' AND so_far > 2 THEN 'max_topics_reached' ELSE 'accepted' END AS decision FROM e", "lineitem")
def _(li):
    rows = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 7).cast("string").alias("slug"), F.when(F.col("l_returnflag") == "A", "entity").otherwise("concept").alias("kind"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("rank_score"))
    return K.decide(rows, 2)


@_q("artifact_pieces", "SELECT doc_id, CAST(place AS INTEGER) AS place, substring(text, CAST(place * 2000 + 1 AS BIGINT), 2000) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 2000) AS BIGINT)))) AS place FROM documents)")
def _(d):
    return T.split_artifact(d, "doc_id", "text", 2000)


@_q("artifact_round_trip", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(d):
    return T.join_artifact(T.split_artifact(d, "doc_id", "text", 2000), "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@_q("new_episodes", "SELECT DISTINCT lang AS source_id, source AS published FROM documents WHERE (lang, source) NOT IN (SELECT lang, source FROM documents WHERE doc_id < 50)")
def _(d):
    rows = d.select(F.col("lang").alias("source_id"), F.col("source").alias("published"), "doc_id")
    return T.new_episodes(rows, rows.filter("doc_id < 50")).select("source_id", "published")


@_q("source_health", "WITH e AS (SELECT user_id AS source_id, ts AS seen, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'succeeded' ELSE 'other' END AS status FROM events), g AS (SELECT source_id, max(seen) AS last_success FROM e WHERE status = 'succeeded' GROUP BY source_id) SELECT source_id, max(seen) FILTER (WHERE status = 'started') AS last_start, max(last_success) AS last_success, count(*) FILTER (WHERE status = 'failed' AND (last_success IS NULL OR seen > last_success)) AS failures FROM e LEFT JOIN g USING (source_id) GROUP BY source_id", "events")
def _(e):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "started").when(F.col("event_type") == "purchase", "succeeded").otherwise("other")
    return T.health(e.select(F.col("user_id").alias("source_id"), F.col("ts").alias("at"), status.alias("status")))


@_q("upsert_latest", "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id", "events")
def _(e):
    rows = e.select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return T.latest(rows, ["user_id"], "at").select("user_id", "event_type")


@_q("conversation_neighbours", "SELECT conv_id, turn, lag(role) OVER w AS previous, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)", "conversations")
def _(c):
    from gleaner.operators.analytics import adjacent

    return adjacent(c.select("conv_id", "turn", "role"), ["conv_id"], [F.asc("turn")], "role").select("conv_id", "turn", "previous", "next")


@_q("tumbling_events", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", "events")
def _(e):
    return I.tumbling(e)


@_q("sliding_events", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(k AS INTEGER)) AS start, event_type, count(*) AS n FROM events, range(0, 2) r(k) GROUP BY ALL", "events")
def _(e):
    return I.sliding(e)


@_q("session_events", "WITH m AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k", "events")
def _(e):
    return I.sessions(e)


@_q("redirect_links", "SELECT page_id, url AS target FROM pages", "pages")
def _(p):
    return p.select("page_id", X.unwrap_redirect(F.concat(F.lit("https://www.google.com/url?q="), F.url_encode("url"))).alias("target"))
