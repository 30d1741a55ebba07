"""Registered queries of gates and merges, and their SQL. Words of the corpus are single topics, adjacent pairs phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import gates as G
from gleaner.functions import text as X
from gleaner.operators import evaluate as E
from gleaner.operators import merges as M
from gleaner.operators import phrases as P
from gleaner.plans.textual import _BI, _DBI, TOK
from gleaner.sources.shared import dealt, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
T = G.DEFAULT


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def mined(docs: DataFrame) -> DataFrame:
    """topic_id, name, kind, usage (documents), support (sources), distinctiveness: words and adjacent pairs of two documents or more."""
    # documents of a source are counted where they are, per source first: its number of sources is then the number of rows
    words = dealt(docs.select("doc_id", "source", "text"), "doc_id").select("source", X.tokenize(F.col("text")).alias("words"))
    grams = words.select("source", F.explode_outer(F.array_distinct(F.concat("words", X.word_ngrams(F.col("words"), 2)))).alias("name")).filter("name IS NOT NULL")
    per = grams.groupBy("name", "source").agg(F.count("*").alias("n"))
    used = per.groupBy("name").agg(F.sum("n").alias("usage"), F.count("source").alias("support")).filter("usage >= 2")
    return used.select(F.crc32("name").alias("topic_id"), "name", F.when(F.col("name").startswith("the"), "entity").otherwise("concept").alias("kind"), "usage", "support", (F.length("name") * 1.5).cast("double").alias("distinctiveness"))


MINED = TOK + f", mined AS MATERIALIZED (SELECT name, CASE WHEN name LIKE 'the%' THEN 'entity' ELSE 'concept' END AS kind, usage, support, CAST(length(name) * 1.5 AS DOUBLE) AS distinctiveness FROM (SELECT name, count(*) AS usage, count(DISTINCT source) AS support FROM (SELECT doc_id, source, unnest(list_distinct(list_concat(words, {_BI}))) AS name FROM tok) GROUP BY name HAVING count(*) >= 2)) "
_NOISE = f"(list_contains({_list(T.noise)}, name) OR CASE WHEN name LIKE '% %' THEN list_contains({_list(T.starters)}, split_part(name, ' ', 1)) OR len(list_filter(string_split(name, ' '), lambda w: NOT (list_contains({_list(T.filler)}, w) OR length(w) < 4))) = 0 ELSE length(name) < 4 OR (name LIKE '%ly' AND length(name) >= 6) OR (regexp_matches(name, '(ize|ify)$') AND length(name) <= 8) OR (name LIKE '%ment' AND length(name) <= 9) OR regexp_matches(name, '(oes|ays|akes|ives)$') END)"
_WEAK = f"(name NOT LIKE '% %' AND ({_NOISE} OR (distinctiveness < 15 AND usage < 6) OR (regexp_matches(name, '(ed|ing|ment|ness|tion|sion|ance|ence)$') AND distinctiveness < 20 AND usage < 20)))"
_PU = ", pu AS MATERIALIZED (SELECT word, CAST(sum(usage) AS BIGINT) AS phrase_usage FROM (SELECT usage, unnest(list_distinct(string_split(name, ' '))) AS word FROM mined WHERE name LIKE '% %') GROUP BY word)"


def _q(name: str, sql: str | None, *tables: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables or ("documents",)))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@_q("noise_filter", MINED + f"SELECT name, {_NOISE} AS noise FROM mined")
def _(d):
    return mined(d).select("name", G.is_noise(F.col("name")).alias("noise"))


@_q("weak_singletons", MINED + f"SELECT name FROM mined WHERE {_WEAK}")
def _(d):
    return mined(d).filter(G.is_weak_single(F.col("name"), F.col("usage"), F.col("distinctiveness"))).select("name")


@_q("curate_topics", MINED + _PU + f"SELECT name, NOT (list_contains({_list(T.noise)}, name) OR (name NOT LIKE '% %' AND length(name) < 4 AND usage < 20) OR {_WEAK} OR (name NOT LIKE '% %' AND phrase_usage IS NOT NULL AND phrase_usage >= usage * 0.25)) AS keep FROM mined LEFT JOIN pu ON word = name")
def _(d):
    return G.curate(written(mined(d), "mined")).select("name", "keep")


@_q("suppress_components", MINED + _PU + "SELECT name FROM mined ANTI JOIN pu ON word = name")
def _(d):
    return G.suppress_components(written(mined(d), "mined")).select("name")


@_q("display_decisions", MINED + "SELECT name, CASE WHEN kind = 'entity' THEN NULL WHEN support < 2 THEN 'low_episode_spread' WHEN name NOT LIKE '% %' AND usage < 10 AND distinctiveness < 25 THEN 'weak_singleton_filter' END AS reason FROM mined")
def _(d):
    return mined(d).select("name", G.display_reason(F.col("name"), F.col("kind"), F.col("support"), F.col("usage"), F.col("distinctiveness")).alias("reason"))


@_q("promotion_gates", MINED + "SELECT name, CASE WHEN kind = 'entity' THEN NULL WHEN support < 2 THEN 'insufficient_episode_support' WHEN usage < CASE WHEN name LIKE '% %' THEN 4 ELSE 5 END THEN 'insufficient_chunk_support' WHEN name NOT LIKE '% %' AND distinctiveness < 20 AND usage < 8 THEN 'low_distinctiveness_support' END AS reason FROM mined")
def _(d):
    return mined(d).select("name", G.promotion_reason(F.col("name"), F.col("kind"), F.col("usage"), F.col("support"), F.col("distinctiveness"), F.col("usage")).alias("reason"))


@_q("corpus_prior", MINED + f"SELECT name, CASE WHEN kind = 'entity' OR name LIKE '% %' THEN NULL WHEN {_WEAK} THEN 'weak_singleton_prior' WHEN distinctiveness < 20 AND usage < 5 THEN 'low_distinctiveness_prior' END AS reason FROM mined")
def _(d):
    return mined(d).select("name", G.prior_reason(F.col("name"), F.col("kind"), F.col("usage"), F.col("distinctiveness"), F.col("usage")).alias("reason"))


@_q("candidate_rejection", MINED + f"SELECT name, CASE WHEN length(replace(name, ' ', '-')) < 3 THEN 'short_slug' WHEN kind = 'entity' THEN NULL WHEN {_NOISE} THEN 'noise_candidate' END AS reason FROM mined WHERE NOT contains(name, '''') AND name NOT LIKE '%-%'")
def _(d):
    rows = mined(d).filter(~F.col("name").contains("'") & ~F.col("name").contains("-"))
    return rows.select("name", G.reject_reason(F.col("name"), X.slugify(F.col("name")), F.col("kind")).alias("reason"))


@_q("phrase_gate", MINED + f"SELECT name, CASE WHEN {_NOISE} THEN 'noise_phrase' WHEN usage < 2 THEN 'low_doc_count' WHEN support < 2 THEN 'low_support_count' WHEN distinctiveness < 1.5 THEN 'low_quality_score' END AS reason FROM mined WHERE name LIKE '% %'")
def _(d):
    rows = mined(d).filter(F.col("name").contains(" "))
    return rows.select("name", G.phrase_reason(F.col("name"), F.col("usage"), F.col("support"), F.col("distinctiveness")).alias("reason"))


_SING = "CASE WHEN length(w) <= 4 OR w IN (" + ", ".join(f"'{w}'" for w in X.KEEP_S) + ") THEN w WHEN w LIKE '%ies' AND length(w) > 5 THEN left(w, -3) || 'y' WHEN regexp_matches(w, '(ses|xes|zes|ches|shes)$') THEN left(w, -2) WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, -1) ELSE w END"


@_q("canonical_merge", MINED + f", k AS (SELECT name, usage, array_to_string(list_transform(string_split(name, ' '), lambda w: {_SING}), '-') AS key FROM mined WHERE regexp_matches(name, '^[a-z0-9 ]+$')) SELECT key, count(*) AS merged, CAST(max(usage) AS BIGINT) AS usage FROM k GROUP BY key")
def _(d):
    rows = mined(d).filter(F.col("name").rlike("^[a-z0-9 ]+$"))
    return rows.groupBy(X.slugify(X.normalize_term(F.col("name"))).alias("key")).agg(F.count("*").alias("merged"), F.max("usage").alias("usage"))


_MENDED = "CASE WHEN regexp_matches({0}, '(at|bl|iz)$') THEN {0} || 'e' ELSE {0} END"


@_q(
    "stem_merge",
    "WITH n AS (SELECT p_partkey AS topic_id, string_split(lower(p_name), ' ') AS words, p_size AS usage FROM part), w AS (SELECT topic_id, usage, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM n), "
    "one AS (SELECT *, CASE WHEN word LIKE '%sses' THEN left(word, -2) WHEN word LIKE '%ies' AND length(word) > 5 THEN left(word, -3) || 'y' WHEN word LIKE '%s' AND NOT regexp_matches(word, '(ss|us)$') AND length(word) > 4 THEN left(word, -1) ELSE word END AS w FROM w), "
    f"two AS (SELECT topic_id, usage, i, CASE WHEN w LIKE '%eed' THEN w WHEN w LIKE '%ed' AND length(w) > 5 THEN {_MENDED.format('left(w, -2)')} WHEN w LIKE '%ing' AND length(w) > 6 THEN {_MENDED.format('left(w, -3)')} ELSE w END AS w FROM one), "
    "k AS (SELECT topic_id, usage, string_agg(CASE WHEN w LIKE '%ational' THEN left(w, -5) || 'e' WHEN w LIKE '%ation' AND length(w) > 7 THEN left(w, -3) || 'e' ELSE w END, ' ' ORDER BY i) AS key FROM two GROUP BY topic_id, usage) "
    "SELECT topic_id, first_value(topic_id) OVER (PARTITION BY key ORDER BY usage DESC, topic_id) AS keeper_id FROM k",
    "part",
)
def _(p):
    rows = p.select(F.col("p_partkey").alias("topic_id"), F.col("p_name").alias("name"), F.col("p_size").alias("usage"))
    return M.stem_merge(rows)


@_q("alias_merge", "SELECT p_partkey AS topic_id, CASE p_name WHEN 'red widget' THEN 'blue widget' ELSE 'blue bolt' END AS canonical FROM part WHERE p_name IN ('red widget', 'red bolt')", "part")
def _(p):
    rows = p.select(F.col("p_partkey").alias("topic_id"), F.col("p_name").alias("name"))
    aliases = p.sparkSession.createDataFrame([("red widget", "green widget", 1), ("red widget", "blue widget", 2), ("red bolt", "blue bolt", 3)], "alias string, canonical string, place int")
    return M.alias_merge(rows, aliases)


@_q("affected_topics", "WITH l AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS t FROM lineitem) SELECT DISTINCT t AS topic_id FROM l WHERE c IN (SELECT c FROM l WHERE t < 3) UNION SELECT DISTINCT t FROM l WHERE t < 3", "lineitem")
def _(li):
    links = li.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("topic_id")).distinct()
    return M.affected(links, links.filter("topic_id < 3").select("topic_id").distinct())


@_q(
    "similarity_merge",
    f"""WITH n AS (SELECT lower(p_name) AS name, min(p_partkey) AS topic_id, max(p_size) AS usage FROM part GROUP BY lower(p_name)), g AS (SELECT *, {_DBI.format('name')} AS g FROM n),
    s AS (SELECT x.topic_id, y.topic_id AS keeper_id, round(2 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)), 6) AS score, y.usage AS u, y.name AS m, x.usage AS xu, x.name AS xm FROM g x JOIN g y ON x.name != y.name),
    b AS (SELECT topic_id, keeper_id FROM s WHERE score >= 0.7 AND (u > xu OR u = xu AND length(m) > length(xm) OR u = xu AND length(m) = length(xm) AND m < xm) QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, u DESC, length(m) DESC, m) = 1)
    SELECT topic_id, keeper_id FROM b WHERE keeper_id NOT IN (SELECT topic_id FROM b)""",
    "part",
)
def _(p):
    return M.similarity_merge(p.select(F.col("p_partkey").alias("topic_id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("usage")))


@_q(
    "precision_recall_at_k",
    TOK + ", r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY len(words) DESC, doc_id) AS rank FROM tok), g AS (SELECT doc_id, max(quality) AS good FROM labels GROUP BY doc_id), x AS (SELECT k, count(*) FILTER (WHERE good = 1) AS hits, count(*) AS shown FROM r JOIN (VALUES (5), (10)) v(k) ON rank <= k LEFT JOIN g USING (doc_id) GROUP BY k) SELECT k, round(hits / shown, 6) AS precision, round(hits / (SELECT count(*) FROM g JOIN documents USING (doc_id) WHERE good = 1), 6) AS recall FROM x",
    "documents",
    "labels",
)
def _(d, labels):
    words = d.select("doc_id", "source", F.size(X.tokenize(F.col("text"))).alias("n"))
    gold = labels.groupBy("doc_id").agg(F.max("quality").alias("good")).filter("good = 1").join(d.select("doc_id", "source"), "doc_id")
    return E.precision_recall(words, ["source"], [F.desc("n"), F.asc("doc_id")], gold, "doc_id", [5, 10])


@_q("topic_support_stats", MINED + "SELECT support, count(*) AS topics, CAST(sum(usage) AS BIGINT) AS usage, count(*) FILTER (WHERE name LIKE '% %') AS phrases FROM mined GROUP BY support")
def _(d):
    return mined(d).groupBy("support").agg(F.count("*").alias("topics"), F.sum("usage").alias("usage"), F.count_if(F.col("name").contains(" ")).alias("phrases"))


@_q("idf_extremes", TOK + "SELECT * FROM (SELECT word, count(*) AS df FROM cw GROUP BY word) ORDER BY df DESC, word LIMIT 20")
def _(d):
    return P.inverse_frequencies(d).select("word", "df").orderBy(F.desc("df"), "word").limit(20)
