"""Registered search queries over a stored index of the documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import index as I
from gleaner.operators.search import parse_query
from gleaner.sources.shared import fresh_path

#: Roles: a document's title is its first line, its date follows its id, its language and source are topics.
_PUBLISHED = "DATE '2023-01-01' + CAST(doc_id % 730 AS INTEGER)"
_BUILT: dict[tuple[str, str], I.Index] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.date_add(F.lit("2023-01-01").cast("date"), F.pmod("doc_id", F.lit(730)).cast("int")).alias("published"), "lang", "source")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.explode(F.array("lang", "source")).alias("slug")).withColumn("name", F.col("slug"))


def index_of(spark: SparkSession, sf_dir: str) -> I.Index:
    """Built by the first query of a session over these tables, read by the others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = I.build_index(documents(spark, sf_dir).drop("lang", "source"), fresh_path(spark, "index"))
    return _BUILT[key]


FTS = '"of the" the after:2023-06-01 before:2024-11-30 topic:en'
ANY = "hend OR tion OR ther year:2023"
HYBRID = "the in topic:en"


def fts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = parse_query(FTS)
    out = index_of(spark, sf_dir).search(q, allowed=I.topics_filter(assigned(spark, sf_dir), q.topics))
    return out.select("doc_id", "published", "raw", "score")


def fts_any_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).search(parse_query(ANY)).select("doc_id", "published", "raw", "score")


def search_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = e.filter("doc_id = 0").head()
    return I.search_all(index_of(spark, sf_dir), "tion topic:en", [("tion", ["hend", "of the"])], e.filter("doc_id != 0"), list(asked["v"]), assigned(spark, sf_dir), least=0.3)


QUERIES = {"fts_search": fts_search, "fts_any_words": fts_any_words, "search_whole": search_whole}


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(translate(lower({x}), '{I.MARKED}', '{I.PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda w: w != '')"


def _phrase(words: str, phrase: str) -> str:
    parts = phrase.split()
    return f"len(list_filter(range(1, len({words}) - {len(parts) - 2}), lambda i: " + " AND ".join(f"{words}[i + {k}] = '{w}'" for k, w in enumerate(parts)) + "))"


def _sql(phrases: list[str], fits: str, dates: str, topics: str, most: int = 20) -> str:
    """phrases get the columns f1, f2, ..."""
    f = ", ".join(f"5.0::DOUBLE * {_phrase('title', p)} + {_phrase('content', p)} AS f{k}" for k, p in enumerate(phrases, 1))
    idf = ", ".join(f"greatest(1e-6::DOUBLE, ln((count(*) - count(*) FILTER (WHERE f{k} > 0) + 0.5::DOUBLE) / (count(*) FILTER (WHERE f{k} > 0) + 0.5::DOUBLE))) AS i{k}" for k in range(1, len(phrases) + 1))
    raw = " + ".join(f"i{k} * f{k} * 2.2::DOUBLE / (f{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))" for k in range(1, len(phrases) + 1))
    return f"""WITH w AS (SELECT doc_id, lang, source, CAST({_PUBLISHED} AS DATE) AS published, {_words('split_part(text, chr(10), 1)')} AS title, {_words('text')} AS content FROM documents),
        h AS (SELECT doc_id, lang, source, published, len(title) + len(content) AS len, {f} FROM w),
        n AS (SELECT avg(len) AS mean, {idf} FROM h),
        s AS (SELECT doc_id, published, lang, source, round({raw}, 6) AS raw FROM h, n WHERE ({fits}) AND ({dates}) AND ({topics}) ORDER BY raw DESC, published DESC, doc_id DESC LIMIT {most}),
        fts AS (SELECT doc_id, published, raw, round((raw - min(raw) OVER ()) / coalesce(nullif(max(raw) OVER () - min(raw) OVER (), 0), 1), 6) AS score FROM s)"""


_COS = "list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / (sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) * sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])))"

ORACLE = {
    "fts_search": _sql(["the", "of the"], "f1 > 0 AND f2 > 0", "published BETWEEN DATE '2023-06-01' AND DATE '2024-11-30'", "lang = 'en'") + " SELECT * FROM fts",
    "fts_any_words": _sql(["hend", "tion", "ther"], "f1 > 0 OR f2 > 0 OR f3 > 0", "year(published) = 2023", "true") + " SELECT * FROM fts",
    "search_whole": _sql(["tion", "hend", "of the"], "f1 > 0 OR f2 > 0 OR f3 > 0", "true", "lang = 'en'")
    + f""", vec AS (SELECT * FROM (SELECT x.vec_id AS doc_id, round({_COS}, 6) AS vec FROM embeddings x, embeddings y WHERE y.vec_id = 0 AND x.vec_id != 0) WHERE vec >= 0.3 ORDER BY vec DESC, doc_id LIMIT 15)
        SELECT doc_id, score AS fts, vec, round(CASE WHEN score > 0 AND vec > 0 THEN 0.4::DOUBLE * score + 0.6::DOUBLE * vec + 0.1::DOUBLE WHEN vec IS NULL THEN 0.4::DOUBLE * score ELSE 0.6::DOUBLE * vec END, 6) AS score
        FROM fts FULL JOIN vec USING (doc_id)""",
}
