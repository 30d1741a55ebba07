"""Search: a query language, keyword and BM25 ranking, vector neighbours, hybrid reranking, string similarity joins."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import nearest
from gleaner.operators.phrases import tokens
from gleaner.sources.shared import fresh_path, written


@dataclass
class Query:
    text: str = ""
    phrases: list[str] = field(default_factory=list)
    before: str | None = None
    after: str | None = None
    year: int | None = None
    topics: list[str] = field(default_factory=list)


_OPERATOR = re.compile(r'"(?P<phrase>[^"]+)"|before:(?P<before>\d{4}-\d{2}-\d{2})|after:(?P<after>\d{4}-\d{2}-\d{2})|year:(?P<year>\d{4})|(?i:topic):(?P<topic>\S+)')


def parse_query(raw: str) -> Query:
    """Quoted phrases and the operators before:, after:, year: and topic:; what is left is free text."""
    out = Query()
    raw = re.sub("[" + "".join(map(chr, (0x201C, 0x201D, 0x201E, 0x201F, 0x2033, 0x2036))) + "]", '"', raw)

    def take(m: re.Match) -> str:
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "phrase":
            out.phrases.append(value.strip())
        elif kind == "topic":
            out.topics.append(value.lower())
        else:
            setattr(out, kind, int(value) if kind == "year" else value)
        return ""

    out.text = " ".join(_OPERATOR.sub(take, raw).split())
    return out


def date_filter(q: Query, date: Column) -> Column:
    """Both bounds belong to the result."""
    out = F.lit(True)
    if q.before:
        out = out & (date <= F.to_date(F.lit(q.before)))
    if q.after:
        out = out & (date >= F.to_date(F.lit(q.after)))
    if q.year:
        out = out & (F.year(date) == q.year)
    return out


def expand_aliases(query: str, entities: list[tuple[str, list[str]]]) -> list[str]:
    """The query and all names of the first entity that it mentions."""
    low = query.lower()
    for name, aliases in entities:
        forms = [name, *aliases]
        if any(f.lower() in low for f in forms):
            return [query, *(f for f in forms if f.lower() != low)]
    return [query]


def keyword_search(docs: DataFrame, needle: str, also: Column | None = None) -> DataFrame:
    """Case-insensitive substring search; further conditions reach the scan."""
    found = docs if also is None else docs.filter(also)
    return found.filter(F.lower("text").contains(needle.lower()))


def bm25(docs: DataFrame, terms: list[str], most: int, k1: float = 1.2, b: float = 0.75, stop=X.STOPWORDS) -> DataFrame:
    """doc_id, score of the best documents. Only rows of the query's terms leave the scan's stage."""
    words = tokens(docs, stop).select("doc_id", "words", F.size("words").alias("size"))
    mean = words.agg(F.avg("size").alias("mean"), F.count("*").alias("many"))
    hits = words.select("doc_id", "size", F.explode(F.filter("words", lambda w: w.isin(*terms))).alias("word")).groupBy("doc_id", "size", "word").agg(F.count("*").alias("n"))
    df = hits.groupBy("word").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df), "word").crossJoin(F.broadcast(mean))  # a row per term of the query, and one row
    idf = F.log(1 + (F.col("many") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return rows.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(most)


def cosine_topk(rows: DataFrame, queries: DataFrame, most: int | None, least: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4000) -> DataFrame:
    """query_id, vec_id, score, rank: exact neighbours of any number of queries, about `block` of them at a time; the results of several blocks are written to the shared folder."""
    spark = rows.sparkSession
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).cast("array<double>").alias("qv")).filter("query_id IS NOT NULL")
    turns = max(1, -(-asked.count() // block))
    path = None if turns == 1 else fresh_path(spark, "cosine")
    # a file of vectors may be one piece, which one core would read: rows are dealt to all
    table = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).repartition(2 * spark.sparkContext.defaultParallelism, "vec_id")
    table = table if turns == 1 else written(table, "vectors")
    for turn in range(turns):
        some = asked if turns == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn)
        few = some.collect()
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in few], [r["qv"] for r in few]))
        scored = table.mapInArrow(nearest.scores_of(shared, most, least), nearest.SCHEMA)
        if path:
            scored.write.mode("append").parquet(path)
    scored = spark.read.schema(nearest.SCHEMA).parquet(path) if path else scored
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def min_max(df: DataFrame, column: str) -> DataFrame:
    """Scores moved to 0..1; a single value becomes 0."""
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    scaled = (F.col(column) - F.col("low")) / F.coalesce(F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(1.0))
    return df.crossJoin(F.broadcast(ends)).withColumn(column, scaled).drop("low", "high")


def rerank(fts: DataFrame, vec: DataFrame, text_weight: float = 0.4, vector_weight: float = 0.6, both_bonus: float = 0.1) -> DataFrame:
    """id, fts, vec, score: found by both 0.4 + 0.6 of the scores and a bonus; by one its weight's share."""
    rows = fts.join(vec, "id", "full_outer")
    both = F.col("fts").isNotNull() & F.col("vec").isNotNull()
    score = F.when(both, text_weight * F.col("fts") + vector_weight * F.col("vec") + both_bonus).when(F.col("vec").isNull(), text_weight * F.col("fts")).otherwise(vector_weight * F.col("vec"))
    return rows.select("id", "fts", "vec", F.round(score, 6).alias("score"))


def topic_boost(results: DataFrame, assigned: DataFrame, boost: float = 0.15) -> DataFrame:
    """results (id, score) with a boost for the ids in assigned (id)."""
    flagged = results.join(assigned.select("id").distinct().withColumn("on_topic", F.lit(True)), "id", "left")
    return flagged.withColumn("score", F.col("score") + F.when(F.col("on_topic"), boost).otherwise(0.0)).drop("on_topic")


def dice_pairs(names: DataFrame, least: float) -> DataFrame:
    """a < b, score of all names at least so alike. Names meet on shared character pairs, each pair of names once; lengths that can't reach the score don't meet."""
    rows = names.select("name", X.bigrams(F.col("name")).alias("grams")).withColumn("size", F.size("grams"))
    each = rows.select("name", "size", F.explode("grams").alias("gram"))
    x, y = each.toDF("a", "size_a", "gram"), each.toDF("b", "size_b", "gram")
    possible = 2 * F.least("size_a", "size_b") >= least * (F.col("size_a") + F.col("size_b"))
    met = x.join(y, "gram").filter((F.col("a") < F.col("b")) & possible).groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("common"))
    return met.select("a", "b", F.round(2 * F.col("common") / (F.col("size_a") + F.col("size_b")), 6).alias("score")).filter(F.col("score") >= least)
