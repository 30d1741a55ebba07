"""A positional index in tables: built once, then searched by reading only the rows of a query's terms.

Under its folder stand `postings` (a row per term, document and field: positions of the term), `documents` (lengths and the
columns that queries filter by), `maxima` (per term and block of documents: documents, most occurrences by field, least
length) and `totals` (one row). postings and maxima are split into folders by a hash of the term, and within a folder sorted by
term and block, so that a query's terms prune folders, files and row groups. A folder's rows are dealt by term and by document,
so that no task writes a frequent term alone.

A query is a sum of products: alternatives, each of phrases that must all occur. A phrase occurs where its words stand side by
side in one field; its occurrences are found by moving the positions of each word to the phrase's start and intersecting them.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.search import Query, cosine_topk, date_filter, min_max, parse_query, rerank, topic_boost
from gleaner.sources.shared import dealt, written

#: Folders of the term tables, and documents of one block of maxima.
BUCKETS, BLOCK = 16, 4096
#: Term frequency saturation and the weight of lengths; an inverse frequency is never below FLOOR.
K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Blocks that are searched whole to get a first bound.
FIRST_BLOCKS = 4


def folded_letters() -> tuple[str, str]:
    """Letters of the Latin blocks that are a plain letter with marks, and those letters."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if c.islower() and len(unicodedata.normalize("NFD", c)) > 1]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


MARKED, PLAIN = folded_letters()


def analyzed(text: Column) -> Column:
    """Words of letters and digits, lower-case, without marks on Latin letters."""
    return F.filter(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def analyzed_here(text: str) -> list[str]:
    """The same for a query's words."""
    low = text.lower().translate(str.maketrans(MARKED, PLAIN))
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in low).split()


Expression = list[list[tuple[str, ...]]]


def expression(q: Query) -> Expression:
    """Alternatives of phrases: the text is one phrase, or several around OR; quoted phrases belong to the last of these, as AND binds closer."""
    own = [part.strip().strip('"') for part in q.text.split(" OR ")] if " OR " in f" {q.text} " else [q.text]
    alternatives = [[tuple(analyzed_here(part))] for part in own if analyzed_here(part)]
    quoted = [tuple(words) for words in map(analyzed_here, q.phrases) if words]
    if not alternatives:
        return [quoted] if quoted else []
    alternatives[-1] += quoted
    return alternatives


def back(places: int):
    return lambda p: p - places


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, path: str, fields: tuple[str, ...] = ("title", "content"), keep: tuple[str, ...] = ("published",), buckets: int = BUCKETS, block: int = BLOCK) -> Index:
    """Write the index of docs (doc_id, the fields' texts, and the columns to keep). Documents are told by doc_id, which is a number and unique."""
    spark = docs.sparkSession
    docs = dealt(docs, "doc_id")
    words = docs.select("doc_id", F.floor(F.col("doc_id") / block).cast("long").alias("block"), *(analyzed(F.col(f)).alias(f) for f in fields))
    sizes = [F.size(f).alias(f"len_{f}") for f in fields]
    lengths = words.select("doc_id", "block", *sizes)
    kept = docs.select("doc_id", *keep)
    lengths.join(kept, "doc_id").withColumn("len", sum((F.col(f"len_{f}") for f in fields), F.lit(0))).write.parquet(f"{path}/documents")
    stored = spark.read.parquet(f"{path}/documents")
    stored.agg(F.count("*").alias("docs"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("mean"), F.lit(buckets).alias("buckets"), F.lit(list(fields)).alias("fields")).write.parquet(f"{path}/totals")

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("term", pa.string()), ("doc_id", pa.int64()), ("block", pa.int64()), ("field", pa.int32()), ("n", pa.int32()), ("len", pa.int32()), ("lead", pa.bool_()), ("positions", pa.list_(pa.int32()))])
        for batch in batches:
            out: list[tuple] = []
            texts = [batch.column(f).to_pylist() for f in fields]
            for k, (doc, at) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                length = sum(len(t[k]) for t in texts)
                known: set[str] = set()  # words of the fields before: a document's first row of a term leads, and counts as the document
                for field, text in enumerate(texts):
                    places: dict[str, list[int]] = {}
                    for place, word in enumerate(text[k]):
                        places.setdefault(word, []).append(place)
                    out += [(word, doc, at, field, len(p), length, word not in known, p) for word, p in places.items()]
                    known.update(places)
                    if len(out) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types, strict=True)], schema=schema)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types, strict=True)], schema=schema)

    rows = words.filter(F.col("doc_id").isNotNull()).mapInArrow(postings, "term string, doc_id long, block long, field int, n int, len int, lead boolean, positions array<int>")
    rows = rows.withColumn("bucket", term_bucket(F.col("term"), buckets))
    clustered = rows.repartition(F.col("bucket"), F.pmod(F.col("block"), F.lit(64))).sortWithinPartitions("bucket", "term", "block", "doc_id", "field")
    clustered.write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    by_field = [F.max(F.when(F.col("field") == k, F.col("n"))).alias(f"most_{f}") for k, f in enumerate(fields)]
    maxima = stored.groupBy("bucket", "term", "block").agg(F.count_if("lead").alias("docs"), F.min("len").alias("least_len"), *by_field)
    maxima.repartition(F.col("bucket")).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/maxima")
    return Index(spark, path)


@dataclass
class Index:
    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        t = self.spark.read.parquet(f"{self.path}/totals").head()
        self.docs, self.mean, self.buckets, self.fields = t["docs"], t["mean"] or 1.0, t["buckets"], list(t["fields"])

    def rows_of(self, table: str, terms: list[str]) -> DataFrame:
        """The rows of the terms; folders and row groups of others aren't read."""
        known = self.spark.range(1).select(F.array(*(term_bucket(F.lit(t), self.buckets) for t in terms)).alias("b")).head()["b"]
        return self.spark.read.parquet(f"{self.path}/{table}").filter(F.col("bucket").isin(sorted(set(known))) & F.col("term").isin(terms))

    def hits(self, phrases: list[tuple[str, ...]], weights: list[float], blocks: DataFrame | None = None) -> DataFrame:
        """doc_id, block, f: an array with each phrase's occurrences, weighted by field; documents with none are left out."""
        terms = sorted({w for p in phrases for w in p})
        rows = self.rows_of("postings", terms)
        rows = rows if blocks is None else rows.join(blocks.select("block"), "block", "left_semi")
        name = {(t, k): f"p{i}_{k}" for i, t in enumerate(terms) for k in range(len(self.fields))}
        at = [F.max(F.when((F.col("term") == t) & (F.col("field") == k), F.col("positions"))).alias(n) for (t, k), n in name.items()]
        placed = rows.groupBy("doc_id", "block").agg(*at)

        def starts(phrase: tuple[str, ...], k: int) -> Column:
            if len(phrase) == 1:
                return F.coalesce(F.size(name[phrase[0], k]), F.lit(0))
            moved = [F.transform(name[w, k], back(j)) for j, w in enumerate(phrase)]
            both = moved[0]
            for more in moved[1:]:
                both = F.array_intersect(both, more)
            return F.coalesce(F.size(both), F.lit(0))  # null where a word is missing

        weighted = [sum((float(weights[k]) * F.greatest(starts(p, k), F.lit(0)) for k in range(len(self.fields))), F.lit(0.0)) for p in phrases]
        found = placed.select("doc_id", "block", F.array(*weighted).alias("f"))
        return found.filter(F.exists("f", lambda x: x > 0))

    def rarity(self, phrases: list[tuple[str, ...]], found: DataFrame | None) -> list[float]:
        """Inverse frequency of each phrase in all documents. Single words have their documents in maxima; others need their hits."""
        if found is None:
            sums = dict(self.rows_of("maxima", [p[0] for p in phrases]).groupBy("term").agg(F.sum("docs")).collect())  # a row per term of the query
            counts = [sums.get(p[0], 0) for p in phrases]
        else:
            counts = list(found.agg(*(F.count_if(F.col("f")[k] > 0) for k in range(len(phrases)))).head())
        return [max(FLOOR, math.log((self.docs - n + 0.5) / (n + 0.5))) for n in counts]

    def scored(self, found: DataFrame, alternatives: Expression, phrases: list, idf: list[float], q: Query, date: str | None, allowed: DataFrame | None) -> DataFrame:
        """doc_id, published or nothing, raw: scores of the documents that the expression and the filters let through."""
        fits = F.lit(False)
        for each in alternatives:
            whole = F.lit(True)
            for p in each:
                whole = whole & (F.col("f")[phrases.index(p)] > 0)
            fits = fits | whole
        documents = self.spark.read.parquet(f"{self.path}/documents")
        documents = documents.filter(date_filter(q, F.col(date))) if date else documents
        rows = found.filter(fits).join(documents.drop("block"), "doc_id")
        rows = rows if allowed is None else rows.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
        norm = K1 * (1 - B + B * F.col("len") / self.mean)
        raw = sum((i * F.col("f")[k] * (K1 + 1) / (F.col("f")[k] + norm) for k, i in enumerate(idf)), F.lit(0.0))
        return rows.withColumn("raw", F.round(raw, 6))

    def promising(self, alternatives: Expression, phrases: list, idf: list[float], weights: list[float], best, most: int) -> DataFrame:
        """Blocks that may hold one of the `most` best documents, for queries of single words. best: their order, given blocks."""
        rows = self.rows_of("maxima", [p[0] for p in phrases])
        heaviest = sum((w * F.coalesce(F.col(f"most_{f}"), F.lit(0)) for w, f in zip(weights, self.fields, strict=True)), F.lit(0.0))
        part = heaviest * (K1 + 1) / (heaviest + K1 * (1 - B + B * F.col("least_len") / self.mean))
        idfs = F.create_map(*(x for p, i in zip(phrases, idf, strict=True) for x in (F.lit(p[0]), F.lit(i))))
        bounds = rows.groupBy("block").agg(F.sum(idfs[F.col("term")] * part).alias("bound"), F.collect_set("term").alias("terms"))
        fits = F.lit(False)
        for each in alternatives:
            whole = F.lit(True)
            for p in each:
                whole = whole & F.array_contains("terms", p[0])
            fits = fits | whole
        bounds = bounds.filter(fits)
        first = best(bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS)).agg(F.count("*").alias("n"), F.min("raw").alias("least")).head()
        return bounds if first["n"] < most else bounds.filter(F.col("bound") >= first["least"] - 1e-6)

    def search(self, q: Query, most: int = 20, weights: tuple[float, ...] = (5.0, 1.0), date: str | None = "published", allowed: DataFrame | None = None, skip: bool = True) -> DataFrame:
        """doc_id, raw (BM25 with weighted fields), score (raw from 0 to 1 over the result), and the kept columns; best first, then latest, then greatest id. allowed: doc_id of the documents that may be found, all if None."""
        alternatives = expression(q)
        phrases = list(dict.fromkeys(p for each in alternatives for p in each))
        order = [F.desc("raw"), *([F.desc(date)] if date else []), F.desc("doc_id")]
        if not phrases:
            found = self.spark.createDataFrame([], "doc_id long, block long, f array<double>")
            return min_max(self.scored(found, alternatives, phrases, [], q, date, allowed).withColumn("score", F.col("raw")), "score").drop("f", "block")
        weights = list(weights)
        if skip and all(len(p) == 1 for p in phrases):
            idf = self.rarity(phrases, None)
            best = lambda blocks: self.scored(self.hits(phrases, weights, blocks), alternatives, phrases, idf, q, date, allowed).orderBy(*order).limit(most)
            top = best(self.promising(alternatives, phrases, idf, weights, best, most))
        else:
            found = written(self.hits(phrases, weights), "found")  # read for the phrases' frequency and for the scores
            top = self.scored(found, alternatives, phrases, self.rarity(phrases, found), q, date, allowed).orderBy(*order).limit(most)
        return min_max(top.withColumn("score", F.col("raw")), "score").withColumn("score", F.round("score", 6)).drop("f", "block").orderBy(*order)


def topics_filter(assigned: DataFrame, slugs: list[str]) -> DataFrame | None:
    """doc_id of the documents that have all the topics; assigned: doc_id, slug of visible topics. None without slugs."""
    wanted = list(dict.fromkeys(s.strip() for s in slugs if s.strip()))
    if not wanted:
        return None
    return assigned.filter(F.col("slug").isin(wanted)).groupBy("doc_id").agg(F.count_distinct("slug").alias("n")).filter(F.col("n") == len(wanted)).select("doc_id")


def with_aliases(q: Query, entities: list[tuple[str, list[str]]]) -> Query:
    """The query with the names of the first entity that its text mentions as alternatives."""
    low = q.text.lower()
    for name, aliases in entities:
        names = [name.lower(), *(a.lower() for a in aliases)]
        if low and any(n in low for n in names):
            return replace(q, text=" OR ".join(dict.fromkeys(n for n in (low, *names) if n)))
    return q


def search_all(index: Index, raw: str, entities: list[tuple[str, list[str]]] = (), vectors: DataFrame | None = None, asked: list[float] | None = None, assigned: DataFrame | None = None, most: int = 20, near: int = 15, least: float = 0.72, boost: float = 0.15, date: str | None = "published") -> DataFrame:
    """doc_id, fts, vec, score: one search. A query's operators filter, its text and phrases are searched in the index with
    aliases of known entities, its vector (asked) among vectors (doc_id, v) unless it has quoted phrases; both are merged, and
    documents of the topic that the text names get a boost. assigned: doc_id, slug, name of visible topics' documents."""
    q = parse_query(raw)
    allowed = topics_filter(assigned, q.topics) if assigned is not None else None
    found = index.search(with_aliases(q, entities), most, date=date, allowed=allowed).select(F.col("doc_id").alias("id"), F.col("score").alias("fts"))
    if vectors is not None and asked is not None and not q.phrases:
        one = index.spark.createDataFrame([(-1, asked)], "vec_id long, embedding array<double>")
        rows = vectors.select(F.col("doc_id").alias("vec_id"), F.col("v").alias("embedding"))
        vec = cosine_topk(rows, one, near, least).select(F.col("vec_id").alias("id"), F.col("score").alias("vec"))
    else:
        vec = index.spark.createDataFrame([], "id long, vec double")
    both = (F.col("fts") > 0) & (F.col("vec") > 0)  # a last place of 0 in one list counts as not found there
    merged = rerank(found, vec).withColumn("score", F.when(F.col("vec").isNotNull() & ~both, F.round(0.6 * F.col("vec"), 6)).otherwise(F.col("score")))
    if assigned is not None and q.text:
        low = q.text.lower()
        named = assigned.filter((F.col("slug") == low) | (F.lower("name") == low)).select(F.col("doc_id").alias("id"))
        merged = topic_boost(merged, named, boost)
    return merged.withColumnRenamed("id", "doc_id").orderBy(F.desc("score"), F.desc("doc_id"))
