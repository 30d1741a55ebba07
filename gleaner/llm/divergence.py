"""Source divergence audit: how far a source's terms are from those of its language and of its other sources.

As a count vectorizer per language would (minDF, and a vocabulary as large as an integer allows): terms of documents are
counted exactly, a language keeps the terms that stand in at least MIN_DF of its documents, and a document is the sparse
vector of its counts. A task sums the vectors of the documents it reads by source and hands on the sums, with the number of
documents a term stands in beside them; both are added up by term. The vocabulary is a table and stays one: the library
class of that name gathers it on the driver and sends it to all tasks, and it grows with the corpus.

Two sources of a language are compared without their zeros. Of the sum over the vocabulary of f(p, q), the terms that neither
has give one value each; terms that one has depend on its count alone, so that one row per distinct count is joined with the other
sources; only terms that both have are met as pairs, and put right what the two other sums took for them.

Exactness: p is worked out in decimals. (p - q)^2 is at most (10^9 + 1)^2 and sums of f at most 10^9 * (2 * 10^9 + 2 V), so both
fit 64 bits for any vocabulary below 10^9 terms; Spark raises on overflow.

Defined results: null text, language and source are ''; groups without kept terms are compared too; a language without kept
terms gives value 0 for each pair and no term rows; a source that is alone in its language has no pair rows; repeated rows and
null ids count as documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, table

MIN_DF, TOP, UNIT = 3, 200, 1_000_000_000
#: Entries that a task holds before it hands them on.
HELD = 1 << 19
#: Letters of a term (ASCII letters, lowered, and all that isn't ASCII) stay, other bytes part terms.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def vector_sums(docs: DataFrame) -> DataFrame:
    """lang, source, term, n: sums of the vectors of documents of one task; source null: n is the number of documents of the language with the term; term null: a group that occurs."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        sums: dict[tuple, Counter] = defaultdict(Counter)
        groups: set[tuple] = set()
        read = 0  # words since the entries were last counted

        def out() -> Iterator[dict]:
            for (lang, source), counts in sums.items():
                yield {"lang": [lang] * len(counts), "source": [source] * len(counts), "term": [t.decode() for t in counts], "n": list(counts.values())}
            sums.clear()

        for b in batches:
            for lang, source, text in zip(b["lang"], b["source"], b["text"], strict=True):
                terms = text.translate(_LETTERS).split()
                sums[lang, source].update(terms)
                sums[lang, None].update(set(terms))
                groups.add((lang, source))
                read += len(terms)
                if read >= HELD:
                    read = 0
                    if sum(map(len, sums.values())) >= HELD:
                        yield from out()
            if len(groups) >= HELD:
                yield {"lang": [g[0] for g in groups], "source": [g[1] for g in groups], "term": [None] * len(groups), "n": [0] * len(groups)}
                groups.clear()
        yield from out()
        yield {"lang": [g[0] for g in groups], "source": [g[1] for g in groups], "term": [None] * len(groups), "n": [0] * len(groups)}

    return arrow_rows(docs, run, "lang string, source string, term string, n long")


def share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms))."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")
    return F.lit(1).cast("long") + whole((wide(count) + 1) * F.lit(UNIT).cast("decimal(10,0)"), wide(total) + wide(terms))


def whole(a: Column, b: Column) -> Column:
    """a div b, rounded down (both are never negative)."""
    return F.call_function("div", a, b)


def apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / q)."""
    return whole((F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(q))


def kept_counts(sums: DataFrame, min_df: int) -> DataFrame:
    """lang, source, term, n, total (n over all sources) of the terms in at least min_df documents; and rows with term null, one for each group that occurs."""
    met = sums.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    term = Window.partitionBy("lang", "term")
    of_source = F.when(F.col("source").isNotNull(), F.col("n"))
    seen = met.withColumn("df", F.sum(F.when(F.col("source").isNull(), F.col("n"))).over(term)).withColumn("total", F.sum(of_source).over(term))
    return seen.filter(F.col("source").isNotNull() & (F.col("term").isNull() | (F.col("df") >= min_df))).select("lang", "source", "term", "n", "total")


def source_divergence(df: DataFrame, min_df: int = MIN_DF, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(own(lang_col).alias("lang"), own(source_col).alias("source"), own(text_col).cast("binary").alias("text"))
    rows = materialize(kept_counts(vector_sums(docs), min_df), "counts")
    counts = rows.filter("term IS NOT NULL")
    groups = rows.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("term").alias("support"))
    # a term's share of the language is counted once, with the first of its sources
    first = counts.groupBy("lang", "term").agg(F.max("total").alias("total")).groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("terms"))
    groups = groups.join(first, "lang", "left").select("lang", "source", "group_n", "support", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"))
    none = F.when(F.col("terms") > 0, share(F.lit(0), "group_n", F.greatest("terms", F.lit(1)))).alias("p_none")
    groups = materialize(groups.select("*", none), "groups")
    rated = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "group_n", "terms").alias("p"), share("total", "lang_n", "terms").alias("q"), "p_none")
    rated = materialize(rated, "rated")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rated.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    pairs = pair_values(rated, groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms)


def pair_values(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, other, value of each two sources of a language."""
    one, two = (groups.select("lang", F.col("source").alias(name), F.col("support").alias(f"support_{name}"), F.col("p_none").alias(f"none_{name}"), "terms") for name in ("source", "other"))
    pairs = one.join(two.drop("terms"), "lang").filter("source != other")
    # terms that both have, less what the sums below take for them
    a = rated.select("lang", "term", "source", "p", F.col("p_none").alias("none_source"))
    b = rated.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("p_none").alias("none_other"))
    both = a.join(b, ["lang", "term"]).filter("source != other").select("lang", "source", "other", (apart("p", "q") - apart("p", "none_other") - apart("none_source", "q")).alias("value"))
    both = both.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"), F.count("*").alias("shared"))
    # terms of one of the two, by what their counts give
    held = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("many"), F.max("p_none").alias("p_none"))
    held = materialize(held, "held")
    ends = groups.select("lang", F.col("source").alias("end"), F.col("p_none").alias("none_end"))
    met = held.join(ends, "lang").filter("source != end")
    mine = met.groupBy("lang", "source", F.col("end").alias("other")).agg(F.sum(F.col("many") * apart("p", "none_end")).alias("mine"))
    theirs = met.groupBy("lang", F.col("end").alias("source"), F.col("source").alias("other")).agg(F.sum(F.col("many") * apart("none_end", "p")).alias("theirs"))
    keys = ["lang", "source", "other"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    neither = F.col("terms") - F.col("support_source") - F.col("support_other") + zero("shared")
    value = F.when(F.col("terms") > 0, zero("value") + zero("mine") + zero("theirs") + neither * apart("none_source", "none_other")).otherwise(F.lit(0).cast("long"))
    return pairs.join(both, keys, "left").join(mine, keys, "left").join(theirs, keys, "left").select(*keys, value.alias("value"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLE = {
    "op12_source_divergence": r"""
        WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row FROM documents),
        words AS (SELECT lang, source, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        vocab AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 3),
        seen AS (SELECT lang, source, term, count(*) AS n FROM words JOIN vocab USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM d),
        sizes AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM vocab GROUP BY lang),
        group_n AS (SELECT lang, source, sum(n) AS group_n FROM seen GROUP BY ALL),
        dense AS (
            SELECT g.lang, g.source, t.term, coalesce(s.n, 0) AS n,
                1 + (1000000000 * (coalesce(s.n, 0) + 1)::HUGEINT) // (coalesce(group_n, 0) + v)::HUGEINT AS p, 1 + (1000000000 * (total + 1)::HUGEINT) // (lang_n + v)::HUGEINT AS q
            FROM groups g JOIN vocab t USING (lang) JOIN sizes USING (lang) LEFT JOIN group_n USING (lang, source) LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = t.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
        every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
            LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
        terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM dense WHERE n > 0 AND p > q)
        SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM every
        UNION ALL
        SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms
        QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200"""
}
