"""Many terms against many texts in one pass over each text.

Terms go to the tasks as one automaton, so no text meets a term that it doesn't hold and nothing is shuffled. What is sent is
measured first: terms of more than `most_bytes` in all are dealt by hash into parts that fit, and texts are read once for each
part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.sources.shared import dealt, written

#: Bytes of terms that one pass takes along.
MOST_BYTES = 32 << 20


def word_form(text: Column) -> Column:
    """Lower-case letters and digits with single spaces between and around words: terms in this form stand between word boundaries."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


#: Where a hit counts: anywhere, where neither neighbour is a letter a-z or a digit, where both neighbours are spaces.
ANYWHERE, BETWEEN_BOUNDS, BETWEEN_SPACES = "anywhere", "bounds", "spaces"


def matches(texts: DataFrame, terms: DataFrame, most_bytes: int = MOST_BYTES, **counted: tuple[str, str]) -> DataFrame:
    """doc_id, term, and for each name in counted how often (overlaps counted) the term stands in that column of the text in that way; pairs without any are left out. counted: name = (column, way); terms: term, form.

    Each column is gone through once. Several terms may have one form; empty forms are held by nothing, null texts hold none."""
    spark = texts.sparkSession
    terms = written(terms.select("term", "form").filter("form != ''"), "terms")  # read for size, parts and names: made once
    forms = terms.select("form").distinct()
    size = forms.agg(F.sum(F.octet_length("form") + F.lit(16))).head()[0] or 0
    parts = max(1, -(-int(size) // most_bytes))
    schema = "doc_id long, form string, " + ", ".join(f"{name} long" for name in counted)
    if not size:  # no term, so texts needn't be read
        return spark.createDataFrame([], schema).join(terms, "form").select("doc_id", "term", *counted)
    found = None
    for part in range(parts):
        own = [r["form"] for r in forms.filter(F.pmod(F.xxhash64("form"), F.lit(parts)) == part).collect()]  # at most about most_bytes
        hits = texts.mapInArrow(_pass(spark.sparkContext.broadcast(own), counted), schema)
        found = hits if found is None else found.unionByName(hits)
    return found.join(terms, "form").select("doc_id", "term", *counted)


def held(texts: DataFrame, terms: DataFrame, bounds: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, term, n: how often each term stands in each text, for those that do; bounds: only between bounds. texts: doc_id, form; terms: term, form."""
    return matches(texts, terms, most_bytes, n=("form", BETWEEN_BOUNDS if bounds else ANYWHERE))


_INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _automaton(forms: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for form in forms:
        automaton.add_word(form, form)
    if len(automaton):
        automaton.make_automaton()
    return automaton


def _pass(shared, counted: dict[str, tuple[str, str]]):
    columns: dict[str, list[tuple[int, str]]] = {}
    for k, (column, way) in enumerate(counted.values()):
        columns.setdefault(column, []).append((k, way))
    none = [0] * len(counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value)
        if not len(automaton):
            return
        for batch in batches:
            ids: list = []
            forms: list[str] = []
            counts: list[list[int]] = []
            texts = [(batch.column(column).to_pylist(), ways) for column, ways in columns.items()]
            for row, doc in enumerate(batch.column("doc_id").to_pylist()):
                seen: dict[str, list[int]] = {}
                for column, ways in texts:
                    text = column[row]
                    for end, form in automaton.iter(text or ""):
                        first = end - len(form) + 1
                        before, after = text[first - 1] if first else "", text[end + 1 : end + 2]
                        for k, way in ways:
                            if way == ANYWHERE or (way == BETWEEN_BOUNDS and before not in _INNER and after not in _INNER) or (way == BETWEEN_SPACES and before == after == " "):
                                seen.setdefault(form, none.copy())[k] += 1
                ids += [doc] * len(seen)
                forms += seen.keys()
                counts += seen.values()
            sums = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(counted))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.string()), *sums], names=["doc_id", "form", *counted])

    return run


def _texts(docs: DataFrame, deal: bool = True) -> DataFrame:
    """doc_id, text, dealt to all cores unless they come in parts of like size."""
    texts = docs.select("doc_id", "text")
    return dealt(texts, "doc_id") if deal else texts


def _lowered(docs: DataFrame, deal: bool = True) -> DataFrame:
    """doc_id, form: texts in lower case."""
    return _texts(docs, deal).select("doc_id", F.lower("text").alias("form"))


def with_words(docs: DataFrame, terms: DataFrame, deal: bool = True) -> DataFrame:
    """doc_id, term of all terms that stand in a text between word boundaries. docs: doc_id, text; terms: term."""
    shaped = terms.select("term", word_form(F.col("term")).alias("form")).filter("trim(form) != ''")
    return held(_texts(docs, deal).select("doc_id", word_form(F.col("text")).alias("form")), shaped).select("doc_id", "term").distinct()


def with_substrings(docs: DataFrame, terms: DataFrame, deal: bool = True) -> DataFrame:
    """doc_id, term of all terms that stand anywhere in a text, letters' case aside."""
    return held(_lowered(docs, deal), _as_they_are(terms)).select("doc_id", "term").distinct()


def with_bounds(docs: DataFrame, terms: DataFrame, deal: bool = True) -> DataFrame:
    """doc_id, term of all terms that stand in a text, as they are but for case, with no letter a-z or digit next to them."""
    return held(_lowered(docs, deal), _as_they_are(terms), bounds=True).select("doc_id", "term").distinct()


def with_wholeness(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, term, whole of all terms that stand anywhere in a text: whether one has no letter a-z or digit next to it."""
    found = matches(_lowered(docs), _as_they_are(terms), inside=("form", ANYWHERE), own=("form", BETWEEN_BOUNDS))
    return found.groupBy("doc_id", "term").agg((F.max("own") > 0).alias("whole"))


def only_inside(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, term of all terms that stand in a text, but nowhere as words of its word form."""
    texts = dealt(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.lower("text").alias("low"), word_form(F.col("text")).alias("words"))
    found = matches(texts, _as_they_are(terms), inside=("low", ANYWHERE), own=("words", BETWEEN_SPACES))
    return found.groupBy("doc_id", "term").agg(F.max("inside").alias("inside"), F.max("own").alias("own")).filter("inside > 0 AND own = 0").select("doc_id", "term")


def _as_they_are(terms: DataFrame) -> DataFrame:
    return terms.select("term", F.lower("term").alias("form"))
