"""The corpus pipeline: classify, filter by rules, drop near duplicates, cut repeated strings, pack.

Each stage reads all that the one before kept; every stage but the last returns the columns of documents. Labels say
which of the kept documents are trusted; documents without labels are judged like all others.

A decision belongs to a row, told by its id and its text; so rows that share an id are judged apart, and rows without an
id are judged like all others.

Defined results: null ids stay null and are kept where their text is; rows that repeat id and text are kept or dropped
together by the first two stages, and the near-duplicate stage keeps one of them (other columns are those of the first that
Spark meets); rows without words are near duplicates of nothing; texts of any length go through whole; columns beyond
those of documents stay, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.classifier import classify
from gleaner.llm.common import materialize, table
from gleaner.llm.jaccard import jaccard_components
from gleaner.llm.packing import pack_documents
from gleaner.llm.quality_rules import quality_rules
from gleaner.llm.suffixes import strip_repeats


def _decided(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents whose id and text are in rows (doc_id, text_hash), with their own columns; rows of one id and text are alike."""
    keys = rows.select(F.col("doc_id").alias("decided_id"), F.col("text_hash").alias("decided_hash")).distinct()
    own = docs["doc_id"].cast("long").eqNullSafe(keys["decided_id"])
    return docs.join(keys, own & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == keys["decided_hash"]), "left_semi")


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier predicts to be good."""
    good = classify(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select("doc_id", "text_hash")
    return _decided(docs, materialize(good, "good"))  # so that the driver is rid of the model before rows are joined


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rules and the likelihood ratio."""
    return _decided(docs, quality_rules(docs, table(spark, sf_dir, "labels")).filter("kept"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: of those with the smallest id that with the least hash of its text."""
    leaders = jaccard_components(docs).filter("leader")
    groups = leaders.filter("node IS NOT NULL").groupBy("doc_id", "node").agg(F.min("text_hash").alias("text_hash"))
    kept = _decided(docs, groups).select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("key"), F.xxhash64("text").alias("hash"))
    one = kept.dropDuplicates(["key", "hash"]).select("row.*")
    wordless = leaders.filter("node IS NULL")  # linked with nothing, so all of them stay
    return one.unionByName(_decided(docs, wordless))


def stripped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out of the texts what another document has before; n_chars follows the text."""
    out = strip_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan of what is left: a row per piece."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classified),
    ("quality_rules", ruled),
    ("jaccard_join", distinct),
    ("suffix_dedup", stripped),
    ("packing", packed),
]
#: No stage can be said in SQL as a whole; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
