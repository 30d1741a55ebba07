"""Candidates from a model's answers, as frames: one row per answer in, candidates with evidence, and boosts for chunks out.

Answers come in unlike shapes. Where the text stands is told by a list of known places; failing these, the first string that begins
like JSON within six levels is taken. Nothing is parsed on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.functions import text as X

#: Where answers hold their text, in the order in which these places are tried.
PLACES = ("response", "result.response", "output_text", "text", "result.text", "content", "result.content", "choices.0.message.content", "response.0.content.0.text", "output.0.content.0.text", "result.output.0.content.0.text", "result.response.0.content.0.text")
DEEPEST = 6
KINDS = ("entity", "phrase", "concept")
ANSWER = "candidates array<struct<name:string,kind:string,confidence:string,rank_position:string,aliases:array<string>,evidence:array<struct<chunk_slug:string,quote:string>>>>"


def _at(value, place: str):
    for step in place.split("."):
        if isinstance(value, list):
            value = value[int(step)] if step.isdigit() and int(step) < len(value) else None
        else:
            value = value.get(step) if isinstance(value, dict) and not step.isdigit() else None
    return value


def _found(value, depth: int = 0) -> str | None:
    if isinstance(value, str):
        return value if value.strip()[:1] in ("{", "[") else None
    inner = value if isinstance(value, list) else list(value.values()) if isinstance(value, dict) else []
    if depth > DEEPEST:
        return None
    return next((x for x in (_found(v, depth + 1) for v in inner if not (depth == DEEPEST)) if x is not None), None)


def answer_text(raw: str | None) -> str | None:
    """The text of one answer: the answer itself if it isn't JSON of a known shape; null where there is none."""
    try:
        value = json.loads(raw or "null")
    except ValueError:
        return raw
    if isinstance(value, str):
        return value
    if isinstance(value, dict) and "candidates" in value:
        return raw
    return next((x for x in (_at(value, p) for p in PLACES) if isinstance(x, str)), None) or _found(value)


@F.pandas_udf(StringType())
def _texts(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in raw:
        yield batch.map(answer_text)


def candidates(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """episode_id, place, name, slug, kind, confidence, rank_position, aliases, evidence: what of each answer holds.

    answers: episode_id, raw; chunks: episode_id, chunk_id, slug. A candidate needs a name, a known kind, and evidence: a quote from a
    chunk of its own episode; other evidence is left out. Confidence is 0.5 if missing, and within 0..1. An answer that can't be read gives nothing."""
    text = F.regexp_replace(F.regexp_replace(_texts("raw"), r"(?i)^```(json)?\s*", ""), r"```\s*$", "")
    clean = F.trim(F.regexp_replace(text, r"[\x00-\x1F]+", " "))
    each = answers.select("episode_id", F.posexplode(F.from_json(clean, ANSWER)["candidates"]).alias("place", "c"))
    shaped = each.select("episode_id", "place", X.normalize(F.col("c.name")).alias("name"), F.col("c.kind").alias("kind"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("c.confidence").try_cast("double"), F.lit(0.5)))).alias("confidence"), F.coalesce(F.col("c.rank_position").try_cast("double"), F.col("place")).alias("rank_position"), F.filter(F.transform(F.coalesce("c.aliases", F.array().cast("array<string>")), X.normalize), lambda a: a != "").alias("aliases"), "c.evidence")
    good = shaped.filter((F.col("name") != "") & F.col("kind").isin(*KINDS)).withColumn("slug", X.slugify(F.col("name")))
    quotes = good.select("episode_id", "place", F.explode("evidence").alias("e")).select("episode_id", "place", F.col("e.chunk_slug").alias("slug"), X.normalize(F.col("e.quote")).alias("quote")).filter("quote != ''")
    own = quotes.join(chunks.select("episode_id", "chunk_id", "slug"), ["episode_id", "slug"])
    held = own.groupBy("episode_id", "place").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "slug", "quote"))).alias("evidence"))  # as many as an answer gives
    return good.drop("evidence").join(held, ["episode_id", "place"])


def replaced(stored: DataFrame, fresh: DataFrame, episodes: DataFrame) -> DataFrame:
    """stored candidates with those of the episodes that were asked again replaced, even where nothing of the new answer holds."""
    return stored.join(episodes.select("episode_id").distinct(), "episode_id", "left_anti").unionByName(fresh)


def boosts(found: DataFrame) -> DataFrame:
    """chunk_id, slug, name, kind, confidence: what candidates say of chunks; of several with one slug that of the last place."""
    each = found.select(F.explode("evidence").alias("e"), "episode_id", "place", "slug", "name", "kind", "confidence")
    return each.groupBy(F.col("e.chunk_id").alias("chunk_id"), "slug").agg(F.max_by(F.struct("name", "kind", "confidence"), F.struct("episode_id", "place")).alias("b")).select("chunk_id", "slug", "b.*")


def model_support(found: DataFrame) -> DataFrame:
    """slug, model: in how many episodes a model names a slug with evidence; what promotion counts."""
    return found.groupBy("slug").agg(F.count_distinct("episode_id").alias("model"))


def prompts(chunks: DataFrame, system: str, instruction: str, excerpt: int = 320) -> DataFrame:
    """episode_id, messages: what a model is asked about each episode. chunks: episode_id, position, slug, title, text.

    An episode's text goes into one prompt, as the model takes it; excerpts are of normalised text."""
    text = X.normalize(F.col("text"))
    each = chunks.select("episode_id", F.struct("position", "slug", F.col("title"), F.substring(text, 1, excerpt).alias("excerpt"), text.alias("whole")).alias("c"))
    rows = each.groupBy("episode_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    lines = F.transform("cs", lambda c: F.struct(c["slug"].alias("slug"), c["title"].alias("title"), c["excerpt"].alias("excerpt")))
    body = F.to_json(F.struct(F.lit(instruction).alias("instruction"), F.array_join(F.transform("cs", lambda c: c["whole"]), " ").alias("normalized_episode_text"), lines.alias("chunks")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.select("episode_id", F.array(message("system", F.lit(system)), message("user", body)).alias("messages"))


def promoted_with(stats: DataFrame, found: DataFrame) -> DataFrame:
    """stats (slug, name, kind, chunks, episodes, distinctiveness, usage) with model support and the promotion reason that counts it."""
    from gleaner.functions.gates import promotion_reason

    joined = stats.join(model_support(found), "slug", "left").fillna(0, ["model"])
    why = promotion_reason(F.col("name"), F.col("kind"), F.col("chunks"), F.col("episodes"), F.col("distinctiveness"), F.col("usage"), model=F.col("model"))
    return joined.withColumn("reason", why)
