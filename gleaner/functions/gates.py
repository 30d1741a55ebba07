"""Gates on topics as columns: noise, weak single words, promotion and display. Word lists are parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import STOPWORDS


@dataclass(frozen=True)
class Tuning:
    """Thresholds of promotion and display, and the word lists of the noise rules. Thresholds, starters and filler are fixed values."""

    chunk_support: int = 5
    episode_support: int = 2
    phrase_chunk_support: int = 4
    phrase_episode_support: int = 2
    singleton_distinctiveness: float = 20
    lexicon_docs: int = 2
    lexicon_support: int = 2
    lexicon_quality: float = 1.5
    visible_episodes: int = 2
    visible_distinctiveness: float = 25
    visible_usage: int = 10
    protected: tuple[str, ...] = ()
    noise: tuple[str, ...] = ("thing", "things", "people", "time", "stuff", "work", "good", "make", "need", "want", "like", "really", "great", "part", "point", "idea", "fact", "sense")
    starters: tuple[str, ...] = ("someone", "everyone", "something", "everything", "anyone", "anything", "nobody", "nothing", "whoever", "whatever", "however")
    filler: tuple[str, ...] = ("make", "take", "give", "keep", "come", "show", "play", "move", "turn", "need", "want", "like", "feel", "think", "know", "believe", "tell", "good", "best", "real", "true", "hard", "fast", "high", "long", "work", "thing", "place", "world", "point", "part")
    stop: tuple[str, ...] = field(default_factory=lambda: tuple(STOPWORDS))


DEFAULT = Tuning()


def _in(x: Column, words: tuple[str, ...]) -> Column:
    return x.isin(*words) if words else F.lit(False)


def is_noise(name: Column, t: Tuning = DEFAULT) -> Column:
    """Listed words, short words, phrases with a generic start or of filler only, and single words with a verb's or adverb's ending."""
    low = F.lower(name)
    words = F.split(low, r"\s+")
    phrase = low.contains(" ")
    in_phrase = _in(words[0], t.starters) | F.forall(words, lambda w: _in(w, t.filler) | (F.length(w) < 4))
    n = F.length(low)
    ending = (low.endswith("ly") & (n >= 6)) | (low.rlike("(ize|ify)$") & (n <= 8)) | (low.endswith("ment") & (n <= 9)) | low.rlike("(oes|ays|akes|ives)$")
    return ~_in(low, t.protected) & (_in(low, t.noise) | F.when(phrase, in_phrase).otherwise((n < 4) | ending))


def is_weak_single(name: Column, usage: Column, distinct: Column, t: Tuning = DEFAULT) -> Column:
    low = F.lower(name)
    suffix = low.rlike("(ed|ing|ment|ness|tion|sion|ance|ence)$")
    weak = is_noise(low, t) | ((distinct < 15) & (usage < 6)) | (suffix & (distinct < 20) & (usage < 20))
    return ~low.contains(" ") & ~_in(low, t.protected) & weak


def reject_reason(candidate: Column, slug: Column, kind: Column, t: Tuning = DEFAULT) -> Column:
    """The first reason against a candidate, or null."""
    words = F.filter(F.split(candidate, r"\s+"), lambda w: w != "")
    plain, one = kind != "entity", F.size(words) == 1
    edge = _in(words[0], t.stop) | _in(F.element_at(words, -1), t.stop)
    return (
        F.when(F.coalesce(candidate, F.lit("")) == "", "empty_candidate")
        .when(F.coalesce(slug, F.lit("")) == "", "empty_slug")
        .when(~slug.rlike("^[a-z0-9-]+$"), "malformed_slug")
        .when(F.length(slug) < 3, "short_slug")
        .when(plain & (F.size(words) == 0), "empty_candidate")
        .when(plain & one & (F.length(words[0]) < 4), "ultra_short_singleton")
        .when(plain & one & _in(words[0], t.stop), "stopword_singleton")
        .when(plain & (F.size(words) > 1) & edge, "filler_phrase_boundary")
        .when(plain & is_noise(candidate, t), "noise_candidate")
    )


def phrase_reason(name: Column, docs: Column, support: Column, quality: Column, t: Tuning = DEFAULT) -> Column:
    return (
        F.when(is_noise(name, t), "noise_phrase")
        .when(docs < t.lexicon_docs, "low_doc_count")
        .when(support < t.lexicon_support, "low_support_count")
        .when(quality < t.lexicon_quality, "low_quality_score")
    )


def prior_reason(name: Column, kind: Column, chunks: Column, distinct: Column, usage: Column, t: Tuning = DEFAULT) -> Column:
    """Reasons against single words before promotion."""
    open_to = ~_in(name, t.protected) & (kind != "entity") & ~name.contains(" ")
    return F.when(open_to & is_weak_single(name, chunks, distinct, t), "weak_singleton_prior").when(open_to & (distinct < t.singleton_distinctiveness) & (usage < 5), "low_distinctiveness_prior")


def promotion_reason(name: Column, kind: Column, chunks: Column, episodes: Column, distinct: Column, usage: Column, model: Column | None = None, fidelity: Column | None = None, t: Tuning = DEFAULT) -> Column:
    """Support thresholds; evidence from a model adds one to both supports, structure in the source adds more."""
    model, fidelity = model if model is not None else F.lit(0), fidelity if fidelity is not None else F.lit(0)
    extra = F.when(model > 0, 1).otherwise(0)
    episodes = episodes + extra + F.when(fidelity >= 2, 1).otherwise(0)
    chunks = chunks + extra + F.least(fidelity, F.lit(2))
    distinct = distinct + F.least(fidelity, F.lit(3)) * 6
    phrase = name.contains(" ")
    need = lambda p, s: F.when(phrase, p).otherwise(s)
    return F.when(_in(name, t.protected) | (kind == "entity"), F.lit(None).cast("string")).otherwise(
        F.when(episodes < need(t.phrase_episode_support, t.episode_support), "insufficient_episode_support")
        .when(chunks < need(t.phrase_chunk_support, t.chunk_support), "insufficient_chunk_support")
        .when(~phrase & (distinct < t.singleton_distinctiveness) & (usage < 8), "low_distinctiveness_support")
    )


def display_reason(name: Column, kind: Column, support: Column, usage: Column, distinct: Column, t: Tuning = DEFAULT) -> Column:
    low = F.lower(name)
    open_to = ~_in(low, t.protected) & (kind != "entity")
    weak = ~low.contains(" ") & (usage < t.visible_usage) & (distinct < t.visible_distinctiveness)
    return F.when(open_to & (support < t.visible_episodes), "low_episode_spread").when(open_to & weak, "weak_singleton_filter")


def phrase_usage(topics: DataFrame) -> DataFrame:
    """word, phrase_usage: how often phrases that hold a word are used."""
    words = topics.filter(F.col("name").contains(" ")).select("usage", F.explode(F.array_distinct(F.split(F.lower("name"), r"\s+"))).alias("word"))
    return words.groupBy("word").agg(F.sum("usage").alias("phrase_usage"))


def suppress_components(topics: DataFrame) -> DataFrame:
    """Single words that no phrase among the topics holds, and all phrases."""
    words = phrase_usage(topics).select(F.col("word").alias("low"))
    return topics.withColumn("low", F.lower("name")).join(words, "low", "left_anti").drop("low")


def curate(topics: DataFrame, share: float = 0.25, t: Tuning = DEFAULT) -> DataFrame:
    """topics (name, usage, distinctiveness) with keep: no noise, no weak single word, no word that phrases use as much."""
    low = F.lower("name")
    rows = topics.withColumn("low", low).join(phrase_usage(topics), F.col("low") == F.col("word"), "left").drop("word")
    single = ~F.col("low").contains(" ")
    short = single & (F.length("low") < 4) & (F.col("usage") < 20)
    subsumed = single & F.col("phrase_usage").isNotNull() & (F.col("phrase_usage") >= F.col("usage") * share)
    bad = _in(F.col("low"), t.noise) | short | is_weak_single(F.col("low"), F.col("usage"), F.col("distinctiveness"), t) | subsumed
    return rows.withColumn("keep", ~bad).drop("low", "phrase_usage")
