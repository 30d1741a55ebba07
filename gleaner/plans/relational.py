"""Registered read-side queries and their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from gleaner.operators import analytics as A
from gleaner.operators.pages import topic_pages
from gleaner.plans.roles import SQL, Corpus
from gleaner.sources.shared import written

D = datetime.date
NOW, BEFORE = (D(1998, 4, 1), D(1998, 4, 30)), (D(1998, 3, 1), D(1998, 3, 31))
_NOW = "published BETWEEN DATE '1998-04-01' AND DATE '1998-04-30'"
_BEFORE = "published BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'"
_WEIGHT = "ln(1 + greatest(greatest(current, previous), 1)) * (1 + greatest(distinctiveness, 0) / 10)"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _q(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = SQL + sql
        return f

    return add


@_q("topic_counts_in_period", f"SELECT topic_id, count(*) AS n FROM dated WHERE {_NOW} GROUP BY topic_id")
def _(c):
    return A.topic_counts(c.within(*NOW).dated, *NOW)


@_q("episodes_in_period", f"SELECT e.episode_id, e.published, count(c.chunk_id) AS chunks FROM episodes e LEFT JOIN chunks c USING (episode_id) WHERE e.published BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY ALL")
def _(c):
    here = c.episodes.filter(A.within("published", D(1998, 1, 1), D(1998, 12, 31)))
    return here.join(c.chunks.select("episode_id", "chunk_id"), "episode_id", "left").groupBy("episode_id", "published").agg(F.count("chunk_id").alias("chunks"))


@_q("chunks_in_period", f"SELECT chunk_id, episode_id FROM chunks WHERE {_NOW}")
def _(c):
    return c.within(*NOW).chunks.select("chunk_id", "episode_id")


@_q("top_topics_weighted", "SELECT topic_id, name, usage, round(usage * CASE WHEN distinctiveness > 0 THEN distinctiveness WHEN name LIKE '% %' THEN 20.0 ELSE 1.0 END, 6) AS score FROM used WHERE NOT hidden ORDER BY score DESC, topic_id LIMIT 50")
def _(c):
    return A.top_topics(c.used, 50)


@_q("topic_rank_history", "SELECT * FROM (SELECT year, topic_id, n, CAST(row_number() OVER (PARTITION BY year ORDER BY n DESC, topic_id) AS INTEGER) AS rank FROM (SELECT CAST(year(published) AS INTEGER) AS year, topic_id, count(*) AS n FROM dated GROUP BY ALL)) WHERE rank <= 10")
def _(c):
    return A.rank_history(c.dated, 10)


@_q("adjacent_topics", "SELECT topic_id, CAST(row_number() OVER w AS BIGINT) AS rank, lag(topic_id) OVER w AS above, lead(topic_id) OVER w AS below FROM used WHERE NOT hidden WINDOW w AS (ORDER BY usage DESC, distinctiveness DESC, name, topic_id)")
def _(c):
    return A.neighbours_in_rank(c.used.filter(A.visible()))


@_q("topic_sparkline_dense", "SELECT t.topic_id, e.episode_id, count(d.chunk_id) AS n FROM (SELECT topic_id FROM used WHERE NOT hidden ORDER BY usage DESC, topic_id LIMIT 10) t CROSS JOIN episodes e LEFT JOIN dated d ON d.topic_id = t.topic_id AND d.episode_id = e.episode_id GROUP BY ALL")
def _(c):
    top = c.used.filter(A.visible()).orderBy(F.desc("usage"), "topic_id").limit(10)
    return A.sparkline(c.dated, c.episodes, top)


@_q("topic_interest_cv", "SELECT topic_id, round(cv * log2(usage + 1) * CASE WHEN name LIKE '% %' THEN 1.5 ELSE 1.0 END, 6) AS interest FROM (SELECT topic_id, stddev_pop(n) / avg(n) AS cv FROM (SELECT topic_id, episode_id, count(*) AS n FROM dated GROUP BY ALL) GROUP BY topic_id) JOIN used USING (topic_id)")
def _(c):
    return A.interest(c.dated, c.used)


@_q(
    "period_movers",
    f", both_ways AS (SELECT topic_id, coalesce(a.n, 0) AS current, coalesce(b.n, 0) AS previous FROM (SELECT topic_id, count(*) AS n FROM dated WHERE {_NOW} GROUP BY topic_id) a FULL JOIN (SELECT topic_id, count(*) AS n FROM dated WHERE {_BEFORE} GROUP BY topic_id) b USING (topic_id)), scored AS (SELECT topic_id, current, previous, current - previous AS delta, CASE WHEN current > previous THEN 'up' ELSE 'down' END AS way, round(abs(current - previous) * {_WEIGHT}, 6) AS score FROM both_ways JOIN used USING (topic_id) WHERE NOT hidden AND current != previous) SELECT * FROM (SELECT way, CAST(row_number() OVER (PARTITION BY way ORDER BY score DESC, topic_id) AS INTEGER) AS rank, topic_id, current, previous, delta, score FROM scored) WHERE rank <= 20",
)
def _(c):
    return A.movers(c.dated, c.used, NOW, BEFORE, 20)


@_q("period_new_topics", "SELECT topic_id, first_seen, n, round(ln(1 + greatest(n, 1)) * (1 + greatest(distinctiveness, 0) / 10), 6) AS score FROM (SELECT topic_id, min(published) AS first_seen, count(*) FILTER (WHERE published BETWEEN DATE '1995-02-01' AND DATE '1995-03-31') AS n FROM dated GROUP BY topic_id) JOIN used USING (topic_id) WHERE NOT hidden AND first_seen BETWEEN DATE '1995-02-01' AND DATE '1995-03-31' ORDER BY score DESC, topic_id LIMIT 20")
def _(c):
    return A.new_topics(c.dated, c.used, D(1995, 2, 1), D(1995, 3, 31), 20)


@_q("archive_contrast", f"SELECT topic_id, n, usage, ratio FROM (SELECT topic_id, n, usage, round((n / (SELECT count(*) FROM episodes WHERE {_NOW})) / (usage / (SELECT count(*) FROM episodes)), 6) AS ratio FROM (SELECT topic_id, count(*) AS n FROM dated WHERE {_NOW} GROUP BY topic_id) JOIN used USING (topic_id) WHERE NOT hidden) WHERE ratio > 1.5 ORDER BY ratio DESC, topic_id LIMIT 25")
def _(c):
    return A.archive_contrast(c.dated, c.episodes, c.used, *NOW, 25)


@_q("novel_topic_history", "SELECT episode_id, count(*) AS novel FROM (SELECT topic_id, min(published) AS published, min(episode_id) AS episode_id FROM dated GROUP BY topic_id) WHERE published >= (SELECT max(published) FROM dated) - INTERVAL 84 MONTH GROUP BY episode_id")
def _(c):
    return A.novel_history(c.dated, 84)


@_q("first_occurrence", "SELECT topic_id, min(published) AS first_seen FROM dated GROUP BY topic_id")
def _(c):
    return A.first_seen(c.dated)


@_q(
    "episode_blended_topics",
    ", counts AS (SELECT episode_id, topic_id, count(*) AS n FROM dated GROUP BY ALL), main AS (SELECT * FROM (SELECT episode_id, topic_id, 'main' AS tier, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY n DESC, topic_id) AS INTEGER) AS rank FROM counts) WHERE rank <= 5), scored AS (SELECT episode_id, topic_id, round(n * ln((SELECT count(*) FROM episodes) / df), 6) AS tfidf FROM counts JOIN (SELECT topic_id, count(*) AS df FROM counts GROUP BY topic_id) USING (topic_id) WHERE n >= 2) SELECT * FROM main UNION ALL SELECT * FROM (SELECT episode_id, topic_id, 'distinctive' AS tier, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY tfidf DESC, topic_id) AS INTEGER) AS rank FROM scored ANTI JOIN main USING (episode_id, topic_id)) WHERE rank <= 5",
)
def _(c):
    return A.blended_topics(c.dated, c.episodes, 5, 5)


_PAIRS = ", every AS (SELECT x.chunk_id, x.episode_id, x.topic_id AS a, y.topic_id AS b FROM dated x JOIN dated y ON x.chunk_id = y.chunk_id AND x.topic_id < y.topic_id)"


@_q("unexpected_pairings", _PAIRS + " SELECT a, b, count(*) FILTER (WHERE episode_id = 199804) AS here, count(*) FILTER (WHERE episode_id != 199804) AS elsewhere FROM every GROUP BY a, b HAVING here >= 1 ORDER BY elsewhere, here DESC, a, b LIMIT 40")
def _(c):
    return A.unexpected_pairs(c.dealt_dated, 199804, 40, parts=c.parts)


@_q("most_novel_chunks", "SELECT chunk_id, round(avg(ln(((SELECT count(*) FROM episodes WHERE published < DATE '1996-04-01') + 1) / (coalesce(prior, 0) + 1))), 6) AS novelty FROM dated LEFT JOIN (SELECT topic_id, count(DISTINCT episode_id) AS prior FROM dated WHERE published < DATE '1996-04-01' GROUP BY topic_id) USING (topic_id) WHERE published = DATE '1996-04-01' GROUP BY chunk_id ORDER BY novelty DESC, chunk_id LIMIT 20")
def _(c):
    return A.novelty(c.dated, c.episodes, D(1996, 4, 1), 20)


@_q(
    "since_last",
    f", both_ways AS (SELECT topic_id, coalesce(a.n, 0) AS current, coalesce(b.n, 0) AS previous FROM (SELECT topic_id, count(*) AS n FROM dated WHERE published = DATE '1998-04-01' GROUP BY topic_id) a FULL JOIN (SELECT topic_id, count(*) AS n FROM dated WHERE published = DATE '1998-03-01' GROUP BY topic_id) b USING (topic_id)), scored AS (SELECT topic_id, current, previous, CASE WHEN previous = 0 THEN 'new' WHEN current = 0 THEN 'disappeared' WHEN current > previous THEN 'intensified' ELSE 'downshifted' END AS change, round(abs(current - previous) * {_WEIGHT}, 6) AS score FROM both_ways JOIN used USING (topic_id) WHERE current != previous) SELECT * FROM (SELECT change, CAST(row_number() OVER (PARTITION BY change ORDER BY score DESC, topic_id) AS INTEGER) AS rank, topic_id, current, previous, score FROM scored) WHERE rank <= 3",
)
def _(c):
    return A.since_last(c.dated, c.used, D(1998, 4, 1), D(1998, 3, 1), 3)


@_q("related_topics_cooccurrence", _PAIRS + ", p AS (SELECT a, b, count(*) AS shared FROM every GROUP BY a, b) SELECT * FROM (SELECT topic_id, other_id, shared, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY shared DESC, other_id) AS INTEGER) AS rank FROM (SELECT a AS topic_id, b AS other_id, shared FROM p UNION ALL SELECT b, a, shared FROM p)) WHERE rank <= 5")
def _(c):
    return A.related(c.dealt_links, 5, c.parts)


@_q("topic_jaccard", _PAIRS + ", s AS (SELECT topic_id, count(*) AS size FROM links GROUP BY topic_id), p AS (SELECT a, b, count(*) AS overlap FROM every GROUP BY a, b), j AS (SELECT a, b, overlap, round(overlap / (sa.size + sb.size - overlap), 6) AS jaccard, round(overlap / (sa.size + sb.size - overlap), 6) AS score FROM p JOIN s sa ON sa.topic_id = a JOIN s sb ON sb.topic_id = b) SELECT * FROM (SELECT topic_id, other_id, overlap, jaccard, score, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, other_id) AS INTEGER) AS rank FROM (SELECT a AS topic_id, b AS other_id, overlap, jaccard, score FROM j UNION ALL SELECT b, a, overlap, jaccard, score FROM j)) WHERE rank <= 12")
def _(c):
    return A.jaccard_blend(c.dealt_links, None, 12, c.parts)


@_q("thread_chunks", "SELECT chunk_id, count(*) AS shared FROM links WHERE chunk_id != 7 AND topic_id IN (SELECT topic_id FROM links WHERE chunk_id = 7) GROUP BY chunk_id ORDER BY shared DESC, chunk_id LIMIT 20")
def _(c):
    return A.thread(c.links, 7, 20)


@_q("most_connected_reach", "SELECT chunk_id, reach FROM (SELECT c.chunk_id, CAST(coalesce(sum(u.usage), 0) AS BIGINT) AS reach FROM chunks c LEFT JOIN links l USING (chunk_id) LEFT JOIN used u ON u.topic_id = l.topic_id AND NOT u.hidden GROUP BY c.chunk_id) ORDER BY reach DESC, chunk_id LIMIT 30")
def _(c):
    return A.reach(c.links, c.used, c.chunks).orderBy(F.desc("reach"), "chunk_id").limit(30)


@_q("chunk_reach", "SELECT c.chunk_id, CAST(coalesce(sum(u.usage), 0) AS BIGINT) AS reach FROM chunks c LEFT JOIN links l USING (chunk_id) LEFT JOIN used u ON u.topic_id = l.topic_id AND NOT u.hidden GROUP BY c.chunk_id")
def _(c):
    return A.reach(c.links, c.used, c.chunks)


@_q("burst_score", ", per AS (SELECT topic_id, CAST(year(published) * 4 + quarter(published) - 1 AS BIGINT) AS q, count(*) AS n FROM dated GROUP BY ALL) SELECT topic_id, round(max(n) / (sum(n) / (max(q) - min(q) + 1)), 6) AS burst, (SELECT CAST(x.q // 4 AS VARCHAR) || '-Q' || CAST(x.q % 4 + 1 AS VARCHAR) FROM per x WHERE x.topic_id = per.topic_id ORDER BY x.n DESC, x.q LIMIT 1) AS peak_quarter FROM per GROUP BY topic_id")
def _(c):
    return A.burst(c.dated)


@_q("all_topics_filter", ", top AS (SELECT a, b FROM (SELECT x.topic_id AS a, y.topic_id AS b, count(*) AS n FROM links x JOIN links y ON x.chunk_id = y.chunk_id AND x.topic_id < y.topic_id GROUP BY ALL) ORDER BY n DESC, a, b LIMIT 1) SELECT chunk_id FROM links WHERE topic_id IN (SELECT a FROM top UNION ALL SELECT b FROM top) GROUP BY chunk_id HAVING count(DISTINCT topic_id) = 2")
def _(c):
    top = A.by_pair(A.pairs(c.dealt_links).select("a", "b"), c.parts).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").first()
    return A.all_topics(c.links, [top["a"], top["b"]])


@_q("drift_sample_early_late", ", r AS (SELECT chunk_id, row_number() OVER (ORDER BY published, chunk_id) AS e, row_number() OVER (ORDER BY published DESC, chunk_id DESC) AS l FROM dated WHERE topic_id = 5) SELECT chunk_id, CASE WHEN e <= 30 THEN 'early' ELSE 'late' END AS part FROM r WHERE e <= 30 OR l <= 30")
def _(c):
    return A.drift_sample(c.dated, 5, 30)


@_q("adjacent_chunks", "SELECT chunk_id, lag(chunk_id) OVER w AS previous, lead(chunk_id) OVER w AS next FROM chunks WINDOW w AS (PARTITION BY episode_id ORDER BY chunk_id)")
def _(c):
    return A.adjacent(c.chunks, ["episode_id"], [F.asc("chunk_id")], "chunk_id").select("chunk_id", "previous", "next")


@_q("trending_for_episode", "SELECT topic_id, n, usage, ratio FROM (SELECT topic_id, n, usage, round(n / (usage / (SELECT count(*) FROM episodes)), 6) AS ratio FROM (SELECT topic_id, count(*) AS n FROM dated WHERE episode_id = 199804 GROUP BY topic_id) JOIN used USING (topic_id) WHERE NOT hidden AND support >= 1) WHERE ratio > 2.0 ORDER BY ratio DESC, topic_id LIMIT 30")
def _(c):
    return A.trending(c.dated, c.used, c.episodes, 199804, 30)


@_q("year_index_cards", "SELECT m.month, coalesce(c.n, 0) AS chunks, coalesce(f.n, 0) AS new_topics FROM (SELECT CAST(range AS INTEGER) AS month FROM range(1, 13)) m LEFT JOIN (SELECT CAST(month(published) AS INTEGER) AS month, count(*) AS n FROM chunks WHERE year(published) = 1995 GROUP BY ALL) c USING (month) LEFT JOIN (SELECT CAST(month(s) AS INTEGER) AS month, count(*) AS n FROM (SELECT min(published) AS s FROM dated GROUP BY topic_id) WHERE year(s) = 1995 GROUP BY ALL) f USING (month)")
def _(c):
    return A.year_cards(c.dated, c.chunks, 1995)


@_q("usage_recount", "SELECT topic_id, usage, support FROM used")
def _(c):
    return c.used.select("topic_id", "usage", "support")


@_q("left_join_zero_counts", "SELECT t.topic_id, count(d.chunk_id) AS n FROM topics t LEFT JOIN (SELECT * FROM dated WHERE episode_id = 199804) d USING (topic_id) GROUP BY t.topic_id")
def _(c):
    return c.topics.join(c.dated.filter("episode_id = 199804"), "topic_id", "left").groupBy("topic_id").agg(F.count("chunk_id").alias("n"))


@_q("orphan_audit", "SELECT topic_id FROM topics WHERE topic_id NOT IN (SELECT topic_id FROM links)")
def _(c):
    return c.topics.join(c.links, "topic_id", "left_anti").select("topic_id")


@_q("invariant_audit", "SELECT 'links_without_chunk' AS invariant, count(*) AS n FROM links WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks) UNION ALL SELECT 'links_without_topic', count(*) FROM links WHERE topic_id NOT IN (SELECT topic_id FROM topics) UNION ALL SELECT 'topics_without_links', count(*) FROM topics WHERE topic_id NOT IN (SELECT topic_id FROM links) UNION ALL SELECT 'chunks_without_links', count(*) FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM links)")
def _(c):
    return A.invariants(c.chunks, c.links, c.topics)


@_q("baseline_diff", ", a AS (SELECT topic_id AS key, count(*) AS v FROM dated WHERE episode_id = 199803 GROUP BY topic_id), b AS (SELECT topic_id AS key, count(*) AS v FROM dated WHERE episode_id = 199804 GROUP BY topic_id) SELECT key, a.v AS \"left\", b.v AS \"right\", coalesce(b.v, 0) - coalesce(a.v, 0) AS delta, CASE WHEN a.v IS NULL THEN 'left' WHEN b.v IS NULL THEN 'right' ELSE 'none' END AS missing FROM a FULL JOIN b USING (key)")
def _(c):
    return A.baseline_diff(A.topic_counts(c.dated, *BEFORE), A.topic_counts(c.dated, *NOW))


@_q("lineage_compaction", "SELECT topic_id, CAST(year(published) AS INTEGER) AS year, min(published) AS first_at, max(published) AS last_at, count(*) AS archived, arg_max(chunk_id, (published, chunk_id)) AS last_id FROM dated GROUP BY ALL")
def _(c):
    rows = c.dated.select("topic_id", F.year("published").alias("year"), F.col("published").alias("at"), F.col("chunk_id").alias("id"))
    return A.compact_lineage(rows, ["topic_id", "year"])


@_q("keep_min_id_dedup", "SELECT name, min(topic_id) AS topic_id FROM topics GROUP BY name")
def _(c):
    return A.keep_least(c.topics.select("name", "topic_id"), ["name"], "topic_id")


@_q("support_gate", "SELECT topic_id, support FROM used WHERE kind != 'entity' AND support >= (SELECT greatest(2, CAST(ceil(log2(greatest(1, count(*)))) AS INTEGER)) FROM episodes)")
def _(c):
    threshold = c.episodes.agg(A.support_threshold(F.count("*")).alias("k"))
    return c.used.filter("kind != 'entity'").crossJoin(F.broadcast(threshold)).filter("support >= k").select("topic_id", "support")


@_q("corpus_totals", "SELECT (SELECT count(*) FROM episodes) AS episodes, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM used WHERE usage = 1) AS singletons, (SELECT count(*) FROM used WHERE NOT hidden) AS visible")
def _(c):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    topics = c.used.agg(F.count_if(F.col("usage") == 1).alias("singletons"), F.count_if(A.visible()).alias("visible"))
    return one(c.episodes, "episodes").crossJoin(one(c.chunks, "chunks")).crossJoin(one(c.links, "links")).crossJoin(topics)


@_q("episodes_union_distinct", "SELECT episode_id FROM chunks WHERE published < DATE '1996-01-01' UNION SELECT episode_id FROM dated JOIN topics USING (topic_id) WHERE kind = 'entity' AND hidden")
def _(c):
    old = c.chunks.filter(F.col("published") < F.lit(D(1996, 1, 1))).select("episode_id")
    return old.union(c.dated.join(c.topics.filter("kind = 'entity' AND hidden"), "topic_id").select("episode_id")).distinct()


@_q("paged_topics", "SELECT topic_id, usage FROM used WHERE NOT hidden ORDER BY usage DESC, topic_id LIMIT 20 OFFSET 40")
def _(c):
    return c.used.filter(A.visible()).orderBy(F.desc("usage"), "topic_id").offset(40).limit(20).select("topic_id", "usage")


@_q("name_merge", "SELECT name, arg_max(topic_id, (usage, -topic_id)) AS keeper, count(*) AS merged, CAST(sum(usage) AS BIGINT) AS usage FROM used GROUP BY name")
def _(c):
    best = F.max(F.struct("usage", (-F.col("topic_id")).alias("less")))
    return c.used.groupBy("name").agg((-best["less"]).alias("keeper"), F.count("*").alias("merged"), F.sum("usage").alias("usage"))


@_q("episode_topics_rebuild", "SELECT DISTINCT episode_id, topic_id FROM dated")
def _(c):
    return c.dated.select("episode_id", "topic_id").distinct()


@_q("topic_lookup", "SELECT topic_id, name, usage, support FROM used WHERE topic_id = 1 AND NOT hidden")
def _(c):
    return c.used.filter((F.col("topic_id") == 1) & A.visible()).select("topic_id", "name", "usage", "support")


@_q("chunk_with_episode", "SELECT chunk_id, e.episode_id, e.published FROM chunks JOIN episodes e USING (episode_id) WHERE chunk_id = 7")
def _(c):
    return c.chunks.filter("chunk_id = 7").select("chunk_id", "episode_id").join(c.episodes, "episode_id").select("chunk_id", "episode_id", "published")


@_q("chunks_of_episode", "SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS position FROM chunks WHERE episode_id = 199804")
def _(c):
    from pyspark.sql import Window

    here = c.chunks.filter("episode_id = 199804")
    return here.select("chunk_id", F.row_number().over(Window.partitionBy("episode_id").orderBy("chunk_id")).cast("long").alias("position"))


@_q("next_episode", "SELECT episode_id, (SELECT min(n.episode_id) FROM episodes n WHERE n.published > e.published) AS following FROM episodes e")
def _(c):
    from pyspark.sql import Window

    return c.episodes.withColumn("one", F.lit(1)).select("episode_id", F.lead("episode_id").over(Window.partitionBy("one").orderBy("published")).alias("following"))  # months: a short table


@_q("topic_distribution", "SELECT count(*) FILTER (usage = 1) / count(*) AS single_share, CAST(count(*) FILTER (usage BETWEEN 2 AND 9) AS BIGINT) AS few, CAST(count(*) FILTER (usage BETWEEN 10 AND 49) AS BIGINT) AS some, CAST(count(*) FILTER (usage >= 50) AS BIGINT) AS many, min(length(name)) AS shortest, max(length(name)) AS longest FROM used")
def _(c):
    use, name = F.col("usage"), F.length("name").cast("long")
    return c.used.agg((F.count_if(use == 1) / F.count("*")).alias("single_share"), F.count_if(use.between(2, 9)).alias("few"), F.count_if(use.between(10, 49)).alias("some"), F.count_if(use >= 50).alias("many"), F.min(name).alias("shortest"), F.max(name).alias("longest"))


@_q("topic_histogram", "SELECT CAST(floor(usage / 5) AS BIGINT) AS bucket, count(*) AS topics, max(usage) AS most FROM used GROUP BY ALL")
def _(c):
    return c.used.groupBy(F.floor(F.col("usage") / 5).alias("bucket")).agg(F.count("*").alias("topics"), F.max("usage").alias("most"))


@_q("topic_chunks", "SELECT chunk_id, episode_id, published FROM dated WHERE topic_id = 5 ORDER BY published DESC, chunk_id LIMIT 40")
def _(c):
    return c.dated.filter("topic_id = 5").orderBy(F.desc("published"), "chunk_id").limit(40).select("chunk_id", "episode_id", "published")


@_q("topic_episodes", "SELECT episode_id, count(*) AS n FROM dated WHERE topic_id = 5 GROUP BY episode_id")
def _(c):
    return c.dated.filter("topic_id = 5").groupBy("episode_id").agg(F.count("*").alias("n"))


@_q("chunk_topics", "SELECT topic_id, name, usage FROM links JOIN used USING (topic_id) WHERE chunk_id = 7 AND NOT hidden")
def _(c):
    return c.links.filter("chunk_id = 7").join(c.used, "topic_id").filter(A.visible()).select("topic_id", "name", "usage")


@_q("previous_episode", "SELECT episode_id, (SELECT max(p.episode_id) FROM episodes p WHERE p.published < e.published) AS previous FROM episodes e")
def _(c):
    from pyspark.sql import Window

    per_year = Window.partitionBy("one").orderBy("published")  # months of the corpus: a short table
    return c.episodes.withColumn("one", F.lit(1)).select("episode_id", F.lag("episode_id").over(per_year).alias("previous"))


@_q("recent_episodes", "SELECT episode_id, published FROM episodes ORDER BY published DESC LIMIT 12")
def _(c):
    return c.episodes.orderBy(F.desc("published")).limit(12)


@_q("episodes_by_year", "SELECT CAST(year(published) AS INTEGER) AS year, count(*) AS episodes, string_agg(episode_id::VARCHAR, ',' ORDER BY episode_id) AS listed FROM episodes GROUP BY ALL")
def _(c):
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("episode_id")), lambda x: x.cast("string")), ",")
    return c.episodes.groupBy(F.year("published").alias("year")).agg(F.count("*").alias("episodes"), listed.alias("listed"))


@_q("topic_halves", "SELECT half, count(*) AS n, min(chunk_id) AS first_id FROM (SELECT chunk_id, CAST(ntile(2) OVER (ORDER BY published, chunk_id) AS INTEGER) AS half FROM dated WHERE topic_id = 5) GROUP BY half")
def _(c):
    from pyspark.sql import Window

    w = Window.partitionBy("topic_id").orderBy("published", "chunk_id")
    return c.dated.filter("topic_id = 5").withColumn("half", F.ntile(2).over(w)).groupBy("half").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"))


@_q("share_of_period", f"SELECT topic_id, round(count(*) FILTER (WHERE {_NOW}) / count(*), 6) AS share FROM dated GROUP BY topic_id HAVING count(*) FILTER (WHERE {_NOW}) > 0")
def _(c):
    inside = F.count_if(A.within("published", *NOW))
    return c.dated.groupBy("topic_id").agg(F.round(inside / F.count("*"), 6).alias("share"), inside.alias("n")).filter("n > 0").drop("n")


@_q("first_and_last_use", "SELECT topic_id, arg_min(chunk_id, (published, chunk_id)) AS first_chunk, arg_max(chunk_id, (published, chunk_id)) AS last_chunk FROM dated GROUP BY topic_id")
def _(c):
    at = F.struct("published", "chunk_id")
    return c.dated.groupBy("topic_id").agg(F.min(at)["chunk_id"].alias("first_chunk"), F.max(at)["chunk_id"].alias("last_chunk"))


@_q("disappeared_topics", f"SELECT DISTINCT topic_id FROM dated WHERE {_BEFORE} EXCEPT SELECT topic_id FROM dated WHERE {_NOW}")
def _(c):
    return c.dated.filter(A.within("published", *BEFORE)).select("topic_id").distinct().join(c.dated.filter(A.within("published", *NOW)), "topic_id", "left_anti")


@_q("kind_by_support", "SELECT kind, support >= 5 AS wide, count(*) AS topics, CAST(sum(usage) AS BIGINT) AS usage FROM used GROUP BY ALL")
def _(c):
    return c.used.groupBy("kind", (F.col("support") >= 5).alias("wide")).agg(F.count("*").alias("topics"), F.sum("usage").alias("usage"))


@_q("usage_quantile_bands", "SELECT topic_id, usage, CAST(CASE WHEN usage = 0 THEN 0 WHEN usage < 3 THEN 1 WHEN usage < 10 THEN 2 ELSE 3 END AS INTEGER) AS band FROM used")
def _(c):
    band = F.when(F.col("usage") == 0, 0).when(F.col("usage") < 3, 1).when(F.col("usage") < 10, 2).otherwise(3)
    return c.used.select("topic_id", "usage", band.alias("band"))


def _words(df):
    """chunk_id, word, n of the names of a chunk's topics."""
    return df.select("chunk_id", F.explode(F.split("name", " ")).alias("word")).groupBy("chunk_id", "word").agg(F.count("*").alias("n"))


_EARLIER = "published < DATE '1998-04-01'"


@_q(
    "corpus_invariants",
    f""", named AS (SELECT d.chunk_id, d.published, unnest(string_split(name, ' ')) AS word FROM dated d JOIN topics USING (topic_id)),
    episode_topics AS (SELECT DISTINCT episode_id, topic_id FROM dated), stored AS (SELECT topic_id, count(*) AS usage, count(DISTINCT episode_id) AS support FROM dated WHERE {_EARLIER} GROUP BY topic_id)
    SELECT *, orphan_chunk_topics + orphan_episode_topics + orphan_chunk_words + usage_mismatches + support_mismatches + drifted_episodes + abs(word_total_delta) = 0 AS healthy FROM (SELECT
        (SELECT count(*) FROM links WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE {_EARLIER})) AS orphan_chunk_topics,
        (SELECT count(*) FROM episode_topics WHERE episode_id NOT IN (SELECT episode_id FROM episodes WHERE {_EARLIER})) AS orphan_episode_topics,
        (SELECT count(*) FROM (SELECT DISTINCT chunk_id, word FROM named) WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE {_EARLIER})) AS orphan_chunk_words,
        (SELECT count(*) FROM used LEFT JOIN stored s USING (topic_id) WHERE coalesce(s.usage, 0) != used.usage) AS usage_mismatches,
        (SELECT count(*) FROM used LEFT JOIN stored s USING (topic_id) WHERE coalesce(s.support, 0) != used.support) AS support_mismatches,
        (SELECT count(*) FROM (SELECT episode_id, count(*) AS n, count(*) FILTER (WHERE {_EARLIER}) AS m FROM chunks GROUP BY episode_id) WHERE n != m AND m > 0) AS drifted_episodes,
        (SELECT count(*) FROM named) - (SELECT count(*) FROM named WHERE {_EARLIER}) AS word_total_delta)""",
)
def _(c):
    """The state as it was stored before the last months, held against all that has come since."""
    earlier = F.col("published") < F.lit(D(1998, 4, 1))
    dated = written(c.dealt_dated, "dated")  # read for five of the counts
    named = dated.join(c.topics.select("topic_id", "name"), "topic_id").select("chunk_id", "published", "name").repartition(c.parts, "chunk_id")
    stored = dated.filter(earlier).groupBy("topic_id").agg(F.count("*").alias("usage"), F.count_distinct("episode_id").alias("support"))
    return A.corpus_invariants(
        chunks=c.chunks.filter(earlier).repartition(c.parts, "chunk_id"),
        episodes=c.episodes.filter(earlier).join(c.chunks.groupBy("episode_id").agg(F.count("*").alias("chunk_count")), "episode_id"),
        links=c.dealt_links,
        topics=c.topics.select("topic_id").join(stored, "topic_id", "left").fillna(0),
        episode_topics=dated.select("topic_id", "episode_id").repartition(c.parts, "topic_id").distinct(),
        chunk_words=_words(named),
        word_stats=_words(named.filter(earlier)).groupBy("word").agg(F.sum("n").alias("total")),
    )


_MANY = "{0} || ' {1}' || CASE WHEN {0} = 1 THEN '' ELSE 's' END"
_LIST = "CASE len({0}) WHEN 0 THEN '' WHEN 1 THEN {0}[1] WHEN 2 THEN {0}[1] || ' and ' || {0}[2] ELSE array_to_string({0}[:-2], ', ') || ', and ' || {0}[-1] END"


@_q(
    "topic_pages",
    f""", seen AS (SELECT topic_id, name, row_number() OVER w AS place, lag(name) OVER w AS above, lead(name) OVER w AS below FROM used WHERE NOT hidden WINDOW w AS (ORDER BY usage DESC, distinctiveness DESC, name, topic_id)),
    span AS (SELECT topic_id, count(*) AS chunks, count(DISTINCT episode_id) AS episodes, min(published) AS first, max(published) AS last FROM dated GROUP BY topic_id),
    peak AS (SELECT topic_id, episode_id AS peak_episode, published AS peak_day, count(*) AS peak_n FROM dated GROUP BY topic_id, episode_id, published QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, published, episode_id) = 1),
    yearly AS (SELECT year(published) AS y, topic_id, row_number() OVER (PARTITION BY year(published) ORDER BY count(*) DESC, topic_id) AS r FROM dated GROUP BY year(published), topic_id),
    ends AS (SELECT topic_id, min(y) AS y1, max(y) AS y2, arg_min(r, y) AS r1, arg_max(r, y) AS r2 FROM yearly GROUP BY topic_id),
    own AS (SELECT chunk_id, topic_id, name FROM links JOIN seen USING (topic_id)),
    shared AS (SELECT a.topic_id, b.topic_id AS other_id, b.name, count(*) AS n FROM own a JOIN own b ON a.chunk_id = b.chunk_id AND a.topic_id != b.topic_id GROUP BY a.topic_id, b.topic_id, b.name QUALIFY row_number() OVER (PARTITION BY a.topic_id ORDER BY count(*) DESC, b.topic_id) <= 3),
    others AS (SELECT topic_id, list(name ORDER BY n DESC, other_id) AS related FROM shared GROUP BY topic_id),
    page AS (SELECT *, coalesce(related, []) AS rel, list_filter([above, below], lambda x: x IS NOT NULL) AS near, CASE WHEN y1 != y2 THEN 'its yearly rank moved from #' || r1 || ' in ' || y1 || ' to #' || r2 || ' in ' || y2 END AS moved
        FROM seen JOIN span USING (topic_id) JOIN peak USING (topic_id) JOIN ends USING (topic_id) LEFT JOIN others USING (topic_id))
    SELECT topic_id, chunks, episodes, peak_episode, array_to_string(rel, '|') AS related,
        name || ' appears in ' || {_MANY.format('chunks', 'chunk')} || CASE WHEN first = last THEN ' from ' || first || '.' ELSE ' across ' || {_MANY.format('episodes', 'episode')} || ', from ' || first || ' to ' || last || '.' END
        || ' Its densest episode is ' || peak_episode || ' (' || peak_day || '), with ' || {_MANY.format('peak_n', 'observation')} || ' on this topic. '
        || CASE WHEN len(rel) > 0 AND len(near) > 0 THEN 'Semantically it travels with ' || {_LIST.format('rel')} || ', while by chunk count it sits between ' || {_LIST.format('near')} || coalesce('; ' || moved, '') || '.'
            WHEN len(rel) > 0 THEN 'It most often travels with ' || {_LIST.format('rel')} || coalesce('; ' || moved, '') || '.'
            WHEN len(near) > 0 THEN 'By chunk count it sits between ' || {_LIST.format('near')} || coalesce('; ' || moved, '') || '.' ELSE 'I' || moved[2:] || '.' END AS summary FROM page""",
)
def _(c):
    """All that a topic's page tells, with its summary."""
    # what a topic has in each episode is counted once; its use, span, peak and years are sums of that
    per = c.dealt_dated.select("topic_id", "episode_id", "published").repartition(c.parts, "topic_id").groupBy("topic_id", "episode_id", "published").agg(F.count("*").alias("n"))
    per = written(per, "per-episode")
    use = per.groupBy("topic_id").agg(F.sum("n").alias("usage"), F.count_distinct("episode_id").alias("support"))
    used = written(c.topics.join(use, "topic_id", "left").fillna(0, ["usage", "support"]), "used")
    rows = topic_pages(c.dealt_links, None, used, per=per, parts=c.parts)
    return rows.select("topic_id", "chunks", "episodes", F.col("peak.episode_id").alias("peak_episode"), F.array_join("related", "|").alias("related"), F.array_join("summary", " ").alias("summary"))
