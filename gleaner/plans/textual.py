"""Registered text, phrase and similarity queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.functions.vectors import mean_pool
from gleaner.operators import episodes as E
from gleaner.operators import matcher as M
from gleaner.operators import phrases as P
from gleaner.operators import search as S
from gleaner.sources.shared import dealt

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_KEPT = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s''-]', ' ', 'g'), '\s+'), lambda w: w != '')"
_WORDS = rf"list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s''-]', ' ', 'g'), '\s+'), lambda w: length(w) > 3 AND NOT list_contains({_STOP}, w))"
TOK = f"WITH tok AS (SELECT doc_id, source, lang, {_WORDS} AS words FROM documents), cw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM tok) GROUP BY ALL), size AS (SELECT count(*) AS size FROM documents) "
_BI = "[words[i] || ' ' || words[i + 1] FOR i IN range(1, greatest(len(words), 1))]"
_TRI = "[words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, greatest(len(words) - 1, 1))]"
#: A small ranked baseline, the same in both engines.
BASELINE = ("this", "that", "with", "from", "have", "tion", "thin", "here", "ther", "aner", "heed", "ered", "ining", "eaer", "ouer")
_BASE = "(VALUES " + ", ".join(f"('{w}', {k + 1})" for k, w in enumerate(BASELINE)) + ") b(word, rank)"
#: First words of phrases that say little.
STARTERS = ["real", "large", "good", "new", "old", "different", "important", "great", "vast", "more"]


def _lit(chars: str) -> str:
    return "'" + chars.replace("'", "''") + "'"


def _entities(x: str) -> str:
    for entity, char in X.ENTITIES:
        x = f"replace({x}, {_lit(entity)}, {_lit(char)})"
    return f"translate(translate({x}, {_lit(X._SINGLE)}, {_lit(chr(39) * 3)}), {_lit(X._DOUBLE)}, {_lit(chr(34) * 3)})"


def _normal(x: str) -> str:
    x = _entities(f"regexp_replace(coalesce({x}, ''), '&apos;', '''', 'gi')")
    for chars, to in ((X._DASHES, "-"), (X._SPACES, " "), (X._CONTROLS, " ")):
        x = f"translate({x}, {_lit(chars)}, {_lit(to * len(chars))})"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[''{chr(0x2019)}]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _q(name: str, sql: str | None, *tables: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables or ("documents",)))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@_q("normalize_text", rf"SELECT doc_id, t AS normalized, array_to_string(list_filter([CASE WHEN t = '' THEN 'empty_after_normalization' END, CASE WHEN regexp_matches(t, '(?i)&(?:#\d+|#x[\da-f]+|[a-z]+);') THEN 'residual_html_entity' END], lambda w: w IS NOT NULL), ',') AS warnings FROM (SELECT doc_id, {_normal('text')} AS t FROM documents)")
def _(d):
    n = d.select("doc_id", X.normalize(F.col("text")).alias("normalized"))
    return n.select("doc_id", "normalized", F.array_join(X.warnings(F.col("normalized")), ",").alias("warnings"))


@_q("tokenize_counts", TOK + "SELECT doc_id, word, n FROM cw")
def _(d):
    return P.chunk_words(d)


@_q("count_words", r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w != '')) AS n FROM documents")
def _(d):
    return d.select("doc_id", X.count_words(F.col("text")).cast("long").alias("n"))


@_q("slugify", f"SELECT doc_id, {_slug('text')} AS slug FROM documents")
def _(d):
    return d.select("doc_id", X.slugify(F.col("text")).alias("slug"))


_SINGULAR = "CASE WHEN length(word) <= 4 OR word IN (" + ", ".join(f"'{w}'" for w in X.KEEP_S) + ") THEN word WHEN word LIKE '%ies' AND length(word) > 5 THEN left(word, -3) || 'y' WHEN regexp_matches(word, '(ses|xes|zes|ches|shes)$') THEN left(word, -2) WHEN word LIKE '%s' AND NOT regexp_matches(word, '(ss|us|is)$') THEN left(word, -1) ELSE word END"


@_q("singularize", TOK + f"SELECT word, {_SINGULAR} AS singular FROM (SELECT DISTINCT word FROM cw)")
def _(d):
    return P.chunk_words(d).select("word").distinct().select("word", X.singular(F.col("word")).alias("singular"))


_MEND = "CASE WHEN regexp_matches({0}, '(at|bl|iz)$') THEN {0} || 'e' ELSE {0} END"


@_q(
    "simple_stem",
    TOK
    + ", one AS (SELECT word, CASE WHEN word LIKE '%sses' THEN left(word, -2) WHEN word LIKE '%ies' AND length(word) > 5 THEN left(word, -3) || 'y' WHEN word LIKE '%s' AND NOT regexp_matches(word, '(ss|us)$') AND length(word) > 4 THEN left(word, -1) ELSE word END AS w FROM (SELECT DISTINCT word FROM cw)), two AS (SELECT word, CASE WHEN w LIKE '%eed' THEN w WHEN w LIKE '%ed' AND length(w) > 5 THEN "
    + _MEND.format("left(w, -2)")
    + " WHEN w LIKE '%ing' AND length(w) > 6 THEN "
    + _MEND.format("left(w, -3)")
    + " ELSE w END AS w FROM one) SELECT word, CASE WHEN w LIKE '%ational' THEN left(w, -5) || 'e' WHEN w LIKE '%ation' AND length(w) > 7 THEN left(w, -3) || 'e' ELSE w END AS stem FROM two",
)
def _(d):
    return P.chunk_words(d).select("word").distinct().select("word", X.stem(F.col("word")).alias("stem"))


@_q("kwic", f"SELECT doc_id, (CASE WHEN a > 1 THEN '{chr(0x2026)}' ELSE '' END) || substring(text, a, i - a) AS \"left\", substring(text, i + 4, 40) || (CASE WHEN i + 44 <= length(text) THEN '{chr(0x2026)}' ELSE '' END) AS \"right\" FROM (SELECT doc_id, text, i, greatest(1, i - 40) AS a FROM (SELECT doc_id, text, instr(lower(text), 'tion') AS i FROM documents) WHERE i > 0)")
def _(d):
    return d.select("doc_id", X.kwic(F.col("text"), "tion").alias("k")).filter("k IS NOT NULL").select("doc_id", "k.left", "k.right")


def _excerpt(before: int, after: int, most: int, word: str) -> str:
    return f"CASE WHEN i > 0 THEN (CASE WHEN i > {before + 1} THEN '...' ELSE '' END) || substring(text, greatest(1, i - {before}), least(length(text), i + {len(word) + after - 1}) - greatest(1, i - {before}) + 1) || (CASE WHEN i + {len(word) + after - 1} < length(text) THEN '...' ELSE '' END) ELSE substring(text, 1, {most}) END"


@_q("highlight", f"SELECT doc_id, regexp_replace(replace(replace(replace(e, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(tion)', '<mark>\\1</mark>', 'gi') AS html FROM (SELECT doc_id, {_excerpt(80, 150, 300, 'tion')} AS e FROM (SELECT doc_id, text, instr(lower(text), 'tion') AS i FROM documents))")
def _(d):
    return d.select("doc_id", X.highlight(F.col("text"), "tion").alias("html"))


@_q("snippet", f"SELECT doc_id, {_excerpt(60, 100, 200, 'tion')} AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'tion') AS i FROM documents)")
def _(d):
    return d.select("doc_id", X.snippet(F.col("text"), "tion").alias("snippet"))


@_q("strip_html", rf"SELECT page_id, trim(regexp_replace({_entities(chr(39).join(['regexp_replace(html, ', '<[^>]+>', ', ', ' ', ', ', 'g', ')']))}, '\s+', ' ', 'g')) AS text FROM pages", "pages")
def _(p):
    return p.select("page_id", X.strip_html(F.col("html")).alias("text"))


@_q("title_extract", f"SELECT page_id, trim({_entities(chr(39).join(['regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)']))}) AS title FROM pages", "pages")
def _(p):
    return p.select("page_id", X.title_of(F.col("html")).alias("title"))


@_q("link_extract", "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)href=\"([^\"]+)\"', 1)) AS href FROM pages", "pages")
def _(p):
    return p.select("page_id", F.explode(X.hrefs(F.col("html"))).alias("href"))


@_q("url_hosts", r"SELECT nullif(regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', ''), '') AS host, count(*) AS pages, count(*) FILTER (WHERE regexp_matches(url, '(?i)^(https?://|www\.)')) AS external FROM pages GROUP BY ALL", "pages")
def _(p):
    return p.groupBy(X.host_label(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.count_if(X.is_external(F.col("url"))).alias("external"))


@_q("word_stats", TOK + "SELECT word, CAST(sum(n) AS BIGINT) AS total, count(*) AS docs FROM cw GROUP BY word")
def _(d):
    return P.word_stats(d)


@_q("word_distinctiveness", TOK + f", ws AS (SELECT word, CAST(sum(n) AS BIGINT) AS total, count(*) AS docs FROM cw GROUP BY word) SELECT word, total, docs, round(CASE WHEN rank IS NULL THEN 10 + 0.1::DOUBLE * total ELSE total / (SELECT sum(total) FROM ws)::DOUBLE * rank * 0.5::DOUBLE END, 6) AS score FROM ws LEFT JOIN {_BASE} USING (word)")
def _(d):
    baseline = d.sparkSession.createDataFrame([(w, k + 1) for k, w in enumerate(BASELINE)], "word string, rank int")
    return P.word_distinctiveness(d, baseline)


@_q("corpus_ngrams", TOK + f"SELECT phrase, CAST(sum(n) AS BIGINT) AS total, count(*) AS docs FROM (SELECT phrase, doc_id, count(*) AS n FROM (SELECT doc_id, unnest(list_concat({_BI}, {_TRI})) AS phrase FROM tok) GROUP BY ALL) GROUP BY phrase HAVING sum(n) >= 5 AND count(*) >= 3")
def _(d):
    return P.ngrams(d)


@_q("pmi_pairs", TOK + ", df AS (SELECT word, count(*) AS df FROM cw GROUP BY word HAVING count(*) >= 5 AND count(*) <= (SELECT size FROM size) * 0.1), k AS (SELECT doc_id, word, df FROM cw JOIN df USING (word)), p AS (SELECT x.word AS a, y.word AS b, count(*) AS \"both\", round(ln(count(*) * (SELECT size FROM size) / (x.df * y.df)), 6) AS pmi FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.word < y.word GROUP BY x.word, y.word, x.df, y.df HAVING count(*) >= 5 ORDER BY pmi DESC, a, b LIMIT 100) SELECT * FROM p WHERE pmi >= 3")
def _(d):
    return P.pmi_pairs(d)


@_q("adjacent_pmi_lexicon", TOK + f", b AS (SELECT phrase, count(*) AS docs, CAST(sum(n) AS BIGINT) AS support FROM (SELECT phrase, doc_id, count(*) AS n FROM (SELECT doc_id, unnest({_BI}) AS phrase FROM tok) GROUP BY ALL) GROUP BY phrase HAVING count(*) >= 3), df AS (SELECT word, count(*) AS df FROM cw GROUP BY word), s AS (SELECT phrase, docs, support, round(ln(docs * (SELECT size FROM size) / (x.df * y.df)) * (1 + log2(support + 1)), 6) AS quality FROM b JOIN df x ON x.word = split_part(phrase, ' ', 1) JOIN df y ON y.word = split_part(phrase, ' ', 2)) SELECT * FROM s WHERE quality >= 1.5")
def _(d):
    return P.phrase_lexicon(d, most=None)


@_q("sips", TOK + f"SELECT phrase, count(*) AS n FROM (SELECT unnest({_BI}) AS phrase FROM tok) WHERE split_part(phrase, ' ', 1) NOT IN ('tion', 'ther', 'heed') AND split_part(phrase, ' ', 2) NOT IN ('tion', 'ther', 'heed') GROUP BY phrase HAVING count(*) >= 3")
def _(d):
    return P.improbable_phrases(d, ["tion", "ther", "heed"])


@_q(
    "terminology_drift",
    TOK + f", c AS (SELECT phrase, count(*) FILTER (WHERE doc_id <= m) AS e, count(*) FILTER (WHERE doc_id > m) AS l FROM (SELECT doc_id, unnest({_BI}) AS phrase FROM tok), (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY doc_id) AS m FROM documents) GROUP BY phrase), s AS (SELECT phrase, round(e / (SELECT sum(e) FROM c)::DOUBLE, 9) AS early, round(l / (SELECT sum(l) FROM c)::DOUBLE, 9) AS late FROM c), d AS (SELECT *, round(late - early, 9) AS delta, CASE WHEN late > early THEN 'late' ELSE 'early' END AS way FROM s WHERE abs(round(late - early, 9)) >= 0.0005) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY way ORDER BY abs(delta) DESC, phrase) AS INTEGER) AS rank FROM d) WHERE rank <= 5",
)
def _(d):
    return P.terminology_drift(d, "doc_id")


@_q("doc_freq_idf", TOK + "SELECT word, count(*) AS df, round(ln((SELECT size FROM size) / count(*)), 6) AS idf FROM cw GROUP BY word")
def _(d):
    return P.inverse_frequencies(d)


@_q("episode_tfidf", TOK + ", g AS (SELECT source, word, count(*) AS n FROM (SELECT source, unnest(words) AS word FROM tok) GROUP BY ALL), s AS (SELECT source, word, n, df, round(n * ln((SELECT count(DISTINCT source) FROM documents) / df), 6) AS tfidf FROM g JOIN (SELECT word, count(*) AS df FROM g GROUP BY word) USING (word) WHERE n >= 2) SELECT * FROM (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY tfidf DESC, word) AS INTEGER) AS rank, word, n, df, tfidf FROM s) WHERE rank <= 5")
def _(d):
    return P.group_tfidf(d, "source")


_FORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@_q("phrase_containment", f"SELECT DISTINCT d.doc_id, b.text AS term FROM documents d JOIN benchmark b ON contains(' ' || {_FORM.format('d.text')} || ' ', ' ' || {_FORM.format('b.text')} || ' ')", "documents", "benchmark")
def _(d, b):
    """Which documents hold which items of the benchmark whole."""
    return P.contained(d, b.select(F.col("text").alias("term")).distinct())


@_q(
    "heuristic_phrases",
    f"WITH w AS (SELECT doc_id, {_KEPT} AS words FROM documents), g AS (SELECT doc_id, unnest(list_concat({_BI}, {_TRI}, [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] FOR i IN range(1, greatest(len(words) - 2, 1))])) AS phrase FROM w), p AS (SELECT doc_id, phrase, string_split(phrase, ' ') AS parts, count(*) AS n FROM g GROUP BY ALL), f AS (SELECT * FROM p WHERE len(list_filter(parts, lambda w: length(w) < 4 OR list_contains({_STOP}, w))) = 0 AND NOT (len(parts) >= 3 AND list_contains({STARTERS}, parts[1]))), s AS (SELECT doc_id, phrase, n, n * 5 + CASE WHEN len(parts) = 4 THEN 2 ELSE 5 END - CASE WHEN list_contains({STARTERS}, parts[1]) THEN 4 ELSE 0 END - CASE WHEN regexp_matches(parts[1], '(ing|ed|ly)$') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(parts[-1], '(ing|ed|ly)$') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(parts[-1], '(ion|ment|ness|ity|ship|ware|code|model|attack|labor|evidence|industry|software|tool|system|issue|law|effect|models|systems)$') THEN 2 ELSE 0 END AS score FROM f) SELECT * FROM (SELECT doc_id, phrase, n, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(phrase) DESC, phrase) AS INTEGER) AS rank FROM s) WHERE rank <= 8",
)
def _(d):
    return P.phrase_candidates(d, STARTERS)


_COS = "list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / (sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) * sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])))"


@_q("cosine_topk", f"SELECT * FROM (SELECT y.vec_id AS query_id, x.vec_id, round({_COS}, 6) AS score, CAST(row_number() OVER (PARTITION BY y.vec_id ORDER BY round({_COS}, 6) DESC, x.vec_id) AS INTEGER) AS rank FROM embeddings x, embeddings y WHERE y.vec_id % 50 = 0 AND x.vec_id != y.vec_id) WHERE rank <= 10", "embeddings")
def _(e):
    return S.cosine_topk(e, e.filter("vec_id % 50 = 0"), 10)


@_q("cross_references", f"SELECT y.vec_id AS query_id, x.vec_id, round({_COS}, 6) AS score FROM embeddings x, embeddings y WHERE y.vec_id % 50 = 0 AND x.vec_id != y.vec_id AND round({_COS}, 6) >= 0.3", "embeddings")
def _(e):
    return S.cosine_topk(e, e.filter("vec_id % 50 = 0"), None, 0.3).select("query_id", "vec_id", "score")


@_q("mean_pool_by_label", "SELECT label, place, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(0, 64)) AS place, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL", "embeddings")
def _(e):
    return mean_pool(e, "label", "embedding").select("label", F.posexplode("pooled").alias("place", "mean")).select("label", F.col("place").cast("long").alias("place"), F.round("mean", 6).alias("mean"))


_DBI = "list_distinct([substring({0}, i, 2) FOR i IN range(1, length({0}))])"


@_q("dice_pairs", f"WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part), b AS (SELECT name, {_DBI.format('name')} AS g FROM n) SELECT x.name AS a, y.name AS b, round(2 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)), 6) AS score FROM b x JOIN b y ON x.name < y.name WHERE round(2 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)), 6) >= 0.6", "part")
def _(p):
    return S.dice_pairs(p.select(F.lower("p_name").alias("name")).distinct(), 0.6)


@_q("keyword_search", "SELECT doc_id, lang FROM documents WHERE text ILIKE '%ation%' AND lang = 'en' ORDER BY doc_id DESC LIMIT 50")
def _(d):
    return S.keyword_search(d, "ation", F.col("lang") == "en").orderBy(F.desc("doc_id")).limit(50).select("doc_id", "lang")


@_q(
    "bm25_search",
    TOK + ", l AS (SELECT doc_id, len(words) AS size FROM tok), a AS (SELECT avg(size) AS mean, count(*) AS many FROM l), h AS (SELECT doc_id, word, n, count(*) OVER (PARTITION BY word) AS df FROM cw WHERE word IN ('hend', 'tion', 'ther')), s AS (SELECT doc_id, round(sum(ln(1 + (many - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * n * 2.2::DOUBLE / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 6) AS score FROM h JOIN l USING (doc_id), a GROUP BY doc_id) SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20",
)
def _(d):
    return S.bm25(d, ["hend", "tion", "ther"], 20)


@_q(
    "hybrid_rerank",
    TOK + ", l AS (SELECT doc_id, len(words) AS size FROM tok), f AS (SELECT doc_id, n / size AS raw FROM cw JOIN l USING (doc_id) WHERE word = 'hend'), fts AS (SELECT doc_id AS id, round((raw - min(raw) OVER ()) / coalesce(nullif(max(raw) OVER () - min(raw) OVER (), 0), 1), 6) AS fts FROM f), vec AS (SELECT x.vec_id AS id, round(" + _COS + ", 6) AS vec FROM embeddings x, embeddings y WHERE y.vec_id = 0 AND x.vec_id != 0 ORDER BY vec DESC, id LIMIT 15) SELECT id, fts, vec, round(CASE WHEN fts IS NOT NULL AND vec IS NOT NULL THEN 0.4::DOUBLE * fts + 0.6::DOUBLE * vec + 0.1::DOUBLE WHEN vec IS NULL THEN 0.4::DOUBLE * fts ELSE 0.6::DOUBLE * vec END, 6) AS score FROM fts FULL JOIN vec USING (id)",
    "documents",
    "embeddings",
)
def _(d, e):
    words = P.chunk_words(d)
    sizes = P.tokens(d).select("doc_id", F.size("words").alias("size"))
    raw = words.filter("word = 'hend'").join(sizes, "doc_id").select("doc_id", (F.col("n") / F.col("size")).alias("raw"))
    fts = S.min_max(raw, "raw").select(F.col("doc_id").alias("id"), F.round("raw", 6).alias("fts"))
    vec = S.cosine_topk(e, e.filter("vec_id = 0"), 15).select(F.col("vec_id").alias("id"), F.col("score").alias("vec"))
    return S.rerank(fts, vec)


@_q("topic_typeahead", "SELECT p_partkey AS topic_id, p_name AS name FROM part WHERE p_name ILIKE '%wid%' ORDER BY p_name, p_partkey LIMIT 10", "part")
def _(p):
    return p.select(F.col("p_partkey").alias("topic_id"), F.col("p_name").alias("name")).filter(F.col("name").ilike("%wid%")).orderBy("name", "topic_id").limit(10)


@_q("json_links", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", "events")
def _(e):
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@_q("parse_dates", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS parsed, strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS human FROM orders", "orders")
def _(o):
    from gleaner.functions import dates as T

    short = F.date_format("o_orderdate", "M/d/yyyy")
    parsed = T.parse_episode_date(short)
    return o.select(parsed.alias("parsed"), T.human(parsed).alias("human")).distinct()


#: Terms with a word's start in common, so that some stand inside longer words only.
_THE = TOK + ", term AS (SELECT word AS term FROM cw WHERE word LIKE 'the%' GROUP BY word HAVING count(*) >= 3)"


@_q("term_matches", _THE + " SELECT doc_id, term, regexp_matches(lower(text), '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') AS whole FROM documents, term WHERE contains(lower(text), term)")
def _(d):
    """Which documents hold which terms, and whether between word boundaries: what entity validation rests on."""
    the = F.filter(F.array_distinct(X.tokenize(F.col("text"))), lambda w: w.startswith("the"))
    words = dealt(d.select("doc_id", "text"), "doc_id").select("doc_id", F.explode_outer(the).alias("word")).filter("word IS NOT NULL").distinct()
    terms = words.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 3").select(F.col("word").alias("term"))
    return M.with_wholeness(d, terms)


@_q(
    "lexicon_backfill",
    TOK + f", p AS (SELECT phrase FROM (SELECT phrase, doc_id FROM (SELECT doc_id, unnest({_BI}) AS phrase FROM tok) GROUP BY ALL) GROUP BY phrase HAVING count(*) >= 25), f AS MATERIALIZED (SELECT doc_id, lower(text) AS low, ' ' || {_FORM.format('text')} || ' ' AS form FROM documents) SELECT doc_id, phrase FROM f, p WHERE contains(low, phrase) AND NOT contains(form, ' ' || phrase || ' ')",
)
def _(d):
    """Documents that hold a phrase of the lexicon anywhere but not as words, which is where extraction has put no link."""
    words = P.tokens(dealt(d.select("doc_id", "text"), "doc_id"))
    pairs = words.select("doc_id", F.explode_outer(F.array_distinct(X.word_ngrams(F.col("words"), 2))).alias("phrase")).filter("phrase IS NOT NULL")
    terms = pairs.groupBy("phrase").agg(F.count("*").alias("n")).filter("n >= 25").select(F.col("phrase").alias("term"))
    return M.only_inside(d, terms).select("doc_id", F.col("term").alias("phrase"))


@_q(
    "merge_chain",
    f"""WITH RECURSIVE n AS (SELECT lower(p_name) AS name, min(p_partkey) AS topic_id, count(*) AS usage FROM part GROUP BY lower(p_name)),
    g AS (SELECT *, {_DBI.format('name')} AS g FROM n),
    s AS (SELECT x.topic_id, y.topic_id AS keeper_id, round(2 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)), 6) AS score, y.usage AS u, y.name AS m, x.usage AS xu, x.name AS xm FROM g x JOIN g y ON x.name != y.name),
    b AS (SELECT topic_id, keeper_id FROM s WHERE score >= 0.7 AND (u > xu OR u = xu AND length(m) > length(xm) OR u = xu AND length(m) = length(xm) AND m < xm) QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, u DESC, length(m) DESC, m) = 1),
    walk AS (SELECT topic_id, keeper_id, 1 AS steps FROM b UNION ALL SELECT w.topic_id, b.keeper_id, steps + 1 FROM walk w JOIN b ON b.topic_id = w.keeper_id)
    SELECT topic_id, arg_max(keeper_id, steps) AS keeper_id, CAST(max(steps) AS BIGINT) AS steps FROM walk GROUP BY topic_id""",
    "part",
)
def _(p):
    """Names alike go to their best partner, which may go further; the map is closed, with the number of merges on the way."""
    from gleaner.operators.merges import best_partners
    from gleaner.plans.finalization import closed_in_steps

    names = p.groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("topic_id"), F.count("*").alias("usage"))
    return closed_in_steps(best_partners(names, 0.7))


_EPISODE = (
    f"WITH w AS (SELECT doc_id, source AS episode_id, {_KEPT} AS words FROM documents), g AS (SELECT episode_id, unnest(list_concat({_BI}, {_TRI}, [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] FOR i IN range(1, greatest(len(words) - 2, 1))])) AS phrase FROM w), p AS (SELECT episode_id, phrase, string_split(phrase, ' ') AS parts, count(*) AS n FROM g GROUP BY ALL), f AS (SELECT * FROM p WHERE len(list_filter(parts, lambda w: length(w) < 4 OR list_contains({_STOP}, w))) = 0 AND NOT (len(parts) >= 3 AND list_contains({STARTERS}, parts[1]))), s AS (SELECT episode_id, phrase, n, n * 5 + CASE WHEN len(parts) = 4 THEN 2 ELSE 5 END - CASE WHEN list_contains({STARTERS}, parts[1]) THEN 4 ELSE 0 END - CASE WHEN regexp_matches(parts[1], '(ing|ed|ly)$') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(parts[-1], '(ing|ed|ly)$') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(parts[-1], '(ion|ment|ness|ity|ship|ware|code|model|attack|labor|evidence|industry|software|tool|system|issue|law|effect|models|systems)$') THEN 2 ELSE 0 END AS score FROM f), e AS (SELECT * FROM (SELECT episode_id, phrase, score, row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, length(phrase) DESC, phrase) AS rank FROM s) WHERE rank <= 8)"
)


@_q("episode_candidates", _EPISODE + " SELECT episode_id, phrase AS name, score + 1400000 AS rank_score, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, phrase) AS INTEGER) AS rank FROM e")
def _(d):
    """The phrases that set an episode (here: a source) off, mined over all its texts."""
    found = E.episode_candidates(d.select("doc_id", F.col("source").alias("episode_id"), "text"), STARTERS)
    return found.select("episode_id", "name", F.col("rank_score").cast("long").alias("rank_score"), "rank")


@_q("episode_attribution", _EPISODE + " SELECT doc_id, phrase AS name, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, replace(phrase, ' ', '-')) > 5 THEN 'max_topics_reached' ELSE 'accepted' END AS decision FROM documents d JOIN e ON e.episode_id = d.source AND regexp_matches(lower(text), '(^|[^a-z0-9])' || phrase || '($|[^a-z0-9])')")
def _(d):
    """Which texts of an episode its candidates go to."""
    rows = d.select("doc_id", F.col("source").alias("episode_id"), "text")
    return E.attributed(rows, E.episode_candidates(rows, STARTERS)).select("doc_id", "name", "decision")
