"""Text as columns: everything here is a built-in expression, so it stays in the JVM and Catalyst sees it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own list of frequent English function words; every operator takes another one.
STOPWORDS = (
    "about above after again against all also and any are because been before being below between both but can could did does doing down during each "
    "even every few for from further had has have having here how if into its itself just more most much must nor not now off once only other our out over "
    "own same she should some such than that the their them then there these they this those through too under until upon very was were what when where "
    "which while who whom why will with within without would you your yours"
).split()
#: Entities in the order in which they are decoded, the ampersand first.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
#: Words that keep their s.
KEEP_S = ("series", "species", "news", "physics", "analytics", "mathematics")
_SINGLE = "".join(map(chr, (0x2018, 0x2019, 0x201A)))
_DOUBLE = "".join(map(chr, (0x201C, 0x201D, 0x201E)))
_DASHES = "".join(map(chr, range(0x2010, 0x2016)))
_SPACES = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200E), 0x202F, 0x205F, 0x3000)))
_CONTROLS = "".join(map(chr, (*range(1, 9), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F)))
_BLANKS = _SPACES + _CONTROLS + "\t\n\r"


def _all(text: Column, chars: str, to: str) -> Column:
    return F.translate(text, chars, to * len(chars))


def _entities(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def decode_entities(text: Column) -> Column:
    return _all(_all(_entities(text), _SINGLE, "'"), _DOUBLE, '"')


def normalize(text: Column) -> Column:
    """Entities decoded, quotes and dashes straight, all white space and control characters single spaces; null is empty."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(F.contains(text, F.lit("&")), _entities(F.regexp_replace(text, "&[aA][pP][oO][sS];", "'"))).otherwise(text)
    # translate looks up each character of a text, so it goes through it once for all
    text = F.translate(text, _SINGLE + _DOUBLE + _DASHES + _BLANKS, "'" * len(_SINGLE) + '"' * len(_DOUBLE) + "-" * len(_DASHES) + " " * len(_BLANKS))
    return F.trim(F.regexp_replace(text, " {2,}", " "))


def warnings(normalized: Column) -> Column:
    left = normalized.rlike(r"(?i)&(?:#\d+|#x[\da-f]+|[a-z]+);")
    return F.array_compact(F.array(F.when(normalized == "", F.lit("empty_after_normalization")), F.when(left, F.lit("residual_html_entity"))))


def words_kept(text: Column) -> Column:
    """Lower-cased words of a-z, 0-9, ' and -, stop words included."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9'-]+"), lambda w: w != "")


def tokenize(text: Column, stop: tuple | list = STOPWORDS) -> Column:
    """Words of more than three characters that aren't stop words; letters outside a-z separate."""
    return F.filter(words_kept(text), lambda w: (F.length(w) > 3) & ~w.isin(*stop))


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def slugify(text: Column) -> Column:
    text = F.regexp_replace(F.lower(text), f"['{chr(0x2019)}]", "")
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def singular(word: Column) -> Column:
    """One word without a plural ending."""
    cut = lambda k: F.substring(word, F.lit(1), F.length(word) - k)
    return (
        F.when((F.length(word) <= 4) | word.isin(*KEEP_S), word)
        .when(word.endswith("ies") & (F.length(word) > 5), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(ses|xes|zes|ches|shes)$"), cut(2))
        .when(word.rlike("s$") & ~word.rlike("(ss|us|is)$"), cut(1))
        .otherwise(word)
    )


def normalize_term(term: Column) -> Column:
    """Letters, digits and single spaces only, every word singular."""
    text = F.regexp_replace(normalize(term), "['\"]", "")
    text = F.regexp_replace(text, "(?i)([a-z0-9])-(?=[a-z0-9])", "$1 ")
    text = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9\s-]", " "), r"\s+", " ")))
    return F.array_join(F.transform(F.split(text, " "), singular), " ")


def stem(word: Column) -> Column:
    """Light stemming in three steps; words of up to three letters stay."""
    cut = lambda w, k: F.substring(w, F.lit(1), F.length(w) - k)
    mended = lambda w: F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).otherwise(w)
    w = F.lower(word)
    one = (
        F.when(w.endswith("sses"), cut(w, 2))
        .when(w.endswith("ies") & (F.length(w) > 5), F.concat(cut(w, 3), F.lit("y")))
        .when(w.rlike("s$") & ~w.rlike("(ss|us)$") & (F.length(w) > 4), cut(w, 1))
        .otherwise(w)
    )
    two = lambda w: F.when(w.endswith("eed"), w).when(w.endswith("ed") & (F.length(w) > 5), mended(cut(w, 2))).when(w.endswith("ing") & (F.length(w) > 6), mended(cut(w, 3))).otherwise(w)
    three = lambda w: F.when(w.endswith("ational"), F.concat(cut(w, 5), F.lit("e"))).when(w.endswith("ation") & (F.length(w) > 7), F.concat(cut(w, 3), F.lit("e"))).otherwise(w)
    steps = F.transform(F.transform(F.array(one), two), three)  # each step sees the one before as a value
    return F.when(F.length(w) <= 3, w).otherwise(steps[0])


def bigrams(text: Column) -> Column:
    """The set of character pairs."""
    low = F.lower(text)
    return F.when(F.length(low) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """2 * common / all character pairs, as sets; strings of one character are alike only if equal."""
    x, y = bigrams(a), bigrams(b)
    score = 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(score)


def word_ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces. The words are bound to a lambda's argument: else Spark makes them anew for each run."""
    runs = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(F.array(words), runs))


def kwic(text: Column, keyword: str, around: int = 40) -> Column:
    """struct(left, right) of the first occurrence, with ellipses where the text goes on; null if there is none."""
    at = F.instr(F.lower(text), F.lit(keyword.lower()))
    first, after = F.greatest(F.lit(1), at - around), at + len(keyword)
    left = F.concat(F.when(first > 1, chr(0x2026)).otherwise(""), F.substring(text, first, at - first))
    right = F.concat(F.substring(text, after, F.lit(around)), F.when(after + around <= F.length(text), chr(0x2026)).otherwise(""))
    return F.when(at > 0, F.struct(left.alias("left"), right.alias("right")))


def excerpt(text: Column, word: str, before: int = 80, after: int = 150, most: int = 300) -> Column:
    """The text around the first occurrence; without one, its beginning."""
    at = F.instr(F.lower(text), F.lit(word.lower()))
    first = F.greatest(F.lit(1), at - before)
    last = F.least(F.length(text), at + len(word) + after - 1)
    inside = F.concat(F.when(first > 1, "...").otherwise(""), F.substring(text, first, last - first + 1), F.when(last < F.length(text), "...").otherwise(""))
    return F.when(at > 0, inside).otherwise(F.substring(text, 1, most))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def escape_xml(text: Column) -> Column:
    """The five entities of XML."""
    return F.replace(F.replace(escape_html(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;"))


def escape_regex(text: Column) -> Column:
    """The text as a pattern that matches just itself."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def json_for_html(value: Column) -> Column:
    """JSON of a struct, map or array, null fields included, that can't close a script element; in JSON a slash may be escaped."""
    return F.replace(F.to_json(value, {"ignoreNullFields": "false"}), F.lit("</"), F.lit("<\\/"))


def quoted_phrase(query: Column) -> Column:
    """A search query as one phrase: its own quotes gone."""
    return F.concat(F.lit('"'), F.trim(F.replace(query, F.lit('"'), F.lit(""))), F.lit('"'))


def whole_number(text: Column, default: int) -> Column:
    """The leading digits as a number; the default without them, for negative numbers and null."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*\+?(\d+)", 1), F.lit("")).try_cast("long"), F.lit(default).cast("long"))


def topic_tokens(name: Column) -> Column:
    """The distinct lower-case tokens of a topic's name; white space alone parts them."""
    return F.array_distinct(F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != ""))


def highlight(text: Column, word: str) -> Column:
    import re

    return F.regexp_replace(escape_html(excerpt(text, word)), f"(?i)({re.escape(word)})", "<mark>$1</mark>")


def snippet(text: Column, word: str) -> Column:
    return excerpt(text, word, 60, 100, 200)


def strip_html(html: Column) -> Column:
    """Tags to spaces, entities decoded, white space collapsed."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(html, "<[^>]+>", " ")), r"\s+", " "))


def title_of(html: Column) -> Column:
    return F.trim(decode_entities(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))


def hrefs(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit('(?i)href="([^"]+)"'), F.lit(1)))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"https?://\S+|www\.\S+"), F.lit(0))


def is_external(href: Column) -> Column:
    return href.rlike(r"(?i)^(https?://|www\.)")


def host_label(href: Column) -> Column:
    """The host without www., null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(href, r"(?i)^https?://([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))


def unwrap_redirect(href: Column) -> Column:
    """The target of a redirect page's q parameter; other links stay."""
    decoded = decode_entities(href)
    target = F.regexp_extract(decoded, r"^https?://www\.google\.com/url\?(?:[^#]*&)?q=([^&#]*)", 1)
    return F.when(target != "", F.try_url_decode(target)).otherwise(decoded)


def strip_markers(text: Column) -> Column:
    """Footnote markers such as [a] and [12] removed."""
    return F.regexp_replace(text, r"\[(?:[a-z]{1,2}|\d+)\]", "")


def matches_term(text: Column, term: str) -> Column:
    """Whether a term stands in the text between characters that aren't letters or digits."""
    import re

    return F.lower(text).rlike(f"(^|[^a-z0-9]){re.escape(term.lower())}($|[^a-z0-9])")


def oxford_list(items: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(items)
    long = F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(items, -1))
    return F.when(n == 0, "").when(n == 1, F.element_at(items, 1)).when(n == 2, F.array_join(items, " and ")).otherwise(long)
