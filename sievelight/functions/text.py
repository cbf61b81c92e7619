"""Text functions on columns; every one is a native expression. Null texts give null (or 0 tokens where stated)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without meaning for retrieval, words between the initials of an acronym, furniture lines.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "how", "i", "in", "is", "it", "its", "of", "on", "or",
    "s", "that", "the", "this", "to", "was", "were", "what", "when", "where", "which", "who", "why", "will", "with", "you", "your",
)
CONNECTORS = ("of", "and", "the", "for", "in", "to", "a")
BOILERPLATE = (
    r"(?i)^\s*(home|menu|search|share|tweet|subscribe|sign\s?up|log\s?in|newsletter|advertisement|sponsored|related\s+(posts|articles)|read\s+more|next|previous"
    r"|back\s+to\s+top|cookie|privacy\s+policy|terms(\s+of\s+service)?|all\s+rights\s+reserved|follow\s+us|table\s+of\s+contents)([^A-Za-z0-9_]|$)"
)
LINK = r"\[([^\]]*)\]\([^)]*\)"
WORD = r"[A-Za-z0-9][A-Za-z0-9'\-]*"
DEFINITION = r"(?i)(^|[^a-z0-9_])(stands?\s+for|short\s+for|abbreviation|acronym)($|[^a-z0-9_])"
SERIALIZED_CHARS, SERIALIZED_SHARE, SERIALIZED_KEYS = 80, 0.12, 3
EXCERPT = 120


def let(c: Column, f) -> Column:
    """f of a value that is computed once: inside a lambda the optimiser would otherwise repeat the expression of c
    for every element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s ﻿]+|[\s ﻿]+$", "")


def passage_tokens(c: Column) -> Column:
    """Lower-case words of two characters and more without the stop words; with repeats, in order."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0)), lambda x: (F.length(x) > 1) & ~x.isin(*STOP_WORDS))


def plain_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, stop words included."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(tokens: Column, k: int = 5) -> Column:
    """Distinct runs of k tokens; all tokens as one where there are fewer; none without tokens."""

    def of(t: Column) -> Column:
        n = F.size(t)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(n <= 0, F.array().cast("array<string>")).when(n < k, F.array(F.array_join(t, " "))).otherwise(F.array_distinct(runs))

    return let(tokens, of)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def normalized_paragraph(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "), r"\s+", " "))


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def density_signals(c: Column) -> Column:
    """Struct of words, link_ratio, duplicate_ratio, boilerplate_ratio, mean_sentence_words; ratios of nothing are 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def signals(text: Column) -> Column:
        lines = F.filter(F.transform(F.split(text, "\n"), js_trim), lambda x: x != "")
        furniture = lambda ls: ratio(F.size(F.filter(ls, lambda x: x.rlike(BOILERPLATE) | (word_count(x) <= 4))), F.size(ls))
        paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), normalized_paragraph), lambda x: F.size(F.filter(F.split(x, " "), lambda w: w != "")) > 4)
        repeats = lambda ps: ratio(F.size(ps) - F.size(F.array_distinct(ps)), F.size(ps))
        sentences = F.filter(F.transform(F.split(text, r"[.!?]+\s"), word_count), lambda n: n > 0)
        mean = lambda ns: ratio(F.aggregate(ns, F.lit(0), lambda s, n: s + n), F.size(ns))
        return F.struct(word_count(text).alias("words"), let(paragraphs, repeats).alias("dup"), let(lines, furniture).alias("boiler"), let(sentences, mean).alias("mean"))

    links = F.regexp_count(c, F.lit(LINK))
    s = let(F.regexp_replace(c, LINK, "$1"), signals)
    made = let(
        s,
        lambda x: F.struct(
            x["words"].cast("double").alias("words"),
            ratio(links * 100.0, x["words"]).alias("link_ratio"),
            x["dup"].alias("duplicate_ratio"),
            x["boiler"].alias("boilerplate_ratio"),
            x["mean"].alias("mean_sentence_words"),
        ),
    )
    return F.when(c.isNotNull(), made)


def information_density(s: Column) -> Column:
    """Score in [0, 1] of a struct of density_signals, four decimals; 0 without words."""

    def score(x: Column) -> Column:
        mean = x["mean_sentence_words"]
        shape = F.when(mean == 0, F.lit(0.1)).otherwise(clamp01(F.abs(mean - 18) / 30) * 0.1)
        total = 1 - clamp01(x["link_ratio"] / 12) * 0.35 - x["duplicate_ratio"] * 0.25 - clamp01(x["boilerplate_ratio"]) * 0.3 - shape
        return F.when(x["words"] == 0, F.lit(0.0)).otherwise(F.round(clamp01(total) + 1e-9, 4))  # ties go up on every platform

    return F.when(s.isNotNull(), let(s, score))


def density_weight(density: Column) -> Column:
    return clamp01(density) * 0.5 + 0.5


def looks_serialized(c: Column) -> Column:
    """Whether a text is dumped data: long enough, full of brackets and quotes, with quoted keys."""
    marks = F.regexp_count(c, F.lit(r'[{}\[\]":,]'))
    keys = F.regexp_count(c, F.lit(r'"[^"]{1,60}"\s*:'))
    return F.coalesce((F.length(c) >= SERIALIZED_CHARS) & (marks / F.greatest(F.length(c), F.lit(1)) >= SERIALIZED_SHARE) & (keys >= SERIALIZED_KEYS), F.lit(False))


def stripped_text(html: Column) -> Column:
    """Visible text without scripts, styles and tags; entities stay."""
    x = F.regexp_replace(html, r"(?is)<script[\s\S]*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style[\s\S]*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))


def strip_tags(html: Column) -> Column:
    """stripped_text with the common entities decoded, & first."""
    x = F.regexp_replace(html, r"(?is)<script[\s\S]*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style[\s\S]*?</style>", " ")
    x = F.regexp_replace(x, "<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        x = F.regexp_replace(x, "(?i)" + a, b)
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def is_readable(c: Column) -> Column:
    """Whether a string of a payload reads as prose: long enough, five words, no address or encoded blob."""
    return (F.length(c) >= 40) & ~c.rlike(r"^(https?://|data:|/|#|[A-Za-z0-9+/=]{60,}$)") & (F.size(F.split(c, r"\s+")) >= 5)


def is_definition_query(c: Column) -> Column:
    return c.rlike(DEFINITION)


def find_acronyms(c: Column) -> Column:
    """Distinct words of 3 to 8 capitals."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9_])[A-Z]{3,8}(?![A-Za-z0-9_])"), F.lit(0)), lambda x: x))


def acronym_pattern(acronym: Column) -> Column:
    """Pattern of a phrase whose initials spell the acronym (for case-insensitive matching)."""
    gap = rf"(?:[\s,;:/()\-]+(?:(?:{'|'.join(CONNECTORS)})[\s,;:/()\-]+)?)?"
    letters = F.filter(F.split(F.upper(acronym), ""), lambda x: x != "")
    return F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), F.array_join(F.transform(letters, lambda x: F.concat(x, F.lit("[a-z]+"))), gap), F.lit("(?![A-Za-z0-9_])"))


def expands_acronym(c: Column, acronym: Column) -> Column:
    """Whether a text holds a phrase whose initials spell the acronym (three letters and more)."""
    found = F.regexp_extract_all(c, acronym_pattern(acronym), F.lit(0))
    return F.coalesce((F.length(acronym) >= 3) & F.exists(found, lambda m: (F.length(m) >= F.length(acronym) * 2) & (F.upper(m) != F.upper(acronym))), F.lit(False))


def variant_key(c: Column) -> Column:
    """Key of a query without case, punctuation and plural endings."""
    return F.array_join(F.transform(plain_tokens(c), lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.regexp_replace(t, "s$", "")).otherwise(t)), " ")


def replace_term(c: Column, term: Column, by: Column) -> Column:
    """Every whole-word occurrence of a term (plain letters and spaces), in any case, replaced."""
    return F.regexp_replace(c, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])"), term, F.lit(r"(?![A-Za-z0-9_])")), by)


def excerpt_at(c: Column, index: Column) -> Column:
    """120 characters from an offset with white space collapsed; dots mark that it may go on."""
    raw = F.regexp_replace(F.substr(c, index + 1, F.lit(EXCERPT)), r"\s+", " ")
    return F.when(F.length(raw) < EXCERPT, F.trim(raw)).otherwise(F.concat(F.trim(raw), F.lit("...")))


def term_overlap(query: Column, title: Column, snippet: Column) -> Column:
    """Share of the query's tokens (repeats counted) in title or snippet; 0 for an empty query."""
    q = plain_tokens(query)
    have = F.array_union(plain_tokens(F.coalesce(title, F.lit(""))), plain_tokens(F.coalesce(snippet, F.lit(""))))
    hits = let(have, lambda h: F.size(F.filter(q, lambda t: F.array_contains(h, t))))
    return F.when(F.size(q) <= 0, F.lit(0.0)).otherwise(hits / F.size(q))


def coverage(question: Column, text: Column) -> Column:
    """Share of the question's distinct retrieval tokens in a text, four decimals; 0 without any."""
    q = F.array_distinct(passage_tokens(question))
    return F.when(F.size(q) <= 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(q, passage_tokens(F.coalesce(text, F.lit(""))))) / F.size(q), 4))


def parsed_time(c: Column) -> Column:
    """Timestamp of the date forms that results carry, null for anything else ('3 days ago', '')."""
    iso = F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c))
    forms = [(r"^\d{1,2} [A-Z][a-z]+ \d{4}$", "d MMMM yyyy"), (r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd")]
    return F.coalesce(iso, *[F.try_to_timestamp(F.when(c.rlike(r), c), F.lit(f)) for r, f in forms])


def recency(published: Column, as_of: Column, days: int) -> Column:
    """1 within the days before as_of, 0 before them, 0.5 without a readable date."""
    t = parsed_time(published)
    return F.when(t.isNull(), F.lit(0.5)).when(t >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(1.0)).otherwise(F.lit(0.0))


def freshness_token(days: Column, as_of: Column) -> Column:
    """Provider token of a window in days: none, pd, pw, pm, py, or a range of dates."""
    d = days
    return (
        F.when(d.isNull() | (d <= 0), F.lit(None).cast("string")).when(d <= 1, F.lit("pd")).when(d <= 7, F.lit("pw")).when(d <= 30, F.lit("pm")).when(d <= 365, F.lit("py"))
        .otherwise(F.concat(F.date_format(F.date_sub(as_of, d.cast("int")), "yyyy-MM-dd"), F.lit("to"), F.date_format(as_of, "yyyy-MM-dd")))
    )


def token_estimate(chars: Column) -> Column:
    return F.round(chars / 4)
