"""Search variants of a question by a fixed synonym table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions import text as T

# Terms and their replacements, in the order in which variants are made.
SYNONYMS = (
    ("germany", ("Germany", "Deutschland")), ("deutschland", ("Deutschland", "Germany")), ("unlimited", ("unlimited", "unbegrenztes")),
    ("mobile internet", ("mobile internet", "Datenvolumen")), ("internet", ("internet", "Datenvolumen")), ("cheap", ("cheapest", "affordable", "günstig")),
    ("cheapest", ("cheap", "affordable")), ("affordable", ("cheap", "cheapest")), ("best", ("best", "top", "beste")), ("top", ("best", "top")),
    ("how to", ("how to", "guide", "tutorial")), ("guide", ("guide", "how to")), ("tutorial", ("tutorial", "guide")),
    ("review", ("review", "reviews", "comparison")), ("compare", ("compare", "comparison", "vs")), ("price", ("price", "cost", "preis")),
)
LIMIT, QUICK = 6, 2


def variants(question: Column, limit: int = LIMIT) -> Column:
    """Array of a question and its variants: one term replaced at a time, only terms that occur (as a substring),
    variants with a key seen before left out, at most ``limit``; [''] for an empty question, null for null."""
    q = F.trim(F.regexp_replace(question, r"^\s+|\s+$", ""))
    low = F.lower(q)
    made = [F.struct(q.alias("v"), T.variant_key(q).alias("k"), F.lit(True).alias("on"))]
    for term, replacements in SYNONYMS:
        for r in replacements:
            v = T.replace_term(q, F.lit(term), F.lit(r))
            made.append(F.struct(v.alias("v"), T.variant_key(v).alias("k"), low.contains(term).alias("on")))
    live = F.filter(F.array(*made), lambda x: x.on)
    first = T.let(live, lambda a: T.let(F.transform(a, lambda y: y.k), lambda ks: F.filter(a, lambda x, i: F.array_position(ks, x.k) == i + 1)))
    return F.when(q == "", F.array(F.lit(""))).otherwise(F.slice(F.transform(first, lambda x: x.v), 1, limit))


def expand(questions: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per question and variant: the question's columns, variant_no from 0, variant."""
    return questions.select("*", F.posexplode(variants(F.col(text), limit)).alias("variant_no", "variant"))
