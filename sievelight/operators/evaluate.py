"""Evaluation of retrieval: token efficiency and retention of marked answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELIABLE = 0.7


def efficiency(runs: DataFrame) -> DataFrame:
    """Totals of runs(id, baseline_chars, research_chars, baseline_ms, research_ms): reduction is one minus the ratio of
    the sums, median_reduction that of the single ones; runs without a baseline count in the totals only."""
    each = F.when(F.col("baseline_chars") > 0, 1 - F.col("research_chars") / F.col("baseline_chars"))
    return runs.agg(
        F.count("*").alias("questions"), F.sum("baseline_chars").alias("baseline_chars"), F.sum("research_chars").alias("research_chars"),
        F.round(F.sum("baseline_chars") / 4).cast("long").alias("baseline_tokens"), F.round(F.sum("research_chars") / 4).cast("long").alias("research_tokens"),
        F.round(1 - F.sum("research_chars") / F.sum("baseline_chars"), 4).alias("reduction"), F.round(F.median(each), 4).alias("median_reduction"),
    )


def retention(found: DataFrame) -> DataFrame:
    """(category, found, kept, retention) of found(category, in_baseline, retained), with category null for all, and
    whether enough answers were found for it to mean something."""
    rows = found.rollup("category").agg(F.count("*").alias("asked"), F.count_if("in_baseline").alias("found"), F.count_if(F.col("in_baseline") & F.col("retained")).alias("kept"))
    share = F.when(F.col("found") > 0, F.round(F.col("kept") / F.col("found"), 4)).otherwise(F.lit(0.0))
    return rows.select("category", "asked", "found", "kept", share.alias("retention"), (F.col("found") >= RELIABLE * F.col("asked")).alias("reliable"))


def marked(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """(question_id, url, has_all): whether a text of texts(question_id, url, content) holds every marker (a pattern,
    in any case) of its question; questions without markers have null."""
    q = questions.select(F.col("id").alias("question_id"), "must_contain")
    rows = texts.join(q, "question_id")
    return rows.select("question_id", "url", F.when(F.size("must_contain") > 0, F.forall("must_contain", lambda m: F.rlike(F.coalesce(F.col("content"), F.lit("")), F.concat(F.lit("(?i)"), m)))).alias("has_all"))
