"""Cited evidence for questions: passages of opened pages, weighed by density and spread over independent sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.operators import passages as P
from sievelight.session import materialize

PER_PAGE, OVERSAMPLE, EXCERPTS = 2, 4, 5
LOW_DENSITY = 0.5


def citations(pages: DataFrame, limit: int = EXCERPTS) -> DataFrame:
    """(call_id, citation, url, title, quote, start_pos, end_pos, relevance) of pages(call_id, ord, url, title, content,
    question, cluster, content_duplicate, density); offsets are those of the trimmed content.

    Reprints and blank pages are skipped, of a page's first eight passages those that are no data dumps and at most
    two count; first one of each cluster in the order of score, then the rest, to ``limit``. A null cluster is one of
    its own, a null density weighs 1."""
    keep = pages.where(~F.coalesce("content_duplicate", F.lit(False))).withColumn("content", T.js_trim(F.coalesce("content", F.lit("")))).where("content <> ''")
    texts = keep.select("url", "content").dropDuplicates(["url"])
    split = materialize(P.split(texts))  # read by each branch of the ranking
    asked = keep.select(F.col("call_id").alias("question_id"), "url", "question").dropDuplicates(["question_id", "url"])
    top = P.select(split.select("url", "passage_no", "passage"), asked, PER_PAGE * OVERSAMPLE)
    rows = top.withColumnRenamed("question_id", "call_id").join(split, ["url", "passage_no"]).where(~T.looks_serialized(F.col("passage")))
    rows = rows.withColumn("prank", F.row_number().over(Window.partitionBy("call_id", "url").orderBy("prank"))).where(F.col("prank") <= PER_PAGE)
    rows = rows.join(keep.select("call_id", "ord", "url", "title", "cluster", "density"), ["call_id", "url"])
    weighed = rows.withColumn("weighted", F.col("score") * T.density_weight(F.coalesce("density", F.lit(1.0)))).withColumn("citation", F.col("ord") + 1)
    order = Window.partitionBy("call_id").orderBy(F.desc("weighted"), "citation", "prank")
    group = Window.partitionBy("call_id", F.coalesce("cluster", -F.col("citation"))).orderBy(F.desc("weighted"), "citation", "prank")
    first = weighed.withColumn("_first", F.row_number().over(group) == 1).withColumn("_place", F.row_number().over(order))
    pick = Window.partitionBy("call_id").orderBy(F.desc("_first"), "_place")
    chosen = first.withColumn("_pick", F.row_number().over(pick)).where(F.col("_pick") <= limit)
    return chosen.select("call_id", "citation", "url", "title", F.col("passage").alias("quote"), "start_pos", "end_pos", F.round("weighted", 4).alias("relevance"))


def answers(calls: DataFrame, cited: DataFrame) -> DataFrame:
    """(call_id, answer) of calls(call_id, url; a row for each page opened, url null where there is none): the numbered
    quotes under the number of pages; a fixed sentence for a call that cites nothing."""
    order = F.array_sort(F.collect_list(F.struct("citation", (-F.col("relevance")).alias("r"), "quote")))  # at most EXCERPTS
    quotes = cited.groupBy("call_id").agg(F.array_join(F.transform(order, lambda x: F.concat(F.lit("["), x.citation, F.lit("] "), x.quote)), "\n\n").alias("q"))
    pages = calls.groupBy("call_id").agg(F.count("url").alias("n"))
    text = F.concat(F.lit("Based on "), F.col("n"), F.lit(" sources:\n\n"), F.col("q"))
    return pages.join(quotes, "call_id", "left").select("call_id", F.coalesce(text, F.lit("No results found")).alias("answer"))


def evidence(pages: DataFrame, cited: DataFrame) -> DataFrame:
    """Counters of each call: opened, independent, derivative, low_density, cited and coverage of the question."""
    opened = pages.groupBy("call_id").agg(F.count("*").alias("opened"), F.countDistinct("cluster").alias("independent"), F.count_if(F.col("density") < LOW_DENSITY).alias("low_density"), F.max("question").alias("question"))
    text = cited.groupBy("call_id").agg(F.count("*").alias("cited"), F.array_join(F.array_sort(F.collect_list("quote")), " ").alias("quotes"))
    rows = opened.join(text, "call_id", "left")
    return rows.select("call_id", "opened", "independent", F.greatest(F.lit(0), F.col("opened") - F.col("independent")).cast("long").alias("derivative"), "low_density", F.coalesce("cited", F.lit(0)).cast("long").alias("cited"), T.coverage(F.col("question"), F.col("quotes")).alias("coverage"))
