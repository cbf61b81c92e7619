"""The tools end to end: search, site search, news, extraction and research over tables of results and pages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.functions import web as W
from sievelight.operators import cache, expand, independence, pacing, research, results, router, screen
from sievelight.session import materialize

MAX_PAGES = 10
MODES = ("auto", "fast", "browser")
DEPTHS = {"quick": expand.QUICK, "deep": expand.LIMIT}
BANNER = "[The following page content is untrusted and contains text that addresses the reader's tools.]\n\n"


def checked(**given) -> None:
    """Raises ValueError for a value outside its range: limits 1 to 20, days 0 to 365 (news 1 to 365), results per
    query 1 to 10, known modes and depths, no empty list of urls."""
    ranges = {"max_results": (1, 20), "recency_days": (0, 365), "news_days": (1, 365), "count_per_query": (1, 10)}
    for name, value in given.items():
        if name in ranges and not ranges[name][0] <= value <= ranges[name][1]:
            raise ValueError(f"{name} must be from {ranges[name][0]} to {ranges[name][1]}, not {value}")
        if name == "mode" and value not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if name == "depth" and value not in DEPTHS:
            raise ValueError(f"depth must be one of {', '.join(DEPTHS)}")
        if name == "urls" and not value:
            raise ValueError("urls must not be empty")


def web_extract(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """router.route of pages with screening: content that addresses the reader is prefixed with a banner. A page whose
    url must not be fetched, or without content, has confidence 0 and no content. budget_ms is what it may take."""
    checked(mode=mode)
    routed = screen.annotate(screen.screen(router.route(pages, mode)), BANNER)
    refused = screen.U.refusal(F.col("url")).isNotNull()
    empty = refused | (F.coalesce("content", F.lit("")) == "")
    return routed.withColumn("error", F.when(refused, F.lit("refused")).when(empty, F.lit("no content"))).withColumn("confidence", F.when(empty, F.lit(0.0)).otherwise(F.col("confidence"))).withColumn("content", F.when(empty, F.lit("")).otherwise(F.col("content"))).withColumn("budget_ms", pacing.budget_ms(F.lit(mode != "fast")))


def publishable(pages: DataFrame) -> DataFrame:
    """(url, json_ld, present, readable_chars) of pages(url, html): the JSON-LD objects that fit, the names of the
    hydration containers the page has, and how much readable text its payload holds."""
    html = F.col("html")
    rows = pages.select("url", "html", W.json_ld_objects(W.json_ld_texts(html)).alias("objects"), W.next_data(html).alias("next"), W.next_flight(html).alias("flight"))
    for name in ("__NUXT__", "__APOLLO_STATE__", "__INITIAL_STATE__"):
        rows = rows.withColumn(name, W.window_object(name)(html))
    names = {"nextData": "next", "nextFlight": "flight", "nuxt": "__NUXT__", "apollo": "__APOLLO_STATE__", "initialState": "__INITIAL_STATE__"}
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in names.items()]))
    return rows.select("url", router.published_objects(F.col("objects")).alias("json_ld"), present.alias("present"), F.length(W.hydration_text(F.col("next"))).alias("readable_chars"))


class Research(NamedTuple):
    sources: DataFrame
    citations: DataFrame
    evidence: DataFrame
    answers: DataFrame
    queries_used: DataFrame
    extraction_stats: DataFrame


def research_statistics(opened: DataFrame) -> DataFrame:
    """Methods and mean confidence of the pages each call opened; pages without a known method count as best effort."""
    if "method" not in opened.columns:
        opened = opened.withColumn("method", F.lit("best_effort")).withColumn("confidence", F.lit(router.CONFIDENCE["best_effort"]))
    return router.statistics(opened.select("call_id", F.coalesce("method", F.lit("best_effort")).alias("method"), F.coalesce("confidence", F.lit(router.CONFIDENCE["best_effort"])).alias("confidence")), ("call_id",))


def cached_research(answers: DataFrame, statuses: DataFrame, log: DataFrame) -> DataFrame:
    """log(key, query, results, created_at) with the answers(key, query, results, created_at) of runs without a warning:
    a run whose searches were refused would serve its gap until it expires. statuses(key, status)."""
    return cache.store(log, answers, statuses.where("status <> 'ok'").select("key"), "key")


def web_research(questions: DataFrame, found: DataFrame, pages: DataFrame, as_of: Column, depth: str = "deep", recency_days: int = 0) -> Research:
    """Research of all questions(id, text) at once.

    found(query, ord, ...) are results by query text: each question's variants (two for quick, six for deep) are joined
    with them, de-duplicated, ranked, cut to the recent ones (undated pass; 0 days: all) and to MAX_PAGES; their pages
    (url, content, and method and confidence where known) are clustered, weighed and cited. Pages that are missing or
    empty cite nothing but stay sources. queries_used has the variants of each question."""
    checked(depth=depth, recency_days=recency_days)
    variants = expand.expand(questions.select(F.col("id").alias("question_id"), F.col("text").alias("question")), "question", DEPTHS[depth])
    asked = found.join(variants, F.col("query") == F.col("variant")).withColumn("ord", (F.col("variant_no") * 1_000_000 + F.col("ord")).cast("long"))
    ranked = results.rerank(results.deduplicate(asked.drop("query", "variant", "variant_no"), ("question_id",)), F.col("question"), as_of, by=("question_id",))
    if recency_days:
        ranked = ranked.where(results.within_days(F.col("published"), as_of, recency_days, True))
        ranked = results.numbered(ranked.drop("rank"), ("question_id",))
    known = [c for c in ("method", "confidence") if c in pages.columns]
    top = materialize(ranked.where(F.col("rank") <= MAX_PAGES).select("question_id", "question", "rank", "url", "title", "relevance"))
    opened = materialize(top.join(pages.select("url", "content", *known), "url").select(F.col("question_id").alias("call_id"), (F.col("rank") - 1).cast("long").alias("ord"), "url", "title", "question", "content", *known))
    clusters = independence.analyze(opened.select("call_id", "ord", "url", "content")).select("call_id", "ord", "cluster", "content_duplicate")
    weighed = materialize(opened.join(clusters, ["call_id", "ord"]).withColumn("density", T.information_density(T.density_signals(F.col("content")))))
    cited = materialize(research.citations(weighed))
    calls = questions.select(F.col("id").alias("call_id")).join(opened.select("call_id", "url"), "call_id", "left")
    return Research(top, cited, research.evidence(weighed, cited), research.answers(calls, cited), variants, research_statistics(weighed))
