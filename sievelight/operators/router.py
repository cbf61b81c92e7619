"""Tiers of page extraction, fallback variants and the fusion of strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.functions import urls as U
from sievelight.functions import web as W

# Confidence of each tier and baseline of each strategy.
CONFIDENCE = {"http_fetch": 0.85, "hydration_data": 0.90, "product": 0.95, "browser_api_intercept": 0.96, "rendered_dom": 0.90, "best_effort": 0.50}
BASELINE = {"api": 0.99, "jsonld": 0.95, "rendered": 0.9, "readability": 0.85, "metadata": 0.6}
RENDERED = ("api", "rendered")
SNIPPET_CONFIDENCE, SNIPPETS = 0.6, 3


def blocked(status: Column) -> Column:
    """Whether a fetch failed (null status) or was refused."""
    return status.isNull() | status.isin(401, 403, 429)


def weak(status: Column, confidence: Column) -> Column:
    """Whether a page takes other evidence: it refused, or was read with a confidence below one half."""
    return blocked(status) | (F.coalesce(confidence, F.lit(0.0)) < CONFIDENCE["best_effort"])


def structured_content(objects: Column, payload_text: Column) -> Column:
    """articleBody, description, headline and name of the JSON-LD objects, then the payload's text, by blank lines."""
    field = lambda o, f: F.get_json_object(o, f"$.{f}")
    four = F.flatten(F.transform(objects, lambda o: F.array(*[field(o, f) for f in ("articleBody", "description", "headline", "name")])))
    kept = F.filter(four, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.array_join(F.filter(F.concat(kept, F.array(F.coalesce(payload_text, F.lit("")))), lambda x: x != ""), "\n\n")


def is_product(objects: Column) -> Column:
    t = lambda o: F.coalesce(F.get_json_object(o, "$['@type']"), F.lit(""))
    return F.exists(objects, lambda o: (t(o) == "Product") | (t(o).startswith("[") & t(o).contains('"Product"')))


def published_objects(objects: Column) -> Column:
    """The first JSON-LD objects whose sizes sum to at most MAX_JSONLD; the first that overflows ends them."""
    total = lambda sizes, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, x: a + x)
    return T.let(F.transform(objects, F.length), lambda sizes: F.filter(objects, lambda o, i: total(sizes, i) <= W.MAX_JSONLD))


def route(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """url, method, confidence, rendered, content of pages(url, status, html, cached, rendered_html, api_payloads,
    skip_browser): the first of cache, plain fetch, hydration, browser and best effort that has enough content.

    cached is a struct(content, extraction_method, confidence) or null. Pages settled by the cache never reach the
    parsers; each later tier is computed for all of the rest, as its Arrow UDF runs before a CASE could skip it."""
    hit = F.col("cached").isNotNull()
    cached = pages.where(hit).select("url", F.col("cached.extraction_method").alias("method"), F.col("cached.confidence").alias("confidence"), F.lit(False).alias("rendered"), F.col("cached.content").alias("content"))
    rest = pages.where(~hit).withColumn("_html", F.coalesce(F.substring("html", 1, W.BODY_LIMIT), F.lit("")))
    rest = rest.withColumn("_article", W.article_text(F.col("_html"))).withColumn("_objects", W.json_ld_objects(W.json_ld_texts(F.col("_html"))))
    rest = rest.withColumn("_structured", structured_content(F.col("_objects"), W.hydration_text(W.next_data(F.col("_html")))))
    rest = rest.withColumn("_rendered", F.when(F.col("rendered_html").isNotNull() & ~F.coalesce("skip_browser", F.lit(False)), T.stripped_text(F.col("rendered_html"))))
    l1 = F.lit(mode != "browser") & F.col("status").isNotNull() & W.enough(F.col("_html")) & F.col("_article").isNotNull()
    l2 = F.length("_structured") > W.STRUCTURED_ENOUGH
    l3 = F.lit(mode != "fast") & (F.length("_rendered") > 0)
    api = F.coalesce(F.size("api_payloads") > 0, F.lit(False))
    tier = lambda m, c, r, x: F.struct(F.lit(m).alias("method"), c.alias("confidence"), F.lit(r).alias("rendered"), x.alias("content"))
    won = (
        F.when(l1, tier("http_fetch", F.lit(CONFIDENCE["http_fetch"]), False, F.col("_article")))
        .when(l2, tier("hydration_data", F.when(is_product(F.col("_objects")), F.lit(CONFIDENCE["product"])).otherwise(F.lit(CONFIDENCE["hydration_data"])), False, F.col("_structured")))
        .when(l3 & api, tier("browser_api_intercept", F.lit(CONFIDENCE["browser_api_intercept"]), True, F.col("_rendered")))
        .when(l3, tier("rendered_dom", F.lit(CONFIDENCE["rendered_dom"]), True, F.col("_rendered")))
        .otherwise(tier("best_effort", F.lit(CONFIDENCE["best_effort"]), False, F.coalesce("_article", T.stripped_text(F.col("_html")))))
    )
    return cached.unionByName(rest.select("url", won.alias("w")).select("url", "w.*"))


def host_snippets(pages: DataFrame, found: DataFrame) -> DataFrame:
    """fallback's snippets for pages(url, h): the first results of their host h in found(ord, snippet_url, snippet, h),
    distinct by url, without the page's own.

    One more result of each host than fallback takes is joined: a page's own url drops at most one of them. Pages by all
    results of a host would be quadratic."""
    once = found.groupBy("h", "snippet_url").agg(F.min(F.struct("ord", "snippet")).alias("s"))
    first = once.withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("s.ord"))).where(F.col("n") <= SNIPPETS + 1)
    return pages.select("url", "h").join(first, "h").where("url <> snippet_url").select("url", "s.ord", "snippet_url", "s.snippet")


def fallback(blocked_urls: DataFrame, variants: DataFrame, snippets: DataFrame) -> DataFrame:
    """Evidence for pages that refused: (url, source, content, confidence) of the first usable url variant, else of at
    most three snippets of other results, distinct by their url.

    blocked_urls(url); variants(url, variant_no, status, html); snippets(url, ord, snippet_url, snippet)."""
    usable = variants.where(F.col("status").between(200, 299) & (F.trim(F.coalesce("html", F.lit(""))) != ""))
    first = usable.groupBy("url").agg(F.min(F.struct("variant_no", "html")).alias("v")).select("url", T.stripped_text(F.col("v.html")).alias("variant_text"))
    once = snippets.groupBy("url", "snippet_url").agg(F.min(F.struct("ord", "snippet")).alias("s"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("s.ord"))).where(F.col("n") <= SNIPPETS)
    joined = ranked.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("s.snippet").alias("t")))), lambda x: x.t), "\n\n").alias("snippet_text"))
    rows = blocked_urls.select("url").join(first, "url", "left").join(joined, "url", "left")
    source = F.when(F.col("variant_text").isNotNull(), F.lit("variant")).when(F.col("snippet_text").isNotNull(), F.lit("snippets")).otherwise(F.lit("none"))
    return rows.select("url", source.alias("source"), F.coalesce("variant_text", "snippet_text", F.lit("")).alias("content"), F.when(source == "none", F.lit(0.0)).when(source == "snippets", F.lit(SNIPPET_CONFIDENCE)).otherwise(F.lit(CONFIDENCE["best_effort"])).alias("confidence"))


NOTE = "> Note: primary extraction blocked or low-confidence; alternative source evidence appended."


def append_evidence(routed: DataFrame, evidence: DataFrame) -> DataFrame:
    """routed(url, status, confidence, content, ...) with the evidence (fallback's rows) of pages that refused or have a
    confidence below one half: its text under a note takes the content's place. Adds evidence_source, null without."""
    e = evidence.where("source <> 'none'").select("url", F.col("source").alias("_source"), F.col("content").alias("_text"))
    rows = routed.join(e, "url", "left").withColumn("evidence_source", F.when(weak(F.col("status"), F.col("confidence")), F.col("_source")))
    text = F.when(F.col("evidence_source").isNotNull() & (F.col("_text") != ""), F.concat(F.lit(NOTE + "\n\n"), F.col("_text"))).otherwise(F.col("content"))
    return rows.withColumn("content", text).drop("_source", "_text")


def writes(routed: DataFrame, as_of: int) -> tuple[DataFrame, DataFrame]:
    """(page_cache rows, profile rows) that routing leaves behind: the pages of routed(url, method, confidence, content,
    html) with content, and for each host what its page of the greatest url shows, with the method that read it."""
    kept = routed.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    log = kept.select("url", "content", F.col("method").alias("extraction_method"), "confidence", F.lit(as_of).cast("long").alias("created_at"))
    p = W.profile(F.coalesce("html", F.lit("")))
    by = kept.select(U.host(F.col("url")).alias("domain"), "url", p.alias("p"), W.best_method(F.col("method")).alias("best_method")).where("domain <> ''")
    best = by.groupBy("domain").agg(F.max(F.struct("url", "p", "best_method")).alias("r"))
    return log, best.select("domain", "r.p.requires_js", "r.p.framework", "r.p.has_json_ld", "r.best_method", F.lit(as_of).cast("long").alias("updated_at"))


def fuse(strategies: DataFrame) -> DataFrame:
    """One row per url of strategies(url, ord, method, confidence, content): the non-blank content of greatest
    confidence (the method's baseline at least, the first of equals); readability with confidence 0 without any."""
    base = F.lit(0.0)
    for m, c in BASELINE.items():
        base = F.when(F.col("method") == m, F.lit(c)).otherwise(base)
    eff = F.greatest(base, F.coalesce("confidence", F.lit(0.0)))
    blank = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")) == ""
    won = F.min(F.when(~blank, F.struct((-eff).alias("worst"), "ord", "method", "content")))
    rows = strategies.groupBy("url").agg(won.alias("w"), F.count("*").alias("n_strategies"))
    method = F.coalesce("w.method", F.lit("readability"))
    return rows.select("url", method.alias("method"), F.coalesce(-F.col("w.worst"), F.lit(0.0)).alias("confidence"), F.coalesce("w.content", F.lit("")).alias("content"), method.isin(*RENDERED).alias("rendered"), "n_strategies")


def merge_payloads(strategies: DataFrame, column: str) -> DataFrame:
    """(url, column): the arrays of all strategies of a url in their order; strategies of one url are few."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", F.col(column).alias("a"))))
    return strategies.where(F.col(column).isNotNull()).groupBy("url").agg(F.flatten(F.transform(ordered, lambda x: x.a)).alias(column))


def statistics(extracted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """method_counts (map) and mean confidence (0 without pages)."""
    counts = extracted.groupBy(*by, "method").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "n")))).alias("method_counts"), F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.0)).alias("avg_confidence"))

