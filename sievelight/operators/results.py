"""Search results: union of providers, de-duplication, ranking, site search and news.

results: ord, title, url, snippet, published, score, source. Ties end in ord, which is the order of arrival; repeated
rows (same ord) count once. Extra columns are carried along. The ``by`` columns name the independent result sets (one
for each query); without them the whole table is one set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.functions import urls as U

WINDOW = 30  # results that are ranked for a site search


def union_providers(providers: list[tuple[str, DataFrame]]) -> DataFrame:
    """Results of all providers in provider order: ord is renumbered (provider, then the provider's own ord)."""
    parts = [df.withColumn("provider", F.lit(n)).withColumn("provider_ord", F.lit(i)) for i, (n, df) in enumerate(providers)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def warnings_of(statuses: DataFrame) -> DataFrame:
    """Distinct warnings of provider calls (provider, status, message): failed and timed-out ones."""
    return statuses.where("status <> 'ok'").select(F.concat_ws(": ", "provider", F.coalesce("message", "status")).alias("warning")).distinct()


def deduplicate(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The best-scored row of each normalised url (missing score 0, first of equals), at the place of the url's first
    row (column position); malformed urls are dropped.

    One aggregation with a map-side combine, so that a url with a third of the rows is reduced before the shuffle."""
    rest = [c for c in results.columns if c not in by]
    rows = results.withColumn("norm_url", U.normalize_url(F.col("url"))).where(F.col("norm_url").isNotNull())
    best = F.min(F.struct((-F.coalesce("score", F.lit(0.0))).alias("worst"), F.col("ord").alias("o"), F.struct(*rest).alias("r")))
    out = rows.groupBy(*by, "norm_url").agg(best.alias("best"), F.min("ord").alias("position"))
    return out.select(*by, "norm_url", "position", *[F.col(f"best.r.{c}").alias(c) for c in rest])


def scored(results: DataFrame, query: Column, as_of: Column, days: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds relevance = half the term overlap + fifth of the domain score + fifth of recency + tenth of the score's
    share of the set's greatest."""
    best = F.greatest(F.max(F.coalesce("score", F.lit(0.0))), F.lit(0.0)).alias("best_score")
    if by:
        rows = results.join(results.groupBy(*by).agg(best), list(by))
    else:
        rows = results.join(F.broadcast(results.agg(best)), F.lit(True))  # one row
    share = F.when(F.col("best_score") > 0, F.coalesce("score", F.lit(0.0)) / F.col("best_score")).otherwise(F.lit(0.0))
    relevance = T.term_overlap(query, F.col("title"), F.col("snippet")) * 0.5 + U.domain_score(F.col("url")) * 0.2 + T.recency(F.col("published"), as_of, days) * 0.2 + share * 0.1
    return rows.withColumn("relevance", relevance).drop("best_score")


def numbered(rows: DataFrame, by: tuple[str, ...] = (), order: str = "position") -> DataFrame:
    """Adds rank, 1-based by relevance and then by the order given, in each set."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or (F.lit(0),))).orderBy(F.desc("relevance"), F.col(order))))


def rerank(results: DataFrame, query: Column, as_of: Column, days: int = 30, by: tuple[str, ...] = (), order: str = "position") -> DataFrame:
    """scored and numbered: every row of each set with its relevance and rank."""
    return numbered(scored(results, query, as_of, days, by), by, order)


def search(results: DataFrame, query: Column, as_of: Column, limit: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """De-duplicated, ranked, the first ``limit`` of each set; no filter on dates."""
    _check("limit", limit, 1, 20)
    rows = scored(deduplicate(results, by), query, as_of, by=by)
    if not by:  # a top-k of the whole table, never a sort of it in one task
        rows = rows.orderBy(F.desc("relevance"), "position").limit(limit)
    return numbered(rows, by).where(F.col("rank") <= limit)


def find_on_site(results: DataFrame, site: str, query: Column, as_of: Column, limit: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """search among the results of one site and its subdomains."""
    h = U.host(F.col("url"))
    return search(results.where((h == site.lower()) | h.endswith("." + site.lower())), query, as_of, limit, by)


def within_days(published: Column, as_of: Column, days: int, undated: bool) -> Column:
    """Whether a result is recent; results without a readable date pass if ``undated``."""
    t = T.parsed_time(published)
    return F.coalesce(t >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(undated))


def news(results: DataFrame, query: Column, as_of: Column, days: int = 7, limit: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Recent results, one per host, at most ``limit`` of each set, with rank and day; where a set has no recent result
    its undated ones (null or empty dates, not unreadable ones) take their place and recency_verified is false."""
    _check("days", days, 1, 365)
    ranked = rerank(deduplicate(results, by), query, as_of, days, by)
    part = Window.partitionBy(*(by or (F.lit(0),)))
    rows = ranked.withColumn("recent", within_days(F.col("published"), as_of, days, False)).withColumn("blank", F.coalesce(F.col("published") == "", F.lit(True)))
    rows = rows.withColumn("recency_verified", F.max("recent").over(part))
    rows = rows.where(F.when(F.col("recency_verified"), F.col("recent")).otherwise(F.col("blank")))
    host = Window.partitionBy(*by, "raw_host").orderBy("rank")
    rows = rows.withColumn("raw_host", U.raw_host(F.col("url"))).withColumn("in_host", F.row_number().over(host)).where("in_host = 1")
    rows = rows.withColumn("rank", F.row_number().over(part.orderBy("rank"))).where(F.col("rank") <= limit)
    return rows.withColumn("day", F.when(~F.col("blank"), F.substring("published", 1, 10))).drop("recent", "blank", "in_host", "raw_host")


def timeline(news_rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Results of each day in rank order; undated ones are left out. At most ``limit`` results of a set reach it."""
    rows = news_rows.where(F.col("day").isNotNull())
    return rows.groupBy(*by, "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x.url).alias("urls"))


def _check(name: str, value: int, lo: int, hi: int) -> None:
    if not lo <= value <= hi:
        raise ValueError(f"{name} must be from {lo} to {hi}, not {value}")
