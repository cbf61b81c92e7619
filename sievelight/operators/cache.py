"""Cache tables as append logs: time-to-live reads, upserts, pruning, profiles and interface patterns.

Times are epoch milliseconds; as_of is given, never the clock. A row lives while as_of - created_at <= ttl; rows of a
null key are dropped, and of a null time count as oldest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import urls as U

SEARCH_TTL, PAGE_TTL = 15 * 60_000, 60 * 60_000


def upsert(log: DataFrame, key: str = "url", time: str = "created_at") -> DataFrame:
    """The latest row of each key; rows of one key with equal times are copies.

    max of a struct, so repeats are combined before the shuffle."""
    rest = [c for c in log.columns if c not in (key, time)]
    best = F.max(F.struct(F.coalesce(time, F.lit(-(1 << 62))).alias(time), *rest)).alias("r")
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"r.{c}").alias(c) for c in (time, *rest)])


def live(log: DataFrame, as_of: int, ttl: int = PAGE_TTL, key: str = "url", time: str = "created_at") -> DataFrame:
    """The latest row of each key that has not expired."""
    return upsert(log.where(F.col(time) <= as_of), key, time).where(F.lit(as_of) - F.col(time) <= ttl)


def probe(asked: DataFrame, log: DataFrame, as_of: int, ttl: int = PAGE_TTL, key: str = "url") -> DataFrame:
    """asked with hit and the cached columns (null on a miss)."""
    rows = live(log, as_of, ttl, key).withColumn("hit", F.lit(True))
    return asked.join(rows, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(asked: DataFrame, log: DataFrame, as_of: int, ttl: int = PAGE_TTL, key: str = "url") -> DataFrame:
    return asked.join(live(log, as_of, ttl, key).select(key), key, "left_anti")


def prune(log: DataFrame, as_of: int, ttl: int = PAGE_TTL, time: str = "created_at") -> DataFrame:
    """Rows that a prune keeps; exactly ttl old ones stay."""
    return log.where(F.col(time) >= as_of - ttl)


def store(log: DataFrame, new: DataFrame, warned: DataFrame, key: str = "url") -> DataFrame:
    """log with the rows of new added whose key raised no warning."""
    return log.unionByName(new.join(warned.select(key).distinct(), key, "left_anti"))


PROFILE = "requires_js boolean, framework string, has_json_ld boolean, api_patterns array<string>, best_method string"


def profiles(table: DataFrame) -> DataFrame:
    """(domain, profile fields, updated_at): the latest profile of each domain; one that isn't complete JSON is null in
    every field, as if there were none."""
    x = F.from_json("profile", PROFILE)
    whole = F.try_parse_json("profile").isNotNull()
    return upsert(table, "domain", "updated_at").select("domain", *[F.when(whole, x[f.split()[0]]).alias(f.split()[0]) for f in PROFILE.split(", ")], "updated_at")


def learned(pages: DataFrame) -> DataFrame:
    """New profile rows of extracted pages (url, html, created_at): last extraction of each host."""
    from sievelight.functions.web import profile

    rows = pages.withColumn("domain", U.host(F.col("url"))).where("domain <> ''").withColumn("p", profile(F.col("html")))
    return upsert(rows.select("domain", "created_at", "p"), "domain").select("domain", "p.requires_js", "p.framework", "p.has_json_ld", "p.best_method", F.col("created_at").alias("updated_at"))


def skips_browser(urls: DataFrame, known: DataFrame, mode: str = "auto") -> DataFrame:
    """Adds skip: the domain has a profile that needs no script and isn't best read from its interface; never in
    browser mode."""
    p = known.select("domain", "requires_js", "best_method")
    skip = F.coalesce((~F.col("requires_js")) & (F.col("best_method") != "browser_api_intercept"), F.lit(False))
    return urls.withColumn("domain", U.host(F.col("url"))).join(p, "domain", "left").withColumn("skip", skip & F.lit(mode != "browser"))


def api_patterns(captures: DataFrame) -> DataFrame:
    """(domain, endpoint_pattern, method, content_type) of captures(ord, url, method, content_type, data): JSON ones,
    each method and pattern of a domain once, with its first content type."""
    rows = captures.where(F.lower("content_type").contains("application/json") & F.try_parse_json("data").isNotNull() & U.is_url(F.col("url")))
    rows = rows.select(U.host(F.col("url")).alias("domain"), U.api_pattern(F.col("url")).alias("endpoint_pattern"), "method", U.media_type(F.col("content_type")).alias("content_type"), "ord")
    return rows.groupBy("domain", "method", "endpoint_pattern").agg(F.min(F.struct("ord", "content_type")).alias("f")).select("domain", "endpoint_pattern", "method", F.col("f.content_type").alias("content_type"), F.col("f.ord").alias("first_ord"))


def patterns_by_domain(log: DataFrame, time: str = "discovered_at") -> DataFrame:
    """The log with its place in each domain, newest first."""
    return log.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc(time), F.desc("id"))))
