"""Search providers as captured tables: enabled list, scans of their JSON and HTML answers, and a Python data source.

Live calls are no part of the engine; an answer is a row (provider, query, status, body). Unreadable bodies and rows
without url or title give no results, and a failed answer a warning."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievelight.functions import urls as U
from sievelight.functions import web as W

RESULT = "ord long, title string, url string, snippet string, published string, score double, source string"
ORDER = ("brave", "tavily", "duckduckgo")  # provider order; the last needs no key
BRAVE = "struct<web:struct<results:array<struct<title:string,url:string,description:string,extra_snippets:array<string>,age:string>>>>"
TAVILY = "struct<results:array<struct<title:string,url:string,content:string,score:double,published_date:string>>>"


def enabled(keys: dict[str, str | None]) -> list[str]:
    """Providers in order: those with a non-blank key, and the one that needs none."""
    return [p for p in ORDER if p == "duckduckgo" or (keys.get(p) or "").strip()]


def _rows(answers: DataFrame, items, source: str, fields: dict) -> DataFrame:
    rows = answers.select("query", F.posexplode(items).alias("ord", "r"))
    t, u = F.trim(F.coalesce(F.col("r.title"), F.lit(""))), F.trim(F.coalesce(F.col("r.url"), F.lit("")))
    return rows.where((t != "") & (u != "")).select("query", F.col("ord").cast("long").alias("ord"), F.col("r.title").alias("title"), F.col("r.url").alias("url"), *[v.alias(k) for k, v in fields.items()], F.lit(source).alias("source"))


def brave(answers: DataFrame) -> DataFrame:
    """Results of answers(query, body): description and extra snippets joined by spaces, age as published."""
    items = F.from_json("body", BRAVE)["web"]["results"]
    extra = F.coalesce(F.col("r.extra_snippets"), F.array().cast("array<string>"))
    return _rows(answers, items, "brave", {"snippet": F.trim(F.concat_ws(" ", F.coalesce(F.col("r.description"), F.lit("")), F.array_join(extra, " "))), "published": F.col("r.age"), "score": F.lit(None).cast("double")})


def tavily(answers: DataFrame) -> DataFrame:
    return _rows(answers, F.from_json("body", TAVILY)["results"], "tavily", {"snippet": F.coalesce(F.col("r.content"), F.lit("")), "published": F.col("r.published_date"), "score": F.col("r.score")})


def duckduckgo(answers: DataFrame) -> DataFrame:
    """Results of html answers; a challenge page has none (and a warning, see statuses)."""
    return _rows(answers.where(~F.coalesce(W.is_challenge(F.col("body")), F.lit(False))), W.serp_results(F.col("body")), "duckduckgo", {"snippet": F.col("r.snippet"), "published": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})


def serpapi(spark: SparkSession) -> DataFrame:
    """The stub provider: no results, with the schema."""
    return spark.createDataFrame([], "query string, " + RESULT)


def statuses(answers: DataFrame) -> DataFrame:
    """(provider, query, status, message): ok, blocked, timeout or error."""
    s = F.when(F.col("status").isNull(), F.lit("timeout")).when((F.col("provider") == "duckduckgo") & (~F.col("status").between(200, 299) | F.coalesce(W.is_challenge(F.col("body")), F.lit(False))), F.lit("blocked")).when(~F.col("status").between(200, 299), F.lit("error")).otherwise(F.lit("ok"))
    return answers.select("provider", "query", s.alias("status"), F.when(s != "ok", F.concat(s, F.coalesce(F.concat(F.lit(" "), F.col("status").cast("string")), F.lit("")))).alias("message"))


def redirect_target(href):
    """Target of a result link: its uddg parameter, else the link itself."""
    q = F.regexp_extract(href, r"[?&]uddg=([^&#]*)", 1)
    return F.when(q != "", F.try_url_decode(q)).otherwise(href)


class CapturedSearch(DataSource):
    """spark.read.format("captured_search").option("path", folder): parquet answers of providers as results, one
    partition per file. Options provider and query filter them."""

    @classmethod
    def name(cls) -> str:
        return "captured_search"

    def schema(self) -> str:
        return "provider string, query string, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _CapturedReader(self.options)


class _CapturedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.provider, self.query = options["path"], options.get("provider"), options.get("query")

    def partitions(self) -> list[InputPartition]:
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(".parquet"))
        return [InputPartition(f) for f in files]

    def read(self, partition) -> Iterator:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        want = None
        for name, value in (("provider", self.provider), ("query", self.query)):
            if value is not None:
                e = pc.field(name) == value
                want = e if want is None else want & e
        yield from ds.dataset(partition.value).to_batches(columns=["provider", "query", "status", "body"], filter=want)


def fetchable(pages: DataFrame) -> DataFrame:
    """Fetched pages that count: html or no content type, the body cut at the limit."""
    kind = F.lower(U.media_type(F.coalesce(F.col("content_type"), F.lit("text/html"))))
    return pages.where(kind == "text/html").withColumn("html", F.substring("html", 1, W.BODY_LIMIT))


def follow_redirects(starts: DataFrame, hops: DataFrame, most: int = 5) -> DataFrame:
    """(url, final, n_hops) after at most ``most`` redirects of hops(url, target); a longer chain or one to an address
    that must not be fetched ends with final null. One join per hop; loops end as too long."""
    at = starts.select("url", F.col("url").alias("final"), F.lit(0).alias("n_hops"))
    step = hops.select(F.col("url").alias("_from"), "target").dropDuplicates(["_from"])
    for _ in range(most + 1):
        j = at.join(step, at.final == step._from, "left")
        ok = U.refusal(F.col("target")).isNull()
        at = j.select("url", F.when(F.col("target").isNull(), F.col("final")).when(ok & (F.col("n_hops") < most), F.col("target")).alias("final"), F.when(F.col("target").isNull(), F.col("n_hops")).otherwise(F.col("n_hops") + 1).alias("n_hops"))
    return at
