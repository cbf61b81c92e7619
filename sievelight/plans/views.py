"""Inputs of the queries, derived from the supplied tables over all their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators import cache
from sievelight.session import table

#: The clock of the queries, as a time and in milliseconds.
AS_OF = "2025-03-01T00:00:00Z"
AS_OF_MS = 1_740_787_200_000


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def latest_pages(spark: SparkSession, d: str) -> DataFrame:
    """The newest capture of each url."""
    return cache.upsert(table(spark, d, "page_cache"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """Search results, repeated rows once."""
    return table(spark, d, "results").dropDuplicates(["ord"])


def asked_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of each question: those whose url a call of the question looked at."""
    seen = table(spark, d, "independence").select("question_id", "url").distinct()
    q = table(spark, d, "questions").select(F.col("id").alias("question_id"), F.col("text").alias("question"))
    return results(spark, d).join(seen, "url").join(F.broadcast(q), "question_id")  # 60 questions at every scale


def call_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each past call: call_id, question_id, ord, url, content."""
    calls = table(spark, d, "independence").dropDuplicates(["call_id", "ord"]).select("call_id", "question_id", "ord", "url")
    return calls.join(latest_pages(spark, d).select("url", "content"), "url", "left")


def escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each page as html: its first line as title, its host as site name, paragraphs in an article between a menu and a
    footer; every third page also with its text as JSON-LD, every fourth with a framework's marks."""
    p = latest_pages(spark, d).where(F.col("content").isNotNull())
    title = F.regexp_extract("content", r"^\s*#*\s*([^\r\n]*)", 1)
    body = F.regexp_replace(escaped(F.col("content")), r"\r?\n[ \t]*\r?\n", "</p><p>")
    n = F.length("content")
    ld = F.when(n % 3 == 0, F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("Article").alias("@type"), title.alias("headline"), F.col("content").alias("articleBody"))), F.lit("</script>"))).otherwise(F.lit(""))
    mark = F.when(n % 4 == 0, F.lit('<script id="__NEXT_DATA__" type="application/json">{"a":1}</script>')).when(n % 4 == 1, F.lit("<script>self.__next_f.push([1])</script>")).when(n % 4 == 2, F.lit("<script>window.__NUXT__={}</script>")).otherwise(F.lit(""))
    html = F.concat(
        F.lit("<html><head><title>"), escaped(title), F.lit('</title><meta content="'), F.col("extraction_method"), F.lit('" name="author"><meta property="og:site_name" content="Site"><style>p{a:b}</style>'), ld, mark,
        F.lit('</head><body><nav>Home</nav><article><p>'), body, F.lit('</p></article><script>var x="</p>";</script><footer>&copy; Site</footer></body></html>'),
    )
    status = F.when(n % 11 == 0, F.lit(403)).when(n % 13 == 0, F.lit(None).cast("int")).otherwise(F.lit(200))
    return p.select("url", "content", "created_at", title.alias("title"), F.coalesce(html, F.lit("")).alias("html"), status.alias("status"))


def captures(spark: SparkSession, d: str) -> DataFrame:
    """Results as responses captured by a browser, with several content types and some bad payloads."""
    n = F.col("ord") % 4
    kind = F.when(n == 0, F.lit("application/json; charset=utf-8")).when(n == 1, F.lit("text/html")).otherwise(F.lit("application/json"))
    return results(spark, d).select("ord", "url", F.when(F.col("ord") % 3 == 0, F.lit("POST")).otherwise(F.lit("GET")).alias("method"), kind.alias("content_type"), F.when(F.col("ord") % 7 == 0, F.lit('{"a":')).otherwise(F.lit('{"a": 1}')).alias("data"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls of providers."""
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("provider"), F.col("event_id").alias("ord"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP'1970-01-01 00:00:00', cast(ts AS timestamp))").alias("arrive_ms"), (F.col("event_id") % 7 * 700).alias("duration_ms"), (F.col("event_id") % 50 == 0).alias("blocked"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Results as captured answers of three providers: provider, query, n (number of the query), status, body.

    Ten results make the answers of one query; each ninth query was throttled and each eleventh timed out."""
    r = results(spark, d).withColumn("n", F.floor(F.col("ord") / 10).cast("long")).withColumn("k", F.col("ord") % 3)
    both = lambda *c: F.to_json(F.struct(*c))
    brave = both(F.col("title"), F.col("url"), F.col("snippet").alias("description"), F.array("source").alias("extra_snippets"), F.col("published").alias("age"))
    tavily = both(F.col("title"), F.col("url"), F.col("snippet").alias("content"), F.col("score"), F.col("published").alias("published_date"))
    html = F.concat(F.lit('<div class="result"><a class="result__a" href="/l/?uddg='), F.url_encode(F.coalesce("url", F.lit(""))), F.lit('">'), escaped(F.coalesce("title", F.lit(""))), F.lit('</a><a class="result__snippet">'), escaped(F.coalesce("snippet", F.lit(""))), F.lit("</a></div>"))
    item = F.when(F.col("k") == 0, brave).when(F.col("k") == 1, tavily).otherwise(html)
    parts = r.groupBy("n", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("x")))), lambda v: v.x).alias("l"))  # at most ten
    listed = F.array_join("l", ",")
    body = F.when(F.col("k") == 0, F.concat(F.lit('{"web":{"results":['), listed, F.lit("]}}"))).when(F.col("k") == 1, F.concat(F.lit('{"results":['), listed, F.lit("]}"))).otherwise(F.concat(F.lit("<html>"), F.array_join("l", ""), F.lit("</html>")))
    status = F.when(F.col("n") % 9 == 0, F.lit(429)).when(F.col("n") % 11 == 0, F.lit(None).cast("int")).otherwise(F.lit(200))
    provider = F.when(F.col("k") == 0, F.lit("brave")).when(F.col("k") == 1, F.lit("tavily")).otherwise(F.lit("duckduckgo"))
    return parts.select(provider.alias("provider"), F.concat(F.lit("q"), F.col("n")).alias("query"), "n", status.alias("status"), F.when(status == 200, body).alias("body"))


def hops(spark: SparkSession, d: str) -> DataFrame:
    """Redirects among the results: each url of an odd ord leads to the url of half of it, each seventh to a private address."""
    r = results(spark, d).where("url IS NOT NULL")
    first = r.groupBy("url").agg(F.min("ord").alias("ord"))
    goal = first.select(F.col("ord").alias("half"), F.col("url").alias("target"))
    far = first.where("ord % 2 = 1").withColumn("half", F.floor(F.col("ord") / 2)).join(goal, "half").where("url <> target")
    return far.select("url", F.when(F.col("ord") % 7 == 0, F.lit("http://127.0.0.1/")).otherwise(F.col("target")).alias("target"))
