"""Queries over literal inputs for the operators whose inputs the supplied tables lack, with the rows they must give.

Each case stands here once with its input and its result; the SQL of a case is the list of the results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.functions import web as W
from sievelight.operators import router
from sievelight.sources import providers

LONG = "The quiet harbour town rebuilt its library after the storm, and every family lent a hand with the work. "


def _script(body: str, kind: str = "application/ld+json") -> str:
    return f'<script type="{kind}">{body}</script>'


# name, html, objects, product?, present containers with their JSON, flight text
STRUCTURED = [
    ("graph", _script('{"@graph":[{"@type":"Article","name":"a"},{"@type":"Person","name":"b"}]}'), 2, False, "", None),
    ("single", _script('{"@type":"Product","name":"cup"}'), 1, True, "", None),
    ("types", _script('{"@type":["Thing","Product"],"name":"cup"}'), 1, True, "", None),
    ("array", _script('[{"a":1},{"b":2},{"c":3}]'), 3, False, "", None),
    ("malformed", _script('{"a":') + _script('{"a":1}'), 1, False, "", None),
    ("next", '<script id="__NEXT_DATA__" type="application/json">{"props":{"x":1}}</script>', 0, False, 'next={"props":{"x":1}}', None),
    ("broken_next", '<script id="__NEXT_DATA__" type="application/json">{"props":</script>', 0, False, "", None),
    ("flight", '<script>self.__next_f.push([1,"a\\"b\\n"])</script><script>self.__next_f.push([1,"c\\u0041\\\\d"])</script>', 0, False, "", 'a"b\ncA\\d'),
    ("nuxt", '<script>window.__NUXT__ = {"a":{"b":"}"},"c":[1]};</script>', 0, False, '__NUXT__={"a": {"b": "}"}, "c": [1]}', None),
    ("apollo", '<script>window.__APOLLO_STATE__={"k":"v"}</script><script>window.__INITIAL_STATE__={"s":true};</script>', 0, False, '__APOLLO_STATE__={"k": "v"} __INITIAL_STATE__={"s": true}', None),
    ("function", "<script>window.__NUXT__=(function(){return {}}())</script>", 0, False, "", None),
    ("empty", "", 0, False, "", None),
]


def structured(spark: SparkSession) -> DataFrame:
    """Embedded data: JSON-LD objects, products, hydration containers and decoded flight chunks."""
    html = F.col("html")
    rows = spark.createDataFrame([(n, h) for n, h, *_ in STRUCTURED], "name string, html string").withColumn("o", W.json_ld_objects(W.json_ld_texts(html)))
    kinds = {"next": W.next_data(html), **{n: W.window_object(n)(html) for n in ("__NUXT__", "__APOLLO_STATE__", "__INITIAL_STATE__")}}
    present = F.array_join(F.array_compact(F.array(*[F.concat(F.lit(k + "="), v) for k, v in kinds.items()])), " ")
    return rows.select("name", F.size("o").cast("long").alias("objects"), router.is_product(F.col("o")).alias("product"), present.alias("present"), W.next_flight(html).alias("flight"))


# name, JSON payload, readable text
HYDRATION = [
    ("nested", json.dumps({"a": {"b": [{"c": LONG.strip()}]}}), LONG.strip()),
    ("tags", json.dumps({"x": "<p>" + LONG.strip() + "</p>"}), LONG.strip()),
    ("twice", json.dumps([LONG.strip(), LONG.strip()]), LONG.strip()),
    ("order", json.dumps({"z": "First " + LONG.strip(), "a": "Second " + LONG.strip()}), "First " + LONG.strip() + "\n\nSecond " + LONG.strip()),
    ("short", json.dumps({"x": "five words but too short"}), ""),
    ("few_words", json.dumps({"x": "internationalisation-and-localisation of-everything-at-once"}), ""),
    ("url", json.dumps({"x": "https://example.com/a path with many words that would be long enough"}), ""),
    ("path", json.dumps({"x": "/a path with many words that would otherwise be long enough here"}), ""),
    ("slug", json.dumps({"x": "#a slug with many words that would otherwise be long enough here"}), ""),
    ("blob", json.dumps({"x": "QUJD" * 20}), ""),
    ("not_json", "{", ""),
    ("null", None, ""),
]


def hydration(spark: SparkSession) -> DataFrame:
    """Readable text of payloads; and of the single strings whether they are readable."""
    rows = spark.createDataFrame([(n, p) for n, p, _ in HYDRATION], "name string, payload string")
    one = F.get_json_object("payload", "$.x")
    return rows.select("name", W.hydration_text(F.col("payload")).alias("text"), T.is_readable(F.when(F.col("name") != "tags", one)).alias("readable"))


def _result(href: str, title: str, snippet: str) -> str:
    return f'<div class="result results_links"><h2 class="result__title"><a class="result__a" href="{href}">{title}</a></h2><a class="result__snippet" href="{href}">{snippet}</a></div>'


# name, status, html, number of results, first url, first title, status of the answer
SERP = [
    ("two", 200, _result("//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx%3Fy%3D1&amp;rut=9", "A &amp; <b>B</b>", "one <b>two</b>") + _result("https://b.example/", "B", ""), 2, "https://a.example/x?y=1", "A & B", "ok"),
    ("untitled", 200, _result("https://a.example/", "", "text") + _result("https://b.example/", "B", "text"), 1, "https://b.example/", "B", "ok"),
    ("challenge", 200, "<html><form id='challenge'>Unusual traffic: anomaly detected</form></html>", 0, None, None, "blocked"),
    ("none", 200, "<html><p>No results.</p></html>", 0, None, None, "ok"),
    ("throttled", 429, "", 0, None, None, "blocked"),
    ("late", None, None, 0, None, None, "timeout"),
]


def serp(spark: SparkSession) -> DataFrame:
    """Result pages in html: results with decoded targets, and the status of the answer."""
    answers = spark.createDataFrame([("duckduckgo", n, s, h) for n, s, h, *_ in SERP], "provider string, query string, status int, body string")
    found = providers.duckduckgo(answers).groupBy("query").agg(F.count("*").alias("n"), F.min(F.struct("ord", "url", "title")).alias("f"))
    return providers.statuses(answers).select("query", "status").join(found, "query", "left").select("query", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("f.url").alias("url"), F.col("f.title").alias("title"), "status")


_ARTICLE = "<html><body><article>" + f"<p>{LONG * 4}</p>" * 2 + "</article></body></html>"
_SHELL = '<html><body><div id="app"></div>{}</body></html>'
_CACHED = ("kept text", "http_fetch", 0.85)
# name, status, html, cached, rendered html, api payloads, browser skipped, mode -> method, confidence, rendered, start of the content
ROUTED = [
    ("article", 200, _ARTICLE, None, None, [], False, "auto", ("http_fetch", 0.85, False, "The quiet ")),
    ("cached", 200, _ARTICLE, _CACHED, None, [], False, "auto", ("http_fetch", 0.85, False, "kept text")),
    ("article_in_browser_mode", 200, _ARTICLE, None, "<p>drawn text</p>", [], False, "browser", ("rendered_dom", 0.90, True, "drawn text")),
    ("json_ld", 200, _SHELL.format(_script(json.dumps({"@type": "Article", "articleBody": LONG * 3}))), None, "<p>drawn</p>", [], False, "auto", ("hydration_data", 0.90, False, "The quiet ")),
    ("product", 200, _SHELL.format(_script(json.dumps({"@type": "Product", "description": LONG * 3, "name": "cup"}))), None, None, [], False, "auto", ("hydration_data", 0.95, False, "The quiet ")),
    ("payload", 200, _SHELL.format('<script id="__NEXT_DATA__" type="application/json">' + json.dumps({"p": [LONG.strip() * 3]}) + "</script>"), None, None, [], False, "auto", ("hydration_data", 0.90, False, "The quiet ")),
    ("api", 200, _SHELL.format(""), None, "<p>drawn text</p>", ['{"a":1}'], False, "auto", ("browser_api_intercept", 0.96, True, "drawn text")),
    ("rendered", 200, _SHELL.format(""), None, "<p>drawn text</p>", [], False, "auto", ("rendered_dom", 0.90, True, "drawn text")),
    ("skipped", 200, _SHELL.format("few words"), None, "<p>drawn text</p>", [], True, "auto", ("best_effort", 0.50, False, "few words")),
    ("fast", 200, _SHELL.format("few words"), None, "<p>drawn text</p>", [], False, "fast", ("best_effort", 0.50, False, "few words")),
    ("failed", None, None, None, None, [], False, "auto", ("best_effort", 0.50, False, "")),
    ("forbidden", 403, "<html><body>Denied</body></html>", None, None, [], False, "auto", ("best_effort", 0.50, False, "Denied")),
]


def routed(spark: SparkSession) -> DataFrame:
    """Tiers of extraction: each case in its mode."""
    schema = "url string, status int, html string, cached struct<content:string,extraction_method:string,confidence:double>, rendered_html string, api_payloads array<string>, skip_browser boolean, mode string"
    rows = spark.createDataFrame([r[:8] for r in ROUTED], schema)
    parts = [router.route(rows.where(F.col("mode") == m).drop("mode"), m) for m in ("auto", "fast", "browser")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("url", "method", "confidence", "rendered", F.substring("content", 1, 10).alias("start"))


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def _rows(names: str, rows: list[tuple], types: dict[str, str] | None = None) -> str:
    cols = ", ".join(f"{n}::{(types or {}).get(n)} AS {n}" if (types or {}).get(n) else n for n in names.split(", "))
    return f"SELECT {cols} FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) t({names})"


def oracle_sql() -> dict[str, str]:
    readable = {"short": False, "few_words": False, "url": False, "path": False, "slug": False, "blob": False}
    return {
        "structured_cases": _rows("name, objects, product, present, flight", [(n, o, p, c, f) for n, _, o, p, c, f in STRUCTURED], {"objects": "BIGINT"}),
        "hydration_cases": _rows("name, text, readable", [(n, t, readable.get(n)) for n, _, t in HYDRATION]),
        "serp_cases": _rows("query, n, url, title, status", [(q, n, u, t, s) for q, _, _, n, u, t, s in SERP], {"n": "BIGINT"}),
        "router_cases": _rows("url, method, confidence, rendered, start", [(r[0], *r[8]) for r in ROUTED], {"confidence": "DOUBLE"}),
    }
