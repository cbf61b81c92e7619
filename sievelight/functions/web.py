"""HTML and embedded-data functions. Markup that a pattern can find stays native; walks of unknown depth and balanced
braces go through Arrow UDFs. Null html gives null or empty results, malformed JSON is skipped, never an error."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sievelight.functions.text import stripped_text

_SERP = ArrayType(StructType([StructField(n, StringType()) for n in ("title", "url", "snippet")]))
ENOUGH, STRUCTURED_ENOUGH, BODY_LIMIT = 500, 200, 2 * 1024 * 1024
MAX_JSONLD, MAX_HYDRATION, MAX_DEPTH = 8_000, 20_000, 12
LD_SCRIPT = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
NEXT_SCRIPT = r"(?is)<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>"


def enough(html: Column) -> Column:
    return F.coalesce(F.length(stripped_text(html)) > ENOUGH, F.lit(False))


def framework(html: Column) -> Column:
    return F.when(html.contains("__NEXT_DATA__"), F.lit("Next.js:Pages")).when(html.contains("self.__next_f"), F.lit("Next.js:App")).when(html.contains("__NUXT__"), F.lit("Nuxt")).otherwise(F.lit("unknown"))


def has_json_ld(html: Column) -> Column:
    return F.coalesce(html.rlike(LD_SCRIPT), F.lit(False))


def profile(html: Column) -> Column:
    """Struct of requires_js, framework, has_json_ld and best_method of a page."""
    short = F.length(stripped_text(html)) < ENOUGH
    return F.struct(short.alias("requires_js"), framework(html).alias("framework"), has_json_ld(html).alias("has_json_ld"), F.when(short, F.lit("browser_api_intercept")).otherwise(F.lit("readability")).alias("best_method"))


def best_method(method: Column) -> Column:
    """Profile method of a router method."""
    return F.when(method == "http_fetch", F.lit("readability")).when(method == "hydration_data", method).when(method.isin("browser_api_intercept", "rendered_dom", "rendered"), F.lit("browser_api_intercept")).otherwise(F.lit("readability"))


def _meta(html: Column, attribute: str, name: str) -> Column:
    """content= of the first meta tag with attribute=name, whatever the order of its attributes."""
    tag = F.regexp_extract(html, rf"(?is)(<meta\s[^>]*{attribute}\s*=\s*[\"']{re.escape(name)}[\"'][^>]*>)", 1)
    return F.trim(F.coalesce(F.nullif(F.regexp_extract(tag, r"(?is)content\s*=\s*\"([^\"]*)\"", 1), F.lit("")), F.regexp_extract(tag, r"(?is)content\s*=\s*'([^']*)'", 1)))


def decode_entities(c: Column) -> Column:
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def metadata(html: Column) -> Column:
    """Struct of title, description, published, author, site_name; '' where missing."""
    first = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    return F.struct(
        F.coalesce(decode_entities(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit("")).alias("title"),
        decode_entities(first(_meta(html, "property", "og:description"), _meta(html, "name", "description"))).alias("description"),
        first(_meta(html, "property", "article:published_time"), _meta(html, "name", "datePublished"), _meta(html, "itemprop", "datePublished")).alias("published"),
        decode_entities(first(_meta(html, "property", "article:author"), _meta(html, "name", "author"))).alias("author"),
        decode_entities(first(_meta(html, "property", "og:site_name"))).alias("site_name"),
    )


def json_ld_texts(html: Column) -> Column:
    """Trimmed text of every JSON-LD script that parses."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(LD_SCRIPT), F.lit(1)), F.trim), lambda x: (x != "") & F.try_parse_json(x).isNotNull())


def _objects(text: str) -> list:
    try:
        v = json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return []
    if isinstance(v, list):
        return v
    if isinstance(v, dict):
        return v["@graph"] if isinstance(v.get("@graph"), list) else [v]
    return []


@F.pandas_udf(ArrayType(StringType()))
def json_ld_objects(texts: pd.Series) -> pd.Series:
    """JSON-LD objects of an array of scripts: members of arrays and of @graph, single objects as they are."""
    return texts.map(lambda ts: [json.dumps(o, ensure_ascii=False) for t in (ts if ts is not None else []) for o in _objects(t)])


def next_data(html: Column) -> Column:
    x = F.trim(F.regexp_extract(html, NEXT_SCRIPT, 1))
    return F.when((x != "") & F.try_parse_json(x).isNotNull(), x)


def _decode_js(s: str) -> str:
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        s = s.replace(a, b)
    return re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), s)


@F.pandas_udf(StringType())
def next_flight(html: pd.Series) -> pd.Series:
    """The string arguments of all self.__next_f.push calls, decoded and joined; null without any."""
    call = re.compile(r"self\.__next_f\.push\(\[[^,\]]*,\s*\"((?:[^\"\\]|\\.)*)\"\s*\]\)", re.S)

    def one(h):
        found = call.findall(h) if isinstance(h, str) else []
        return "".join(map(_decode_js, found)) if found else None

    return html.map(one)


def _balanced(text: str, start: int) -> str | None:
    depth, quote, i = 0, "", start
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
        i += 1
    return None


def window_object(name: str):
    """Arrow UDF: the JSON object assigned to window.NAME, by balanced braces outside strings; null if there is none
    or it isn't JSON."""
    head = re.compile(rf"window\.{re.escape(name)}\s*=\s*(?=\{{)")

    @F.pandas_udf(StringType())
    def extract(html: pd.Series) -> pd.Series:
        def one(h):
            m = head.search(h) if isinstance(h, str) else None
            body = _balanced(h, m.end()) if m else None
            try:
                return json.dumps(json.loads(body), ensure_ascii=False) if body else None
            except (ValueError, RecursionError):
                return None

        return html.map(one)

    return extract


def plain(value: str) -> str:
    value = re.sub(r"<(script|style)[\s\S]*?</\1>", " ", value, flags=re.I)
    value = re.sub("<[^>]+>", " ", value)
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        value = re.sub(a, b, value, flags=re.I)
    return re.sub(r"\s+", " ", value).strip()


_BLOB = re.compile(r"https?://|data:|/|#|[A-Za-z0-9+/=]{60,}$")


def payload_strings(text: str | None) -> list[str]:
    """Prose strings of a JSON payload in key order, to MAX_DEPTH deep, distinct, until MAX_HYDRATION characters."""
    try:
        top = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return []
    out: dict[str, None] = {}
    total = 0
    stack = [(top, 0)]
    while stack and total < MAX_HYDRATION:
        v, depth = stack.pop()
        if depth > MAX_DEPTH:
            continue
        if isinstance(v, str):
            t = plain(v)
            if len(t) >= 40 and not _BLOB.match(t) and len(t.split()) >= 5 and t not in out:
                out[t] = None
                total += len(t)
        elif isinstance(v, (list, dict)):
            stack += [(x, depth + 1) for x in reversed(list(v.values() if isinstance(v, dict) else v))]
    return list(out)


@F.pandas_udf(StringType())
def hydration_text(payload: pd.Series) -> pd.Series:
    """Readable text of a payload, strings joined by blank lines; '' without any."""
    return payload.map(lambda t: "\n\n".join(payload_strings(t if isinstance(t, str) else None)))


@F.pandas_udf(StringType())
def article_text(html: pd.Series) -> pd.Series:
    """Main text of an article page as light markdown; null if too little is left to be one.

    Scripts, styles, media and page furniture elements are dropped, <article> or <main> is taken where there is one,
    headings, list items and quotes keep their marks. This is a rule of ours, not a known library's heuristic."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        SKIP = {"script", "style", "noscript", "svg", "iframe", "nav", "header", "footer", "aside", "form", "head"}
        BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "li", "table", "tr", "blockquote", "pre", "br", "h1", "h2", "h3", "h4", "h5", "h6"}

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.skip, self.parts, self.inside, self.main = [], [], 0, []

        def out(self, s):
            self.parts.append(s)
            if self.inside:
                self.main.append(s)

        def handle_starttag(self, tag, attrs):
            if tag in self.SKIP:
                self.skip.append(tag)
            if tag in ("article", "main"):
                self.inside += 1
            if tag in self.BLOCK and not self.skip:
                self.out("\n\n" + {"li": "- ", "blockquote": "> "}.get(tag, "#" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() else ""))

        def handle_endtag(self, tag):
            if self.skip and tag == self.skip[-1]:
                self.skip.pop()
            if tag in ("article", "main"):
                self.inside = max(0, self.inside - 1)
            if tag in self.BLOCK and not self.skip:
                self.out("\n\n")

        def handle_data(self, data):
            if not self.skip:
                self.out(re.sub(r"\s+", " ", data))

    def one(h):
        if not isinstance(h, str):
            return None
        r = Reader()
        r.feed(h)
        r.close()
        text = "".join(r.main if len("".join(r.main).strip()) > 140 else r.parts)
        text = re.sub(r"\n{2,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", text)).strip()
        return text if len(text) > 140 else None

    return html.map(one)


@F.pandas_udf(_SERP)
def serp_results(html: pd.Series) -> pd.Series:
    """Results of a result page's html: title, decoded target and snippet of each .result with both title and url."""
    from html import unescape
    from urllib.parse import parse_qs, urljoin, urlsplit

    block = re.compile(r"<div[^>]*class=\"[^\"]*\bresult\b[^\"]*\"[^>]*>([\s\S]*?)(?=<div[^>]*class=\"[^\"]*\bresult\b[^\"]*\"|\Z)")

    def field(b, cls, attr=None):
        m = re.search(rf"<\w+([^>]*class=\"[^\"]*\b{cls}\b[^\"]*\"[^>]*)>([\s\S]*?)</\w+>", b)
        if not m:
            return ""
        if attr:
            a = re.search(rf"{attr}=\"([^\"]*)\"", m[1])
            return unescape(a[1]) if a else ""
        return unescape(plain(m[2]))

    def target(u):
        if not u:
            return ""
        u = urljoin("https://html.duckduckgo.com/", u)
        return parse_qs(urlsplit(u).query).get("uddg", [u])[0]

    def one(h):
        out = []
        for b in block.findall(h) if isinstance(h, str) else []:
            r = {"title": field(b, "result__a") or field(b, "result__title"), "url": target(field(b, "result__url", "href") or field(b, "result__a", "href")), "snippet": field(b, "result__snippet")}
            if r["title"] and r["url"]:
                out.append(r)
        return out

    return html.map(one)


def is_challenge(html: Column) -> Column:
    """Whether a result page without results asks for a human."""
    return ~(html.contains("result__a") | html.contains('class="result')) & html.rlike(r"(?i)anomaly|unusual traffic|captcha|blocked")
