import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.functions import urls as U
from sievelight.functions import web as W
from sievelight.operators.passages import paragraphs, passages_of


def one(spark, column, *values):
    """Values of a column expression over one-column rows called x."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]




def test_normalize(spark):
    got = one(spark, U.normalize_url(F.col("x")), "HTTPS://WWW.Example.com/A/?utm_source=a&b=2&a=1#f", "https://e.com", "https://e.com/?gclid=1&fbclid=2", "https://e.com:443/x?b&a=", "not a url", "", None, "http://e.com/a//")
    assert got == ["https://www.example.com/A?a=1&b=2", "https://e.com/", "https://e.com/", "https://e.com/x?a=&b=", None, None, None, "http://e.com/a/"]


def test_hosts(spark):
    assert one(spark, U.host(F.col("x")), "https://www.A.b/x", "https://u:p@c.d:8/x", "bad", None) == ["a.b", "c.d", "", None]
    assert one(spark, U.raw_host(F.col("x")), "https://www.A.b/x", "bad") == ["www.a.b", "bad"]
    assert one(spark, U.api_pattern(F.col("x")), "https://a.b/v1/12/x/3", "https://a.b") == ["/v1/*/x/*", "/"]


def test_domain_score(spark):
    assert one(spark, U.domain_score(F.col("x")), "https://de.wikipedia.org/x", "github.com", "https://notgithub.com", "", "pinterest.com", "https://a.bbc.co.uk/1", None) == [0.95, 0.9, 0.5, 0.5, 0.3, 0.7, 0.5]


def test_addresses(spark):
    blocked = ["10.1.2.3", "127.0.0.1", "172.16.0.0", "172.31.255.255", "192.168.1.1", "169.254.169.254", "100.64.0.1", "0.0.0.0", "255.255.255.255", "1.2.3", "1.2.3.256", "::1", "::", "fe80::1", "fc00::1", "ff02::1", "::ffff:10.0.0.1", "::ffff:a00:1"]
    fine = ["8.8.8.8", "172.32.0.0", "172.15.255.255", "100.128.0.0", "198.20.0.0", "2001:4860::8888", "::ffff:8.8.8.8", "::ffff:808:808"]
    assert one(spark, U.blocked_address(F.col("x")), *blocked, *fine) == [True] * len(blocked) + [False] * len(fine)


def test_refusals(spark):
    got = one(spark, U.refusal(F.col("x")), "ftp://a.b/", "http://localhost/", "http://x.localhost./", "http://127.0.0.1/", "http://[::1]/", "https://a.b/", "nothing", None)
    assert got == ["unsupported scheme", "local machine", "local machine", "address not public", "address not public", None, "not a valid URL", "not a valid URL"]


def test_tokens_and_shingles(spark):
    assert one(spark, F.array_join(T.passage_tokens(F.col("x")), " "), "The RTX_4090 is a card, x!", "...", "") == ["rtx_4090 card", "", ""]
    assert one(spark, F.size(T.shingles(T.plain_tokens(F.col("x")))), "a b c d e f", "a b", "", "a a a a a a a") == [2, 1, 0, 1]


def test_density(spark):
    s = T.density_signals(F.col("x"))
    r = one(spark, s, "[one](http://a) two three four five six. Seven eight nine ten eleven.", "", None)
    assert r[0].words == 11 and abs(r[0].link_ratio - 100 / 11) < 1e-9 and r[0].mean_sentence_words == 5.5
    assert r[1].words == 0 and r[1].link_ratio == 0 and r[2] is None
    assert one(spark, T.information_density(s), "", "word " * 18 + ".")[0] == 0.0


def test_serialized(spark):
    payload = '{"a": [1, 2], "b": {"c": "d"}, "e": "f", "g": [], "h": {"i": [1,2,3], "j": ["k"]}, "l": 1}'
    assert one(spark, T.looks_serialized(F.col("x")), payload, "Plain text. " * 20, '{"a":1}', None) == [True, False, False, False]


def test_acronyms(spark):
    pairs = [("Transport Layer Security", "TLS", True), ("the Hypertext Transfer Protocol", "HTP", True), ("DNS means DNS", "DNS", False), ("Tasty Lemon", "TLS", False), ("an Input Output", "IO", False)]
    df = spark.createDataFrame(pairs, "x string, a string, want boolean")
    assert all(r[0] == r[1] for r in df.select(T.expands_acronym(F.col("x"), F.col("a")), "want").collect())
    assert one(spark, T.find_acronyms(F.col("x")), "What does TLS and TLS mean to an AI or WHO") == [["TLS", "WHO"]]
    assert one(spark, T.is_definition_query(F.col("x")), "What does DNS stand for?", "How does DNS work") == [True, False]


def test_dates(spark):
    as_of = F.lit("2024-06-30T12:00:00Z").cast("timestamp")
    got = one(spark, T.recency(F.col("x"), as_of, 30), "2024-06-29", "2024-06-01T10:00:00+02:00", "5 June 2024", "2023-01-01", "3 days ago", "", None)
    assert got == [1.0, 1.0, 1.0, 0.0, 0.5, 0.5, 0.5]


def test_let_computes_once(spark):
    assert one(spark, T.let(F.length(F.col("x")), lambda n: n * n), "abc", None) == [9, None]


def test_markup(spark):
    html = '<html><head><title> A &amp; B </title><meta content="d" property="og:description"></head><script>x</script><p>Hi&nbsp;&lt;b&gt;</p>'
    m = one(spark, W.metadata(F.col("x")), html, "", None)
    assert (m[0].title, m[0].description, m[0].author) == ("A & B", "d", "") and m[1].title == ""
    assert one(spark, T.strip_tags(F.col("x")), "<p>a&amp;lt;b</p><style>x</style>") == ["a<b"]
    assert one(spark, W.framework(F.col("x")), "__NEXT_DATA__", "self.__next_f", "__NUXT__", "x") == ["Next.js:Pages", "Next.js:App", "Nuxt", "unknown"]


def test_structured(spark):
    ld = '<script type="application/ld+json">{"@graph": [{"@type": "A"}, {"@type": "B"}]}</script><script type="application/ld+json">{bad</script>'
    assert len(one(spark, W.json_ld_objects(W.json_ld_texts(F.col("x"))), ld)[0]) == 2
    page = '<script>window.__NUXT__ = {"a": "}", "b": {"c": 1}};</script>'
    assert one(spark, W.window_object("__NUXT__")(F.col("x")), page, "", None) == ['{"a": "}", "b": {"c": 1}}', None, None]
    assert one(spark, W.next_flight(F.col("x")), 'self.__next_f.push([1,"a\\n\\u0041"])', "") == ["a\nA", None]


def test_hydration():
    prose = "This is a readable sentence with more than forty characters in it."
    assert W.payload_strings('{"b": ["%s", "%s"], "u": "https://a.b/c d e f g h i j k l m n o p q r s t"}' % (prose, prose)) == [prose]
    deep = '{"a":' * 60 + f'"{prose}"' + "}" * 60
    assert W.payload_strings(deep) == [] and W.payload_strings("{") == [] and W.payload_strings(None) == []


def test_result_pages(spark):
    html = '<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.b%2Fc">T</a><a class="result__url" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.b%2Fc">a.b</a><a class="result__snippet">S</a></div><div class="result"><a class="result__snippet">no title</a></div>'
    got = one(spark, W.serp_results(F.col("x")), html, None)
    assert [tuple(r) for r in got[0]] == [("T", "https://a.b/c", "S")] and got[1] == []
    assert one(spark, W.is_challenge(F.col("x")), "please solve this captcha", '<a class="result__a">', "empty") == [True, False, False]


def brute_paragraphs(t):
    """The rule by its definition, over every line."""
    out, at = [], 0
    lines = t.split("\n")
    spans = []
    for x in lines:
        spans.append((at, at + len(x), x))
        at += len(x) + 1
    for i, (a, b, x) in enumerate(spans):
        if not x:
            continue
        joined = i > 0 and spans[i - 1][2] and (x.strip() or i == len(spans) - 1)
        if joined:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return [p for p in out if t[p[0] : p[1]].strip()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a \n", max_size=12))
def test_paragraphs(t):
    assert paragraphs(t) == brute_paragraphs(t)


def test_passages():
    assert [b - a for a, b in passages_of("x" * 600 + "\n\n" + "y" * 600)] == [600, 600]
    assert len(passages_of("a\n\nb\n\nc")) == 1 and passages_of(" \n ") == [] and passages_of(None) == []
    random.seed(1)
    t = " ".join(random.choice(["word", "sentence.", "x"]) for _ in range(2000))
    assert all(b - a <= 1200 and t[a:b] == t[a:b].strip() for a, b in passages_of(t))


@pytest.mark.parametrize("t", ["", "a", "\n\n\n", "a\n \nb"])
def test_passage_offsets(t):
    assert all(t[a:b].strip() == t[a:b] != "" for a, b in passages_of(t))
