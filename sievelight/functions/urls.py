"""URL and address functions on columns; every one is a native expression.

A malformed url (no scheme and ``//``, no or an impossible host) gives null, never an error. Null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.functions.text import let

URL = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@\s]*@)?([A-Za-z0-9._\-]+|\[[0-9A-Fa-f:.]+\])(?::([0-9]*))?((?:/[^?#]*)?)((?:\?[^#]*)?)((?:#.*)?)$"
SCHEME, HOST, PORT, PATH, QUERY, FRAGMENT = 1, 2, 3, 4, 5, 6

# Parameters that only track, and the score of known sites by suffix.
TRACKING = ("gclid", "fbclid")
TRACKING_PREFIX = "utm_"
TIERS = (
    ("wikipedia.org", 0.95), ("arxiv.org", 0.95), ("developer.mozilla.org", 0.95), ("stackoverflow.com", 0.95), ("stackexchange.com", 0.9),
    ("github.com", 0.9), ("gov", 0.9), ("edu", 0.9), ("w3.org", 0.9), ("ietf.org", 0.9), ("npmjs.com", 0.9), ("caniuse.com", 0.9), ("mdn.dev", 0.9),
    ("nytimes.com", 0.7), ("theguardian.com", 0.7), ("bbc.com", 0.7), ("bbc.co.uk", 0.7), ("reuters.com", 0.7), ("apnews.com", 0.7), ("wired.com", 0.7),
    ("techcrunch.com", 0.7), ("theverge.com", 0.7), ("arstechnica.com", 0.7), ("medium.com", 0.7), ("dev.to", 0.7), ("reddit.com", 0.7), ("quora.com", 0.7),
    ("forbes.com", 0.7), ("bloomberg.com", 0.7), ("cnn.com", 0.7), ("wsj.com", 0.7), ("ft.com", 0.7), ("economist.com", 0.7),
    ("pinterest.com", 0.3), ("tiktok.com", 0.3), ("instagram.com", 0.3), ("facebook.com", 0.3), ("buzzfeed.com", 0.3), ("clickbait.com", 0.3),
)
DEFAULT_TIER = 0.5
BLOCKED_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def part(url: Column, group: int) -> Column:
    """A component; '' where the url has none, null where it is malformed."""
    return F.when(url.rlike(URL), F.regexp_extract(url, URL, group))


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike(URL), F.lit(False))


def raw_host(url: Column) -> Column:
    """Lower-case host with a leading www.; the whole url where it is malformed."""
    return F.coalesce(F.lower(part(url, HOST)), url)


def host(url: Column) -> Column:
    """Lower-case host without one leading www.; '' where the url is malformed."""
    return F.coalesce(F.regexp_replace(F.lower(part(url, HOST)), r"^www\.", ""), F.when(url.isNotNull(), F.lit("")))


def normalize_url(url: Column) -> Column:
    """Canonical form: lower-case scheme and host, no default port, fragment or tracking parameters, parameters sorted
    by name (stable), no trailing slash but for the root."""
    scheme, port = F.lower(part(url, SCHEME)), part(url, PORT)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = F.coalesce(F.nullif(part(url, PATH), F.lit("")), F.lit("/"))
    path = F.when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    params = F.filter(F.split(F.regexp_replace(part(url, QUERY), r"^\?", ""), "&"), lambda p: p != "")
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(params, lambda p: ~name(p).startswith(TRACKING_PREFIX) & ~name(p).isin(*TRACKING))
    ordered = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("name"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p"))))
    query = F.array_join(F.transform(ordered, lambda x: x.p), "&")
    return F.concat(scheme, F.lit("://"), F.lower(part(url, HOST)), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def domain_score(url_or_host: Column) -> Column:
    """Score of the longest known suffix of the host; a bare host is taken as it is, anything else scores the default.

    The table is fixed and small, so the suffix match is one expression (longest suffix first) and no join."""
    t = F.trim(url_or_host)
    h = F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.lower(part(t, HOST))).otherwise(F.lower(t))
    score = F.lit(DEFAULT_TIER)
    for d, s in sorted(TIERS, key=lambda x: (len(x[0]), x[0])):
        score = F.when((h == d) | h.endswith("." + d), F.lit(s)).otherwise(score)
    return F.when(h.isNull(), F.lit(DEFAULT_TIER)).otherwise(score)


def alternative_urls(url: Column) -> Column:
    """Array of the url, its output=1, /amp path and amp variants; only the url where it is malformed."""
    path, query = part(url, PATH), part(url, QUERY)
    base = F.concat(F.lower(part(url, SCHEME)), F.lit("://"), F.lower(part(url, HOST)), F.when(part(url, PORT) == "", F.lit("")).otherwise(F.concat(F.lit(":"), part(url, PORT))))
    root = F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))
    add = lambda p: F.concat(base, root, F.when(F.length(query) > 1, F.concat(query, F.lit("&"))).otherwise(F.lit("?")), F.lit(p))
    amp = F.concat(base, F.regexp_replace(root, "/+$", ""), F.lit("/amp"), query)
    return F.when(is_url(url), F.array(url, add("output=1"), amp, add("amp"))).otherwise(F.array(url))


def search_queries(url: Column, title: Column) -> Column:
    """Queries that look for a page elsewhere: by quoted title, on its site, or by site alone; none if malformed."""
    h = host(url)
    t = F.trim(F.coalesce(title, F.lit("")))
    quoted = F.concat(F.lit('"'), t, F.lit('"'))
    return F.when(h == "", F.array().cast("array<string>")).when(t != "", F.array(quoted, F.concat(F.lit("site:"), h, F.lit(" "), quoted), F.concat(t, F.lit(" "), h))).otherwise(F.array(F.concat(F.lit("site:"), h)))


def api_pattern(url: Column) -> Column:
    """Path with every all-digit segment as a star; null if malformed."""
    return F.array_join(F.transform(F.split(F.coalesce(F.nullif(part(url, PATH), F.lit("")), F.when(is_url(url), F.lit("/"))), "/"), lambda s: F.when(s.rlike("^[0-9]+$"), F.lit("*")).otherwise(s)), "/")


def media_type(content_type: Column) -> Column:
    return F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))


def _quad(value: str) -> int:
    a, b, c, d = map(int, value.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def ipv4_value(address: Column) -> Column:
    """32-bit value of a dotted quad; null if it isn't one."""
    quad = F.when(address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.transform(F.split(address, r"\."), lambda x: x.cast("long")))
    return let(quad, lambda p: F.when(F.forall(p, lambda x: x <= 255), ((p[0] * 256 + p[1]) * 256 + p[2]) * 256 + p[3]))


def blocked_ipv4(address: Column) -> Column:
    """Whether an address is in a range that isn't public; one that can't be read is blocked."""

    def inside(v: Column) -> Column:
        hit = v.isNull()
        for net, bits in BLOCKED_V4:
            lo = _quad(net)
            hit = hit | v.between(lo, lo + (1 << (32 - bits)) - 1)
        return hit

    return let(ipv4_value(address), inside)


def blocked_ipv6(address: Column) -> Column:
    """Loopback, unspecified, local and multicast addresses, and mapped ones by their IPv4 part, in dotted or hex form."""
    a = F.split_part(F.lower(address), F.lit("%"), F.lit(1))
    dotted = F.regexp_extract(a, r"^(?:::ffff:|::)([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1)
    hx = r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
    hi, lo = F.conv(F.regexp_extract(a, hx, 1), 16, 10).cast("long"), F.conv(F.regexp_extract(a, hx, 2), 16, 10).cast("long")
    octets = F.concat_ws(".", F.floor(hi / 256), hi % 256, F.floor(lo / 256), lo % 256)
    return F.when(dotted != "", blocked_ipv4(dotted)).when(a.rlike(hx), blocked_ipv4(octets)).when(a.isin("::1", "::"), F.lit(True)).otherwise(a.rlike("^(f[cd]|fe[89ab]|ff)"))


def blocked_address(address: Column) -> Column:
    return F.when(address.isNull(), F.lit(True)).when(address.contains(":"), blocked_ipv6(address)).otherwise(blocked_ipv4(address))


def local_host(h: Column) -> Column:
    x = F.regexp_replace(F.lower(h), r"\.$", "")
    return (x == "localhost") | x.endswith(".localhost")


def refusal(url: Column, unsafe: Column | None = None) -> Column:
    """Why a url must not be fetched, null if it may. unsafe tells of the addresses of its host whether one of them is
    not public (null: it has none); without it names pass."""
    scheme = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    h = F.regexp_replace(F.lower(part(url, HOST)), r"^\[|\]$", "")
    literal = h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | h.contains(":")
    rule = F.when(url.isNull() | (scheme == ""), F.lit("not a valid URL")).when(~scheme.isin("http", "https"), F.lit("unsupported scheme"))
    rule = rule.when(h.isNull(), F.lit("missing hostname")).when(local_host(h), F.lit("local machine"))
    rule = rule.when(literal & blocked_address(h), F.lit("address not public"))
    if unsafe is not None:
        rule = rule.when(~literal & unsafe.isNull(), F.lit("no addresses")).when(~literal & unsafe, F.lit("resolves to non-public address"))
    return rule
