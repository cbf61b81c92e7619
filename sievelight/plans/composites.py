"""SQL (DuckDB) of the composed operators: passages, citations, research, extraction tiers and cool-downs.

Written from the definitions, with constants of their own: a wrong constant in an operator shows as a difference."""

from __future__ import annotations

# The stop words of retrieval tokens.
STOP = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "how", "i", "in", "is", "it", "its", "of", "on", "or",
    "s", "that", "the", "this", "to", "was", "were", "what", "when", "where", "which", "who", "why", "will", "with", "you", "your",
)

#: White space as str.strip has it, for a character class.
SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def last_of(text: str, mark: str, pattern: str) -> str:
    """0-based place of the last occurrence of a mark, -1 without one."""
    return f"CASE WHEN contains({text}, '{mark}') THEN length(regexp_extract({text}, '(?s)^(.*){pattern}', 1)) ELSE -1 END"


def passages(src: str) -> str:
    """CTEs up to pas(url, passage_no, passage, start_pos, end_pos) of src(url, content); needs WITH RECURSIVE."""
    part = "substr(content, a::BIGINT + 1, 1200)"
    sentence, word = last_of(part, ". ", r"\. "), last_of(part, " ", " ")
    cut = f"CASE WHEN ({sentence}) > 600 THEN ({sentence}) + 1 WHEN ({word}) > 0 THEN ({word}) ELSE 1200 END"
    return rf"""
ln AS (SELECT url, i, x, lag(x) OVER w AS prev, coalesce(sum(length(x) + 1) OVER (PARTITION BY url ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_pos, max(i) OVER (PARTITION BY url) AS last_i
  FROM (SELECT url, unnest(string_split(content, chr(10))) AS x, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM {src} WHERE content IS NOT NULL) WINDOW w AS (PARTITION BY url ORDER BY i)),
mk AS (SELECT *, sum(CASE WHEN x = '' OR (coalesce(prev, '') <> '' AND (regexp_matches(x, '[^{SPACE}]') OR i = last_i)) THEN 0 ELSE 1 END) OVER (PARTITION BY url ORDER BY i) AS grp FROM ln),
pr AS (SELECT m.url, min(at_pos) AS a, max(at_pos + length(x)) AS b FROM mk m WHERE x <> '' GROUP BY m.url, grp),
pn AS (SELECT p.url, a, b, row_number() OVER (PARTITION BY p.url ORDER BY a) AS k FROM pr p JOIN {src} s ON s.url = p.url WHERE regexp_matches(substr(s.content, a + 1, b - a), '[^{SPACE}]')),
pk AS (SELECT DISTINCT url, 0::BIGINT AS k, NULL::BIGINT AS s, NULL::BIGINT AS e, []::STRUCT(s BIGINT, e BIGINT)[] AS o FROM pn
  UNION ALL SELECT p.url, p.k, CASE WHEN p.b - (CASE WHEN pk.s IS NULL OR (pk.e - pk.s) + (p.b - p.a) > 500 THEN p.a ELSE pk.s END) >= 500 THEN NULL WHEN pk.s IS NULL OR (pk.e - pk.s) + (p.b - p.a) > 500 THEN p.a ELSE pk.s END,
    p.b, list_concat(list_concat(pk.o, CASE WHEN pk.s IS NOT NULL AND (pk.e - pk.s) + (p.b - p.a) > 500 THEN [{{'s': pk.s, 'e': pk.e}}] ELSE [] END),
      CASE WHEN p.b - (CASE WHEN pk.s IS NULL OR (pk.e - pk.s) + (p.b - p.a) > 500 THEN p.a ELSE pk.s END) >= 500 THEN [{{'s': CASE WHEN pk.s IS NULL OR (pk.e - pk.s) + (p.b - p.a) > 500 THEN p.a ELSE pk.s END, 'e': p.b}}] ELSE [] END)
  FROM pk JOIN pn p ON p.url = pk.url AND p.k = pk.k + 1),
pd AS (SELECT url, CASE WHEN s IS NOT NULL THEN list_concat(o, [{{'s': s, 'e': e}}]) ELSE o END AS o FROM pk QUALIFY row_number() OVER (PARTITION BY url ORDER BY k DESC) = 1),
wn AS (SELECT url, n, 0 AS w, o[n].s AS a, o[n].e AS b FROM (SELECT url, o, unnest(range(1, len(o) + 1)) AS n FROM pd)
  UNION ALL SELECT wn.url, n, w + 1, a + {cut}, b FROM wn JOIN {src} s ON s.url = wn.url WHERE b - a > 1200),
em AS (SELECT wn.url, n, w, a, substr(content, a::BIGINT + 1, (CASE WHEN b - a > 1200 THEN {cut} ELSE b - a END)::BIGINT) AS x FROM wn JOIN {src} s ON s.url = wn.url),
tm AS (SELECT url, n, w, a + length(x) - length(regexp_replace(x, '^[{SPACE}]+', '')) AS start_pos, regexp_replace(x, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS passage FROM em),
pas AS (SELECT url, row_number() OVER (PARTITION BY url ORDER BY n, w) - 1 AS passage_no, passage, start_pos::BIGINT AS start_pos, (start_pos + length(passage))::BIGINT AS end_pos FROM tm WHERE passage <> '')"""


def tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9_]+'), lambda x: length(x) > 1 AND x NOT IN ({', '.join(repr(w) for w in STOP)}))"


SERIAL = """coalesce(length({0}) >= 80 AND length(regexp_replace({0}, '[^{{}}\\[\\]":,]', '', 'g'))::DOUBLE / greatest(length({0}), 1) >= 0.12 AND len(regexp_extract_all({0}, '"[^"]{{1,60}}"\\s*:')) >= 3, false)"""


def cited(opened: str) -> str:
    """CTEs up to cit(call_id, citation, url, title, quote, start_pos, end_pos, relevance) of opened(call_id, ord, url,
    title, content, question, cluster, content_duplicate, density)."""
    edge = r"[\s\x{0B}\x{A0}\x{FEFF}]+"
    return f"""
keep AS (SELECT * REPLACE (regexp_replace(coalesce(content, ''), '^{edge}|{edge}$', '', 'g') AS content) FROM {opened} WHERE NOT coalesce(content_duplicate, false)),
txt AS (SELECT DISTINCT url, content FROM keep WHERE content <> ''),
{passages('txt')},
bt AS (SELECT url, passage_no, {tokens('passage')} AS t FROM pas),
st AS (SELECT url, count(*) AS n, avg(len(t)) AS avgdl FROM bt GROUP BY url),
tf AS (SELECT url, passage_no, dl, term, count(*) AS tf FROM (SELECT url, passage_no, len(t) AS dl, unnest(t) AS term FROM bt) GROUP BY ALL),
df AS (SELECT url, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT DISTINCT call_id, url, unnest({tokens('question')}) AS term FROM keep WHERE content <> ''),
sc AS (SELECT q.call_id, q.url, tf.passage_no, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt q JOIN tf ON tf.url = q.url AND tf.term = q.term JOIN df ON df.url = q.url AND df.term = q.term JOIN st ON st.url = q.url GROUP BY ALL),
r8 AS (SELECT *, row_number() OVER (PARTITION BY call_id, url ORDER BY round(score, 9) DESC, passage_no) AS p0 FROM sc WHERE score > 0 QUALIFY p0 <= 8),
r2 AS (SELECT r.*, p.passage, p.start_pos, p.end_pos, row_number() OVER (PARTITION BY r.call_id, r.url ORDER BY p0) AS prank FROM r8 r JOIN pas p ON p.url = r.url AND p.passage_no = r.passage_no WHERE NOT {SERIAL.format('p.passage')} QUALIFY prank <= 2),
wt AS (SELECT r.*, k.title, k.cluster, k.ord + 1 AS citation, r.score * (0.5 + 0.5 * least(1.0, greatest(0.0, coalesce(k.density, 1.0)))) AS weighted FROM r2 r JOIN keep k ON k.call_id = r.call_id AND k.url = r.url WHERE k.content <> ''),
fi AS (SELECT *, row_number() OVER (PARTITION BY call_id, coalesce(cluster, -citation) ORDER BY round(weighted, 9) DESC, citation, prank) = 1 AS lead_, row_number() OVER (PARTITION BY call_id ORDER BY round(weighted, 9) DESC, citation, prank) AS place FROM wt),
cit AS (SELECT call_id, citation, url, title, passage AS quote, start_pos, end_pos, round(weighted, 4) AS relevance FROM fi QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY lead_ DESC, place) <= 5)"""


def evidence(opened: str) -> str:
    """evidence of opened and cit."""
    return f"""
SELECT o.call_id, opened, independent, greatest(0, opened - independent)::BIGINT AS derivative, low_density, coalesce(cited, 0)::BIGINT AS cited,
  CASE WHEN len(q) = 0 THEN 0.0 ELSE round(len(list_filter(q, lambda w: list_contains({tokens("coalesce(quotes, '')")}, w)))::DOUBLE / len(q), 4) END AS coverage
FROM (SELECT call_id, count(*) AS opened, count(DISTINCT cluster) AS independent, count_if(density < 0.5)::BIGINT AS low_density, list_distinct({tokens('max(question)')}) AS q FROM {opened} GROUP BY call_id) o
LEFT JOIN (SELECT call_id, count(*) AS cited, string_agg(quote, ' ') AS quotes FROM cit GROUP BY call_id) c ON c.call_id = o.call_id"""


def answers(opened: str) -> str:
    return f"""
SELECT o.call_id, CASE WHEN q IS NULL THEN 'No results found' ELSE 'Based on ' || n || ' sources:' || chr(10) || chr(10) || q END AS answer FROM (SELECT call_id, count(*) AS n FROM {opened} GROUP BY call_id) o
LEFT JOIN (SELECT call_id, string_agg('[' || citation || '] ' || quote, chr(10) || chr(10) ORDER BY citation, relevance DESC, quote) AS q FROM cit GROUP BY call_id) c ON c.call_id = o.call_id"""


def tiers(html: str, mode: str, rendered: str) -> str:
    """CTEs up to routed(url, method, confidence, rendered, n_chars) of the derived html pages (CTEs html and seen)."""
    paragraphs = f"list_filter(list_transform(regexp_split_to_array(content, '\\r?\\n[ \\t]*\\r?\\n'), lambda p: trim(regexp_replace(p, '[{SPACE}]+', ' ', 'g'))), lambda p: p <> '')"
    return f"""{html},
ar AS (SELECT url, content, n, title, html, visible, CASE WHEN n % 11 = 0 THEN 403 WHEN n % 13 = 0 THEN NULL ELSE 200 END AS status,
  CASE WHEN html <> '' AND length(array_to_string({paragraphs}, chr(10) || chr(10))) > 140 THEN array_to_string({paragraphs}, chr(10) || chr(10)) END AS article,
  CASE WHEN html <> '' AND n % 3 = 0 AND NOT contains(lower(content), '</script>') THEN array_to_string(list_filter([content, title], lambda x: trim(x) <> ''), chr(10) || chr(10)) ELSE '' END AS structured,
  CASE WHEN {rendered} THEN visible END AS drawn FROM seen),
routed AS (SELECT url, CASE WHEN status IS NOT NULL AND length(visible) > 500 AND article IS NOT NULL THEN {{'m': 'http_fetch', 'c': 0.85, 'r': false, 'x': article}}
  WHEN length(structured) > 200 THEN {{'m': 'hydration_data', 'c': 0.90, 'r': false, 'x': structured}}
  WHEN '{mode}' <> 'fast' AND length(drawn) > 0 THEN {{'m': 'rendered_dom', 'c': 0.90, 'r': true, 'x': drawn}}
  ELSE {{'m': 'best_effort', 'c': 0.50, 'r': false, 'x': coalesce(article, visible)}} END AS w FROM ar)"""


COOLDOWNS = """
WITH RECURSIVE ev AS (SELECT event_type AS provider, event_id AS ord, epoch_us(ts) // 1000 AS t, event_id % 50 = 0 AS blocked, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
cd AS (SELECT provider, ord, k, false AS refused, CASE WHEN blocked THEN t + 60000 ELSE 0 END::BIGINT AS cool_until FROM ev WHERE k = 1
  UNION ALL SELECT e.provider, e.ord, e.k, e.t < c.cool_until, CASE WHEN e.t < c.cool_until THEN c.cool_until WHEN e.blocked THEN greatest(c.cool_until, e.t + 60000) ELSE 0 END::BIGINT FROM cd c JOIN ev e ON e.provider = c.provider AND e.k = c.k + 1)
SELECT provider, ord, refused, cool_until FROM cd"""
