"""SQL for the queries that SQL can express on whole tables; the others are tested against brute force."""

# The longest stretch without a natural end: split at line feeds and at end marks before white space.
P4_FOUND = r"""
WITH latest AS (SELECT url, content FROM page_cache WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY coalesce(created_at, -1) DESC) = 1)
SELECT url FROM latest WHERE content IS NOT NULL AND length(content) > 1200
AND list_max(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(content, '[.!?](\s)', chr(1) || '\1', 'g'), '[.!?](\s)', chr(1) || '\1', 'g'), '[' || chr(1) || '\n]'), lambda x: length(x))) > 1200
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_FOUND}
