"""The pN queries over whole tables."""

import re

import pytest

from sievelight.llm import queries as Q
from sievelight.llm import sql
from tests.compare import canonical, connect

COLUMNS = {"p1_found": ["url"], "p2_found": ["url", "line_no"], "p3_found": ["url_a", "url_b"], "p4_found": ["url"], "p5_found": ["url"], "p6_found": ["url"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs(spark, data, name):
    df = Q.queries()[name](spark, data)
    got = df.collect()
    assert len(got) > 0
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(map(str, got))) == len(got)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql(spark, data, name):
    assert canonical(Q.queries()[name](spark, data).toPandas()) == canonical(connect(data).execute(sql.oracle_sql()[name]).fetchdf())


def test_pairs_by_brute_force(spark, data):
    import pandas as pd

    p = pd.read_parquet(f"{data}/page_cache.parquet").sort_values("created_at").drop_duplicates("url", keep="last")
    flagged = {r.url for r in Q.p5_found(spark, data).collect()}
    sets = {}
    for u, c in zip(p.url, p.content):
        w = re.findall("[a-z0-9]+", c.lower()) if isinstance(c, str) else []
        if len(w) >= 20 and u not in flagged:
            sets[u] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    ids = sorted(sets)
    host = lambda u: re.sub(r"^www\.", "", u.split("/")[2].lower())
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if host(a) != host(b) and 10 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert {(r.url_a, r.url_b) for r in Q.p3_found(spark, data).collect()} == want


def test_ids_of_all(spark, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    ids = list(texts)
    want = {i: e.ids for i, e in zip(ids, t.encode_batch([texts[i] for i in ids], add_special_tokens=False))}
    assert {r.doc_id: list(r.ids) for r in Q.p7_ids(spark, data).collect()} == want
