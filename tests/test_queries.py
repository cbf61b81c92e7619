"""Every query of the core runs over its whole tables and equals its SQL."""

import pytest

from tests.compare import canonical, connect
from sievelight.plans import queries as Q

SQL = Q.oracle_sql()
#: The smallest tables have no two alike pages in one call.
MAY_BE_EMPTY = {"shingle_pairs"}


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, data, duck, name):
    got = canonical(Q.queries()[name](spark, data).toPandas())
    assert got == canonical(duck.execute(SQL[name]).fetchdf()) and (got[1] or name in MAY_BE_EMPTY)


@pytest.mark.parametrize("name", ["fallback_evidence", "appended_evidence"])
def test_evidence_is_linear(spark, data, monkeypatch, name):
    """Pages take at most four results of their host on the way, not all of them."""
    from sievelight.operators import router

    counts, fallback = [], router.fallback

    def counted(pages, variants, snippets):
        counts.append((pages.count(), snippets.count()))
        return fallback(pages, variants, snippets)

    monkeypatch.setattr(router, "fallback", counted)
    Q.queries()[name](spark, data.replace("sf0.001", "sf0.01"))
    assert 0 < counts[0][1] <= 4 * counts[0][0]


def test_entry(spark, data):
    assert Q.entry(spark, data).count() > 0


def test_no_subpackage_needed():
    import subprocess
    import sys

    code = "import sys; sys.modules['sievelight.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q[0] == 'p' and q[1].isdigit()]; assert len(e.queries()) == len(e.oracle_sql())"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests", 1)[0]).returncode == 0
