"""Every registered query against its DuckDB twin over the same tables."""

import math
import os

import duckdb
import pytest

from meridia.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def ordered(rows):
    """Rows by their exact cells first, so that a last digit of a double doesn't decide the order."""
    return sorted(rows, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [round(v, 4) for v in r if isinstance(v, float)]))


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, abs_tol=2e-6)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert len(set(columns)) == len(columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    if (sql := registry.oracle_sql().get(name)) is None:
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert len(rows) == len(want)
    for a, b in zip(ordered(rows), ordered(want)):
        assert all(map(same, a, b)), (a, b)
