"""Every registered query with SQL gives DuckDB's rows; the others run and keep their invariants."""

import math

import duckdb
import pytest

from listenlab.plans.catalogue import ORACLE, QUERIES
from listenlab.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if hasattr(x, "is_finite"):
        return round(float(x), 5) + 0.0
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, df.collect()) == _rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and len(set(map(str, rows))) > len(rows) // 2


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
