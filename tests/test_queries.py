"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest
from plumbline.plans import damaged as _damaged  # noqa: F401
from plumbline.plans import queries as _queries  # noqa: F401
from plumbline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(cell(v[i]) for i in order) for v in values], key=str)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["lang", "k", "n_questions", "claim_hits", "claim_count", "macro_claim_recall"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
