"""Every query that has SQL against DuckDB, on the smallest tables."""

import decimal

import duckdb
import pytest

from lagweave.operators.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        return round(float(v), 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def test_lost_cells_of_circles_show(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lagweave.operators.model import SSA

    whole = SSA.reconstruct
    monkeypatch.setattr(SSA, "reconstruct", lambda self, *a: whole(self, *a).withColumn("value", F.lit(None).cast("double")))
    n = QUERIES["ssa2d_circle"](spark, SF).where("value is null").count()
    monkeypatch.undo()
    rows = QUERIES["ssa2d_circle"](spark, SF)
    assert 0.9 * 30 * 28 < n < 30 * 28 == rows.where("value is not null").count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    order = [columns.index(c) for c in sorted(columns)]
    expected = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))
    assert rows or name == "fmask_gaps"  # hours are sparse here
