"""Every query that has SQL gives the oracle's rows on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from fathomic import queries as core

NAMES = sorted(core.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for t in core.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def plain(rows):
    def one(v):
        if v is None:
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, sf, name):
    df = core.queries()[name](spark, sf)
    columns = sorted(df.columns)
    relation = duck.sql(core.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    want = plain(relation.select(*[f'"{c}"' for c in columns]).fetchall())
    got = plain(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
