"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import duckdb
import pytest

from corpusloom.plans import files  # noqa: F401  adds its queries
from corpusloom.plans.queries import QUERIES, SQL

from .conftest import DATA

SMALL = DATA / "sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(value):
    if isinstance(value, float) and value == int(value):
        return int(value)
    return value


def values(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(x) for x in r]) for r in frame.astype(object).where(frame.notna(), None).values.tolist())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, str(SMALL)).toPandas()
    assert len(found)
    if name in SQL:
        wanted = db.sql(SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert values(found) == values(wanted)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
