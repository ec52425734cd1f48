"""The registered queries of the library on the smallest tables against their SQL."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb
import pytest

from tidegrid.plans import classify_queries, driver_queries, feature_queries, library_queries, listing_queries, report_queries, site_queries

TABLES = Path("/root/testdata/sf0.001")
MODULES = {m.__name__ for m in (classify_queries, feature_queries, library_queries, listing_queries, report_queries)}
NAMES = [n for n, f in driver_queries.QUERIES.items() if f.__module__ in MODULES] + ["redact_text", "bounded_evidence", "graph_validate", "unique_in_group", "topology_build", "backend_matches", "bounded_paths", "path_counts", "chain_ends", "graph_edges"]


def plain(value):
    if isinstance(value, list | tuple):
        return [plain(x) for x in value]
    return f"{value:.9g}" if isinstance(value, float) else value.replace(tzinfo=None).isoformat() if isinstance(value, datetime.datetime) else str(value)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in TABLES.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    want = tables.sql(driver_queries.SQL[name])
    columns = sorted(want.columns)
    got = driver_queries.QUERIES[name](spark, str(TABLES))
    assert sorted(got.columns) == columns
    rows = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(plain(tuple(r)) for r in got.select(columns).collect()) == sorted(plain(r) for r in rows)


def test_every_query_has_sql():
    assert set(driver_queries.SQL) == set(driver_queries.QUERIES) and site_queries.site is not None
