"""Every query with SQL against DuckDB, on the smallest tables; a few that cover each module by default."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from edgeweave.plans import catalogue

SF = "/root/testdata/sf0.001"
FEW = ("dependents_scoped", "path_miss_summary", "map_totals", "scope_override_last_wins", "word_splits", "ask_score", "tiered_resolution", "relational_division", "snapshot_token", "debounce_sessions")
NAMES = sorted(catalogue.oracle_sql()) if os.environ.get("ALL_QUERIES") else FEW


def rows(data, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_sql_gives(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    want = db.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = catalogue.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
