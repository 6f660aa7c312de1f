"""Queries over tables with few files and names, so that many references and definitions share a key: rows as SQL's, and no join that makes a row per pair."""

import itertools
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from edgeweave.operators import analyze, resolve
from edgeweave.plans import catalogue, join_queries
from edgeweave.sources import views

LINES, PARTS = 3000, 90


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    r, d = random.Random(5), tmp_path_factory.mktemp("tables")
    parts = [(i, "hot bolt" if i % 9 else "old ring", "Brand#1", "SMALL" if i % 7 else "LARGE", r.randrange(50)) for i in range(PARTS)]
    lines = [(r.randrange(400), r.randrange(PARTS), r.randrange(30), r.randrange(1, 8), float(r.randrange(1, 51)), r.choice("NRA"), r.choice("OF"), f"2001-0{r.randrange(1, 10)}-01 00:00:00") for _ in range(LINES)]
    lines += lines[:50] + [(*x[:5], "N" if x[5] == "R" else "R", *x[6:]) for x in lines[50:100]]
    orders = [(i, r.randrange(200), r.choice("OFP"), f"{1995 + i % 6}-0{1 + i % 9}-15 00:00:00") for i in range(400)]
    db = duckdb.connect()
    for name, columns, rows in (
        ("part", "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER", parts),
        ("lineitem", "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP", lines),
        ("orders", "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_orderdate TIMESTAMP", orders),
        ("documents", "doc_id BIGINT, text VARCHAR", [(1, "x")]),
    ):
        db.execute(f"create table {name} ({columns})")
        db.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
        db.execute(f"copy {name} to '{d}/{name}.parquet' (format parquet)")
    return str(d), db


def made(df):
    """The most rows that a join of the plan has made, once ``df`` has run."""
    df.collect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        below = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        own = p.metrics().get("numOutputRows")
        return max([own.get().value() if "Join" in kind and own.isDefined() else 0, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def metrics(df, kinds, name):
    """A metric of the nodes of the plan of these kinds, once ``df`` has run; exchanges that are read twice count once."""
    df.collect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind.startswith("ReusedExchange"):
            return []
        below = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        own = p.metrics().get(name)
        return ([own.get().value()] if kinds in kind and own.isDefined() else []) + [x for b in below for x in walk(b)]

    return walk(df._jdf.queryExecution().executedPlan())


def same_as_sql(spark, tables, name):
    d, db = tables
    want = db.execute(catalogue.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    df = catalogue.queries()[name](spark, d)
    assert sorted(df.columns) == columns
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    return df


def test_spans_meet_places(spark, tables):
    assert made(same_as_sql(spark, tables, "enclosing_smallest_span")) <= 2 * LINES
    spans = spark.createDataFrame([("f", "in", 10, 20), ("f", "out", 0, 1000)], "file string, id string, start long, end long")
    points = spark.createDataFrame([(i, "f", 5 + i % 2 * 10, 6 + i % 2 * 10) for i in range(400)], "ref_id long, file string, start long, end long")
    got = resolve.smallest_enclosing(points, spans)
    assert {r["ref_id"]: r["enclosing"] for r in got.collect()} == {i: "in" if i % 2 else "out" for i in range(400)}
    assert made(got) <= 400


def test_names_are_counted_once_a_key(spark, tables):
    assert made(same_as_sql(spark, tables, "unique_or_nothing")) <= 2 * LINES


def test_kinds_are_counted_once_a_key(spark, tables):
    assert made(same_as_sql(spark, tables, "namespace_pick")) <= 2 * LINES


def test_occurrences_meet_references_by_place(spark, tables):
    assert made(same_as_sql(spark, tables, "scip_reference_rightmost")) <= 2 * LINES


def test_evidence_of_places(spark, tables):
    assert made(same_as_sql(spark, tables, "evidence_merge")) <= 2 * LINES


def test_scopes_are_read_in_one_order(spark, tables):
    assert made(same_as_sql(spark, tables, "shadow_interval_join")) <= 2 * LINES
    rows = [("f", "x", 0, 1000, "outer"), ("f", "x", 10, 20, "inner"), ("f", "x", 12, 14, None), ("f", "x", 30, 30, "none"), ("f", "x", 40, 45, "a"), ("f", "x", 40, 42, "b"), ("f", "y", 5, 6, "y")]
    locals_ = spark.createDataFrame(rows, "file string, name string, start long, scope_end long, type_name string")
    refs = spark.createDataFrame([(i, "f", "x", i) for i in range(-5, 1005)] + [(2000, "f", "y", 9), (2001, None, "x", 3)], "ref_id long, file string, name string, start long")
    want = {i: max((r for r in rows if r[1] == "x" and r[2] <= i < r[3]), key=lambda r: (r[2], r[4] or ""))[4] for i in range(1000)}
    assert {r["ref_id"]: r["type_name"] for r in resolve.local_at(refs, locals_).collect()} == want


def test_tiers_make_no_row_per_candidate(spark, tables):
    assert made(same_as_sql(spark, tables, "tiered_resolution")) <= 2 * LINES


def test_rates_make_no_row_per_candidate(spark, tables):
    assert made(same_as_sql(spark, tables, "resolution_stats")) <= 2 * LINES


def test_categories_make_no_row_per_candidate(spark, tables):
    assert made(same_as_sql(spark, tables, "unresolved_categories")) <= 2 * LINES


def test_listing_makes_no_row_per_candidate(spark, tables):
    assert made(same_as_sql(spark, tables, "unresolved_listing")) <= 2 * LINES


def test_coverage_makes_no_row_per_candidate(spark, tables):
    assert made(same_as_sql(spark, tables, "coverage_envelope")) <= 2 * LINES


def test_counted_references_move_as_their_places(spark, tables):
    """Their keys are moved once, to be told apart; after that a reference is its file, its name, where it starts and its forms."""
    assert sum(metrics(same_as_sql(spark, tables, "coverage_envelope"), "ShuffleExchange", "dataSize")) <= 300 * LINES


def test_listing_makes_references_of_the_first_places_only(spark, tables):
    assert sum(metrics(same_as_sql(spark, tables, "unresolved_listing"), "ShuffleExchange", "dataSize")) <= 100 * LINES


def test_counted_references_move_as_few_numbers(spark, tables):
    assert sum(metrics(join_queries.missed(spark, tables[0]), "ShuffleExchange", "dataSize")) <= 240 * LINES


def test_keys_that_do_not_fit_are_told_apart(spark, tables, tmp_path):
    d, db = tables
    for name in ("part", "orders", "documents"):
        os.symlink(f"{d}/{name}.parquet", tmp_path / f"{name}.parquet")
    own = duckdb.connect()
    own.execute(f"create table lineitem as select * from '{d}/lineitem.parquet' limit 200")
    odd = {"l_suppkey": (-1, 1 << 27, 1 << 40), "l_linenumber": (-1, 64, 1 << 20), "l_orderkey": (-7, -5003, 1 << 31, 1 << 45), "l_quantity": (-1.0, 0.5, 17.25, 1023.0, 1024.0, 1e6)}
    odd["l_shipdate"] = [f"timestamp '{day}'" for day in ("1969-12-31", "1970-01-01", "2149-06-06", "2149-06-07")]
    for column, values in odd.items():
        for value, flag, n in itertools.product(values, "NR", (5, 3)):
            own.execute(f"insert into lineitem select * replace ({value} as {column}, '{flag}' as l_returnflag) from '{d}/lineitem.parquet' limit {n}")
    own.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    for name in ("part", "orders", "documents"):
        own.execute(f"create view {name} as select * from '{d}/{name}.parquet'")
    lines = views.ref_lines(spark, str(tmp_path))
    packed = views.packed_lines(lines)
    wide = "l_suppkey not between 0 and (1 << 27) - 1 or l_linenumber not between 0 and 63 or l_orderkey not between 0 and (1L << 31) - 1"
    assert packed.filter("odd is not null").count() == lines.filter(f"{wide} or day not between '1970-01-01' and '2149-06-06' or quantity in ('-1.0', '0.5', '17.25', '1024.0', '1000000.0')").count() > 100
    assert packed.select("a", F.expr("b >> 4"), "odd").distinct().count() == lines.select(*views.REF_KEY).distinct().count()
    same_as_sql(spark, (str(tmp_path), own), "unresolved_categories")
    same_as_sql(spark, (str(tmp_path), own), "unresolved_listing")


def test_places_that_lie_together_move_once(spark):
    occ = spark.createDataFrame([(i, "f" if i % 2 else "g", f"m{k}", i * 10 + 1, False) for i in range(2000) for k in range(2)], "part long, file string, moniker string, pos long, is_definition boolean").repartition("part")
    defs = spark.createDataFrame([(f"m{k}", f, f"{f}{k}", True) for k in range(2) for f in "fg"], "moniker string, file string, id string, shared boolean")
    refs = spark.createDataFrame([(f"r{i}", "f" if i % 2 else "g", i * 10, i * 10 + 5) for i in range(2000)], "ref_id string, file string, start long, end long")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        apart, near = resolve.scip_references(occ, refs, defs), resolve.scip_references(occ, refs, defs, "part")
        moved = [sum(metrics(df, "ShuffleExchange", "shuffleRecordsWritten")) for df in (apart, near)]
        rows = [{r["ref_id"]: r["target"] for r in df.collect()} for df in (apart, near)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert rows == [{f"r{i}": "f1" if i % 2 else "g1" for i in range(2000)}] * 2
    assert moved[1] <= moved[0] - 1500


def test_overlaps_make_no_row_per_pair_and_id(spark, tables):
    rows = spark.createDataFrame([(f"c{c:02}", f"f{i}") for c in range(20) for i in range(300)], "change string, id string")
    files = spark.createDataFrame([("c00", "zz")], "change string, file string")
    got = analyze.overlaps(rows, rows, files)
    assert made(got) <= 1000
    assert {(r["direct"], r["radius"], r["files"]) for r in got.collect()} == {(300, 0, 0)}
    assert got.count() == 190
