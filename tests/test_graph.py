from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import pytest

from edgeweave import schema
from edgeweave.operators import analyze, traverse
from edgeweave.plans import graph_queries
from edgeweave.operators.traverse import EdgeFilter
from edgeweave.sources import store


def edges_of(spark, rows):
    df = spark.createDataFrame(rows, "src string, dst string, relation string, evidence string")
    return df.withColumn("confidence", schema.confidence(F.col("evidence")))


def nodes_of(spark, rows):
    return spark.createDataFrame(rows, "id string, kind string, name string, file string, start long, end long, signature string, doc string")


CHAIN = [
    ("src/lib.rs#entry@0", "src/util.rs#core_fn@0", "calls", "import"),
    ("src/lib.rs", "src/util.rs#core_fn@0", "imports", "import"),
    ("src/lib.rs#test_entry@30", "src/lib.rs#entry@0", "calls", "scope"),
    ("src/lib.rs", "src/lib.rs#entry@0", "contains", "structural"),
]
CHAIN_NODES = [
    ("src/lib.rs", "file", "lib.rs", "src/lib.rs", 0, 99, "", None),
    ("src/util.rs", "file", "util.rs", "src/util.rs", 0, 99, "", None),
    ("src/lib.rs#entry@0", "function", "entry", "src/lib.rs", 0, 20, "fn entry()", None),
    ("src/lib.rs#test_entry@30", "function", "test_entry", "src/lib.rs", 30, 50, "fn test_entry()", None),
    ("src/util.rs#core_fn@0", "function", "core_fn", "src/util.rs", 0, 20, "fn core_fn()", None),
]
CORE = "src/util.rs#core_fn@0"


def test_chain(spark):
    edges, nodes = edges_of(spark, CHAIN), nodes_of(spark, CHAIN_NODES)
    rows = traverse.dependents(edges, [CORE], nodes=nodes).join(nodes.select("id", "file"), "id")
    assert traverse.direct_summary(rows).first().asDict() == {"total": 3, "direct": 2, "direct_files": 1}
    assert traverse.dependents(edges, [CORE], max_depth=1, nodes=nodes).count() == 2
    assert traverse.dependents(edges, [CORE], EdgeFilter(evidence=frozenset({"scip"})), nodes=nodes).count() == 0
    assert {r["id"] for r in analyze.impacted_tests(nodes, rows).collect()} == {"src/lib.rs#test_entry@30"}


def test_contains_is_never_followed_but_seeds_files(spark):
    edges, nodes = edges_of(spark, CHAIN), nodes_of(spark, CHAIN_NODES)
    with pytest.raises(ValueError):
        EdgeFilter(relations=frozenset({"contains"}))
    assert {r["id"] for r in traverse.dependencies(edges, ["src/lib.rs"], nodes=nodes).collect()} == {CORE}
    path = traverse.shortest_path(edges, "src/lib.rs", CORE, EdgeFilter(relations=frozenset({"calls"})), nodes)
    assert [p[2] for p in path] == ["contains", "calls"]
    assert traverse.shortest_path(edges, CORE, CORE) == []
    assert traverse.shortest_path(edges, CORE, "src/lib.rs#entry@0") is None
    assert traverse.explain_miss(edges, CORE, "src/lib.rs#entry@0").first().asDict() == {"forward_reached": 0, "admitted_into": 1, "excluded_into": 0, "possible_steps": 0}


def test_dynamic_edges_can_be_left_out(spark):
    edges = edges_of(spark, [("announce", "Speak::speak", "calls", "scope"), ("Speak::speak", "Dog::speak", "calls", "dynamic"), ("Speak::speak", "Cat::speak", "calls", "dynamic")])
    assert {r["id"] for r in traverse.dependents(edges, ["Dog::speak"]).collect()} == {"announce", "Speak::speak"}
    assert traverse.dependents(edges, ["Dog::speak"], EdgeFilter(evidence=frozenset({"import", "scope", "scip"}))).count() == 0
    assert traverse.dependents(edges, ["Dog::speak"], EdgeFilter(certain=True)).count() == 0


def test_links_ignore_confidence(spark):
    edges = edges_of(spark, [("a", "b", "calls", "scope")]).withColumn("member", F.lit("one"))
    links = spark.createDataFrame([("two", "x", "one", "a", "uses", "import", "inferred", "p")], schema.LINKS)
    got = traverse.workspace_dependents(edges, links, "one", "a", EdgeFilter(certain=True)).collect()
    assert [(r["member"], r["id"], r["depth"]) for r in got] == [("two", "x", 1)]
    assert len(traverse.workspace_path(edges, links, ("two", "x"), ("one", "b"))) == 2


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=14))
def test_reach_is_breadth_first_search(spark, pairs):
    edges = edges_of(spark, [(str(a), str(b), "calls", "scope") for a, b in pairs])
    want, front, depth = {}, {"0"}, 0
    while front:
        depth += 1
        front = {str(b) for a, b in pairs if str(a) in front and str(b) != "0" and str(b) not in want}
        want |= dict.fromkeys(front, depth)
    got = {r["id"]: r["depth"] for r in traverse.dependencies(edges, ["0"], max_depth=20).collect()}
    assert got == want


def test_overlap_tiers(spark):
    touched = spark.createDataFrame([("a", "r.rs#Backoff"), ("b", "r.rs#Backoff"), ("c", "l.rs#Login"), ("d", "z.rs#Z")], "change string, id string")
    radius = spark.createDataFrame([("a", "l.rs#Login")], "change string, id string")
    files = spark.createDataFrame([("a", "r.rs"), ("b", "r.rs"), ("c", "q.rs"), ("d", "q.rs")], "change string, file string")
    got = {(r["a"], r["b"]): r["risk"] for r in analyze.overlaps(touched, radius, files).collect()}
    assert got == {("a", "b"): "high", ("a", "c"): "medium", ("c", "d"): "low"}


def test_edge_identity_and_invariants(spark):
    rows = [("a", "b", "calls", "scope", "inferred", 5, 9), ("a", "b", "calls", "scope", "inferred", None, None), ("a", "b", "uses", "scope", "inferred", 1, 2)]
    got = analyze.dedupe_edges(spark.createDataFrame(rows, schema.EDGES)).collect()
    assert sorted((r["relation"], r["site_start"]) for r in got) == [("calls", None), ("uses", 1)]
    bad = store.check_graph(nodes_of(spark, [("a", "function", "a", "f", 3, 3, "", None), ("dep:x@1#y@0", "method", "y", "dep:x@1", 0, 0, "", None)]), edges_of(spark, [("a", "gone", "calls", "scope")]))
    assert {(r["rule"], r["n"]) for r in bad.collect()} == {("invalid node", 1), ("missing endpoint", 1)}


def test_hunks(spark):
    nodes = nodes_of(spark, CHAIN_NODES)
    hunks = spark.createDataFrame([("src/lib.rs", 10, 12, False), ("src/util.rs", 50, 60, False)], "file string, start long, end long, whole boolean")
    assert {(r["id"], r["reason"]) for r in analyze.hunk_symbols(nodes, hunks).collect()} == {("src/lib.rs#entry@0", "overlap"), ("src/util.rs", "file")}
    diff = spark.createDataFrame([("f", "@@ -1,2 +3,0 @@\n@@ -9 +10 @@ x\n")], "file string, text string")
    assert [tuple(r) for r in store.parse_hunks(diff).orderBy("new_start").collect()] == [("f", 3, 0, True), ("f", 10, 1, False)]
    assert store.parse_name_status("R100\0a\0b\0M\0c\0") == [("R", "b", "a"), ("M", "c", None)]
    assert store.parse_porcelain("UU x\n M y\n") == [("UU", "x", True), (" M", "y", False)]


def test_the_path_query_has_no_depth_limit(spark, monkeypatch):
    chain = [1, *range(100, 112), 77]
    edges = spark.createDataFrame([(str(a), str(b), "calls", "scope", "inferred") for a, b in zip(chain, chain[1:], strict=False)], "src string, dst string, relation string, evidence string, confidence string")
    monkeypatch.setattr(graph_queries.views, "deep_edges", lambda *_: edges)
    assert graph_queries.shortest_path_length(spark, "").first()["length"] == 13
