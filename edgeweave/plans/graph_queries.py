"""Catalogue: traversal, adjacency and impact queries over the star and deep graphs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeweave.functions.scopes import scope_of
from edgeweave.operators import analyze, traverse
from edgeweave.operators.traverse import EdgeFilter
from edgeweave.plans import star_sql as sql
from edgeweave.sources import views

QUERIES, SQL = {}, {}


def query(text: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return add


def reached(spark: SparkSession, d: str, ids: list[str], by: EdgeFilter = EdgeFilter(), depth: int = 10) -> DataFrame:
    return traverse.dependents(views.star_edges(spark, d), ids, by, depth, views.star_nodes(spark, d))


STAR = f"{sql.NODES},\n{sql.EDGES}"


@query(sql.reach(STAR, sql.start("s1"), 10) + " SELECT id, CAST(depth AS INTEGER) AS depth FROM best")
def dependents_all(spark: SparkSession, d: str) -> DataFrame:
    return reached(spark, d, ["s1"]).select("id", "depth")


@query(sql.reach(STAR, sql.start("s1"), 1) + " SELECT id, CAST(depth AS INTEGER) AS depth FROM best")
def dependents_depth1(spark: SparkSession, d: str) -> DataFrame:
    return reached(spark, d, ["s1"], depth=1).select("id", "depth")


@query(sql.reach(STAR, sql.start("p7"), 10, where="confidence = 'certain'") + " SELECT id, CAST(depth AS INTEGER) AS depth FROM best")
def dependents_certain(spark: SparkSession, d: str) -> DataFrame:
    return reached(spark, d, ["p7"], EdgeFilter(certain=True)).select("id", "depth")


@query(sql.reach(STAR, sql.start("s1"), 10, where="relation IN ('uses') AND evidence IN ('import', 'scope')") + " SELECT id, CAST(depth AS INTEGER) AS depth FROM best")
def dependents_relations(spark: SparkSession, d: str) -> DataFrame:
    return reached(spark, d, ["s1"], EdgeFilter(relations=frozenset({"uses"}), evidence=frozenset({"import", "scope"}))).select("id", "depth")


@query(sql.reach(STAR + f", fine AS (SELECT id FROM {sql.scoped('SELECT * FROM nodes')} WHERE scope IN ('production', 'docs'))", sql.start("s1"), 10, ends="src IN (SELECT id FROM fine)") + " SELECT id, CAST(depth AS INTEGER) AS depth FROM best")
def dependents_scoped(spark: SparkSession, d: str) -> DataFrame:
    return reached(spark, d, ["s1"], EdgeFilter(scopes=frozenset({"production", "docs"}))).select("id", "depth")


@query(sql.reach(STAR, sql.start("s1", "s2", "c5", "p9"), 10) + " SELECT source, CAST(depth AS INTEGER) AS depth, count(*) AS n FROM best GROUP BY ALL")
def dependents_batch(spark: SparkSession, d: str) -> DataFrame:
    return reached(spark, d, ["s1", "s2", "c5", "p9"]).groupBy("source", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(sql.reach(sql.DEEP, sql.start("345"), 6, forward=True) + " SELECT id, CAST(depth AS INTEGER) AS depth FROM best")
def dependencies_closure(spark: SparkSession, d: str) -> DataFrame:
    return traverse.dependencies(views.deep_edges(spark, d), ["345"], max_depth=6).select("id", "depth")


@query(sql.reach(STAR, "SELECT 'n3' AS source, 'n3' AS id UNION SELECT 'n3', dst FROM edges WHERE src = 'n3' AND relation = 'contains'", 10) + " SELECT id, CAST(depth AS INTEGER) AS depth FROM best")
def file_seeded_closure(spark: SparkSession, d: str) -> DataFrame:
    """Dependents of all that a nation's file holds, seeded as a file start is."""
    edges, nodes = views.star_edges(spark, d), views.star_nodes(spark, d)
    steps = traverse.admitted(edges, EdgeFilter(), False, nodes)
    return traverse.reach(steps, traverse.seeded(edges, ["n3"], nodes), 10).select("id", "depth")


PATH_SQL = sql.reach(sql.DEEP, sql.start("1"), 9, forward=True) + " SELECT CAST(min(depth) AS INTEGER) AS length FROM best WHERE id = '77'"


@query(PATH_SQL)
def shortest_path_length(spark: SparkSession, d: str) -> DataFrame:
    path = traverse.shortest_path(views.deep_edges(spark, d), "1", "77")
    return traverse.path_table(views.deep_edges(spark, d), path).agg(F.nullif(F.count(F.lit(1)), F.lit(0)).cast("int").alias("length"))


@query(
    sql.reach(STAR, sql.start("p3"), 10, forward=True, where="confidence = 'certain'")
    + " SELECT (SELECT count(*) FROM best) AS forward_reached, count(*) FILTER (confidence = 'certain') AS admitted_into, count(*) FILTER (confidence <> 'certain') AS excluded_into FROM edges WHERE dst = 's1' AND relation <> 'contains'"
)
def path_miss_summary(spark: SparkSession, d: str) -> DataFrame:
    miss = traverse.explain_miss(views.star_edges(spark, d), "p3", "s1", EdgeFilter(certain=True))
    return miss.select("forward_reached", "admitted_into", "excluded_into")


WITH_FILES = " SELECT {} FROM best JOIN nodes USING (id)"


@query(sql.reach(STAR, sql.start("s1"), 10) + WITH_FILES.format("count(*) AS total, count(*) FILTER (depth = 1) AS direct, count(DISTINCT CASE WHEN depth = 1 THEN file END) AS direct_files"))
def direct_summary(spark: SparkSession, d: str) -> DataFrame:
    return traverse.direct_summary(reached(spark, d, ["s1"]).join(views.star_nodes(spark, d).select("id", "file"), "id"))


@query(sql.reach(STAR, sql.start("s1"), 10) + WITH_FILES.format("file, count(*) AS n") + " GROUP BY file ORDER BY n DESC, file LIMIT 10")
def by_file_top10(spark: SparkSession, d: str) -> DataFrame:
    return analyze.by_file(reached(spark, d, ["s1"]).join(views.star_nodes(spark, d).select("id", "file"), "id"))


@query(f"WITH {STAR} SELECT dst AS id, count(*) AS in_degree FROM edges WHERE relation <> 'contains' GROUP BY dst")
def in_degrees(spark: SparkSession, d: str) -> DataFrame:
    return traverse.in_degrees(views.star_edges(spark, d))


@query(f"WITH {STAR} SELECT dst AS id, count(*) AS in_degree FROM edges JOIN {sql.scoped('SELECT * FROM nodes')} n ON n.id = dst WHERE relation <> 'contains' AND scope = 'production' GROUP BY dst ORDER BY in_degree DESC, id LIMIT 10")
def in_degree_hubs(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.star_nodes(spark, d).filter(scope_of(F.col("file")) == "production")
    return analyze.hubs(nodes, views.star_edges(spark, d))


@query(sql.reach(STAR, sql.start("s1"), 10) + " SELECT id, CAST(depth AS INTEGER) AS depth, CASE WHEN depth = 1 THEN 's1/' || id ELSE (SELECT 's1/' || min(b.id) FROM best b JOIN steps s ON s.a = b.id WHERE s.b = best.id AND b.depth = 1) || '/' || id END AS line FROM best")
def tree_rendering(spark: SparkSession, d: str) -> DataFrame:
    tree = traverse.tree_order(reached(spark, d, ["s1"]), 2)
    return tree.select("id", "depth", F.array_join("line", "/").alias("line"))


@query(f"WITH {STAR} SELECT relation, evidence, confidence, count(*) AS n FROM edges GROUP BY ALL")
def confidence_tally(spark: SparkSession, d: str) -> DataFrame:
    return views.star_edges(spark, d).groupBy("relation", "evidence", "confidence").agg(F.count(F.lit(1)).alias("n"))


SITES = """WITH e AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'calls' AS relation, 'scope' AS evidence, 'inferred' AS confidence,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey END AS site_start FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY src, dst, relation, evidence, confidence ORDER BY site_start NULLS FIRST) AS k FROM e)
SELECT src, dst, relation, evidence, confidence, site_start, site_start + 4 AS site_end FROM r WHERE k = 1"""


@query(SITES)
def edge_identity_dedup(spark: SparkSession, d: str) -> DataFrame:
    site = F.when(F.col("l_linenumber") != 7, F.col("l_suppkey"))
    edges = views.table(spark, d, "lineitem").select(views.key("o", "l_orderkey").alias("src"), views.key("p", "l_partkey").alias("dst"), F.lit("calls").alias("relation"), F.lit("scope").alias("evidence"), F.lit("inferred").alias("confidence"), site.alias("site_start"), (site + 4).alias("site_end"))
    return analyze.dedupe_edges(edges)


@query(f"WITH {STAR}, x AS (SELECT src AS id, count(*) AS contains FROM edges WHERE relation = 'contains' GROUP BY src), y AS (SELECT dst AS id, count(DISTINCT file) AS user_files FROM edges JOIN nodes ON nodes.id = src WHERE relation <> 'contains' GROUP BY dst) SELECT id, coalesce(contains, 0) AS contains, coalesce(user_files, 0) AS user_files, CAST(0 AS BIGINT) AS extends FROM nodes LEFT JOIN x USING (id) LEFT JOIN y USING (id)")
def adjacency_counts(spark: SparkSession, d: str) -> DataFrame:
    return analyze.adjacency_counts(views.star_edges(spark, d), views.star_nodes(spark, d))


@query(f"WITH {STAR}, e AS (SELECT 'outgoing' AS direction, relation, dst AS other FROM edges WHERE src = 'p7' UNION SELECT 'incoming', relation, src FROM edges WHERE dst = 'p7'), r AS (SELECT *, row_number() OVER (PARTITION BY direction, relation ORDER BY other) AS k FROM e) SELECT direction, relation, count(*) AS n, string_agg(other, ',' ORDER BY other) FILTER (k <= 8) AS first FROM r GROUP BY ALL")
def show_card(spark: SparkSession, d: str) -> DataFrame:
    card = analyze.show_card(views.star_edges(spark, d), "p7")
    return card.withColumn("first", F.array_join("first", ","))


@query(f"WITH {STAR} SELECT file, count(*) AS n FROM edges JOIN nodes ON id = src WHERE dst = 'p7' AND relation <> 'contains' GROUP BY file")
def used_by_files(spark: SparkSession, d: str) -> DataFrame:
    edges = views.star_edges(spark, d).withColumn("site_start", F.lit(None).cast("bigint"))
    return analyze.used_by(edges, views.star_nodes(spark, d), "p7").select("file", "n")


@query(f"WITH {STAR}, n AS {sql.scoped('SELECT * FROM nodes')} SELECT (SELECT count(*) FROM n WHERE scope IN ('production', 'docs')) AS scoped_nodes, (SELECT count(*) FROM n) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges")
def map_totals(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.star_nodes(spark, d)
    return analyze.totals(nodes, views.star_edges(spark, d), nodes.filter(scope_of(F.col("file")).isin("production", "docs")))


@query(f"WITH {STAR}, x AS (SELECT CASE WHEN len(p) > 1 THEN p[1] ELSE '.' END AS top, CASE WHEN len(p) > 2 THEN p[2] END AS second FROM (SELECT string_split(file, '/') AS p FROM nodes)) SELECT top, NULL AS second, count(*) AS n FROM x GROUP BY top UNION ALL SELECT top, second, count(*) FROM x WHERE second IS NOT NULL GROUP BY top, second")
def module_rollup(spark: SparkSession, d: str) -> DataFrame:
    return analyze.module_tree(views.star_nodes(spark, d))


CHANGED = "SELECT DISTINCT 'p' || l_partkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '2001-07-25'"
IMPACT = sql.reach(STAR, f"SELECT 'change' AS source, id FROM ({CHANGED})", 25)


def changed(spark: SparkSession, d: str) -> DataFrame:
    late = views.table(spark, d, "orders").filter("o_orderdate >= timestamp '2001-07-25'").select(F.col("o_orderkey").alias("l_orderkey"))
    return views.table(spark, d, "lineitem").join(late, "l_orderkey").select(views.key("p", "l_partkey").alias("id")).distinct()


@query(IMPACT + " SELECT id, CAST(depth AS INTEGER) AS depth FROM best")
def impact_radius(spark: SparkSession, d: str) -> DataFrame:
    return analyze.impact_radius(views.star_edges(spark, d), changed(spark, d))


@query(IMPACT + ", t AS (SELECT id FROM best UNION SELECT id FROM starts) SELECT id FROM nodes SEMI JOIN t USING (id) WHERE starts_with(file, 'tests/') OR starts_with(name, 'test_') OR starts_with(name, 'Test')")
def impact_tests(spark: SparkSession, d: str) -> DataFrame:
    at = changed(spark, d)
    ids = analyze.impact_radius(views.star_edges(spark, d), at).select("id").unionByName(at)
    return analyze.impacted_tests(views.star_nodes(spark, d), ids).select("id")


@query(sql.reach(STAR, sql.start("s1"), 10) + ", e AS (SELECT best.id, min(struct_pack(p := src2, r := relation, v := evidence)) AS via FROM best JOIN (SELECT src AS id, dst AS src2, relation, evidence FROM edges WHERE relation <> 'contains') x USING (id) LEFT JOIN best b2 ON b2.id = x.src2 WHERE coalesce(b2.depth, CASE WHEN src2 = 's1' THEN 0 END) = best.depth - 1 GROUP BY best.id) SELECT count(*) FILTER (via.v IN ('structural', 'scip', 'declared')) AS certain, count(*) FILTER (via.v NOT IN ('structural', 'scip', 'declared')) AS possible, CAST(0 AS BIGINT) AS unresolved FROM e")
def traversal_evidence_counts(spark: SparkSession, d: str) -> DataFrame:
    return analyze.evidence_counts(reached(spark, d, ["s1"]))


MONTHS = """WITH t AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS change, 'p' || l_partkey AS id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
rad AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS change, 'p' || (l_partkey + 1) AS id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
f AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS change, 'p' || (l_partkey % 50) AS file FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
direct AS (SELECT a.change AS a, b.change AS b, id FROM t a JOIN t b USING (id) WHERE a.change < b.change),
far AS (SELECT DISTINCT least(x.change, y.change) AS a, greatest(x.change, y.change) AS b, id FROM t x JOIN rad y USING (id) WHERE x.change <> y.change),
far2 AS (SELECT * FROM far ANTI JOIN direct USING (a, b, id)),
sf AS (SELECT a, b, id AS file FROM direct UNION SELECT a, b, id FROM far2),
sh AS (SELECT a.change AS a, b.change AS b, file FROM f a JOIN f b USING (file) WHERE a.change < b.change),
sh2 AS (SELECT * FROM sh ANTI JOIN sf USING (a, b, file)),
c AS (SELECT a, b, sum(d) AS direct, sum(r) AS radius, sum(x) AS files FROM (SELECT a, b, 1 AS d, 0 AS r, 0 AS x FROM direct UNION ALL SELECT a, b, 0, 1, 0 FROM far2 UNION ALL SELECT a, b, 0, 0, 1 FROM sh2) GROUP BY a, b)
SELECT a, b, CAST(direct AS BIGINT) AS direct, CAST(radius AS BIGINT) AS radius, CAST(files AS BIGINT) AS files, CASE WHEN direct > 0 THEN 'high' WHEN radius > 0 THEN 'medium' WHEN files > 0 THEN 'low' ELSE 'clean' END AS risk FROM c"""


@query(MONTHS)
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Months of orders as changes."""
    orders = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("change"))
    lines = views.table(spark, d, "lineitem").join(orders, "l_orderkey")
    part = lambda c, name: lines.select("change", F.concat(F.lit("p"), c.cast("string")).alias(name))
    return analyze.overlaps(part(F.col("l_partkey"), "id"), part(F.col("l_partkey") + 1, "id"), part(F.col("l_partkey") % 50, "file"))


WS_LINKS = "links AS (SELECT DISTINCT 'east' AS src_member, 'o' || l_orderkey AS src_id, 'west' AS dst_member, 's' || l_suppkey AS dst_id, 'uses' AS relation, CASE l_linestatus WHEN 'O' THEN 'import' ELSE 'declared' END AS evidence FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1)"
WS = f"""{STAR}, {WS_LINKS},
ws AS (SELECT 'west|' || src AS src, 'west|' || dst AS dst FROM edges WHERE relation <> 'contains' AND evidence IN ('import', 'scope') UNION SELECT 'east|' || src, 'east|' || dst FROM edges WHERE relation <> 'contains' AND evidence IN ('import', 'scope') UNION SELECT src_member || '|' || src_id, dst_member || '|' || dst_id FROM links WHERE evidence IN ('import', 'scope'))"""
WS_SQL = f"""WITH RECURSIVE {WS},
r(id, depth) AS (SELECT 'west|s1', 0 UNION SELECT ws.src, depth + 1 FROM r JOIN ws ON ws.dst = r.id WHERE depth < 4)
SELECT split_part(id, '|', 1) AS member, split_part(id, '|', 2) AS id, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE id <> 'west|s1' GROUP BY ALL"""


def workspace(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = views.star_edges(spark, d)
    both = edges.withColumn("member", F.lit("west")).unionByName(edges.withColumn("member", F.lit("east")))
    lines = views.table(spark, d, "lineitem").filter("l_returnflag = 'A' and l_linenumber = 1")
    links = lines.select(F.lit("east").alias("src_member"), views.key("o", "l_orderkey").alias("src_id"), F.lit("west").alias("dst_member"), views.key("s", "l_suppkey").alias("dst_id"), F.lit("uses").alias("relation"), F.when(F.col("l_linestatus") == "O", "import").otherwise("declared").alias("evidence")).distinct()
    return both, links


@query(WS_SQL)
def workspace_dependents(spark: SparkSession, d: str) -> DataFrame:
    edges, links = workspace(spark, d)
    out = traverse.workspace_dependents(edges, links, "west", "s1", EdgeFilter(evidence=frozenset({"import", "scope"})), 4)
    return out.select("member", "id", "depth")
