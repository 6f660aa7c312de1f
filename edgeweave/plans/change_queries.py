"""Catalogue: incremental maintenance and the debounce window, each with its SQL where SQL has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeweave.operators import analyze, changes
from edgeweave.plans import star_sql as sql
from edgeweave.sources import store, views
from edgeweave.streaming import debounce

QUERIES, SQL = {}, {}


def query(sql_text: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql_text is not None:
            SQL[f.__name__] = sql_text
        return f

    return add


OLD = "old AS (SELECT 'f' || o_orderkey AS file, sha256(o_custkey || ':' || o_orderstatus) AS hash FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01')"
NEW = "cur AS (SELECT 'f' || o_orderkey AS file, sha256(o_custkey || ':' || CASE WHEN o_custkey % 17 = 0 THEN 'Z' ELSE o_orderstatus END) AS hash FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01')"
DIFF = f"""{OLD}, {NEW}, diff AS (SELECT file, CASE WHEN old.hash IS NULL THEN 'added' WHEN cur.hash IS NULL THEN 'removed' WHEN old.hash <> cur.hash THEN 'changed' ELSE 'same' END AS change FROM old FULL JOIN cur USING (file))"""


def stamps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = views.table(spark, d, "orders")
    status = F.when(F.col("o_custkey") % 17 == 0, "Z").otherwise(F.col("o_orderstatus"))
    stamp = lambda s: [views.key("f", "o_orderkey").alias("file"), F.sha2(F.concat_ws(":", F.col("o_custkey").cast("string"), s), 256).alias("hash")]
    old = orders.filter("o_orderdate < timestamp '2001-01-01'").select(*stamp(F.col("o_orderstatus")))
    return old, orders.filter("o_orderdate >= timestamp '1995-03-01'").select(*stamp(status))


@query(f"WITH {DIFF} SELECT file, change FROM diff")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return changes.snapshot_diff(*stamps(spark, d))


@query(f"WITH {DIFF}, t AS (SELECT file FROM diff WHERE change <> 'same') SELECT * FROM old ANTI JOIN t USING (file) UNION ALL SELECT * FROM cur SEMI JOIN t USING (file)")
def teardown_install(spark: SparkSession, d: str) -> DataFrame:
    old, new = stamps(spark, d)
    touched = changes.snapshot_diff(old, new).filter("change != 'same'")
    return changes.install(old, new, touched)


TOUCHED = f"WITH {sql.CODE_NODES}, {sql.CODE_EDGES}, {sql.CODE_REFS}, t AS (SELECT DISTINCT file FROM code_nodes WHERE part % 97 = 5)"


def touched(spark: SparkSession, d: str) -> DataFrame:
    return views.code_nodes(spark, d).filter("part % 97 = 5").select("file").distinct()


@query(f"{TOUCHED}, gone AS (SELECT id FROM code_nodes SEMI JOIN t USING (file)) SELECT src, dst, relation FROM code_edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def edge_teardown(spark: SparkSession, d: str) -> DataFrame:
    edges = views.code_edges(spark, d)
    return changes.install_edges(edges, edges.limit(0), views.code_nodes(spark, d), touched(spark, d)).select("src", "dst", "relation")


NAMES = "names AS (SELECT DISTINCT name FROM code_nodes SEMI JOIN t USING (file) WHERE length(name) % 2 = 0)"
DEPS = "deps AS (SELECT DISTINCT a.file FROM code_edges e JOIN code_nodes a ON a.id = e.src JOIN code_nodes b ON b.id = e.dst WHERE relation <> 'contains' AND b.file IN (SELECT file FROM t) AND a.file NOT IN (SELECT file FROM t))"


@query(f"{TOUCHED} SELECT DISTINCT name FROM code_nodes SEMI JOIN t USING (file)")
def name_delta(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.code_nodes(spark, d)
    return changes.changed_names(nodes, nodes, touched(spark, d))


@query(f"{TOUCHED}, {DEPS} SELECT file FROM deps")
def dependent_files(spark: SparkSession, d: str) -> DataFrame:
    return changes.dependent_files(views.code_edges(spark, d), views.code_nodes(spark, d), touched(spark, d))


@query(f"{TOUCHED}, {NAMES} SELECT DISTINCT file FROM (SELECT file FROM code_refs SEMI JOIN names USING (name) UNION SELECT file FROM t) WHERE file NOT LIKE '%brand_4.py'")
def invalidated_files(spark: SparkSession, d: str) -> DataFrame:
    nodes, t = views.code_nodes(spark, d), touched(spark, d)
    names = changes.changed_names(nodes, nodes, t).filter("length(name) % 2 = 0")
    gone = nodes.filter("file like '%brand_4.py'").select("file").distinct().withColumn("change", F.lit("removed"))
    diff = t.withColumn("change", F.lit("changed")).unionByName(gone)
    return changes.affected_files(views.code_refs(spark, d), names, t.limit(0), diff)


@query(f"{TOUCHED} SELECT DISTINCT b.file FROM code_edges e JOIN code_nodes a ON a.id = e.src JOIN code_nodes b ON b.id = e.dst WHERE relation = 'calls' AND a.file IN (SELECT file FROM t)")
def dispatch_lookahead(spark: SparkSession, d: str) -> DataFrame:
    edges = views.code_edges(spark, d).withColumn("evidence", F.when(F.col("relation") == "calls", "dynamic").otherwise("structural"))
    return changes.dispatch_lookahead(edges, views.code_nodes(spark, d), touched(spark, d))


def digest_sql(name: str, table: str) -> str:
    return f"SELECT sha256('{name}' || chr(1) || file || chr(1) || hash) AS h FROM {table}"


@query(f"WITH {OLD}, {NEW}, h AS ({digest_sql('a', 'old')} UNION ALL {digest_sql('b', 'cur')}), p AS (SELECT CAST('0x' || substr(h, 1, 4) AS INTEGER) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS d FROM h GROUP BY 1) SELECT sha256(string_agg(d, ',' ORDER BY b)) AS token FROM p")
def snapshot_token(spark: SparkSession, d: str) -> DataFrame:
    old, new = stamps(spark, d)
    return changes.snapshot_token({"a": old, "b": new})


@query(f"WITH {OLD}, {NEW}, s AS (SELECT file AS member, hash AS token FROM old), c AS (SELECT file AS member, hash AS token FROM cur) SELECT member FROM c LEFT JOIN s USING (member) WHERE c.token IS DISTINCT FROM s.token")
def stale_members(spark: SparkSession, d: str) -> DataFrame:
    old, new = stamps(spark, d)
    as_member = lambda df: df.select(F.col("file").alias("member"), F.col("hash").alias("token"))
    return changes.stale_members(as_member(old), as_member(new))


SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, count(*) AS n, count(DISTINCT event_type) AS paths FROM s GROUP BY user_id, k"""


@query(SESSIONS)
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Watch events of each user in batches that a gap of six hours closes."""
    events = views.table(spark, d, "events").select("user_id", "ts", F.col("event_type").alias("path"))
    out = debounce.batches(events, "6 hours", ["user_id"])
    return out.select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', first)").alias("first_us"), "n", F.size("paths").cast("long").alias("paths"))


@query(SESSIONS)
def debounce_streaming(spark: SparkSession, d: str) -> DataFrame:
    """The same through Structured Streaming, run until the input is read."""
    out = debounce.stream_batches(spark, f"{d}/events.parquet", "6 hours", ["user_id"], "event_type")
    return out.select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', first)").alias("first_us"), "n", F.size("paths").cast("long").alias("paths"))


@query("SELECT count(*) AS questions, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10 FROM (SELECT nullif(event_id % 13, 12) + 1 AS r FROM events)")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    rank = F.nullif(F.col("event_id") % 13, F.lit(12)) + 1
    out = analyze.eval_metrics(views.table(spark, d, "events").select(F.col("event_id").alias("question"), rank.alias("rank")))
    return out.select("questions", *[F.round(c, 6).alias(c) for c in ("mrr", "recall_1", "recall_5", "recall_10")])


@query("SELECT 'region' AS t, to_json(struct_pack(r_regionkey := r_regionkey, r_name := r_name)) AS json FROM region")
def json_sink(spark: SparkSession, d: str) -> DataFrame:
    return store.as_json(views.table(spark, d, "region").select("r_regionkey", "r_name")).select(F.lit("region").alias("t"), "json")


BROKEN = f"WITH {sql.NODES}, {sql.EDGES} SELECT 'missing endpoint' AS rule, count(*) AS n FROM (SELECT DISTINCT id FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) WHERE id NOT IN (SELECT id FROM nodes)) HAVING count(*) > 0"


@query(BROKEN)
def graph_invariants(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.star_nodes(spark, d).withColumn("start", F.lit(0)).withColumn("end", F.lit(1))
    return store.check_graph(nodes, views.star_edges(spark, d))
