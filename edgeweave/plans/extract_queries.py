"""Catalogue: extraction of generated sources, one file per part, and file inventories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeweave.functions.scopes import scope_of
from edgeweave.operators import resolve
from edgeweave.plans import star_sql as sql
from edgeweave.sources import extract, store, views

QUERIES, SQL = {}, {}


def query(sql_text: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], SQL[f.__name__] = f, sql_text
        return f

    return add


def sources(spark: SparkSession, d: str, language: str, text: F.Column) -> DataFrame:
    file = F.concat(F.lit("gen/f"), F.col("p_partkey").cast("string"))
    return views.table(spark, d, "part").select(file.alias("file"), F.lit(language).alias("language"), text.alias("content"))


N = "replace(p_name, ' ', '_')"
T = "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))"


@query(f"WITH p AS (SELECT 'gen/f' || p_partkey AS file, {N} AS n, {T} AS t FROM part) SELECT file || '#' || t || '@0' AS id, 'class' AS kind, t AS name, file AS parent FROM p UNION ALL SELECT file || '#' || t || '::' || n || '@' || (length(t) + 12), 'method', n, file || '#' || t || '@0' FROM p")
def extract_python_definitions(spark: SparkSession, d: str) -> DataFrame:
    name, kind = F.replace("p_name", F.lit(" "), F.lit("_")), F.initcap(F.lower("p_type"))
    text = F.concat(F.lit("class "), kind, F.lit(":\n    def "), name, F.lit("(self):\n        return other_"), name, F.lit("(1)\n"))
    facts = extract.extract(sources(spark, d, "python", text))
    parents = extract.exploded(facts, "contains").select(F.col("src").alias("parent"), F.col("dst").alias("id"))
    return extract.exploded(facts, "nodes").filter("kind != 'file'").join(parents, "id").select("id", "kind", "name", "parent")


@query(f"SELECT 'gen/f' || p_partkey AS file, 'other_' || {N} AS name, 'calls' AS relation, 'gen/f' || p_partkey || '#' || {T} || '::' || {N} || '@' || (length({T}) + 12) AS enclosing FROM part")
def extract_python_references(spark: SparkSession, d: str) -> DataFrame:
    name, kind = F.replace("p_name", F.lit(" "), F.lit("_")), F.initcap(F.lower("p_type"))
    text = F.concat(F.lit("class "), kind, F.lit(":\n    def "), name, F.lit("(self):\n        return other_"), name, F.lit("(1)\n"))
    return extract.exploded(extract.extract(sources(spark, d, "python", text)), "refs").select("file", "name", "relation", "enclosing")


@query("WITH p AS (SELECT 'gen/f' || p_partkey AS file, p_name AS n, p_type AS t, p_partkey % 9 AS k FROM part) SELECT file, t AS name, 0 AS start, NULL AS link FROM p UNION ALL SELECT file, n, length(t) + 3, NULL FROM p UNION ALL SELECT file, NULL, NULL, '../x' || k || '.md#y' FROM p")
def extract_markdown_facts(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("# "), F.col("p_type"), F.lit("\n## "), F.col("p_name"), F.lit("\nsee [it](../x"), (F.col("p_partkey") % 9).cast("string"), F.lit(".md#y) and `[not](a.md)`, [web](https://a.b)\n"))
    facts = extract.extract(sources(spark, d, "markdown", text))
    heads = extract.exploded(facts, "nodes").filter("kind = 'section'").select("file", "name", F.col("start").cast("int").alias("start"), F.lit(None).cast("string").alias("link"))
    links = extract.exploded(facts, "refs").select("file", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("start"), F.col("path").alias("link"))
    return heads.unionByName(links)


@query(f"WITH p AS (SELECT 'gen/f' || p_partkey AS file, {N} AS n, lower(p_type) AS t FROM part) SELECT file, 'struct' AS what, t || '_' || n AS name FROM p UNION ALL SELECT file, 'typealias', 'v_' || n FROM p UNION ALL SELECT file, 'uses', t || '_' || n FROM p UNION ALL SELECT file, 'uses', 'base' FROM p")
def extract_sql_facts(spark: SparkSession, d: str) -> DataFrame:
    name, kind = F.replace("p_name", F.lit(" "), F.lit("_")), F.lower("p_type")
    text = F.concat(F.lit("CREATE TABLE "), kind, F.lit("_"), name, F.lit(" (a int);\n-- FROM nowhere\nCREATE VIEW v_"), name, F.lit(" AS SELECT 'FROM x' FROM "), kind, F.lit("_"), name, F.lit(" JOIN base USING (a);\n"))
    facts = extract.extract(sources(spark, d, "sql", text))
    defs = extract.exploded(facts, "nodes").filter("kind != 'file'").select("file", F.col("kind").alias("what"), "name")
    return defs.unionByName(extract.exploded(facts, "refs").select("file", F.col("relation").alias("what"), "name"))


@query(f"WITH {sql.CODE_NODES}, f AS (SELECT DISTINCT file FROM code_nodes), m AS (SELECT DISTINCT 'src/' || split_part(file, '/', 2) AS dir FROM f WHERE split_part(file, '/', 2) <> 'promo') SELECT dir, 'python' AS language, count(*) AS files FROM m JOIN f ON starts_with(file, dir || '/') GROUP BY dir")
def project_inventory(spark: SparkSession, d: str) -> DataFrame:
    files = views.code_nodes(spark, d).select("file").distinct()
    marks = files.filter("split(file, '/')[1] != 'promo'").select(F.concat(F.regexp_extract("file", "^(src/[^/]+)/", 1), F.lit("/pyproject.toml")).alias("file")).distinct()
    return store.project_inventory(files.unionByName(marks), {"pyproject.toml": "python"})


@query(f"WITH {sql.CODE_NODES}, t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Arc<Box<' || {T} || '>>' WHEN 1 THEN 'Option<' || {T} || '>' WHEN 2 THEN '&mut ' || {T} ELSE {T} || ' | None' END AS w, p_size % 4 AS k, {T} AS t FROM part) SELECT p_partkey, CASE k WHEN 1 THEN 'Option' WHEN 3 THEN t || ',None' ELSE t END AS types FROM t")
def written_types(spark: SparkSession, d: str) -> DataFrame:
    t, k = F.initcap(F.lower("p_type")), F.col("p_size") % 4
    written = F.when(k == 0, F.concat(F.lit("Arc<Box<"), t, F.lit(">>"))).when(k == 1, F.concat(F.lit("Option<"), t, F.lit(">"))).when(k == 2, F.concat(F.lit("&mut "), t)).otherwise(F.concat(t, F.lit(" | None")))
    return views.table(spark, d, "part").select("p_partkey", F.array_join(resolve.written_types(written), ",").alias("types"))


@query(f"WITH {sql.CODE_NODES}, g AS (SELECT DISTINCT file, CASE WHEN suffix(file, 'brand_1.py') THEN 'vendor' WHEN suffix(file, 'brand_2.py') THEN 'nonsense' END AS given FROM code_nodes) SELECT file, CASE WHEN given = 'vendor' THEN 'vendor' ELSE 'production' END AS scope FROM g")
def file_scope_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Stored scopes, and the path's where none or an unknown one is stored."""
    files = views.code_nodes(spark, d).select("file").distinct()
    given = F.when(F.col("file").endswith("brand_1.py"), "vendor").when(F.col("file").endswith("brand_2.py"), "nonsense")
    return files.select("file", F.when(given.isin("vendor", "docs", "production"), given).otherwise(scope_of(F.col("file"))).alias("scope"))
