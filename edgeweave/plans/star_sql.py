"""DuckDB SQL of the views and of the catalogue's traversal queries."""

FILE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'src/core/orders.rs' WHEN '2-HIGH' THEN 'tests/orders.rs' WHEN '3-MEDIUM' THEN 'examples/orders.rs'
  WHEN '5-LOW' THEN 'vendor/orders.rs' ELSE 'docs/orders.md' END"""

NODES = f"""nodes AS (
  SELECT 'r' || r_regionkey AS id, 'module' AS kind, r_name AS name, 'geo/regions.py' AS file FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'file', n_name, 'geo/' || lower(n_name) || '.py' FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'struct', c_name, 'crm/' || lower(c_mktsegment) || '.py' FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'class', s_name, 'supply/n' || s_nationkey || '.go' FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'function', p_name, 'src/' || lower(p_type) || '/' || lower(p_brand) || '.py' FROM part
  UNION ALL SELECT 'o' || o_orderkey, 'method', o_orderstatus, {FILE} FROM orders)"""

EDGES = """edges AS (
  SELECT *, CASE WHEN evidence IN ('structural', 'scip', 'declared') THEN 'certain' ELSE 'inferred' END AS confidence FROM (
  SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'uses' AS relation, 'scope' AS evidence FROM orders
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'calls', CASE l_returnflag WHEN 'N' THEN 'scope' WHEN 'R' THEN 'import' ELSE 'scip' END FROM lineitem
  UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'uses', 'import' FROM lineitem
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'contains', 'structural' FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains', 'structural' FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'contains', 'structural' FROM supplier))"""

DEEP = """edges AS (SELECT CAST(p_partkey AS VARCHAR) AS src, CAST((p_partkey * 31 + k * 977) % (SELECT count(*) FROM part) AS VARCHAR) AS dst,
  'calls' AS relation, 'scope' AS evidence, 'inferred' AS confidence FROM part, (SELECT unnest([1, 2, 3]) AS k))"""


def reach(graph: str, starts: str, depth: int, forward: bool = False, where: str = "true", ends: str = "true") -> str:
    """CTEs up to ``best`` (source, id, depth): the least depth of each reached id that is no start."""
    at, to = ("src", "dst") if forward else ("dst", "src")
    return f"""WITH RECURSIVE {graph},
steps AS (SELECT DISTINCT {at} AS a, {to} AS b FROM edges WHERE relation <> 'contains' AND {where} AND {ends}),
starts AS ({starts}),
r(source, id, depth) AS (SELECT source, id, 0 FROM starts UNION SELECT r.source, s.b, r.depth + 1 FROM r JOIN steps s ON s.a = r.id WHERE r.depth < {depth}),
best AS (SELECT source, id, min(depth) AS depth FROM r WHERE (source, id) NOT IN (SELECT source, id FROM starts) GROUP BY source, id)"""


def start(*ids: str) -> str:
    return " UNION ALL ".join(f"SELECT '{i}' AS source, '{i}' AS id" for i in ids)


SCOPE = """CASE WHEN starts_with(file, 'dep:') OR len(list_intersect(parts, ['vendor', 'vendored', 'third_party', 'third-party', 'node_modules'])) > 0 THEN 'vendor'
  WHEN len(list_intersect(parts, ['generated', 'autogen', 'auto-generated', 'generated-src'])) > 0 OR contains(base, '.generated.') OR contains(base, '_generated.')
    OR suffix(base, '.g.rs') OR suffix(base, '.pb.go') OR suffix(base, '.designer.cs') THEN 'generated'
  WHEN len(list_intersect(parts, ['fixture', 'fixtures', 'golden', 'testdata', 'test-data', 'snapshot', 'snapshots', '__snapshots__'])) > 0 THEN 'fixture'
  WHEN len(list_intersect(parts, ['example', 'examples', 'sample', 'samples', 'demo', 'demos'])) > 0 THEN 'example'
  WHEN len(list_intersect(parts, ['test', 'tests', 'spec', 'specs'])) > 0 OR starts_with(base, 'test_') OR contains(base, '_test.') OR contains(base, '.test.')
    OR contains(base, '_spec.') OR contains(base, '.spec.') THEN 'test'
  WHEN parts[1] IN ('docs', 'doc', 'documentation') OR base IN ('readme', 'readme.md', 'readme.mdx', 'changelog.md', 'contributing.md', 'architecture.md')
    OR suffix(base, '.md') OR suffix(base, '.mdx') OR suffix(base, '.rst') OR suffix(base, '.adoc') OR suffix(base, '.asciidoc') THEN 'docs'
  ELSE 'production' END"""


def scoped(files: str) -> str:
    """A subquery of ``files`` (a query with file) with scope."""
    return f"(SELECT *, {SCOPE} AS scope FROM (SELECT *, parts[-1] AS base FROM (SELECT *, string_split(lower(replace(file, chr(92), '/')), '/') AS parts FROM ({files}))))"


CODE_NODES = """code_nodes AS (SELECT file || '#' || t || '::' || name || '@' || (part * 100) AS id, kind, name, file, part * 100 AS start, part * 100 + 10 + p_size AS end_, signature, doc, part FROM (
  SELECT p_partkey AS part, p_size, 'src/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '_') || '.py' AS file,
    upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS t,
    list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', '') AS name,
    ['function', 'struct', 'method', 'class', 'trait'][p_size % 5 + 1] AS kind, 'fn ' || lower(p_type) || ' ' || p_name AS signature, text AS doc
  FROM part LEFT JOIN documents ON doc_id = p_partkey))"""

CODE_EDGES = """code_edges AS (SELECT a.id AS src, b.id AS dst, relation FROM (
  SELECT DISTINCT l_partkey AS x, (l_suppkey * 7 + l_linenumber) % (SELECT count(*) FROM part) AS y, CASE l_returnflag WHEN 'R' THEN 'contains' ELSE 'calls' END AS relation FROM lineitem)
  JOIN code_nodes a ON a.part = x JOIN code_nodes b ON b.part = y)"""

CODE_REFS = """code_refs AS (SELECT DISTINCT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || strftime(l_shipdate, '%Y%m%d') || '-' || l_quantity AS ref_id,
  h.file, h.module, t.name, CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_linenumber % 2 = 0 THEN [t.b, t.name] ELSE ['shop', t.t, t.b, t.name] END END AS path,
  CASE l_returnflag WHEN 'N' THEN 'calls' ELSE 'uses' END AS relation, l_orderkey % 5000 AS start, l_orderkey % 5000 + length(t.name) AS end_
  FROM lineitem JOIN (SELECT part, name, split_part(file, '/', 2) AS t, replace(split_part(file, '/', 3), '.py', '') AS b FROM code_nodes) t ON t.part = l_partkey
  JOIN (SELECT part, file, split_part(file, '/', 2) AS module FROM code_nodes) h ON h.part = (l_suppkey * 11 + l_linenumber) % (SELECT count(*) FROM part))"""
