"""The query verbs over a store of one graph (V1-V13): each returns DataFrames; totals come before limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeweave.functions.scopes import parse_scopes, scope_of
from edgeweave.functions.text import segments
from edgeweave.lineage import cut
from edgeweave.operators import analyze, changes, rank, resolve, search, traverse
from edgeweave.operators.traverse import EdgeFilter
from edgeweave.schema import confidence, qualified
from edgeweave.sources import extract, store

#: Defaults of the verbs; fixed values.
DEPTH, LIMIT, IMPACT_DEPTH = 10, 200, 25


@dataclass
class Answer:
    """``status`` complete, partial, not_found or not_proven, with named tables; ``exit`` 0 found, 1 valid but empty."""

    status: str
    tables: dict[str, DataFrame]

    @property
    def exit(self) -> int:
        return 1 if self.status in ("not_found", "not_proven") else 0


def build(spark: SparkSession, root: str, path: str, patterns: tuple[str, ...] = ()) -> Answer:
    """Scans a tree, extracts files that changed, resolves all references and commits a snapshot; a clean tree writes nothing."""
    db = store.Store(spark, path)
    files = store.scan(spark, root, patterns)
    stamps = files.select("file", "hash", "identity", "len")
    old = db.read("file_stamp") if db.current() else spark.createDataFrame([], "file string, hash string, identity string, len bigint")
    diff = cut(changes.snapshot_diff(old, stamps))
    touched = diff.filter("change != 'same'")
    if db.current() and touched.isEmpty():
        return Answer("complete", {"diff": diff})
    fresh = cut(extract.extract(files.join(diff.filter("change in ('added', 'changed')").select("file"), "file", "left_semi")))
    have = db.current() is not None
    keep = lambda name, new: changes.install(db.read(name), new, touched) if have else new
    nodes = cut(keep("nodes", extract.exploded(fresh, "nodes")))
    refs = keep("refs", extract.exploded(fresh, "refs"))
    locals_ = keep("locals", extract.exploded(fresh, "locals"))
    refs = cut(refs)
    edges, missed = link(nodes, refs, locals_)
    inside = contains(nodes)
    every = analyze.dedupe_edges(edges.unionByName(inside))
    db.write(nodes=nodes, refs=refs, locals=locals_, edges=every, unresolved=missed, file_stamp=stamps)
    return Answer("complete", {"diff": diff, "nodes": db.read("nodes"), "edges": db.read("edges"), "unresolved": db.read("unresolved")})


def contains(nodes: DataFrame) -> DataFrame:
    """Each symbol in the smallest symbol around it, or its file."""
    q = qualified(F.col("id"))
    rows = nodes.filter("kind != 'file'").select("id", "file", q.alias("q"), F.regexp_extract(q, r"^(.*)::", 1).alias("up"), "start")
    up = rows.select("file", F.col("q").alias("up"), F.col("id").alias("parent"), F.col("start").alias("s"))
    best = rows.filter("up != ''").join(up, ["file", "up"]).filter("s <= start").groupBy("id").agg(F.max_by("parent", "s").alias("parent"))
    src = rows.join(best, "id", "left").select(F.coalesce("parent", "file").alias("src"), F.col("id").alias("dst"))
    return src.select("src", "dst", F.lit("contains").alias("relation"), F.lit("structural").alias("evidence"), F.lit("certain").alias("confidence"), F.lit(None).cast("bigint").alias("site_start"), F.lit(None).cast("bigint").alias("site_end"))


def module_of(file: str = "file") -> F.Column:
    """A file's module: its path without ending and index names."""
    parts = F.split(F.regexp_replace(F.col(file), r"\.[A-Za-z0-9]+$", ""), "/")
    return F.filter(parts, lambda s: ~s.isin("", "src", "__init__", "index", "mod", "lib"))


def link(nodes: DataFrame, refs: DataFrame, locals_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and unresolved references of all refs."""
    key = F.sha2(F.concat_ws("\u0001", "file", "relation", "name", F.coalesce("path", F.lit("")), F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce("alias", F.lit(""))), 256)
    nodes = nodes.withColumn("module", module_of())
    owners = nodes.filter(F.col("kind").isin("struct", "enum", "interface", "trait", "typealias", "class")).select("file", qualified(F.col("id")).alias("up"), F.col("id").alias("owner"))
    owners = owners.groupBy("file", "up").agg(F.min("owner").alias("owner"))
    nodes = cut(nodes.withColumn("up", F.regexp_extract(qualified(F.col("id")), r"^(.*)::", 1)).join(owners, ["file", "up"], "left").drop("up"))
    rows = cut(refs.withColumn("ref_id", key).dropDuplicates(["ref_id"]).withColumn("module", module_of()))
    defs = nodes.filter("kind != 'file'").filter(F.instr(qualified(F.col("id")), "::") == 0).select("module", "name", "id")
    modules = nodes.filter("kind = 'file'").select("module", "file")
    up = F.length(F.regexp_extract("name", r"^(\.*)", 1))
    base = F.slice(F.col("module"), F.lit(1), F.greatest(F.size("module") - F.greatest(up, F.lit(1)) + F.when(F.col("file").endswith("__init__.py"), 1).otherwise(0), F.lit(0)))
    own = segments(F.regexp_replace("name", r"\.(rs|go|py|tsx?|jsx?|mjs|cjs|sh|bash|proto|h|hpp|hh|hxx|c|cc|cpp|cxx)$", ""))
    said = rows.filter("relation = 'imports'").withColumn("path", F.filter(F.when(F.col("name").startswith("."), F.concat(base, own)).otherwise(own), lambda s: ~s.isin("*", "crate", "super", "self", "src")))
    said = cut(said.withColumn("is_glob", F.coalesce(F.col("alias") == "*", F.lit(False))))
    imports = said.select("file", F.when(~F.col("is_glob"), F.coalesce(F.col("alias"), F.element_at("path", -1))).alias("binding"), "path")
    plain = rows.filter("relation != 'imports'")
    bare = resolve.bare_references(plain.filter("path is null").select("ref_id", "file", "module", "name", "relation", "start", "enclosing"), nodes, locals_, imports, defs)
    paths = plain.filter("path is not null").withColumn("segments", segments(F.regexp_replace("path", "->", ".")))
    empty = lambda ddl: nodes.sparkSession.createDataFrame([], ddl)
    dotted = resolve.qualified_references(paths.select("ref_id", "file", "module", "name", "relation", "start", "enclosing", "segments"), nodes, locals_, empty("owner string, name string, type_name string"), empty("owner string, target string"), imports, defs)
    imported = resolve.import_references(said.select("ref_id", "name", "path", "is_glob"), modules, defs)
    decided = cut(bare.unionByName(dotted).unionByName(imported))
    shaped = rows.select("ref_id", "file", "name", "path", "relation", "start", "end", "enclosing", "alias")
    return cut(resolve.edges_of(shaped, decided, nodes)), cut(resolve.unresolved_of(shaped, decided))


class Graph:
    """The verbs that read; tables are those of a store or any DataFrames of its schemas."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, unresolved: DataFrame | None = None) -> None:
        self.nodes, self.edges, self.unresolved = nodes, edges, unresolved

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Graph:
        db = store.Store(spark, path)
        return cls(db.read("nodes"), db.read("edges"), db.read("unresolved"))

    def _lost(self, name: str) -> int:
        """Unresolved references that may mean the name."""
        return 0 if self.unresolved is None else self.unresolved.filter(F.element_at(F.split("name", r"::|[/.]"), -1) == name).count()

    def _reached(self, rows: DataFrame, limit: int, symbol: str) -> Answer:
        rows = cut(rows.join(self.nodes.select("id", "kind", "name", "file"), "id", "left"))
        lost = self._lost(symbol.rpartition("#")[2].rpartition("@")[0].rpartition("::")[2] or symbol)
        tables = {
            "summary": traverse.direct_summary(rows), "by_file": analyze.by_file(rows), "coverage": analyze.evidence_counts(rows, lost), "rows": rows.orderBy("depth", "id").limit(limit),
        }
        return Answer("not_proven" if rows.isEmpty() else "partial", tables)

    def affected(self, symbol: str, by: EdgeFilter = EdgeFilter(), depth: int = DEPTH, limit: int = LIMIT) -> Answer:
        """V4."""
        ident = search.unique_symbol(self.nodes, symbol)
        return self._reached(traverse.dependents(self.edges, [ident], by, depth, self.nodes), limit, ident)

    def deps(self, symbol: str, by: EdgeFilter = EdgeFilter(), depth: int = DEPTH, limit: int = LIMIT) -> Answer:
        """V5."""
        ident = search.unique_symbol(self.nodes, symbol)
        out = self._reached(traverse.dependencies(self.edges, [ident], by, depth, self.nodes), limit, ident)
        if self.unresolved is not None:
            out.tables["unresolved"] = self.unresolved.filter(F.col("enclosing") == ident)
        return out

    def path(self, start: str, end: str, by: EdgeFilter = EdgeFilter()) -> Answer:
        """V6."""
        a, b = search.unique_symbol(self.nodes, start), search.unique_symbol(self.nodes, end)
        found = traverse.shortest_path(self.edges, a, b, by, self.nodes)
        if found is None:
            return Answer("not_proven", {"miss": traverse.explain_miss(self.edges, a, b, by, self.unresolved)})
        return Answer("complete", {"steps": traverse.path_table(self.edges, found)})

    def query(self, text: str) -> Answer:
        """V3."""
        rows = search.find_symbol(self.nodes, text)
        return Answer("not_found" if rows.isEmpty() else "complete", {"symbols": rows})

    def show(self, symbol: str) -> Answer:
        """V2."""
        ident = search.unique_symbol(self.nodes, symbol)
        return Answer("complete", {"symbol": self.nodes.filter(F.col("id") == ident), "card": analyze.show_card(self.edges, ident), "used_by": analyze.used_by(self.edges, self.nodes, ident)})

    def ask(self, question: str, scopes: str | None = None, limit: int = 10) -> Answer:
        """V1."""
        wanted = parse_scopes(scopes)
        hits = cut(rank.ask(self.nodes.filter(scope_of(F.col("file")).isin(*sorted(wanted))), self.edges, question))
        n = hits.select("topic_no").distinct().count()
        shares = F.create_map(*[F.lit(x) for i, k in enumerate(rank.budget(limit, n)) for x in (i, k)]) if n else None
        rows = hits if shares is None else hits.filter(F.col("rank") <= F.coalesce(F.element_at(shares, F.col("topic_no")), F.lit(limit)))
        terms = hits.select("topic").first()
        first = hits.filter("topic_no = 0")
        return Answer("not_found" if terms is None else "partial", {"hits": rows, "confidence": rank.assess(first, len(terms["topic"].split()) if terms else 1)})

    def unresolved_list(self, limit: int = LIMIT) -> Answer:
        """V7."""
        rows = cut(analyze.categorize(self.unresolved, self.nodes))
        return Answer("partial" if rows.isEmpty() else "complete", {"by_category": rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "rows": analyze.unresolved_listing(rows, limit)})

    def impact(self, hunks: DataFrame, by: EdgeFilter = EdgeFilter(), depth: int = IMPACT_DEPTH) -> Answer:
        """V8: ``hunks``: file, start, end (bytes), whole."""
        changed = cut(analyze.hunk_symbols(self.nodes, hunks))
        radius = analyze.impact_radius(self.edges, changed.select("id"), by, depth)
        tests = analyze.impacted_tests(self.nodes, radius.select("id").unionByName(changed.select("id")))
        return Answer("partial", {"changed": changed, "radius": radius, "tests": tests})

    def overlap(self, hunks: DataFrame, by: EdgeFilter = EdgeFilter(), depth: int = IMPACT_DEPTH) -> Answer:
        """V9: ``hunks`` as for impact, with change."""
        symbols = hunks.select("change", "file").distinct()
        touched = None
        for row in hunks.select("change").distinct().collect():  # one row a change that the caller names
            t = analyze.hunk_symbols(self.nodes, hunks.filter(F.col("change") == row["change"]).drop("change")).select(F.lit(row["change"]).alias("change"), "id")
            touched = t if touched is None else touched.unionByName(t)
        touched = cut(touched)
        steps = traverse.admitted(self.edges, by, False)
        radius = traverse.reach(steps, touched.select(F.col("change").alias("source"), "id"), depth).select(F.col("source").alias("change"), "id")
        return Answer("complete", {"pairs": analyze.overlaps(touched, radius, symbols)})

    def map(self, scopes: str | None = None) -> Answer:
        """V10."""
        scoped = self.nodes.filter(scope_of(F.col("file")).isin(*sorted(parse_scopes(scopes))))
        return Answer("complete", {"modules": analyze.module_tree(scoped), "hubs": analyze.hubs(scoped, self.edges), "docs": analyze.doc_entries(scoped), "totals": analyze.totals(self.nodes, self.edges, scoped)})


def workspace(members: dict[str, Graph], declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All members' edges (with member) and the links between them: by path from unresolved references, and declared ones."""
    edges = refs = defs = None
    for name, g in sorted(members.items()):
        e = g.edges.select(F.lit(name).alias("member"), "src", "dst", "relation", "evidence", "confidence")
        d = g.nodes.filter("kind != 'file'").select(F.lit(name).alias("member"), "id", module_of().alias("module"), "name")
        edges, defs = (e, d) if edges is None else (edges.unionByName(e), defs.unionByName(d))
        if g.unresolved is not None:
            u = g.unresolved.select(F.lit(name).alias("member"), "ref_id", F.coalesce("enclosing", "file").alias("src_id"), "relation", segments(F.coalesce("path", "name")).alias("path"))
            refs = u if refs is None else refs.unionByName(u)
    links = resolve.boundary_links(refs, defs)
    if declared is not None:
        links = links.unionByName(declared.select("src_member", "src_id", "dst_member", "dst_id", "relation", F.lit("declared").alias("evidence"), confidence(F.lit("declared")).alias("confidence"), F.lit("declared").alias("via")))
    return edges, links
