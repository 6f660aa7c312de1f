"""Graph traversal as frontier joins.

A level joins the frontier with the admitted edges, keeps one row per entered node, and drops what was visited
before.  Each level is written to the shared folder, so the plan of a level never holds the levels before it, and
the loop ends as soon as a level is empty.  Several sources travel together, each with its own visited set.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeweave.functions.scopes import scope_of
from edgeweave.lineage import cut
from edgeweave.schema import EVIDENCE, RELATIONS, qualified

UNBOUNDED = 1 << 30


@dataclass(frozen=True)
class EdgeFilter:
    """Which edges a traversal follows. None admits all; contains is never followed."""

    evidence: frozenset[str] | None = None
    relations: frozenset[str] | None = None
    certain: bool = False
    scopes: frozenset[str] | None = None

    def __post_init__(self) -> None:
        for given, known in ((self.evidence, set(EVIDENCE)), (self.relations, set(RELATIONS) - {"contains"})):
            if given is not None and (bad := set(given) - known):
                raise ValueError(f"not accepted: {sorted(bad)}")

    def admits(self) -> Column:
        ok = F.col("relation") != "contains"
        if self.evidence is not None:
            ok &= F.col("evidence").isin(*sorted(self.evidence)) if self.evidence else F.lit(False)
        if self.relations is not None:
            ok &= F.col("relation").isin(*sorted(self.relations)) if self.relations else F.lit(False)
        if self.certain:
            ok &= F.col("confidence") == "certain"
        return ok


def admitted(edges: DataFrame, by: EdgeFilter, forward: bool, nodes: DataFrame | None = None) -> DataFrame:
    """(at, to, relation, evidence): one row per step a traversal may take; dangling or out-of-scope ends are none."""
    at, to = ("src", "dst") if forward else ("dst", "src")
    steps = edges.filter(by.admits()).select(F.col(at).alias("at"), F.col(to).alias("to"), "relation", "evidence").distinct()
    if nodes is not None:
        ends = nodes
        if by.scopes is not None:
            scope = F.col("scope") if "scope" in nodes.columns else scope_of(F.col("file"))
            ends = nodes.filter(scope.isin(*sorted(by.scopes)))
        steps = steps.join(ends.select(F.col("id").alias("to")), "to", "left_semi").select("at", "to", "relation", "evidence")
    return steps


def reach(steps: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """source, id, depth, parent, relation, evidence of all that the starts (source, id) reach, the starts left out.

    Of several steps into a node on its level the least (parent, relation, evidence) is kept.
    """
    steps = cut(steps)
    frontier = cut(starts.select("source", "id").distinct())
    seen, levels = frontier, []
    for depth in range(1, max_depth + 1):
        entered = frontier.join(steps, frontier["id"] == steps["at"]).groupBy("source", F.col("to").alias("id"))
        entered = entered.agg(F.min(F.struct(F.col("at").alias("parent"), "relation", "evidence")).alias("via"))
        level = entered.join(seen, ["source", "id"], "left_anti").select("source", "id", F.lit(depth).alias("depth"), "via.parent", "via.relation", "via.evidence")
        level = cut(level)
        if level.isEmpty():
            break
        levels.append(level)
        frontier = level.select("source", "id")
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = cut(seen)
    if not levels:
        return level if max_depth else starts.sparkSession.createDataFrame([], "source string, id string, depth int, parent string, relation string, evidence string")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def as_starts(edges: DataFrame, ids: Iterable[str]) -> DataFrame:
    return edges.sparkSession.createDataFrame([(i, i) for i in ids], "source string, id string")


def dependents(edges: DataFrame, ids: Iterable[str], by: EdgeFilter = EdgeFilter(), max_depth: int = 10, nodes: DataFrame | None = None) -> DataFrame:
    """What transitively depends on each id, at its least depth."""
    return reach(admitted(edges, by, False, nodes), as_starts(edges, ids), max_depth)


def seeded(edges: DataFrame, ids: Iterable[str], nodes: DataFrame) -> DataFrame:
    """Starts, and for a start that is a file also what it contains, at depth 0."""
    starts = as_starts(edges, ids)
    files = starts.join(nodes.filter("kind = 'file'").select("id"), "id", "left_semi")
    inside = edges.filter("relation = 'contains'").select(F.col("src").alias("id"), "dst")
    return starts.unionByName(files.join(inside, "id").select("source", F.col("dst").alias("id")))


def dependencies(edges: DataFrame, ids: Iterable[str], by: EdgeFilter = EdgeFilter(), max_depth: int = 10, nodes: DataFrame | None = None) -> DataFrame:
    """What each id transitively depends on; a file also starts from the symbols it contains."""
    starts = as_starts(edges, ids) if nodes is None else seeded(edges, ids, nodes)
    return reach(admitted(edges, by, True, nodes), starts, max_depth)


def shortest_path(edges: DataFrame, start: str, end: str, by: EdgeFilter = EdgeFilter(), nodes: DataFrame | None = None, max_depth: int = UNBOUNDED) -> list[tuple] | None:
    """The steps (src, dst, relation, evidence) of a shortest path; [] from a node to itself; None without one.

    Of equally short paths the one with the least parent at every step, from the end back.  A file's start shows the
    contains step to the symbol that the path leaves from.
    """
    if start == end:
        return []
    steps = cut(admitted(edges, by, True, nodes))
    frontier = cut(as_starts(edges, [start]).select("id") if nodes is None else seeded(edges, [start], nodes).select("id"))
    seen, levels = frontier, []
    if not frontier.filter(F.col("id") == end).isEmpty():
        return [(start, end, "contains", "structural")]
    while len(levels) < max_depth:
        entered = frontier.join(steps, frontier["id"] == steps["at"]).groupBy(F.col("to").alias("id")).agg(F.min(F.struct(F.col("at").alias("parent"), "relation", "evidence")).alias("via"))
        level = cut(entered.join(seen, "id", "left_anti").select("id", "via.*"))
        if level.isEmpty():
            return None
        levels.append(level)
        if not level.filter(F.col("id") == end).isEmpty():
            break
        frontier = level.select("id")
        seen = seen.unionByName(frontier)
        if len(levels) % 8 == 0:
            seen = cut(seen)
    else:
        return None
    path, at = [], end
    for level in reversed(levels):  # one row of each level
        row = level.filter(F.col("id") == at).first()
        path.append((row["parent"], at, row["relation"], row["evidence"]))
        at = row["parent"]
    if at != start:
        path.append((start, at, "contains", "structural"))
    return path[::-1]


def path_table(edges: DataFrame, path: list[tuple] | None) -> DataFrame:
    rows = [(i, *step) for i, step in enumerate(path or [], 1)]
    return edges.sparkSession.createDataFrame(rows, "step int, src string, dst string, relation string, evidence string")


def direct_summary(reached: DataFrame) -> DataFrame:
    """Total, and rows and files at depth 1; ``reached`` has depth and file."""
    return reached.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("depth") == 1).alias("direct"),
        F.countDistinct(F.when(F.col("depth") == 1, F.col("file"))).alias("direct_files"),
    )


def explain_miss(edges: DataFrame, start: str, end: str, by: EdgeFilter = EdgeFilter(), unresolved: DataFrame | None = None) -> DataFrame:
    """Why no path was found: how much the start reaches, what leads to the end, and calls left unresolved on the way."""
    reached = dependencies(edges, [start], by, UNBOUNDED)
    into = edges.filter((F.col("dst") == end) & (F.col("relation") != "contains"))
    counts = into.agg(F.count_if(by.admits()).alias("admitted_into"), F.count_if(~by.admits()).alias("excluded_into"))
    size = reached.agg(F.count(F.lit(1)).alias("forward_reached"))
    out = size.withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k").drop("_k")
    if unresolved is None:
        return out.withColumn("possible_steps", F.lit(0).cast("long"))
    inside = reached.select("id").unionByName(as_starts(edges, [start]).select("id"))
    name = F.element_at(F.split(qualified(F.lit(end)), "::"), -1)
    lost = unresolved.filter(F.col("name") == name).join(inside, F.col("enclosing") == F.col("id"), "left_semi")
    lost = lost.agg(F.count(F.lit(1)).alias("possible_steps"))
    return out.withColumn("_k", F.lit(1)).join(lost.withColumn("_k", F.lit(1)), "_k").drop("_k")


def in_degrees(edges: DataFrame) -> DataFrame:
    """Edges into each id but contains; ids without any are left out."""
    return edges.filter("relation != 'contains'").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def tree_order(reached: DataFrame, max_depth: int) -> DataFrame:
    """The rows with ``line``, their path of ids from the source; ordered by it they read as a tree, parents first."""
    lines = reached.filter("depth = 1").select("*", F.array("source", "id").alias("line"))
    out = lines
    for d in range(2, max_depth + 1):
        up = lines.select("source", F.col("id").alias("parent"), F.col("line").alias("_up"))
        lines = reached.filter(F.col("depth") == d).join(up, ["source", "parent"]).select(*reached.columns, F.concat("_up", F.array("id")).alias("line"))
        out = out.unionByName(lines)
    return out.orderBy("line")


def workspace_steps(edges: DataFrame, links: DataFrame, by: EdgeFilter, forward: bool) -> DataFrame:
    """Steps over (member, id) pairs written member|id; links are followed whatever their confidence."""
    at, to = ("src", "dst") if forward else ("dst", "src")
    key = lambda m, i: F.concat_ws("|", F.col(m), F.col(i))
    inner = edges.filter(by.admits()).select(key("member", at).alias("at"), key("member", to).alias("to"), "relation", "evidence")
    loose = F.lit(True)
    if by.evidence is not None:
        loose &= F.col("evidence").isin(*sorted(by.evidence))
    if by.relations is not None:
        loose &= F.col("relation").isin(*sorted(by.relations))
    outer = links.filter(loose).select(key(f"{at}_member", f"{at}_id").alias("at"), key(f"{to}_member", f"{to}_id").alias("to"), "relation", "evidence")
    return inner.unionByName(outer).distinct()


def workspace_dependents(edges: DataFrame, links: DataFrame, member: str, ident: str, by: EdgeFilter = EdgeFilter(), max_depth: int = 10) -> DataFrame:
    """Member, id, depth, parent of what depends on one member's symbol in all members."""
    start = as_starts(edges, [f"{member}|{ident}"])
    out = reach(workspace_steps(edges, links, by, False), start, max_depth)
    return out.select(F.substring_index("id", "|", 1).alias("member"), F.expr("substring(id, instr(id, '|') + 1)").alias("id"), "depth", "parent", "relation", "evidence")


def workspace_path(edges: DataFrame, links: DataFrame, start: tuple[str, str], end: tuple[str, str], by: EdgeFilter = EdgeFilter()) -> list[tuple] | None:
    """A shortest path over members; no file is seeded."""
    steps = workspace_steps(edges, links, by, True).select(F.col("at").alias("src"), F.col("to").alias("dst"), "relation", "evidence", F.lit("certain").alias("confidence"))
    return shortest_path(steps.filter("relation != 'contains'"), "|".join(start), "|".join(end))
