"""Incremental maintenance over per-file tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """File and change (added, changed, removed, same) of two (file, hash) tables."""
    both = stored.select("file", F.col("hash").alias("old")).join(current.select("file", F.col("hash").alias("new")), "file", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return both.select("file", change.alias("change"))


def within(files: DataFrame, paths: list[str]) -> DataFrame:
    """Only the files that are one of the paths or below one."""
    ok = [(F.col("file") == p) | F.col("file").startswith(p.rstrip("/") + "/") for p in paths]
    return files.filter(reduce(lambda a, b: a | b, ok, F.lit(False)))


def reuse_hashes(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """File, len, identity and hash, known without reading where identity and length are as stored and the file is not empty."""
    s = stored.select("file", F.col("len").alias("_len"), F.col("identity").alias("_identity"), F.col("hash").alias("_hash"))
    same = (F.col("len") == F.col("_len")) & (F.col("identity") == F.col("_identity")) & (F.col("len") > 0)
    return listing.filter("len > 0").join(s, "file", "left").select("file", "len", "identity", F.when(same, F.col("_hash")).alias("hash"))


def install(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """``old`` without the rows of touched files, and ``new``'s rows of them."""
    keep = old.join(touched.select("file").distinct(), "file", "left_anti")
    return keep.unionByName(new.join(touched.select("file").distinct(), "file", "left_semi"))


def install_edges(old: DataFrame, new: DataFrame, old_nodes: DataFrame, touched: DataFrame) -> DataFrame:
    """Edges from or to a symbol of a touched file go; ``new`` edges come."""
    gone = old_nodes.join(touched.select("file").distinct(), "file", "left_semi").select("id")
    keep = old.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return keep.select(*old.columns).unionByName(new.select(*old.columns))


def changed_names(old_nodes: DataFrame, new_nodes: DataFrame, touched: DataFrame) -> DataFrame:
    """Names defined in touched files before or after."""
    t = touched.select("file").distinct()
    return old_nodes.join(t, "file", "left_semi").select("name").unionByName(new_nodes.join(t, "file", "left_semi").select("name")).distinct()


def dependent_files(edges: DataFrame, nodes: DataFrame, touched: DataFrame) -> DataFrame:
    """Files with an edge into a touched file, but for touched ones."""
    where = nodes.select("id", "file")
    into = where.join(touched.select("file").distinct(), "file", "left_semi").select(F.col("id").alias("dst"))
    src = edges.filter("relation != 'contains'").join(into, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return src.join(where, "id").select("file").distinct().join(touched.select("file").distinct(), "file", "left_anti")


def affected_files(refs: DataFrame, names: DataFrame, dependents: DataFrame, diff: DataFrame) -> DataFrame:
    """I4: files to resolve again: those that refer to a changed name, dependents, and changed ones; not removed ones."""
    by_name = refs.join(names, "name", "left_semi").select("file")
    changed = diff.filter("change in ('added', 'changed')").select("file")
    every = by_name.unionByName(dependents.select("file")).unionByName(changed).distinct()
    return every.join(diff.filter("change = 'removed'").select("file"), "file", "left_anti")


def needs_full_pass(old: DataFrame, new: DataFrame) -> bool:
    """Whether any input fingerprint (kind, value) differs."""
    both = old.select("kind", F.col("value").alias("o")).join(new.select("kind", F.col("value").alias("n")), "kind", "full_outer")
    return not both.filter(~F.col("o").eqNullSafe(F.col("n"))).isEmpty()


def dispatch_lookahead(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Files that dynamic edges of the given files lead to."""
    where = nodes.select("id", "file")
    src = where.join(files.select("file").distinct(), "file", "left_semi").select(F.col("id").alias("src"))
    dst = edges.filter("evidence = 'dynamic'").join(src, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return dst.join(where, "id").select("file").distinct()


def snapshot_token(tables: dict[str, DataFrame], buckets: int = 256) -> DataFrame:
    """One row, token: a digest of (name, key, value) rows that no order of rows changes.

    Rows are hashed in buckets and the buckets' digests in order, so no task holds all rows.
    """
    rows = None
    for name, df in sorted(tables.items()):
        k, v = df.columns[:2]
        part = df.select(F.sha2(F.concat_ws("\u0001", F.lit(name), F.col(k).cast("string"), F.col(v).cast("string")), 256).alias("h"))
        rows = part if rows is None else rows.unionByName(part)
    parts = rows.groupBy(F.conv(F.substring("h", 1, 4), 16, 10).cast("int").alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ","), 256).alias("token"))


def merge_health(stored: DataFrame, touched: DataFrame, errors: DataFrame) -> DataFrame:
    """(file, error): touched files' old errors go, new ones come."""
    return stored.join(touched.select("file").distinct(), "file", "left_anti").unionByName(errors.select("file", "error"))


def merge_dependencies(stored: DataFrame, fresh: DataFrame, full: bool) -> DataFrame:
    """Nodes of external packages: a full pass replaces them, a partial one adds what is new."""
    if full:
        return fresh.dropDuplicates(["id"])
    return stored.unionByName(fresh.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti").select(*stored.columns))


def stale_members(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Members whose fingerprint (member, token) is not the stored one, or that have none."""
    now = current.select("member", F.col("token").alias("_now"))
    return now.join(stored.select("member", "token"), "member", "left").filter(~F.col("_now").eqNullSafe(F.col("token"))).select("member")


class StaleSnapshot(RuntimeError):
    """The caller's token is not the current one; asking again is fine."""


def ensure_snapshot(expected: str | None, tables: dict[str, DataFrame]) -> str:
    token = snapshot_token(tables).first()["token"]
    if expected is not None and expected != token:
        raise StaleSnapshot(f"stale_snapshot: {token}")
    return token


class Freshness:
    """Builds once per dirty generation; a failed build stays dirty."""

    def __init__(self) -> None:
        self.dirty = True

    def mark(self) -> None:
        self.dirty = True

    def sync(self, build) -> bool:  # noqa: ANN001
        if not self.dirty:
            return False
        self.dirty = False
        try:
            build()
        except Exception:
            self.dirty = True
            raise
        return True


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)
