"""Tables of a graph as versioned Parquet snapshots, and the engine's other sources and sinks."""

from __future__ import annotations

import json
import re
import tomllib
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeweave import schema
from edgeweave.functions.scopes import ignored, scope_of

#: Directories of derived files; fixed values.
DERIVED = ("graphify-out", "memory", ".memory")
# Languages by file ending.
LANGUAGES = {
    "rust": ("rs",), "go": ("go",), "python": ("py",), "typescript": ("ts", "tsx"), "javascript": ("js", "jsx", "mjs", "cjs"), "bash": ("sh", "bash"), "proto": ("proto",),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx", "h"), "c": ("c",), "java": ("java",), "csharp": ("cs",), "sql": ("sql",), "markdown": ("md", "markdown"),
}
RECEIVERS = {"rust": ("self", "Self"), "python": ("self", "cls"), "csharp": ("this", "base"), "typescript": ("this",), "javascript": ("this",), "java": ("this",), "cpp": ("this",)}


def language_table(spark: SparkSession) -> DataFrame:
    """Ext, language, receivers, whether references name files, whether interfaces are implicit."""
    rows = [(e, name, list(RECEIVERS.get(name, ())), name == "markdown", name == "go") for name, ends in LANGUAGES.items() for e in ends]
    return spark.createDataFrame(rows, "ext string, language string, receivers array<string>, file_refs boolean, implicit_interfaces boolean")


def scan(spark: SparkSession, root: str, patterns: Iterable[str] = ()) -> DataFrame:
    """File, len, identity, content, hash, language, scope of a tree's source files, empty ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(re.sub(r"^file:/*", "/", root).rstrip("/"))
    rows = files.select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{base}/", "").alias("file"), F.col("length").alias("len"), F.unix_micros("modificationTime").cast("string").alias("identity"), "content")
    top = F.element_at(F.split("file", "/"), 1)
    rows = rows.filter((F.col("len") > 0) & ~top.isin(*DERIVED) & ~top.startswith("."))
    rules = list(patterns)
    if rules:
        out = F.udf(lambda p: ignored(p, rules), "boolean")
        rows = rows.filter(~out("file"))
    ext = F.substring_index("file", ".", -1)
    named = rows.withColumn("ext", F.lower(ext)).join(F.broadcast(language_table(spark).select("ext", "language")), "ext").drop("ext")
    return named.withColumn("hash", F.sha2("content", 256)).withColumn("scope", scope_of(F.col("file")))


def manifest_roots(files: DataFrame) -> DataFrame:
    """Name, dir, language of the packages that manifests among the files declare; ``files``: file, content."""
    kind = F.substring_index("file", "/", -1)
    text = F.decode("content", "utf-8")
    rows = files.filter(kind.isin("Cargo.toml", "go.mod", "package.json", "pyproject.toml")).withColumn("t", text).withColumn("m", kind)
    name = F.when(F.col("m") == "go.mod", F.regexp_extract("t", r"(?m)^module\s+(\S+)", 1)).when(F.col("m") == "package.json", F.regexp_extract("t", r'"name"\s*:\s*"([^"]+)"', 1)).otherwise(F.regexp_extract("t", r'(?m)^name\s*=\s*"([^"]+)"', 1))
    language = F.when(F.col("m") == "Cargo.toml", "rust").when(F.col("m") == "go.mod", "go").when(F.col("m") == "package.json", "typescript").otherwise("python")
    name = F.when(F.col("m") == "Cargo.toml", F.replace(name, F.lit("-"), F.lit("_"))).otherwise(name)
    folder = F.when(F.instr("file", "/") > 0, F.regexp_extract("file", "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    return rows.select(name.alias("name"), folder.alias("dir"), language.alias("language")).filter("name != ''")


class Store:
    """The tables of one graph; a snapshot is a folder, CURRENT names the valid one, written last.

    A reader keeps the snapshot that it opened, so nothing is locked; a failed write leaves CURRENT as it was (I7, I8).
    """

    TABLES = ("nodes", "edges", "refs", "unresolved", "locals", "fields", "embeds", "trait_impls", "file_stamp", "links")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> str | None:
        """The snapshot's folder; none if there is none or an older version made it; a newer version is an error."""
        try:
            row = self.spark.read.text(f"{self.path}/CURRENT").first()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        version, name = row["value"].split(" ")
        if int(version) > schema.SCHEMA_VERSION:
            raise ValueError(f"the store's version {version} is newer than {schema.SCHEMA_VERSION}")
        return f"{self.path}/{name}" if int(version) == schema.SCHEMA_VERSION else None

    def write(self, **tables: DataFrame) -> str:
        """A new snapshot of the given tables and the others as they are."""
        old, name = self.current(), f"v-{uuid.uuid4().hex}"
        for t, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{self.path}/{name}/{t}")
        for t in self.TABLES:
            if t not in tables and old is not None and (df := self._open(f"{old}/{t}")) is not None:
                df.write.option("compression", "zstd").parquet(f"{self.path}/{name}/{t}")
        stamp = self.spark.createDataFrame([(f"{schema.SCHEMA_VERSION} {name}",)], "value string")
        stamp.coalesce(1).write.mode("overwrite").text(f"{self.path}/CURRENT")
        return name

    def _open(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def read(self, name: str) -> DataFrame:
        where = self.current()
        df = self._open(f"{where}/{name}") if where else None
        if df is None:
            raise KeyError(name)
        return df

    def node(self, ident: str) -> DataFrame:
        return self.read("nodes").filter(F.col("id") == ident)

    def adjacent(self, ids: DataFrame, forward: bool) -> DataFrame:
        """Edges from (or to) each of many ids."""
        end = "src" if forward else "dst"
        return self.read("edges").join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi")

    def file_scopes(self, given: DataFrame | None = None) -> DataFrame:
        """File and scope: the given one where known, else by path."""
        files = self.read("nodes").select("file").distinct()
        if given is None:
            return files.select("file", scope_of(F.col("file")).alias("scope"))
        known = given.filter(F.col("scope").isin(*schema.SCOPES)).select("file", F.col("scope").alias("_s"))
        return files.join(known, "file", "left").select("file", F.coalesce("_s", scope_of(F.col("file"))).alias("scope"))


def check_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The invariants that a graph breaks: rule and n, without a row for those it keeps."""
    external = F.col("file").startswith("dep:")
    bad_nodes = nodes.filter((F.col("id") == "") | (F.col("name") == "") | (F.col("file") == "") | ((F.col("end") <= F.col("start")) & ~external))
    twice = nodes.groupBy("id").count().filter("count > 1")
    ids = nodes.select("id").distinct()
    loose = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(ids, "id", "left_anti")
    loops = edges.filter("src = dst and relation != 'contains'")
    out = None
    for rule, rows in (("invalid node", bad_nodes), ("duplicate id", twice), ("missing endpoint", loose), ("edge to itself", loops)):
        n = rows.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(rule).alias("rule"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def as_json(df: DataFrame) -> DataFrame:
    """S14."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def load_workspace(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Members (name, path) and declared links (src, dst, relation) of a TOML manifest."""
    doc = tomllib.loads(text)
    members = [(k, v if isinstance(v, str) else v["path"]) for k, v in (doc.get("members") or {}).items()]
    links = [(x["from"], x["to"], x.get("relation", "uses")) for x in doc.get("links") or []]
    return spark.createDataFrame(members, "name string, path string"), spark.createDataFrame(links, "src string, dst string, relation string")


def parse_name_status(text: str) -> list[tuple[str, str, str | None]]:
    """(status, file, old file) of NUL-separated name-status output; renames and copies have two names."""
    parts = [p for p in text.split("\0") if p]
    out, i = [], 0
    while i < len(parts):
        letter = parts[i][0]
        if letter in "RC":
            out.append((letter, parts[i + 2], parts[i + 1]))
            i += 3
        else:
            out.append((letter, parts[i + 1], None))
            i += 2
    return out


def parse_porcelain(text: str) -> list[tuple[str, str, bool]]:
    """(status, file, conflict) of short status lines."""
    out = []
    for line in text.splitlines():
        mark, name = line[:2], line[3:].split(" -> ")[-1].strip('"')
        out.append((mark, name, "U" in mark or mark in ("AA", "DD")))
    return out


def parse_hunks(diff: DataFrame) -> DataFrame:
    """File, new_start, new_count, deleted_only of unified diffs; ``diff``: file, text."""
    head = r"(?m)^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    heads = diff.select("file", F.explode(F.regexp_extract_all("text", F.lit(head), F.lit(0))).alias("h"))
    start, count = F.regexp_extract("h", head, 2).cast("long"), F.regexp_extract("h", head, 3)
    n = F.when(count == "", 1).otherwise(count.cast("long"))
    return heads.select("file", start.alias("new_start"), n.cast("long").alias("new_count"), (n == 0).alias("deleted_only"))


def scip_rebase(occurrences: DataFrame, prefix: str) -> DataFrame:
    """Document paths below ``prefix`` unless they are absolute or below it."""
    p = prefix.strip("/")
    there = F.col("file").startswith("/") | (F.col("file") == p) | F.col("file").startswith(f"{p}/")
    return occurrences if not p else occurrences.withColumn("file", F.when(there, F.col("file")).otherwise(F.concat(F.lit(f"{p}/"), F.col("file"))))


def scip_merge(indexes: list[DataFrame]) -> DataFrame:
    """S8."""
    out = indexes[0]
    for df in indexes[1:]:
        out = out.unionByName(df)
    return out


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def _fields(data: bytes):  # noqa: ANN202
    """(number, value) of a protobuf message's fields: numbers or bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def _numbers(value: bytes | int) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = _varint(value, at)
        out.append(n)
    return out


def scip_occurrences(spark: SparkSession, path: str) -> DataFrame:
    """File, moniker, line, column, is_definition of the index files at ``path``, read as protobuf by hand.

    By the format's numbers: documents are field 2 of an index, a document's path 1 and occurrences 2, an occurrence's
    range 1, symbol 2 and roles 3, of which bit 1 marks a definition.
    """

    def rows(content: bytes):  # noqa: ANN202
        for n, doc in _fields(content):
            if n != 2:
                continue
            parts = list(_fields(doc))
            file = next((v.decode() for k, v in parts if k == 1), "")
            for k, occ in parts:
                if k == 2:
                    place, symbol, roles = [], "", 0
                    for j, v in _fields(occ):
                        if j == 1:
                            place += _numbers(v)
                        elif j == 2:
                            symbol = v.decode()
                        elif j == 3:
                            roles = v
                    if len(place) >= 2:
                        yield file, symbol, place[0], place[1], bool(roles & 1)

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            got = [r for c in b["content"] for r in rows(bytes(c))]
            yield pd.DataFrame(got, columns=["file", "moniker", "line", "column", "is_definition"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "file string, moniker string, line int, column int, is_definition boolean")


def project_inventory(files: DataFrame, markers: dict[str, str]) -> DataFrame:
    """Dir, language, n files for each directory with a marker file that says how to index a language below it."""
    table = files.sparkSession.createDataFrame(sorted(markers.items()), "marker string, language string")
    at = files.withColumn("marker", F.substring_index("file", "/", -1)).join(table, "marker")
    dirs = at.select(F.regexp_extract("file", "^(?:(.*)/)?[^/]*$", 1).alias("dir"), "language").distinct()
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    ext = {e: name for name, ends in LANGUAGES.items() for e in ends}
    lang = F.element_at(F.create_map(*[F.lit(x) for kv in ext.items() for x in kv]), F.lower(F.substring_index("file", ".", -1)))
    below = files.select("file", lang.alias("language"), F.explode(above).alias("dir"))
    return dirs.join(below, ["dir", "language"]).groupBy("dir", "language").agg(F.count(F.lit(1)).alias("files"))


def envelope(status: str, payload: dict) -> str:
    """The compact JSON answer of a tool call; whatever carries coverage is partial at best."""
    if status == "complete" and "coverage" in payload:
        status = "partial"
    return json.dumps({"status": status, **payload}, separators=(",", ":"), sort_keys=True)
