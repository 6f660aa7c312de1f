"""Secret scans (operator 3): an incremental ledger of content-addressed blobs, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text.  A ledger holds the (blob, rule, rule_version)
pairs scanned so far and their spans.  A scan anti-joins the wanted pairs with the ledger, scans each unseen blob
once under its missing rules, and joins findings back to all paths that hold the blob.

A span is the whole match, ``kind:start:end`` in code points, end exclusive.  Matches are leftmost and do not
overlap within a rule; one whose checked group is shorter than the rule's minimum is dropped, and what it covered
stays covered.  Positions are running sums over the pieces that ``split`` and ``regexp_extract_all`` give for one
pattern, so that no position is searched for again; the sums go by blocks of BLOCK matches, as a fold that appends to
one long array takes time with its square.

Defined cases: a null text is an empty one; equal texts are one blob, scanned once, and joined back to their rows in
SALTS parts; very long texts are scanned whole; spans that start at one place are listed in the order of the rules;
null ids pass through; repeated rows each get their row; further columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeweave.llm.common import shared_dir, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds, ``group`` is what must have ``least`` characters; bump ``version`` when either changes."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: In the order in which spans that start at one place are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Runs of under 32 characters would be dropped; a run is maximal either way.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

SPAN = "array<struct<start:bigint,rank:int,span:string>>"
#: Matches of one fold.
BLOCK = 128
#: Parts that the rows of one blob are joined in.
SALTS = 8


def spans_of(rule: Rule, rank: int, text: Column) -> Column:
    """The rule's spans in ``text``, in order."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    length = lambda xs: F.transform(xs, lambda x: F.length(x).cast("bigint"))
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole))
    parts = F.arrays_zip(length(gaps).alias("gap"), length(whole).alias("hit"), length(checked).alias("checked"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + p["hit"]
        found = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["checked"] >= rule.least, F.concat(acc["found"], found)).otherwise(acc["found"]).alias("found"))

    def block(xs: Column, i: Column) -> Column:
        return F.aggregate(F.slice(xs, i * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found")), step)

    def walked(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda i: block(xs, i))
        return bound(blocks, shifted)

    def shifted(blocks: Column) -> Column:
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
        starts = F.aggregate(blocks, begin, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
        return F.flatten(F.zip_with(blocks, starts, lambda x, o: F.transform(x["found"], lambda s: named(s["start"] + o, s["end"] + o))))

    def named(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(rule.kind), start.cast("string"), end.cast("string")).alias("span"))

    return F.when(text.rlike(rule.pattern), bound(parts, walked)).otherwise(F.array().cast(SPAN))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def blob_of(name: str = "text") -> Column:
    return F.sha2(text_or_empty(name), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows: blob and, for each rule, spans (null where the pair was in ``ledger`` already).

    ``versions`` has a text per row; ``ledger`` (blob, kind, version, spans) is what earlier scans returned by
    ``ledger_rows``.  Each distinct unseen blob is scanned once.
    """
    blobs = versions.select(blob_of().alias("blob"), text_or_empty().alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        seen = [F.lit(False)] * len(rules)
    else:
        done = ledger.groupBy("blob").agg(*[F.max((F.col("kind") == r.kind) & (F.col("version") == r.version)).alias(f"_seen_{i}") for i, r in enumerate(rules)])
        blobs = blobs.join(done, "blob", "left")
        seen = [F.coalesce(f"_seen_{i}", F.lit(False)) for i in range(len(rules))]
        blobs = blobs.filter(~reduce(lambda a, b: a & b, seen))
    return blobs.select("blob", *[F.when(~s, spans_of(r, i, F.col("text"))).alias(r.kind) for i, (r, s) in enumerate(zip(rules, seen, strict=True))])


def ledger_rows(new: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, version, spans) to append to the ledger, also for blobs without findings."""
    pairs = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(r.kind).alias("spans")) for r in rules])
    return new.select("blob", F.explode(pairs).alias("p")).select("blob", "p.*").filter("spans is not null")


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and one array of spans per rule, from the ledger's rows that have any."""
    current = ledger.filter(F.size("spans") > 0).groupBy("blob")
    return current.agg(*[F.coalesce(F.max(F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.col("spans"))), F.array().cast(SPAN)).alias(r.kind) for r in rules])


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, at: str | None = None) -> DataFrame:
    """One row per document: doc_id, the counts by rule, and the joined spans; see op3.

    Scans what the ledger in the folder ``at`` lacks, appends it, and joins the ledger's findings back.  Without a
    folder the ledger is a new, empty one in the shared folder.
    """
    spark = docs.sparkSession
    at = at or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    empty = spark.range(0).select(F.lit("").alias("blob"), F.lit("").alias("kind"), F.lit(0).alias("version"), F.array().cast(SPAN).alias("spans"))
    empty.write.mode("append").parquet(at)
    ledger_rows(scan(docs, spark.read.parquet(at), rules), rules).write.mode("append").parquet(at)
    hits = findings(docs, spark.read.parquet(at), rules)
    # A blob may be that of a third of all rows, so blobs with findings, which are few, are repeated for parts of the rows.
    paths = docs.select(F.col("doc_id"), blob_of().alias("blob"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    at = paths.join(hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["blob", "salt"], "left")
    every = F.array_sort(F.concat(*[F.coalesce(r.kind, F.array().cast(SPAN)) for r in rules]))
    joined = F.array_join(F.transform(every, lambda s: s["span"]), ",")
    counts = [F.coalesce(F.size(F.col(r.kind)), F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules]
    out = at.select("doc_id", *counts, joined.alias("spans"))
    return out.select("doc_id", *[f"n_{r.kind}" for r in rules], F.sha2("spans", 256).alias("base_sha256"), "spans")
