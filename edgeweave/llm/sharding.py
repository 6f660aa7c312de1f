"""Sharding (operator 6) by balanced label propagation.

Documents that share a hub (by default: an equal text) are linked.  Labels start as a hash shard.  In each round
every hub's documents that lie in one shard ask, as a piece, to move to the shard with room that holds most of the
hub's other documents; requests are granted by Spark joins up to each shard's quota.  Pieces, at most one per hub
and first shard, are counted before any shuffle, so a hub of any size is a few rows.  At the end every shard holds
its quota of rows exactly: linked rows first, then unlinked ones, and what is over a quota fills the free slots.

The law is ``rows``: counts of any two shards differ by one at most.

Defined cases: a null text has size 8 and is a text like others (all null texts are linked, and so are all empty
ones); null and repeated ids pass through, equal rows are interchangeable; ties go to the lowest shard; of texts, also
very long ones, only hash and size are kept; an empty table gives an empty result; columns of any name pass through,
new ones that clash get an underscore in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeweave.llm.common import cut, fresh

#: Requests to one shard are granted by whole buckets of hubs; that many of them.
GRANTS = 512
#: Rows that one task numbers, about.
ROWS_PER_BUCKET = 100_000


def equal_text(name: str = "text") -> Column:
    """The hub of a row: what its text is."""
    return F.md5(F.concat(F.when(F.col(name).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(name), F.lit(""))))


def propagate(pieces: DataFrame, quotas: list[int], rounds: int) -> DataFrame:
    """(hub, origin, shard): where the documents of a hub that began in ``origin`` end.

    ``pieces`` has (hub, origin, n).  A piece asks for the shard, among those with room, that holds most of its hub
    (the lowest on ties); it moves only if that shard holds more of the hub than its own, or as much and is lower or its own is full.  Where no
    shard of the hub has room, pieces in a shard over its quota ask for one that the hub's hash picks.
    """
    spark = pieces.sparkSession
    placed = place_large(pieces, quotas)
    begin = pieces.join(placed, ["hub", "origin"], "left").withColumn("shard", F.coalesce("shard", "origin"))
    state = cut(begin.select("hub", "origin", "shard", "n"))
    for _ in range(rounds):
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [max(0, q - load.get(s, 0)) for s, q in enumerate(quotas)]
        rooms = F.array(*[F.lit(r).cast("long") for r in room])
        held = state.groupBy("hub", "shard").agg(F.sum("n").alias("held"))
        best = held.filter(F.get(rooms, F.col("shard")) > 0).groupBy("hub").agg(F.max(F.struct("held", (-F.col("shard")).alias("low"))).alias("best"))
        full = F.get(rooms, F.col("shard")) == 0
        crowded = F.array(*[F.lit(load.get(s, 0) > q) for s, q in enumerate(quotas)])
        free = [s for s, r in enumerate(room) if r] or [0]
        other = F.get(F.array(*[F.lit(s) for s in free]), F.pmod(F.xxhash64("hub"), F.lit(len(free))).cast("int"))
        wants = held.join(best, "hub", "left").select("hub", "shard", "held", F.coalesce(-F.col("best.low"), other).alias("to"), F.coalesce("best.held", F.lit(0)).alias("there"))
        better = (F.col("there") > F.col("held")) | ((F.col("there") == F.col("held")) & ((F.col("to") < F.col("shard")) | full))
        wants = wants.filter((F.col("to") != F.col("shard")) & (better | ((F.col("there") == 0) & F.get(crowded, F.col("shard")))))
        dealt = wants.withColumn("grant", F.pmod(F.xxhash64("hub", "shard"), F.lit(GRANTS)).cast("int"))
        sums = dealt.groupBy("to", "grant").agg(F.sum("held").alias("n")).collect()  # at most shards x GRANTS rows
        granted, left = [], room[:]
        for r in sorted(sums, key=lambda r: (r["to"], r["grant"])):
            if r["n"] <= left[r["to"]]:
                left[r["to"]] -= r["n"]
                granted.append((r["to"], r["grant"]))
        if not granted:
            break
        yes = spark.createDataFrame(granted, "to int, grant int")
        moves = dealt.join(yes, ["to", "grant"], "left_semi").select("hub", "shard", "to")
        state = cut(state.join(moves, ["hub", "shard"], "left").select("hub", "origin", F.coalesce("to", "shard").alias("shard"), "n"))
    return state.select("hub", "origin", "shard")


def place_large(pieces: DataFrame, quotas: list[int]) -> DataFrame:
    """(hub, origin, shard) of the pieces of hubs that no shard can hold whole: they fill shard after shard.

    Together these hubs have no more rows than all quotas, so there are at most as many as shards.
    """
    least = max(1, min(quotas))
    large = pieces.groupBy("hub").agg(F.sum("n").alias("all")).filter(F.col("all") > least).select("hub")
    rows = pieces.join(large, "hub", "left_semi").collect()  # at most shards x shards
    room, at, out = list(quotas), 0, []
    for hub in sorted({r["hub"] for r in rows}):
        for r in sorted((r for r in rows if r["hub"] == hub), key=lambda r: (-r["n"], r["origin"])):
            to = next((s for s in [*range(at, len(room)), *range(at)] if room[s] >= r["n"]), None)
            if to is not None:
                room[to] -= r["n"]
                out.append((hub, r["origin"], to))
        at = (max((s for h, _, s in out if h == hub), default=at) + 1) % len(room)
    return pieces.sparkSession.createDataFrame(out, "hub string, origin int, shard int")


def assign_shards(docs: DataFrame, n_shards: int = 24, hub: Column | None = None, rounds: int = 6) -> DataFrame:
    """``docs`` with shard (0 to n_shards - 1) and slot (from 0, gapless in each shard).

    All is decided on counts by (hub, origin, bucket); the documents themselves are shuffled once, by these.
    """
    h, origin, bucket, ident, within, shard, slot = fresh(docs, "_hub", "_origin", "_bucket", "_id", "_within", "shard", "slot")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")) if "doc_id" in docs.columns else F.col(h)
    base = docs.withColumn(h, equal_text() if hub is None else hub)
    base = base.withColumn(ident, F.xxhash64(key, F.col(h)))
    base = base.withColumn(origin, F.pmod(F.col(ident), F.lit(n_shards)).cast("int"))
    # A bucket holds about ROWS_PER_BUCKET rows of the largest hub that there can be.
    whole = cut(base.groupBy(F.col(h).alias("hub"), F.col(origin).alias("origin")).agg(F.count(F.lit(1)).alias("n")))
    total, most = whole.agg(F.sum("n"), F.max("n")).first()
    buckets = (most or 0) // ROWS_PER_BUCKET + 1
    base = base.withColumn(bucket, F.pmod(F.xxhash64(F.lit("bucket"), ident), F.lit(buckets)).cast("int"))
    parts = whole.withColumn("bucket", F.lit(0))
    if buckets > 1:
        parts = cut(base.groupBy(F.col(h).alias("hub"), F.col(origin).alias("origin"), F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    quotas = [(total or 0) // n_shards + (s < (total or 0) % n_shards) for s in range(n_shards)]
    linked = whole.groupBy("hub").agg(F.sum("n").alias("all")).filter("all > 1").select("hub")
    placed = propagate(whole.join(linked, "hub", "left_semi"), quotas, rounds)
    found = parts.join(placed, ["hub", "origin"], "left")
    found = found.select("hub", "origin", "bucket", "n", F.coalesce("shard", "origin").alias("at"), F.col("shard").isNull().alias("alone"))
    found = cut(places(cut(found), quotas))
    same = [F.col(f"l.{x}") == F.col(f"r.{y}") for x, y in ((h, "hub"), (origin, "origin"), (bucket, "bucket"))]
    ranked = base.withColumn(within, F.row_number().over(Window.partitionBy(h, origin, bucket).orderBy(ident)) - 1)
    joined = ranked.alias("l").join(found.alias("r"), same)
    to, at = destination(F.col("r.at"), F.col("r.place") + F.col(f"l.{within}"), found, quotas)
    return joined.select(*[F.col(f"l.{c}") for c in docs.columns], to.alias(shard), at.alias(slot))


def places(parts: DataFrame, quotas: list[int]) -> DataFrame:
    """``parts`` (hub, origin, bucket, n, at, alone) with place: how many rows of their shard come before; linked rows come first."""
    deals = max(8, sum(quotas) // ROWS_PER_BUCKET)
    dealt = parts.withColumn("deal", F.pmod(F.xxhash64("hub", "origin", "bucket"), F.lit(deals)).cast("int"))
    upto = lambda *by: Window.partitionBy(*by[0]).orderBy(*by[1]).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("at", "alone", "deal").agg(F.sum("n").alias("m"))  # shards x 2 x deals rows
    counts = counts.select("at", "alone", "deal", F.coalesce(F.sum("m").over(upto(["at"], ["alone", "deal"])), F.lit(0)).alias("first"))
    before = F.coalesce(F.sum("n").over(upto(["at", "alone", "deal"], ["hub", "origin", "bucket"])), F.lit(0))
    numbered = dealt.withColumn("before", before).join(counts, ["at", "alone", "deal"])
    return numbered.select("hub", "origin", "bucket", "at", "n", (F.col("first") + F.col("before")).alias("place"))


def destination(at: Column, place: Column, parts: DataFrame, quotas: list[int]) -> tuple[Column, Column]:
    """Shard and slot: the first rows of a shard, up to its quota, keep it; the others fill the free slots in order."""
    k = len(quotas)
    sizes = {r["at"]: r["n"] for r in parts.groupBy("at").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    n_all = [sizes.get(s, 0) for s in range(k)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    of = lambda xs: F.get(longs(xs), at)
    over = [max(0, n - q) for n, q in zip(n_all, quotas, strict=True)]
    free = [max(0, q - n) for n, q in zip(n_all, quotas, strict=True)]
    over_before = [sum(over[:s]) for s in range(k)]
    free_to = [sum(free[: s + 1]) for s in range(k)]
    moved = place - of(quotas) + of(over_before)  # the how manyth of all rows that must move
    to = F.size(F.filter(longs(free_to), lambda end: end <= moved))
    new_slot = F.get(longs(n_all), to) + moved - F.get(longs([e - f for e, f in zip(free_to, free, strict=True)]), to)
    stays = place < of(quotas)
    return F.when(stays, at).otherwise(to).cast("int"), F.when(stays, place).otherwise(new_slot).cast("long")


def shard_table(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """One row per document with its place; see op6."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), equal_text().alias("text_md5"))
    out = assign_shards(narrow, n_shards, F.col("text_md5"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
