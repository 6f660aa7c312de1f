"""N-gram Jaccard join (operator 10) by parity sketches.

A document is the set of its distinct k-word shingles, as 64-bit hashes.  Equal sets are one class.  For sets whose
Jaccard similarity reaches t / 100, the smaller with a members, the symmetric difference has at most
a * (100 - t) / t members.  Sizes are cut into bands; a size band whose smaller sets have at most ``a`` members
allows d = floor(a * (100 - t) / t) differing shingles, and deals the shingles by hash to more than d words:

* a word's XOR of the 64-bit hashes that fall into it is its key; of d + 1 words that hold shingles, d differing
  shingles leave one untouched (pigeonhole), so linked sets share a key;
* in a sketch of bits each shingle's hash flips one bit, so the Hamming distance of two sketches is at most the
  symmetric difference.

A class gives the keys of its own size band, and those of the band below where its size can still meet a set of that
band.  Classes that share a key are compared in three steps, none of which writes all pairs of a group:

1. star: each class against the key's centre, the class that shares most keys with others;
2. rest: only where a key's other classes still lie in different components, pairs of different components whose
   sketches allow a link (tested inside the join, so that other pairs are never rows);
3. every pair from 1 and 2 whose sizes and sketches allow a link is verified on the sets themselves, in integers.

Of large sets a short sketch says nothing, as half its bits are set by chance.  They have a wide one as well, of about as
many bits as members, which pairs from 1 and 2 must pass before their sets are read; the wider one of two is folded.

Components come from star rounds over the verified links.  No link between different texts is lost; classes stand
for their copies.  Sets of all documents are never stored: sketches choose the pairs, and only for these the texts
are read again.

Defined cases: a null text or one without words has n_shingles 0, is its own component and linked with nothing;
fewer than k words make one shingle of the whole sequence; every row is a document of its own, also where rows repeat
a doc_id with equal or other texts, and gets a row; a null doc_id is larger than any other, so a group of such rows
alone has a null component; ties (a key's classes with equal support) go to the class numbered first, which changes no
component; very long texts are hashed in pieces; further columns are ignored, or passed through by ``one_of_each``,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeweave.llm.common import bounded, cut, delete, forget, fresh, release, shared_dir, slices, text_or_empty
from edgeweave.llm.graph import components
from edgeweave.llm.hashing import ODD, fingerprint, mixed, shingles, word_hashes

#: A size band reaches to so many times its least size.
WIDTH = 1.5
#: Parts of the key space that are shuffled one after the other.
PASSES = 8
#: Words of 64 bits in the sketch that pairs are tested by before their sets are.
SKETCH = 32
#: Sets that a task remembers to have given, and bits of the filter that spares texts a join.
GIVEN = 1 << 20
FILTER = 1 << 24


def size_bands(largest: int) -> list[int]:
    """The least size of each band, up to one that holds ``largest``."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * WIDTH)))
    return out


def allowed(limit: int, threshold: int) -> int:
    """The largest symmetric difference of linked sets of which the smaller has at most ``limit`` members."""
    return limit * (100 - threshold) // threshold


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """The parity sketch: word (h >> 6) mod words has bit h mod 64 flipped, for every h."""
    cells = ((hashes >> np.uint64(6)) % np.uint64(words)) * np.uint64(64) + (hashes & np.uint64(63))
    odd = np.bincount(cells.astype(np.int64), minlength=words * 64).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def wide_words(n: int) -> int:
    """Words of the wide sketch of n members: a power of two, with n to 2 n bits, and SKETCH at least."""
    return max(SKETCH, 1 << max(0, (n - 1) // 64).bit_length())


def word_keys(hashes: np.ndarray, words: int, needed: int, band: int) -> np.ndarray:
    """One join key per word that has a shingle: the XOR of the whole hashes that fall into it, with size band and place.

    Words that no differing shingle touches have equal keys, as they have equal bits; but unlike 64 bits, a key of few
    shingles meets only the same few shingles.  With ``needed`` words that have shingles or more, one of these is
    untouched by needed - 1 differences, so empty words say nothing; with fewer they get keys too.
    """
    word = ((hashes >> np.uint64(6)) % np.uint64(words)).astype(np.int64)
    order = np.argsort(word, kind="stable")
    starts = np.flatnonzero(np.diff(word[order], prepend=-1))
    held = word[order][starts]
    out = np.zeros(words, dtype=np.uint64)
    out[held] = np.bitwise_xor.reduceat(mixed(hashes + ODD[3])[order], starts)
    keys = mixed(out + mixed(np.arange(words, dtype=np.uint64) * ODD[0] + np.uint64(band))).view(np.int64)
    return keys[held] if len(held) >= needed else keys


def words_for(needed: int, least: int) -> int:
    """So many words that a set of ``least`` members leaves ``needed`` of them filled, as a rule."""
    words = needed
    for _ in range(8):
        words = int(1.02 * needed / (1 - np.exp(-least / words))) + 1
    return max(words, needed)


def placed(n: int, threshold: int, bands: list[int]) -> list[tuple[int, int, int]]:
    """(band, words, d + 1) of the size's own band, and of the one below if a set there can be linked with this size."""
    own = int(np.searchsorted(bands, n, side="right")) - 1
    out = []
    for k in (own, own - 1):
        if k >= 0 and (k == own or n * threshold <= (bands[k + 1] - 1) * 100):
            d = allowed(bands[k + 1] - 1, threshold)
            if d:  # with no difference allowed, linked sets are one class
                out.append((k, words_for(d + 1, bands[k]), d + 1))
    return out


class Bands:
    """The size bands, grown as larger sets come."""

    def __init__(self) -> None:
        self.least = size_bands(1 << 20)

    def of(self, n: int, threshold: int) -> list[tuple[int, int, int]]:
        if n >= self.least[-1]:
            self.least = size_bands(n)
        return placed(n, threshold, self.least)


def arrow_list(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64), pa.int64()))


#: What ``written`` gives: a row's set, a class's sketch, a large class's wide sketch, or (0 to PASSES - 1) a class's keys of that part.
ROW, MARK, WIDE = -1, -2, -3
WRITTEN = "part int, doc_id bigint, digest binary, n bigint, hi bigint, lo bigint, numbers array<bigint>"


def written(docs: DataFrame, k: int, threshold: int) -> str:
    """The folder of one pass over the texts, by part: every row's fingerprint, and sketches and keys of the classes.

    A task gives sketch and keys of a class once, as a rule, however many of its rows have the class's set.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, given = Bands(), set()
        for batch in (piece for whole in batches for piece in slices(whole)):
            marks, wide, keys, each = [], [], [], []
            for text in batch.column("text"):
                s = shingles(word_hashes(text.as_py()), k)
                each.append((len(s), *fingerprint(s)))
                if len(s) and each[-1] not in given:
                    if len(given) >= GIVEN:
                        given.clear()
                    given.add(each[-1])
                    marks.append((each[-1], sketch(s, SKETCH)))
                    if (words := wide_words(len(s))) > SKETCH:
                        wide.append((each[-1], sketch(s, words)))
                    keys += [(each[-1], own) for b, w, needed in bands.of(len(s), threshold) for own in by_part(word_keys(s, w, needed, b))]
            size = len(each)
            yield rows_of(np.full(size, ROW), batch.column("doc_id"), batch.column("digest"), each, [np.empty(0, dtype=np.int64)] * size)
            for part, sketches in ((MARK, marks), (WIDE, wide)):
                yield rows_of(np.full(len(sketches), part), None, None, [m for m, _ in sketches], [x for _, x in sketches])
            yield rows_of(np.array([part for _, (part, _) in keys], dtype=np.int64), None, None, [m for m, _ in keys], [x for _, (_, x) in keys])

    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    digest = F.unhex(F.md5(text_or_empty()))
    rows = bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), digest.alias("digest"), "text").mapInArrow(run, WRITTEN)
    rows.write.partitionBy("part").parquet(path)
    return path


def by_part(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    part = (keys.view(np.uint64) % np.uint64(PASSES)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=PASSES))
    for i, (a, b) in enumerate(zip(np.append(0, ends), ends, strict=False)):
        if b > a:
            yield i, keys[order[a:b]]


def rows_of(part: np.ndarray, ids: pa.Array | None, digests: pa.Array | None, sets: list[tuple[int, int, int]], numbers: list[np.ndarray]) -> pa.RecordBatch:
    n, hi, lo = zip(*sets, strict=True) if sets else ((), (), ())
    ids = pa.nulls(len(sets), pa.int64()) if ids is None else ids
    digests = pa.nulls(len(sets), pa.binary()) if digests is None else digests
    columns = [pa.array(part, pa.int32()), ids, digests, pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), arrow_list(numbers)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "digest", "n", "hi", "lo", "numbers"])


def part_of(spark: SparkSession, path: str, part: int) -> DataFrame:
    """The rows of one part; none if no task wrote any."""
    schema = T.StructType([f for f in T.StructType.fromDDL(WRITTEN) if f.name != "part"])
    try:
        return spark.read.schema(schema).parquet(f"{path}/part={part}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def flagged(docs: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """``docs`` with a column that is true wherever the doc_id may be one of ``ids`` (doc), and false elsewhere for most others.

    The filter is a bitmap of FILTER bits at the ids' hashes, as FILTER / 64 rows at most, which are broadcast.
    """
    at, word, bits = fresh(docs, "_at", "_word", "_bits")
    spot = lambda name: F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("bigint"), F.lit(-1).cast("bigint"))), F.lit(FILTER))
    of_word = ids.select(spot("doc").alias("at")).groupBy(F.shiftright("at", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias(bits))
    found = docs.withColumn(at, spot("doc_id")).withColumn(word, F.shiftright(at, 6)).join(F.broadcast(cut(of_word)), word, "left")
    return found.withColumn(flag, F.coalesce(F.expr(f"shiftright({bits}, cast({at} & 63 as int)) & 1 = 1"), F.lit(False))).drop(at, word, bits)


def shingle_sets(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """node, set of the classes in ``pairs`` (a, b).

    Only texts whose doc_id may be a class's smallest are read; what else comes along is left out by a join.
    """
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = cut(classes.join(nodes, "node", "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole)):
            sets = [shingles(word_hashes(t.as_py()), k) for t in batch.column("text")]
            marks = [fingerprint(s) for s in sets]
            columns = [pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, arrow_list(sets)], names=["hi", "lo", "set"])

    texts = flagged(docs.select("doc_id", "text"), wanted, "may").filter("may").select("text")
    found = bounded(texts).mapInArrow(run, "hi bigint, lo bigint, set array<bigint>").join(wanted.select("hi", "lo", "node"), ["hi", "lo"])
    out = cut(found.groupBy("node").agg(F.first("set").alias("set")))  # equal sets, sorted
    forget(wanted)
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity: 100 * |intersection| >= threshold * |union|."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.filter(100 * common >= threshold * union).select("a", "b")


def shared_keys(spark: SparkSession, path: str, classes: DataFrame) -> DataFrame:
    """key, node, n of the keys that several classes have; n is about how many.

    The key space is gone through in PASSES parts, one after the other.  Each reads its own files and deletes them, so
    that the disk holds one part's exchange at a time.
    """
    out = None
    for i in range(PASSES):
        part = part_of(spark, path, i)
        # Dealt by key once; the count and the join read the same exchange.
        keyed = part.select("hi", "lo", F.explode("numbers").alias("key")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
        ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("hi", "lo") for f in (F.min, F.max)]
        shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *ends).filter("hi_min != hi_max or lo_min != lo_max").select("key", "n")
        active = cut(keyed.join(shared.hint("shuffle_hash"), "key").dropDuplicates(["key", "hi", "lo"]))
        out = active if out is None else out.unionByName(active)
        del part, keyed, shared
        delete(spark, f"{path}/part={i}")
        release(spark)
    nodes = cut(out.join(classes.select("hi", "lo", "node"), ["hi", "lo"]).select("key", "node", "n"))
    forget(out)
    release(spark)
    return nodes


def folded(sketch_: Column, words: Column) -> Column:
    """The sketch in so many words, a divisor of its own: those that fall together are XORed."""
    piece = lambda j: F.slice(sketch_, j * words + 1, words)
    others = F.sequence(F.lit(1), (F.size(sketch_) / words).cast("int") - 1)
    xored = F.aggregate(others, piece(F.lit(0)), lambda s, j: F.zip_with(s, piece(j), lambda a, b: a.bitwiseXOR(b)))
    return F.when(F.size(sketch_) == words, sketch_).otherwise(xored)


def wide_hamming(a: Column, b: Column) -> Column:
    words = F.least(F.size(a), F.size(b))
    return hamming(folded(a, words), folded(b, words))


def may_link(x: Column, y: Column, threshold: int, distance: Callable[[Column, Column], Column] = hamming) -> Column:
    """Whether size and sketch allow a link; x and y are structs of both.

    Linked sets differ in (x + y) * (100 - t) / (100 + t) shingles at most, and their sketches in no more bits.
    """
    sizes = 100 * F.least(x["size"], y["size"]) >= threshold * F.greatest(x["size"], y["size"])
    return sizes & (distance(x["sketch"], y["sketch"]) * (100 + threshold) <= (x["size"] + y["size"]) * (100 - threshold))


def marks_of(marks: DataFrame, node: str, mark: str) -> DataFrame:
    return marks.select(F.col("node").alias(node), F.struct("size", "sketch").alias(mark))


def star_pairs(active: DataFrame, centres: DataFrame, marks: DataFrame, threshold: int) -> DataFrame:
    """Each class with the centre of every key that it shares, if size and sketch allow a link."""
    pairs = active.join(centres, "key").filter("node != centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    pairs = pairs.join(marks_of(marks, "a", "x"), "a").join(marks_of(marks, "b", "y"), "b")
    return pairs.filter(may_link(F.col("x"), F.col("y"), threshold)).select("a", "b")


def rest_of(active: DataFrame, centres: DataFrame, parts: DataFrame) -> DataFrame:
    """key, node, component where a key's classes but for the centre lie in several components."""
    rest = active.filter("n > 2").join(centres, "key").filter("node != centre").join(parts, "node", "left")
    rest = rest.select("key", "node", F.coalesce("component", "node").alias("component"))
    several = rest.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("key")
    return cut(rest.join(several, "key", "left_semi"))


def rest_pairs(rest: DataFrame, marks: DataFrame, threshold: int) -> DataFrame:
    """The pairs of different components that share a key and whose sizes and sketches allow a link."""
    own = rest.join(marks_of(marks, "node", "mark"), "node")
    x, y = own.alias("x"), own.alias("y")
    close = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    close &= may_link(F.col("x.mark"), F.col("y.mark"), threshold)
    return x.join(y, close).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def wide_pairs(pairs: DataFrame, wide: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) without those of two large classes whose wide sketches allow no link."""
    both = pairs.join(marks_of(wide, "a", "x"), "a", "left").join(marks_of(wide, "b", "y"), "b", "left")
    x, y = F.col("x"), F.col("y")
    return both.filter(F.when(x.isNull() | y.isNull(), True).otherwise(may_link(x, y, threshold, wide_hamming))).select("a", "b")


def confirmed(pairs: DataFrame, wide: DataFrame, docs: DataFrame, classes: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets, made anew from the texts, are linked."""
    pairs = cut(wide_pairs(pairs, wide, threshold))
    sets = shingle_sets(docs, pairs, classes, k)
    release(pairs.sparkSession)
    out = cut(verified(pairs, sets, threshold))
    forget(pairs, sets)
    release(pairs.sparkSession)
    return out


def near_pairs(active: DataFrame, marks: DataFrame, wide: DataFrame, docs: DataFrame, classes: DataFrame, k: int, threshold: int) -> DataFrame:
    """Verified links (a, b) between class nodes that connect whatever all links connect."""
    spark = active.sparkSession
    support = active.groupBy("node").agg(F.sum("n").alias("support"))
    centres = active.join(support, "node").groupBy("key").agg(F.max(F.struct("support", (-F.col("node")).alias("m"))).alias("c"))
    centres = cut(centres.select("key", (-F.col("c.m")).alias("centre")))
    release(spark)
    links = confirmed(star_pairs(active, centres, marks, threshold), wide, docs, classes, k, threshold)
    rest = rest_of(active, centres, components(links))
    forget(active, centres)
    if not rest.isEmpty():
        release(spark)
        links = links.unionByName(confirmed(rest_pairs(rest, marks, threshold), wide, docs, classes, k, threshold))
    forget(rest)
    release(spark)
    return links


def grouped(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """doc_id, digest (MD5 of the text), n, group for every row: rows of one group are linked, however indirectly.

    ``group`` is null for a row without words.
    """
    spark = docs.sparkSession
    path = written(docs, k, threshold)
    each = part_of(spark, path, ROW).select("doc_id", "digest", "n", "hi", "lo")
    classes = each.filter("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))  # fixed by being written
    active = shared_keys(spark, path, classes)
    marks = part_of(spark, path, MARK).join(classes.select("hi", "lo", "node"), ["hi", "lo"]).join(active.select("node").distinct(), "node", "left_semi")
    marks = cut(marks.groupBy("node").agg(F.max("n").alias("size"), F.first("numbers").alias("sketch")))  # equal ones
    wide = part_of(spark, path, WIDE).join(classes.select("hi", "lo", "node"), ["hi", "lo"]).join(marks.select("node"), "node", "left_semi")
    wide = cut(wide.groupBy("node").agg(F.max("n").alias("size"), F.first("numbers").alias("sketch")))
    for part in (MARK, WIDE):
        delete(spark, f"{path}/part={part}")
    links = near_pairs(active, marks, wide, docs, classes, k, threshold)
    parts = components(links)
    named = classes.join(parts, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("group"))
    out = cut(each.join(named, ["hi", "lo"], "left").select("doc_id", "digest", "n", F.when(F.col("n") > 0, F.col("group")).alias("group")))
    forget(classes, marks, wide, links, parts)
    delete(spark, path)
    release(spark)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links of at least ``threshold`` percent."""
    rows = grouped(docs, k, threshold)
    least = rows.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    named = rows.join(least, "group", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row of each group of linked rows: the smallest doc_id's, and of several such rows the one with the least digest.

    Rows without words all stay.
    """
    rows = grouped(docs, k, threshold)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    least = rows.filter("group is not null").groupBy("group").agg(F.min(order).alias("least")).select("group", "least.*")
    same = rows.alias("r").join(least.alias("l"), (F.col("r.group") == F.col("l.group")) & F.col("r.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("r.digest") == F.col("l.digest")), "left")
    fate = same.filter("r.group is not null").groupBy("r.doc_id", "r.digest").agg(F.count("l.digest").alias("kept")).filter("kept != 1")
    ident, digest, kept, may = fresh(docs, "_id", "_digest", "_kept", "_may")
    fate = cut(fate.select(F.col("doc_id").alias(ident), F.col("digest").alias(digest), F.col("kept").alias(kept)))  # 0: goes; more: equal rows
    # Only rows that the filter does not clear meet the fates.
    hashed = flagged(docs.withColumn(digest, F.unhex(F.md5(text_or_empty()))), fate.select(F.col(ident).alias("doc")), may)
    rest = hashed.filter(F.col(may))
    keys = rest["doc_id"].cast("bigint").eqNullSafe(fate[ident]) & (rest[digest] == fate[digest])
    once = hashed.filter(~F.col(may)).select(*docs.columns).unionByName(rest.join(fate, keys, "left_anti").select(*docs.columns))
    equal = fate.filter(F.col(kept) > 1)
    if equal.isEmpty():
        return once
    several = rest.join(equal, keys, "left_semi")
    whole = F.struct(*docs.columns)
    one = several.groupBy("doc_id", digest).agg((F.first if has_map(docs.schema) else F.min)(whole).alias("_row"))
    return once.unionByName(one.select("_row.*"))


def has_map(schema: T.DataType) -> bool:
    """Whether values of the type have no order."""
    return "map<" in schema.simpleString() or "variant" in schema.simpleString()
