"""Approximate nearest neighbours (operator 1): randomly rotated one-bit codes (RaBitQ, Gao and Long, 2024).

A vector, scaled to length 1, is rotated by a seeded random matrix with orthonormal columns into BITS_PER_DIM times
its dimensions; the signs are its code, packed to bits, and ``<code, rotated vector>`` is its correction scalar f.
For a query q the inner product is estimated without bias as ``<code, rotated q> / f``, and lies within
``BOUND * sqrt((1 - f * f) / (f * f * (bits - 1)))`` of it but for a tiny probability.  The rotated query is rounded to
PLANES bits a number, so ``<code, rotated q>`` is a sum of bit counts of the packed codes, and what rounding can change
is added to the bound.  Vectors whose upper bound reaches the k-th best lower bound are reranked by the cosine itself,
in double precision.

Rows and queries are dealt into blocks of bounded size; a task estimates one block of rows against one block of
queries, and gives at most k rows a query.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components take no part, nor do rows
without vec_id; vectors of different lengths are not compared; every row is a candidate, also where rows repeat a
vec_id, but for those with the query's own; a query whose vec_id several rows have is as near as the nearest of them;
ties go to the smaller vec_id; vectors of any length are read whole; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeweave.llm.common import cut

BITS_PER_DIM = 4
BOUND = 3.0
PLANES = 8
SEED = 20240521
#: Rows and queries of one task.
ROWS, QUERIES = 8192, 2048

_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """bits x dim, with orthonormal columns; the same everywhere."""
    if dim not in _ROTATIONS:
        bits = -(-BITS_PER_DIM * dim // 64) * 64
        q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((bits, dim)))
        _ROTATIONS[dim] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim]


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes and correction scalars of the rows of ``vectors`` (none is zero)."""
    turned = (vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))) @ rotation(vectors.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(turned.shape[1])


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed component by component: equal rows give equal numbers."""
    dot, own, other = np.zeros(len(rows)), np.zeros(len(rows)), 0.0
    for j in range(rows.shape[1]):
        dot += rows[:, j] * query[j]
        own += rows[:, j] * rows[:, j]
        other += query[j] * query[j]
    return np.clip(dot / np.sqrt(own * other), -1.0, 1.0)


def bit_sums(words: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, float]:
    """<code, turned> for every code (as 64-bit words), of the numbers rounded to PLANES bits; and what rounding changes at most."""
    low, top = turned.min(), turned.max()
    step = (top - low) / (2**PLANES - 1) or 1.0
    steps = np.rint((turned - low) / step).astype(np.uint8)
    total = np.zeros(len(words))
    for p in range(PLANES):
        plane = np.packbits((steps >> p) & 1).view(np.uint64)
        total += 2.0**p * np.bitwise_count(words & plane).sum(1, dtype=np.int64)
    ones = np.bitwise_count(words).sum(1, dtype=np.int64)
    rounded = low + step * steps
    return 2 * (low * ones + step * total) - rounded.sum(), float(np.abs(turned - rounded).sum())


def search_block(ids: np.ndarray, rows: np.ndarray, codes: np.ndarray, f: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query_id, row, score) of each query's k nearest rows of the block, by estimate, bound and rerank."""
    words = np.ascontiguousarray(codes).view(np.uint64)
    bits = words.shape[1] * 64
    turned = (queries / np.sqrt((queries * queries).sum(1, keepdims=True))) @ rotation(rows.shape[1]).T
    error = BOUND * np.sqrt(np.maximum(0.0, 1 - f * f) / (f * f * (bits - 1)))
    scale = np.sqrt(bits) * f
    out = []
    for j, q in enumerate(query_ids):
        sums, slack = bit_sums(words, turned[j])
        g, wide = sums / scale, error + slack / scale
        other = ids != q
        low = np.where(other, g - wide, -np.inf)
        bar = np.partition(low, -k)[-k] if len(low) > k else -np.inf
        near = np.flatnonzero(other & (g + wide >= bar - 1e-6))
        score = cosines(rows[near], queries[j])
        best = np.lexsort((ids[near], -score))[:k]
        out += [(int(q), int(near[i]), float(score[i])) for i in best]
    return out


def valid(c: Column) -> Column:
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & finite & F.exists(c, lambda x: x != 0)


def build_index(embeddings: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, dim, embedding, code, f for every vector that takes part."""
    rows = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull()).filter(valid(F.col("embedding")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            dims = np.diff(column.offsets.to_numpy())
            flat, starts = column.flatten().to_numpy(), np.cumsum(dims) - dims
            code, f = [b""] * len(dims), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                packed, f[at] = encode(flat[(starts[at][:, None] + np.arange(d))])
                for i, row in zip(at, packed, strict=True):
                    code[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(dims, pa.int32()), column, pa.array(code, pa.binary()), pa.array(f)], names=["row", "vec_id", "dim", "embedding", "code", "f"])

    return rows.mapInArrow(run, "row bigint, vec_id bigint, dim int, embedding array<double>, code binary, f double")


def search(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows of the index but its own; ``queries`` has row, vec_id, dim, embedding.

    ``index`` must be a stored table: its rows' numbers are joined by.
    """
    n, m = index.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n // ROWS)), max(1, -(-m // QUERIES))
    deal = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = index.withColumn("rows_in", deal(row_blocks)).withColumn("queries_in", every(query_blocks))
    asked = queries.select("row", "vec_id", "dim", "embedding").withColumn("queries_in", deal(query_blocks)).withColumn("rows_in", every(row_blocks))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            matrix = lambda t: t.column("embedding").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), dtype=np.uint8).reshape(left.num_rows, -1)
            out = search_block(left.column("vec_id").to_numpy(), matrix(left), codes, left.column("f").to_numpy(), right.column("vec_id").to_numpy(), matrix(right), k)
        q, r, s = zip(*out, strict=True) if out else ((), (), ())
        at = pa.array(r, pa.int64())
        return pa.table({"query_id": pa.array(q, pa.int64()), "row": left.column("row").take(at), "vec_id": left.column("vec_id").take(at), "score": pa.array(s, pa.float64())})

    keys = ["dim", "rows_in", "queries_in"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id bigint, row bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by ``every``, among all other rows; see op1."""
    index = cut(build_index(embeddings))
    return search(index, index.filter(F.col("vec_id") % every == 0), k)
