"""Mixing sources to target weights (operator 5) by Poisson replication.

A source with ``n`` rows and target weight ``w`` (of weights that sum to 1) gets the mean repetition rate
``rate = total * w / n``.  Each row inverts the Poisson distribution with that mean at a number in (0, 1) that a
seeded hash of its doc_id gives, is repeated that often, and all copies are shuffled by another hash.  Counts
depend on nothing but seed, doc_id and rate, so a lost executor recomputes the same rows.

Defined cases: null sources are one source of their own; a null doc_id hashes as the word null; repeated rows are
each replicated (equal ids get equal counts); an empty table gives an empty result; sources without a given
weight get none of it; columns of any name pass through, and new ones that clash get an underscore in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeweave.llm.common import fresh

#: One inversion covers means up to this; a larger rate is a sum of equal parts.
PART = 16.0
#: No count above this has a probability over 1e-19 at a mean of PART.
MOST = 64


def uniform(seed: str, *parts: Column) -> Column:
    """A hash of the parts as a number in (0, 1): 48 bits of md5 and a half."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def rates(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, total: float | None = None) -> DataFrame:
    """source, n_rows, rate: target weight over share.

    ``weights`` (source, weight) states the targets; without it a source weighs its row count to ``power``.
    ``total`` is the expected number of rows of the mixture (default: as many as there are).
    """
    n = docs.groupBy(F.col("source").alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        n = n.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(power)))
    else:
        w = weights.select(F.col("source").alias("_w_source"), F.col("weight").cast("double").alias("weight"))
        n = n.join(w, n["source"].eqNullSafe(w["_w_source"]), "left").drop("_w_source").fillna({"weight": 0.0})
    wanted = n.agg(F.sum("n_rows").cast("double")).scalar() if total is None else F.lit(float(total))
    all_weight = n.agg(F.sum("weight")).scalar()
    return n.select("source", "n_rows", F.coalesce(wanted * F.col("weight") / all_weight / F.col("n_rows"), F.lit(0.0)).alias("rate"))


def poisson(rate: Column, u: Column) -> Column:
    """The count at which the distribution function with mean ``rate`` (at most PART) first reaches over u."""
    steps = F.sequence(F.lit(0), F.lit(MOST - 1))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("count"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / (k + 1)
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["count"] + F.when(acc["cdf"] <= u, 1).otherwise(0)).alias("count"))

    return F.aggregate(steps, start, step, lambda a: a["count"])


def replicate(docs: DataFrame, by: DataFrame, seed: str = "mix") -> DataFrame:
    """Each row as often as its hash and its source's rate say, with copy (from 1), n_copies and mix_key; shuffled."""
    rate, src, copy, n_copies, key = fresh(docs, "_rate", "_source", "copy", "n_copies", "mix_key")
    by = by.select(F.col("source").alias(src), F.col("rate").alias(rate))
    joined = docs.join(by, docs["source"].eqNullSafe(F.col(src)), "left").drop(src)
    parts = F.greatest(F.ceil(F.col(rate) / PART), F.lit(1)).cast("int")
    share = F.col(rate) / parts
    counts = F.transform(F.sequence(F.lit(1), parts), lambda i: poisson(share, uniform(seed, F.col("doc_id"), i)))
    counted = joined.withColumn(n_copies, F.aggregate(counts, F.lit(0), lambda a, x: a + x).cast("long"))
    copies = counted.filter(F.col(n_copies) > 0).drop(rate).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n_copies))))
    keyed = copies.withColumn(key, F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(copy).cast("string"))))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, F.col(key)).sortWithinPartitions(key)


def mix(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, total: float | None = None, seed: str = "mix") -> DataFrame:
    """The mixture: ``docs`` replicated to the target weights and shuffled."""
    return replicate(docs, rates(docs, weights, power, total), seed)
