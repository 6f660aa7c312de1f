"""Shared plumbing of the training-data operators: tables, lineage cuts, ranking."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that go to a Python worker at once; a longer row goes by itself.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (any path that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where a local session has none (as in tests) a temporary one is set.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = sc.getCheckpointDir()
    if not where and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not where:
        where = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This cuts the lineage; a lost executor loses none of it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(nullable(df.schema)).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if there is one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(*frames: DataFrame) -> None:
    """Deletes the files that ``cut`` wrote for the frames, which nothing may read any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/cut-" in folder:
                delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of frames that are out of use; it acts on the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session hands Python workers BATCH_BYTES at a time, or what the caller has set.

    A batch is held in the JVM outside the heap as well as in the worker.  Spark reads the setting when a plan runs, so
    it stays set.
    """
    conf = df.sparkSession.conf
    if BATCH_SETTING not in conf.getAll:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return df


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of so many rows at most; its bytes are bounded by the session (see ``bounded``)."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def stretch(name: str, most: int, seed: Column) -> Column:
    """The text, or ``most`` characters of a longer one from a place that ``seed`` (a number) gives."""
    start = F.pmod(seed, F.greatest(F.length(name) - most + 1, F.lit(1))) + 1
    return F.substring(F.col(name), start.cast("int"), F.lit(most))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` does not have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def gapless(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str, buckets: int) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps and without one task per group.

    Rows are dealt into ``buckets`` hash buckets of the ``order`` columns; a bucket starts where the earlier
    buckets of its group end.  Only counts by (group, bucket) meet in one task of the running sum.
    Rows that agree in all ``order`` columns are interchangeable.
    """
    b, n, first, within = fresh(df, "_bucket", "_n", "_first", "_within")
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*group, b).agg(F.count(F.lit(1)).alias(n))
    starts = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(first, F.coalesce(F.sum(n).over(starts), F.lit(0))).drop(n)
    keys = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in [*group, b]]
    ranked = dealt.withColumn(within, F.row_number().over(Window.partitionBy(*group, b).orderBy(*order)) - 1)
    joined = ranked.alias("l").join(counts.alias("r"), keys)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col(f"r.{first}") + F.col(f"l.{within}")).cast("long").alias(out))
