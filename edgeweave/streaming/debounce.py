"""Watch events in batches that an idle gap closes, and their installation as snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeweave.functions.scopes import ignored
from edgeweave.lineage import shared_dir

#: Files whose change asks for a full pass.
POLICY = (".gitignore", ".ignore")


def batches(events: DataFrame, gap: str = "200 milliseconds", keys: Iterable[str] = ()) -> DataFrame:
    """keys, first, n, paths (distinct, sorted): events (ts, path) no further than ``gap`` from the one before are one batch.

    An event exactly ``gap`` after another still joins it.
    """
    window = F.session_window("ts", gap)
    out = events.groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("path")).alias("paths"))
    return out.select(*keys, F.col("w.start").alias("first"), "n", "paths")


def relevant(events: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Events of files that are neither hidden nor ignored; policy files always."""
    rules = list(patterns)
    top = F.element_at(F.split("path", "/"), 1)
    out = F.udf(lambda p: ignored(p, rules), "boolean")
    name = F.element_at(F.split("path", "/"), -1)
    return events.filter(name.isin(*POLICY) | (~top.startswith(".") & ~out("path")))


def stream_batches(spark: SparkSession, path: str, gap: str, keys: list[str], path_column: str) -> DataFrame:
    """``batches`` over a file stream, with a watermark, run until all is read; complete sessions come from the sink table."""
    import uuid

    where = f"{shared_dir(spark)}/debounce-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    # A folder of part files is a stream as it stands; a single file is picked out of its folder.
    is_folder = any(f.rstrip("/").rpartition("/")[0].endswith(name) for f in spark.read.parquet(path).inputFiles())
    source = spark.readStream.schema(schema).parquet(path) if is_folder else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    events = source.select(*keys, F.col("ts").cast("timestamp").alias("ts"), F.col(path_column).alias("path")).withWatermark("ts", gap)
    install = lambda df, batch_id: df.write.mode("overwrite").parquet(f"{where}/out/batch={batch_id}")
    query = batches(events, gap, keys).writeStream.outputMode("complete").foreachBatch(install).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(f"{where}/out")
    last = done.agg(F.max("batch")).first()[0]
    return done.filter(F.col("batch") == last).drop("batch").withColumn("first", F.col("first").cast("timestamp_ntz"))


def install_stream(stream: DataFrame, checkpoint: str, install: Callable[[DataFrame, int], Any]):  # noqa: ANN201
    """A streaming query that hands each batch once to ``install``; a batch id that comes again must be a no-op there."""
    return stream.writeStream.foreachBatch(install).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
