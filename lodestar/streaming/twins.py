"""Structured Streaming twins of two batch operators.

* first-seen dedup: a stateful minimum per key keeps the first row in file
  order, without expiry.
* period counts: watermarked tumbling-window counts feed the batch
  velocity z-score.

Sources are parquet folders read as file streams. Keyed state lies on disk
(RocksDB); results are read from the final state and from a parquet sink under
the shared folder, so nothing is gathered on the driver. Checkpoints are
deleted once their state has been stored as a table.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import remove, scratch_path, stored

_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def _disk_state(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(aggregated: DataFrame, name: str, sink: str | None = None) -> DataFrame:
    """Run an aggregation over all available files; returns its final state (key, value),
    stored. With ``sink``, rows that the watermark has closed go to that parquet folder."""
    spark = aggregated.sparkSession
    ck = scratch_path(spark, f"ckpt-{name}")
    w = aggregated.writeStream.option("checkpointLocation", ck).trigger(availableNow=True)
    w = w.outputMode("append").format("parquet").option("path", sink) if sink else w.outputMode("update").format("noop")
    with _disk_state(spark):
        w.start().awaitTermination()
        state = stored(spark.read.format("statestore").load(ck).select("key", "value"), f"state-{name}")
    remove(spark, ck)
    return state


def stream_first_seen(spark: SparkSession, path_glob: str, schema, key: str, name: str = "first_seen") -> DataFrame:
    """The first row of each key, in the order of files and of rows in them."""
    s = spark.readStream.schema(schema).parquet(path_glob)
    row = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
                   F.struct(*[F.col(c) for c in s.columns if c != key]).alias("rest"))
    state = _run(s.groupBy(key).agg(F.min(row).alias("first")), name)
    first = state.schema["value"].dataType.fields[0].name
    return state.select(F.col("key")[key].alias(key), F.col("value")[first]["rest"].alias("rest")).select(key, "rest.*")


def stream_period_counts(spark: SparkSession, path_glob: str, schema, event_time: str, keys, period: str = "1 day",
                         delay: str = "1 day", name: str = "period_counts") -> DataFrame:
    """(window, keys, n): windows that the watermark has closed, from the parquet sink, and
    those still open at the end, from the state."""
    s = spark.readStream.schema(schema).parquet(path_glob)
    s = s.withColumn(event_time, F.col(event_time).cast("timestamp"))  # zone-less -> session (UTC) time
    g = s.withWatermark(event_time, delay).groupBy(F.window(event_time, period), *keys).agg(F.count(F.lit(1)).alias("n"))
    sink = scratch_path(spark, name)
    state = _run(g, name, sink)
    window, count = state.schema["key"].dataType.fields[0].name, state.schema["value"].dataType.fields[0].name
    left = state.select(F.col("key")[window].alias("window"), *[F.col("key")[k].alias(k) for k in keys],
                        F.col("value")[count].alias("n"))
    closed = spark.read.schema(g.schema).parquet(sink)
    return closed.select("window", *keys, "n").unionByName(left)
