"""Rolling z-scores of period counts while the stream runs.

Events are counted per key and window by a watermarked aggregation, so that a hot key's events are
reduced in every task; the windows that the watermark closes go on to a stateful processor that holds
each key's last closed windows (their starts and counts, never more than the rolling length less one)
and gives a window's z-score as soon as it closes. Both states lie on disk (RocksDB) and have no expiry.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.operators import windows as W
from lodestar.session import remove, scratch_path, stored
from lodestar.streaming.twins import _disk_state


class Velocity(StatefulProcessor):
    """Closed windows (start in microseconds, n) of a key -> the same with rolling mean, deviation, z-score and flag."""

    def __init__(self, keys: Sequence[str], n: int, min_periods: int, threshold: float):
        self.keys, self.n, self.min_periods, self.threshold = list(keys), n, min_periods, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "starts array<bigint>, counts array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("start")  # the windows of one key that closed in this batch
        starts, counts = (list(x) for x in self.recent.get()) if self.recent.exists() else ([], [])
        out = []
        for start, n in zip(new["start"].tolist(), new["n"].tolist()):
            starts, counts = (starts + [start])[-self.n:], (counts + [n])[-self.n:]
            mean = std = z = None
            if len(counts) >= self.min_periods:
                mean, std = float(np.mean(counts)), float(np.std(counts, ddof=1))
                z = (n - mean) / std if std else None
            out.append((*key, start, n, mean, std, z, int(z is not None and z > self.threshold)))
        keep = self.n - 1
        self.recent.update((starts[len(starts) - min(keep, len(starts)):], counts[len(counts) - min(keep, len(counts)):]))
        got = pd.DataFrame(out, columns=[*self.keys, "start", "n", "rolling_mean", "rolling_std", "z_score", "rising_flag"])
        yield got.astype({c: "float64" for c in ("rolling_mean", "rolling_std", "z_score")})

    def close(self) -> None:
        pass


def stream_velocity(spark: SparkSession, path_glob: str, schema, event_time: str, keys: Sequence[str], period: str = "1 day",
                    delay: str = "1 day", n: int = 4, min_periods: int = 2, threshold: float = 2.0, max_files: int | None = None) -> DataFrame:
    """(keys, start, n, rolling_mean, rolling_std, z_score, rising_flag) of every window, over the last ``n`` of its key's windows.

    Windows that the watermark has closed come from the processor, by way of a parquet sink; those still open when all files
    are read are scored from the two final states. Events later than ``delay`` find their window closed and are left out; rows with
    a null time are too, and null keys are a key. ``max_files``: files a batch (all, if None)."""
    keys = list(keys)
    source = spark.readStream.schema(schema)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    s = source.parquet(path_glob).withColumn(event_time, F.col(event_time).cast("timestamp"))
    counted = s.withWatermark(event_time, delay).groupBy(F.window(event_time, period), *keys).agg(F.count(F.lit(1)).alias("n"))
    types = ", ".join(f"`{k}` {s.schema[k].dataType.simpleString()}" for k in keys)
    scored = f"{types}, start long, n long, rolling_mean double, rolling_std double, z_score double, rising_flag int"
    closed = counted.select(*keys, F.unix_micros("window.start").alias("start"), "n").groupBy(*keys).transformWithStateInPandas(
        Velocity(keys, n, min_periods, threshold), scored, "Append", "None")
    ck, sink = scratch_path(spark, "ckpt-velocity"), scratch_path(spark, "velocity")
    with _disk_state(spark):
        closed.writeStream.option("checkpointLocation", ck).trigger(availableNow=True).outputMode("append").format("parquet") \
            .option("path", sink).start().awaitTermination()
        ids = {r["operatorName"]: r["operatorId"] for r in spark.read.format("state-metadata").load(ck).collect()}  # two operators
        processor = next(i for name, i in ids.items() if name.startswith("transformWithState"))
        counts = next(i for name, i in ids.items() if name.startswith("stateStoreSave"))
        left = spark.read.format("statestore").option("operatorId", counts).load(ck).select("key", "value")
        window, count = left.schema["key"].dataType.fields[0].name, left.schema["value"].dataType.fields[0].name
        open_windows = left.select(*[F.col("key")[k].alias(k) for k in keys], F.unix_micros(F.col("key")[window]["start"]).alias("start"),
                                   F.col("value")[count].alias("n"), F.lit(True).alias("open"))
        held = spark.read.format("statestore").option("operatorId", processor).option("stateVarName", "recent").load(ck)
        before = held.select("key", F.explode(F.arrays_zip(F.col("value.starts").alias("start"), F.col("value.counts").alias("n"))).alias("w")) \
            .select(*[F.col("key")[k].alias(k) for k in keys], "w.start", "w.n", F.lit(False).alias("open"))
        rest = stored(open_windows.unionByName(before), "velocity-open")
    remove(spark, ck)
    tail = W.velocity_zscore(rest, "n", keys, "start", n, min_periods, True, threshold).where("open").drop("open")
    done = spark.read.schema(scored).parquet(sink)
    return done.unionByName(tail.select(*done.columns)).withColumn("start", F.timestamp_micros("start"))
