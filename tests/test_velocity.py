"""The stateful velocity processor against the batch z-score."""
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import windows as W
from lodestar.streaming.velocity import stream_velocity

START = datetime(2024, 1, 1)


def written(spark, folder, files):
    """A parquet file per list of rows, in that order of modification time."""
    import os
    import shutil
    os.makedirs(f"{folder}/in")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "ts timestamp, e string").coalesce(1).write.parquet(f"{folder}/raw{i}")
        part = next(f for f in os.listdir(f"{folder}/raw{i}") if f.endswith(".parquet"))
        shutil.copy(f"{folder}/raw{i}/{part}", f"{folder}/in/{i:03d}.parquet")
        os.utime(f"{folder}/in/{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return f"{folder}/in", spark.read.parquet(f"{folder}/in").schema


def result(df):
    return {(r["e"], r["start"]): (r["n"], *(None if r[c] is None else round(r[c], 9) for c in ("rolling_mean", "rolling_std", "z_score")), r["rising_flag"])
            for r in df.collect()}


def batch(spark, rows):
    g = spark.createDataFrame(rows, "ts timestamp, e string").groupBy("e", F.date_trunc("day", "ts").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return result(W.velocity_zscore(g, "n", ["e"], "start"))


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [1, 0, 3, 2]])
def test_equals_the_batch_whatever_the_order_of_files(spark, tmp_path, order):
    rng = np.random.default_rng(1)
    files = [[(START + timedelta(hours=float(rng.uniform(60 * k, 60 * k + 90))), "xyz"[int(rng.integers(3))]) for _ in range(120)] for k in range(4)]
    files[3] += [(START + timedelta(days=20), "x"), (START + timedelta(days=20), None)]  # gaps are no periods; a null key
    path, schema = written(spark, tmp_path, [files[i] for i in order])
    got = stream_velocity(spark, path, schema, "ts", ["e"], delay="30 days", max_files=1)
    assert result(got) == batch(spark, [r for f in files for r in f])


def test_windows_close_while_files_come_and_late_events_are_left_out(spark, tmp_path):
    days = lambda a, b: [(START + timedelta(days=d, hours=h), "x") for d in range(a, b) for h in range(0, 2 + d * d % 7)]
    late = [(START + timedelta(hours=5), "x")] * 50
    path, schema = written(spark, tmp_path, [days(0, 5), days(5, 9), days(9, 12) + late, days(12, 14)])
    got = stream_velocity(spark, path, schema, "ts", ["e"], delay="1 day", max_files=1)
    assert result(got) == batch(spark, days(0, 14))
    assert got.where("rising_flag = 1").count() == 0  # with the current period within, four counts reach 1.5 at most
