"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestar.session import CLEANUP, checkpoint_dir, prepare

#: fixed values: ASCII white space (space, tab to carriage return) separates words
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: rows in an Arrow batch; with Spark's own limit on bytes it bounds a Python worker's memory
BATCH_ROWS = 500


def begin(spark: SparkSession) -> None:
    """Session settings that the Python stages rely on."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    begin(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, on whatever file system that is."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def set_for(spark: SparkSession, name: str, value):
    """A session setting while a block of code runs."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, name: str, compression: str = "snappy", clean: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: later plans start from
    files that survive a lost executor, and joins see plain exchanges. ``clean``: its shuffle files are deleted at once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with set_for(spark, CLEANUP, "true") if clean else contextlib.nullcontext():
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *frames_or_paths) -> None:
    """Delete folders made by ``scratch`` / ``written`` that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for x in frames_or_paths:
        files = x.inputFiles() if isinstance(x, DataFrame) else [f"{x}/-"]
        if files:
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def most_frequent(counts: DataFrame, n: str, size: int) -> DataFrame:
    """Rows of ``counts`` whose whole number ``n`` exceeds a cut that leaves at most
    ``size`` of them: ties at the cut go out together, and only two short histograms
    (powers of two, then 4,096 steps within one) reach the driver, not candidates of
    every partition as with a sorted limit."""
    def above(buckets: DataFrame, room: int) -> tuple[int, int]:
        """The lowest bucket that fits into ``room`` with all higher ones, and what it leaves."""
        lowest = 1 << 62
        for r in sorted(buckets.collect(), key=lambda r: -r["b"]):
            if r["k"] > room:
                break
            room -= r["k"]
            lowest = r["b"]
        return lowest, room

    power = F.floor(F.log2(F.col(n).cast("double"))).cast("int")
    low, room = above(counts.groupBy(power.alias("b")).agg(F.count(F.lit(1)).alias("k")), size)
    low = min(low, 63)
    part = counts.where(power < low)
    top = part.agg(F.max(power)).first()[0]
    if top is None:
        return counts.where(power >= low)
    step = F.floor((F.col(n) - F.lit(1 << top)) * 4096 / F.lit(float(1 << top))).cast("int")
    edge, _ = above(part.where(power == top).groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("k")), room)
    return counts.where((power > top) | ((power == top) & (step >= min(edge, 1 << 30))))


def sampled(rows: DataFrame, key: str, size: int) -> DataFrame:
    """At most ``size`` rows, those with the smallest hashes of ``key``; rows beyond a
    hash threshold are filtered out first, so that few are sorted."""
    n = rows.count()
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    share = min(1.0, 1.1 * (size + 100) / max(n, 1))
    return rows.where(h <= int(share * (1 << 40))).orderBy(h, key).limit(size)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. Texts of ASCII only take the faster ``lower``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower()))


def fold(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text modulo ``mod`` equals ``rest`` (a null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def nullable(t: pa.DataType) -> pa.DataType:
    """The type with nulls allowed at all depths, as a schema read from its string has it."""
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in t])
    if pa.types.is_map(t):
        return pa.map_(t.key_type, nullable(t.item_type))
    return pa.list_(nullable(t.value_type)) if pa.types.is_list(t) else t


def chunks(size: int):
    """For ``mapInArrow`` to "chunk long, rows binary": one row for each chunk of about
    ``size`` bytes, its rows as compressed Arrow batches (``chunk_rows`` reads them)."""
    def pack(batches):
        task, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def packed():
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in held:
                    w.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | k], pa.int64()),
                                               pa.array([out.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])
        for b in batches:
            # a batch of long texts makes several chunks
            step = max(1, int(b.num_rows * size / max(b.nbytes, size)))
            for part in (b.slice(i, step) for i in range(0, b.num_rows, step)):
                held.append(part)
                n += part.nbytes
                if n >= size:
                    yield packed()
                    k, held, n = k + 1, [], 0
        if held:
            yield packed()
    return pack


def chunk_rows(blob):
    """The batches of a chunk."""
    return pa.ipc.open_stream(blob.as_buffer())
