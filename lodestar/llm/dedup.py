"""Exact deduplication as a stateful stream (Spark operators only).

The digest of every normalised text is written to the shared folder with the
row's identifier and content locator (file and row index). A Structured
Streaming aggregation over these rows, without watermark and with its state on
RocksDB (disk), keeps per digest: the stable identifier and the locator of the
row that stays and the number of rows seen. State never expires; a restarted stream continues from
its checkpoint. The state is read back as a table, and every hit (a row whose
digest was seen more than once) is compared byte by byte with the row that the
locator names; digests with a mismatch are regrouped by the text itself.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.llm.common import ascii_lower, remove, scratch, written

_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk set aside ahead
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def _settings(spark: SparkSession, values: dict):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _state(spark: SparkSession, rows: DataFrame, files_per_batch: int | None) -> DataFrame:
    """(digest, keep struct<id, file, row>, n): the final state of the stream over written rows."""
    ck = scratch(spark, "dedup-state")
    source = spark.readStream.schema(rows.schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    folder = rows.inputFiles()[0].rsplit("/", 1)[0]
    seen = (source.parquet(folder).select("digest", F.struct("id", "file", "row").alias("at"))
            .groupBy("digest").agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("n")))
    with _settings(spark, _STATE):
        run = (seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", ck)
               .trigger(availableNow=True).start())
        run.awaitTermination()
        state = spark.read.format("statestore").load(ck)
        keep, n = (f.name for f in state.schema["value"].dataType.fields)
        out = written(state.select(F.col("key")["digest"].alias("digest"), F.col("value")[keep].alias("keep"),
                                   F.col("value")[n].alias("n")), "dedup-keep")
    remove(spark, ck)
    return out


def _located(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in struct ``doc``, with file and row: its own files'
    if it is a plain scan of files, else those of a copy in the shared folder."""
    doc = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    if "_metadata" not in docs.columns:
        try:
            return docs.select(doc, *at)
        except AnalysisException:  # no file metadata: not a scan
            pass
    return written(docs.select(doc), "dedup-rows").select("doc", *at)


def deduplicate(docs: DataFrame, columns: list[str] | None = None, digest=None, files_per_batch: int | None = None) -> DataFrame:
    """Every row of ``docs`` as struct ``doc`` (``columns``, or all) with keep_id,
    group_size, kept and digest.

    ``docs`` needs ``doc_id`` and ``text``; other columns ride along inside
    ``doc``, so their names cannot clash. Equal texts: identical after A-Z are
    lower-cased; null counts as empty. The row with the largest doc_id stays;
    among rows that repeat it (or when all ids are null) the last by locator.
    ``digest`` maps the normalised text to the key (SHA-256 hex by default; any
    function gives the same groups, since hits are checked in full).
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    columns = columns or docs.columns
    norm = lambda c: ascii_lower(F.coalesce(c, F.lit("")))
    digest = digest or (lambda t: F.sha2(t.cast("binary"), 256))
    rows = _located(docs)
    keys = written(rows.select(digest(norm(F.col("doc")["text"])).alias("digest"), F.col("doc")["doc_id"].alias("id"),
                               "file", "row"), "dedup-digests")
    chosen = F.struct(*[F.col("doc")[c].alias(c) for c in columns]).alias("doc")
    if keys.isEmpty():
        return rows.select(chosen, F.col("doc")["doc_id"].alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                           F.lit(True).alias("kept"), F.lit("").alias("digest"))
    state = _state(spark, keys, files_per_batch)
    plan = written(keys.join(state.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d")).select(
        "digest", F.col("file").alias("f"), F.col("row").alias("r"), "keep", "n",
        ((F.col("file") == F.col("keep")["file"]) & (F.col("row") == F.col("keep")["row"])).alias("kept")), "dedup-plan")
    # the texts meet their rows' decisions by locator, a key without repeats
    found = written(rows.join(plan, (F.col("file") == F.col("f")) & (F.col("row") == F.col("r"))).select(
        chosen, F.col("doc")["doc_id"].alias("id"), "file", "row",
        F.when(F.col("n") > 1, F.coalesce(F.col("doc")["text"], F.lit(""))).alias("hit"), "digest", "keep", "n", "kept"), "dedup-found")
    hits = found.where("n > 1").select("digest", "hit")
    names = found.where("n > 1 and kept").select(F.col("digest").alias("d"), F.col("hit").alias("name"))
    differs = written(hits.join(names, F.col("digest") == F.col("d"))
                      .where((F.col("hit") != F.col("name")) & (norm(F.col("hit")) != norm(F.col("name"))))
                      .select("digest"), "dedup-differs")  # as a rule empty; no aggregation, so that a hot digest's join can be split
    remove(spark, keys, state, plan)
    same, collided = found, not differs.isEmpty()
    if collided:
        differs = differs.distinct()
        same = found.join(differs, "digest", "left_anti")
    out = same.select("doc", F.col("keep")["id"].alias("keep_id"), F.col("n").alias("group_size"), "kept", "digest")
    if collided:
        out = out.unionByName(_by_text(found.join(differs, "digest", "left_semi").withColumn("t", norm(F.col("hit")))))
    return out


def _by_text(rows: DataFrame) -> DataFrame:
    """Groups of rows that share a digest but not a text: the text ``t`` is the key."""
    rows = rows.withColumn("at", F.struct("id", "file", "row"))
    best = rows.groupBy("t").agg(F.max("at").alias("best"), F.count(F.lit(1)).alias("m"))
    return rows.join(written(best.withColumnRenamed("t", "u"), "dedup-texts"), F.col("t") == F.col("u")).select(
        "doc", F.col("best")["id"].alias("keep_id"), F.col("m").alias("group_size"),
        (F.col("at") == F.col("best")).alias("kept"), "digest")


def kept_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each text."""
    return deduplicate(docs).where("kept").select("doc.*")
