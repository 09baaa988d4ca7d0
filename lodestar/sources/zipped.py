"""Zipped CSV files as a Spark data source.

``spark.read.format("zipped_csv").schema(...).load(path)``: the zips' directories are read for planning, each
member is a partition, and a task streams its member (deflate can't be split) through an Arrow CSV
reader that parses the schema's columns only, so that memory is bounded by blocks, not by members.
Files are opened through pyarrow's file systems, wherever driver and executors both reach them.
"""

from __future__ import annotations

import fnmatch
import io
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: bytes of a member that are parsed at a time; a record must fit in it
BLOCK = 4 << 20


def _located(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path; a bare path or ``file:`` is local."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pa.fs.LocalFileSystem(), path) if "://" not in path else pa.fs.FileSystem.from_uri(path)


class _File(io.RawIOBase):
    """An Arrow file as Python's own: a position before the start is an OSError, which zipfile counts on."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        return self.file.readinto(buffer)

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("before the start of the file")
        self.file.seek(at)
        return at


def _zip(system: pa.fs.FileSystem, path: str) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BufferedReader(_File(system.open_input_file(path)), 1 << 16))


class Member(InputPartition):
    def __init__(self, path: str, name: str):
        super().__init__((path, name))
        self.path, self.name = path, name


class ZippedCsvReader(DataSourceReader):
    def __init__(self, columns: Sequence[str], paths: Sequence[str], pattern: str):
        self.columns, self.paths, self.pattern = list(columns), list(paths), pattern

    def partitions(self) -> list[Member]:
        """The members by zip and name; folders, empty members and other names are left out."""
        out = []
        for path in self.paths:
            system, where = _located(path)
            info = system.get_file_info(where)
            if info.type == pa.fs.FileType.NotFound:
                raise FileNotFoundError(path)
            zips = [where] if info.is_file else sorted(
                f.path for f in system.get_file_info(pa.fs.FileSelector(where)) if f.is_file and f.path.endswith(".zip"))
            for z in zips:
                with _zip(system, z) as members:
                    full = path if info.is_file else path.rstrip("/") + "/" + z.rsplit("/", 1)[1]
                    out += [Member(full, m.filename) for m in members.infolist()
                            if not m.is_dir() and m.file_size and fnmatch.fnmatch(m.filename.rsplit("/", 1)[-1], self.pattern)]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's call for a source without partitions
            return
        system, where = _located(partition.path)
        text = {c: pa.string() for c in self.columns}
        convert = pa.csv.ConvertOptions(column_types=text, include_columns=self.columns, include_missing_columns=True, null_values=[""],
                                        strings_can_be_null=True, quoted_strings_can_be_null=False)
        with _zip(system, where) as members, members.open(partition.name) as member:
            rows = pa.csv.open_csv(pa.PythonFile(member, "r"), pa.csv.ReadOptions(block_size=BLOCK, use_threads=False),
                                   pa.csv.ParseOptions(newlines_in_values=True), convert)
            for batch in rows:
                if batch.num_rows:
                    yield batch


class ZippedCsv(DataSource):
    """Options: ``path`` (a zip, or a folder of them), ``pattern`` of member names (default ``*.csv``). All columns are text."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def reader(self, schema: StructType) -> DataSourceReader:
        if any(not isinstance(f.dataType, StringType) for f in schema.fields):
            raise ValueError("zipped_csv reads text columns only: cast afterwards")
        return ZippedCsvReader(schema.names, [self.options["path"]], self.options.get("pattern", "*.csv"))


def read_csv_zipped(spark: SparkSession, path: str, keep: Sequence[str], pattern: str = "*.csv") -> DataFrame:
    """The columns ``keep`` of all members of a zip, or of a folder's zips, as text. Columns are found by
    each member's header; one that a member lacks is null there. Empty fields are null, quoted empty ones
    empty texts; fields may hold line breaks. Zips or members without rows give none."""
    spark.dataSource.register(ZippedCsv)
    return spark.read.format("zipped_csv").schema(StructType([StructField(c, StringType()) for c in keep])).option("pattern", pattern).load(path)


def write_csv_zipped(df: DataFrame, folder: str, member_rows: int = 100_000) -> str:
    """Each partition of ``df`` as a zip of CSV members of ``member_rows`` rows, written by its own task;
    lists and structs are not supported. A task that is tried again writes a zip of another name, and those of failed
    tries are deleted in the end."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = _located(folder)
        system.create_dir(where, recursive=True)
        name, member, left, n = f"{uuid.uuid4().hex}.zip", None, 0, 0
        with system.open_output_stream(f"{where}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for batch in batches:
                while batch.num_rows:
                    if not left:
                        if member:
                            member.close()
                        member, left, n = archive.open(f"part-{n:05d}.csv", "w", force_zip64=True), member_rows, n + 1
                        pa.csv.write_csv(batch.slice(0, 0), member)
                    some = batch.slice(0, left)
                    pa.csv.write_csv(some, member, pa.csv.WriteOptions(include_header=False))
                    left, batch = left - some.num_rows, batch.slice(some.num_rows)
            if member:
                member.close()
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    done = {r["name"] for r in df.mapInArrow(write, "name string").collect()}  # a name a partition
    system, where = _located(folder)
    for f in system.get_file_info(pa.fs.FileSelector(where, allow_not_found=True)):
        if f.base_name not in done:
            system.delete_file(f.path)
    return folder
