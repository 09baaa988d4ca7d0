"""The zipped CSV source: members, columns, quoting, odd zips."""
import csv
import io
import zipfile

import pytest

from lodestar.sources import zipped


def text(header, rows):
    out = io.StringIO()
    csv.writer(out).writerows([header, *rows])
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", text(["id", "Narrative text", "extra"], [["1", 'line\nbreak, "quoted"', "x"], ["2", "", "y"]]))
        z.writestr("deep/b.csv", text(["extra", "id", "Narrative text"], [["z", "3", "ünï"]]))  # another order
        z.writestr("deep/readme.txt", "not a table")
        z.writestr("none.csv", "")
        z.writestr("header.csv", "id,extra\n")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("c.csv", text(["id"], [[str(i)] for i in range(10, 20_000)]))  # a column is missing
    with zipfile.ZipFile(tmp_path / "void.zip", "w"):
        pass
    return str(tmp_path)


def test_members_are_partitions_and_columns_are_found_by_name(spark, folder):
    df = zipped.read_csv_zipped(spark, folder, ["Narrative text", "id"])
    assert df.columns == ["Narrative text", "id"] and df.rdd.getNumPartitions() == 4
    got = {r["id"]: r["Narrative text"] for r in df.collect()}
    assert len(got) == 3 + 19_990
    assert got["1"] == 'line\nbreak, "quoted"' and got["2"] is None and got["3"] == "ünï" and got["19999"] is None
    one = zipped.read_csv_zipped(spark, f"file:{folder}/one.zip", ["id"], pattern="b.*")
    assert [r["id"] for r in one.collect()] == ["3"]


def test_only_the_columns_asked_for_are_parsed(folder):
    reader = zipped.ZippedCsvReader(["id"], [folder], "*.csv")
    batches = [b for m in reader.partitions() for b in reader.read(m)]
    assert {tuple(b.schema.names) for b in batches} == {("id",)} and sum(b.num_rows for b in batches) == 3 + 19_990


def test_blocks_bound_the_memory(folder, monkeypatch):
    monkeypatch.setattr(zipped, "BLOCK", 4096)
    reader = zipped.ZippedCsvReader(["id"], [f"{folder}/two.zip"], "*.csv")
    batches = list(reader.read(reader.partitions()[0]))
    assert len(batches) > 10 and [int(x) for b in batches for x in b.column(0).to_pylist()] == list(range(10, 20_000))


def test_odd_zips(spark, folder):
    assert zipped.read_csv_zipped(spark, f"{folder}/void.zip", ["id"]).count() == 0
    with pytest.raises(Exception, match="nothing.zip"):
        zipped.read_csv_zipped(spark, f"{folder}/nothing.zip", ["id"]).count()
    with pytest.raises(Exception, match="text columns"):
        spark.read.format("zipped_csv").schema("id int").load(folder).count()


def test_round_trip(spark, tmp_path):
    df = spark.range(0, 5000, 1, 3).selectExpr("id", "CASE WHEN id % 7 > 0 THEN concat('a,\"', id, '\n') END AS t")
    path = zipped.write_csv_zipped(df, f"{tmp_path}/out", member_rows=600)
    back = zipped.read_csv_zipped(spark, path, ["t", "id"])
    assert back.rdd.getNumPartitions() == 9
    assert {(r["id"], r["t"]) for r in back.collect()} == {(str(r["id"]), r["t"]) for r in df.collect()}
