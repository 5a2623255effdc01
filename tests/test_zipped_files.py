"""Zipped schedules read as streams: whole rows, tasks by bytes, and every planted fault."""
from __future__ import annotations

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F, types as T

from tripwright.sources import archives, file_stream
from tripwright.storage import fresh_path

SCHEMA = T.StructType([T.StructField("yr", T.IntegerType()), T.StructField("mo", T.IntegerType()), T.StructField("name", T.StringType())])
PLACES = [(2023, 1), (2023, 2), (2024, 1)]


def zipped(*members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members:
            archive.writestr(name, data)
    return buffer.getvalue()


def table(year, month, n=40):
    return "name,unused,mo,yr\n" + "".join(f'"a, {i}\n{"" if i % 3 else "é"}",x,{month},{year}\n' for i in range(n))


@pytest.fixture
def sent(spark):
    packed = spark.createDataFrame([(f"part0_{y}_{m}.zip", bytearray(zipped(("rows.csv", table(y, m)), ("read.me", "x")))) for y, m in PLACES],
                                   "path string, content binary").cache()
    folder = fresh_path(spark, "zipped")
    archives.write_archives(packed, folder)
    return packed, folder


def read(spark, packed, folder, **options):
    return archives.read_zipped(spark, folder, archives.archive_digests(packed), SCHEMA, "yr", "mo", **options)


def test_every_row_comes_back(spark, sent):
    got = sorted(map(tuple, read(spark, *sent).collect()))
    assert got == sorted((y, m, f"a, {i}\n{'' if i % 3 else 'é'}") for y, m in PLACES for i in range(40))
    assert not [f for f in os.listdir(sent[1]) if f.startswith("_")]


def test_chunks_and_blocks_do_not_change_the_rows(spark, sent, monkeypatch):
    reader = file_stream.ZippedCsvReader({"path": sent[1], "suffix": ".zip", "task_bytes": "1"}, T.StructType([T.StructField(c, T.StringType()) for c in ("name", "path")]))
    monkeypatch.setattr(file_stream, "CHUNK_ROWS", 7)
    batches = list(reader.read(reader.partitions()[0]))
    assert [b.num_rows for b in batches] == [7, 7, 7, 7, 7, 5] and batches[0].schema.names == ["name", "path"]


def test_tasks_follow_the_bytes(spark, sent):
    assert [f.paths for f in file_stream.dealt([("b", 5), ("a", 4), ("c", 1), ("d", 90)], 10)] == [("a", "b", "c"), ("d",)]
    assert file_stream.dealt([], 10) == []
    assert read(spark, *sent, task_bytes=1).filter("name is not null").select(F.spark_partition_id()).distinct().count() == 3


@pytest.mark.parametrize("fault, told", [
    ("lost", "missing_file"), ("cut", "wrong_size"), ("changed", "wrong_hash"), ("added", "unlisted_file"), ("all", "missing_file")])
def test_unsound_files_fail_the_job(spark, sent, fault, told):
    packed, folder = sent
    names = sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".zip"))
    with open(names[0], "rb") as f:
        data = f.read()
    if fault == "added":
        open(os.path.join(folder, "part9_2023_1.zip"), "wb").write(data)
    elif fault in ("lost", "all"):
        for name in names[: 1 if fault == "lost" else None]:
            os.rename(name, name + ".gone")
    else:
        open(names[0], "wb").write(data[:-1] if fault == "cut" else data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(Exception, match=told):
        read(spark, packed, folder).count()


@pytest.mark.parametrize("members, told", [
    ((("a.csv", table(2023, 1)), ("b.csv", table(2023, 1))), "one CSV"), ((("a.txt", "x"),), "one CSV"),
    ((("a.csv", table(2023, 2)),), "outside the archive"), ((("a.csv", "name,mo,yr\nx,,\n"),), "outside the archive"), (None, "sound archive")])
def test_archives_that_hold_something_else_raise(spark, members, told):
    content = zipped(*members) if members else b"no archive"
    packed = spark.createDataFrame([("part0_2023_1.zip", bytearray(content))], "path string, content binary")
    folder = fresh_path(spark, "zipped")
    archives.write_archives(packed, folder)
    with pytest.raises(Exception, match=told):
        read(spark, packed, folder).collect()


def test_a_member_without_rows_and_bytes_that_are_no_text(spark):
    packed = spark.createDataFrame([("p_2023_1.zip", bytearray(zipped(("a.csv", "name,mo,yr\n")))), ("p_2023_2.zip", bytearray(zipped(("a.csv", b"name,mo,yr\n\xff!,2,2023\n"))))],
                                   "path string, content binary")
    folder = fresh_path(spark, "zipped")
    archives.write_archives(packed, folder)
    assert [tuple(r) for r in read(spark, packed, folder).collect()] == [(2023, 2, "�!")]
