"""Report files against a manifest that knows what was sent."""
from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tripwright.plans.q_sources import _HEADER
from tripwright.schemas import REPORT_FIELDS
from tripwright.sources import archives, nested
from tripwright.storage import fresh_path, materialize

from conftest import rows


@pytest.fixture(scope="module")
def sent(spark):
    line = F.concat_ws(",", F.lit("STé"), F.lit("2024-01-01 00:00:00"), *[F.lit("M") for _ in REPORT_FIELDS])
    reports = spark.range(130).select((F.col("id") % 3).alias("batch"), "id", line.alias("line"))
    lines = materialize(archives.report_file_lines(reports, "batch", "id", "line", _HEADER, rows_per_file=20), "lines")
    path = fresh_path(spark, "reports")
    archives.write_report_files(lines, path)
    return lines, path


def files_of(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_files_follow_the_rows_and_start_with_their_header(spark, sent):
    lines, path = sent
    found = files_of(path)
    assert len(found) == lines.select("batch", "part").distinct().count() == 9  # 44, 43 and 43 rows in files of about 20
    for name in found:
        with open(name, encoding="utf-8") as f:
            text = f.read().splitlines()
        assert text[0].startswith("# station batch") and text[1] == _HEADER
    assert archives.read_reports(spark, f"{path}/*/*").count() == 130


def test_sound_files_pass_and_their_bytes_are_told(spark, sent):
    lines, path = sent
    problems = archives.file_problems(archives.file_digests(spark, path), archives.declared_files(lines))
    assert problems.filter("problem IS NOT NULL").count() == 0 and archives.sound_files(problems).count() == 9
    told = archives.declared_files(lines).agg(F.sum("n_bytes")).first()[0]
    assert told == sum(os.path.getsize(f) for f in files_of(path))


def test_every_problem_is_found_and_refused(spark, sent):
    lines, path = sent
    declared = materialize(archives.declared_files(lines), "declared")
    names = [r.source_file for r in declared.orderBy("source_file").collect()]
    digests = archives.file_digests(spark, path).filter(F.col("source_file") != names[0])
    told = declared.filter(F.col("source_file") != names[1])
    told = told.withColumns({"n_bytes": F.when(F.col("source_file") == names[2], 1).otherwise(F.col("n_bytes")),
                             "sha256": F.when(F.col("source_file") == names[3], "00").otherwise(F.col("sha256"))})
    problems = archives.file_problems(digests, told)
    assert rows(problems.filter("problem IS NOT NULL"), "source_file", "problem") == sorted(
        zip(names, ("missing_file", "unlisted_file", "wrong_size", "wrong_hash")), key=repr)
    with pytest.raises(Exception, match="unsound report file"):
        archives.sound_files(problems).collect()


def test_no_files_and_no_manifest(spark, sent):
    lines, _ = sent
    empty = archives.declared_files(lines).limit(0)
    assert archives.file_problems(empty.drop("batch"), empty).count() == 0
    assert archives.file_problems(empty.drop("batch"), archives.declared_files(lines)).filter("problem = 'missing_file'").count() == 9


def test_multi_line_collections(spark):
    path = fresh_path(spark, "stations")
    spark.sql("""SELECT 1 AS part, '{"features": [\n {"id": "A", "properties": {"name": "x"},\n  "geometry": {"coordinates": [1.5, 2]}},
      {"id": "B", "geometry": {"coordinates": [3]}}\n]}' AS value""").write.partitionBy("part").text(path)
    got = nested.read_station_collections(spark, path)
    assert rows(got, "station", "longitude", "latitude") == [("A", 1.5, 2.0), ("B", None, None)]
