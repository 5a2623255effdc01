"""Station report archives and zipped schedule files."""
from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tripwright.operators.report import count_if
from tripwright.sources import file_stream
from tripwright.sources.csv_files import READ_OPTIONS, text_with_null_token
from tripwright.schemas import REPORT_FIELDS, REPORT_NUMERIC, REPORT_SCHEMA


# ---- station reports --------------------------------------------------------

def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All report files under a path as raw text rows: '#' lines are comments, 'M' is null, blank
    stays blank. ``source_file`` keeps where a row came from."""
    raw = (spark.read.schema(REPORT_SCHEMA).options(**READ_OPTIONS).option("comment", "#").csv(path)
           .select("*", F.col("_metadata.file_path").alias("source_file")))
    return text_with_null_token(raw, "M")


def _is_number(c: Column) -> Column:
    parsed = c.try_cast("double")
    return parsed.isNotNull() & ~F.isnan(parsed) & (F.abs(parsed) != float("inf"))


def typed_reports(raw: DataFrame, manifest: DataFrame) -> DataFrame:
    """Typed reports with their request's provenance; text that is no number raises at run time.

    ``manifest`` has one row per file: source_file, request_id, window_start, window_end,
    stations (array), n_rows.
    """
    joined = raw.join(manifest.select("source_file", "request_id", "window_start", "window_end"), "source_file")

    def numeric(name: str) -> Column:
        v = F.trim(F.col(name))
        bad = F.raise_error(F.concat(F.lit(f"{name} is not a number: "), v)).cast("double")
        return F.when(v.isNull() | (v == ""), F.lit(None).cast("double")).when(_is_number(v), v.try_cast("double")).otherwise(bad)

    fields = [numeric(f).alias(f) if f in REPORT_NUMERIC else F.col(f) for f in REPORT_FIELDS]
    return joined.select(
        "station", F.col("valid").cast("timestamp_ntz").alias("observed_at"), *fields,
        F.col("request_id").alias("source_request_id"), F.col("window_start").alias("source_window_start_utc"),
        F.col("window_end").alias("source_window_end_utc"))


def report_file_lines(rows: DataFrame, batch: str, identifier: str, line: str, header: str, *, rows_per_file: int = 20_000) -> DataFrame:
    """(batch, part, position, value): every line of the report files of each batch, a comment and the
    header first. Rows are dealt to files by hash, and the number of files follows the rows of the batch."""
    sizes = rows.groupBy(batch).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("_files"))
    dealt = rows.join(sizes, batch).select(
        F.col(batch).alias("batch"), F.pmod(F.xxhash64(identifier), F.col("_files")).cast("int").alias("part"),
        F.col(identifier).cast("bigint").alias("position"), F.col(line).alias("value"))
    files = sizes.select(F.col(batch).alias("batch"), F.explode(F.sequence(F.lit(0), F.col("_files") - 1)).alias("part"))
    heads = files.select("batch", "part", F.inline(F.array(
        F.struct(F.lit(-2).cast("bigint").alias("position"), F.concat(F.lit("# station batch "), F.col("batch").cast("string")).alias("value")),
        F.struct(F.lit(-1).cast("bigint").alias("position"), F.lit(header).alias("value")))))
    return heads.unionByName(dealt)


def write_report_files(lines: DataFrame, path: str) -> None:
    """One text file per (batch, part), its lines by position, under ``batch=../part=..``."""
    (lines.repartition("batch", "part").sortWithinPartitions("batch", "part", "position")
     .select("batch", "part", "value").write.partitionBy("batch", "part").text(path))


# The part of a path that names a report file in manifests.
REPORT_FILE = r"(batch=[^/]+/part=[^/]+)/"


def file_name(path: Column, pattern: str = REPORT_FILE) -> Column:
    return F.regexp_extract(path, pattern, 1)


def declared_files(lines: DataFrame) -> DataFrame:
    """(source_file, batch, n_bytes, sha256) that the lines of each file must give; a file is one group."""
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"]), "\n"), F.lit("\n"))
    name = F.concat(F.lit("batch="), F.col("batch").cast("string"), F.lit("/part="), F.col("part").cast("string"))
    return lines.groupBy("batch", "part").agg(text.alias("_t")).select(
        name.alias("source_file"), "batch", F.octet_length("_t").cast("bigint").alias("n_bytes"), F.sha2("_t", 256).alias("sha256"))


def file_digests(spark: SparkSession, folder: str, pattern: str = REPORT_FILE, **options: object) -> DataFrame:
    """(source_file, n_bytes, sha256) of the files as they are, read block by block."""
    files = file_stream.load(spark, file_stream.FileDigests, folder, **options)
    return files.select(file_name(F.col("path"), pattern).alias("source_file"), "n_bytes", "sha256")


def file_problems(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest's columns with ``problem``: missing_file, unlisted_file, wrong_size, wrong_hash, or null
    for a sound file. A file of the right size is wrong by its hash only."""
    found = files.select("source_file", F.col("n_bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    problem = (F.when(F.col("_sha256").isNull(), "missing_file").when(F.col("sha256").isNull(), "unlisted_file")
               .when(F.col("_bytes") != F.col("n_bytes"), "wrong_size").when(F.col("_sha256") != F.col("sha256"), "wrong_hash"))
    return manifest.join(found, "source_file", "full_outer").select(*manifest.columns, problem.alias("problem"))


def sound_files(problems: DataFrame) -> DataFrame:
    """The manifest of files that are all sound; any problem fails the job before a row is typed."""
    refused = F.raise_error(F.concat(F.lit("unsound report file: "), F.col("source_file"), F.lit(" "), F.col("problem")))
    name = F.when(F.col("problem").isNull(), F.col("source_file")).otherwise(refused.cast("string"))
    return problems.withColumn("source_file", name).drop("problem")


def archive_violations(raw: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per file: rows read and expected, foreign stations, times outside the window or missing, junk numbers."""
    joined = raw.join(manifest, "source_file", "full_outer")
    at = F.col("valid").try_cast("timestamp_ntz")
    here = F.col("valid").isNotNull() | F.col("station").isNotNull()
    junk = F.lit(False)
    for f in REPORT_NUMERIC:
        v = F.trim(F.col(f))
        junk = junk | F.coalesce((v != "") & ~_is_number(v), F.lit(False))
    return joined.groupBy("source_file").agg(
        count_if(here).alias("rows_read"), F.max("n_rows").alias("rows_expected"),
        count_if(here & ~F.coalesce(F.array_contains("stations", F.col("station")), F.lit(False))).alias("foreign_station"),
        count_if(here & at.isNull()).alias("missing_time"),
        count_if(at.isNotNull() & ~at.between(F.col("window_start"), F.col("window_end"))).alias("out_of_window"),
        count_if(junk).alias("non_numeric"))


# ---- zipped schedules -------------------------------------------------------

# The part of a path that names an archive: what its rows' year and month must be.
ARCHIVE_FILE = r"([^/]+_\d+_\d+\.zip)$"


def write_archives(packed: DataFrame, folder: str) -> None:
    """The (path, content) archives as files; one that a task repeats replaces itself."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, place = file_stream.opened(folder)
        system.create_dir(place)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                under_way = f"{place}/_{uuid.uuid4().hex}"
                with system.open_output_stream(under_way, compression=None) as stream:
                    stream.write(content)
                system.move(under_way, f"{place}/{path}")
            yield batch[["path"]]

    packed.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()


def archive_digests(packed: DataFrame) -> DataFrame:
    """The manifest (source_file, n_bytes, sha256) of archives as they were packed."""
    return packed.select(F.col("path").alias("source_file"), F.octet_length("content").cast("bigint").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def read_zipped(spark: SparkSession, folder: str, manifest: DataFrame, schema: T.StructType, year: str, month: str, **options: object) -> DataFrame:
    """Rows of each archive's single CSV member, as text columns cast to ``schema``.

    Every file is compared with the manifest by size and SHA-256; a lost, unlisted or changed one, several
    members, or a row of another year and month than the file's name says (``..._<year>_<month>.zip``) raises.
    """
    problems = file_problems(file_digests(spark, folder, ARCHIVE_FILE, suffix=".zip", **options), manifest)
    refused = F.raise_error(F.concat(F.lit("unsound archive: "), F.col("source_file"), F.lit(" "), F.col("problem"))).cast("boolean")
    # no row comes from here, but a problem of any file, rows or not, fails the job
    none = problems.filter(F.when(F.col("problem").isNull(), F.lit(False)).otherwise(refused)).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    raw = file_stream.load(spark, file_stream.ZippedCsv, folder, ["path", *schema.names], suffix=".zip", **options)
    named = F.split(F.regexp_extract("path", r"_(\d+_\d+)\.zip$", 1), "_")
    typed = raw.select("path", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    right = (F.col(year) == named[0].try_cast("int")) & (F.col(month) == named[1].try_cast("int"))
    checked = F.when(F.coalesce(right, F.lit(False)), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("row outside the archive's month: "), F.col("path"))).cast("boolean"))
    return typed.filter(checked).drop("path").unionByName(none)


def zip_by_month(df: DataFrame, year: str, month: str, rows_per_archive: int = 200_000) -> DataFrame:
    """(path, content) archives of a table, several per month when a month is large.

    Rows are dealt to archives by hash, so no archive grows with its month.
    """
    sizes = df.groupBy(year, month).agg(F.ceil(F.count(F.lit(1)) / rows_per_archive).alias("_parts"))
    dealt = df.join(sizes, [year, month]).withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.col("_parts")))
    columns = df.columns

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(zipfile.ZipInfo("part.csv", (1980, 1, 1, 0, 0, 0)), pdf[columns].to_csv(index=False), zipfile.ZIP_DEFLATED)
        name = f"part{int(pdf['_part'].iloc[0])}_{int(pdf[year].iloc[0])}_{int(pdf[month].iloc[0])}.zip"
        return pd.DataFrame({"path": [name], "content": [buffer.getvalue()]})

    return dealt.groupBy(year, month, "_part").applyInPandas(pack, "path string, content binary")


def land_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    df.repartition(*keys).write.partitionBy(*keys).parquet(path)
