"""Sources and sinks: each query writes rows of the given tables and reads them back."""
from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tripwright import fixtures as fx
from tripwright.operators.contracts import source_rows
from tripwright.plans.registry import query
from tripwright.schemas import REPORT_FIELDS, SOURCE_COLUMNS
from tripwright.sources import archives, csv_files, ledger, nested
from tripwright.storage import fresh_path, materialize

V = ("flights",)


def _source_frame(spark, sf):
    """Flights under the source CSV's own column names, plus a stale hour column."""
    rows = fx.flights(spark, sf)
    have = set(rows.columns)
    columns = [F.col(short).cast("string").alias(name) if short in have else F.lit("0").alias(name)
               for name, short in SOURCE_COLUMNS.items()]
    return rows.select(*columns, F.lit("99").alias("Dep_Hour"))


@query("s1_csv_scan", """SELECT CAST(flight_id AS VARCHAR) AS flight_id, mo, dom, CAST(dep_hhmm AS DOUBLE) AS dep_hhmm, CAST(arr_hhmm AS DOUBLE) AS arr_hhmm,
 CAST(origin AS VARCHAR) AS origin, CAST(distance AS DOUBLE) AS distance, airline, delay FROM flights""", V)
def csv_scan(spark, sf):
    path = fresh_path(spark, "trips-csv")
    _source_frame(spark, sf).write.option("header", True).csv(path)
    return csv_files.read_trips(spark, path, with_weather=True, columns=[
        "ID", "Month", "Day_of_Month", "Estimated_Departure_Time", "Estimated_Arrival_Time", "Origin_Airport", "Distance", "Airline", "Delay"])


_TEXT_ROWS = ("CAST(flight_id AS {t}) AS id", "CASE WHEN flight_id % 3 = 0 THEN '' WHEN flight_id % 5 <> 0 THEN airline END AS note",
              "CAST(dep_hhmm AS DOUBLE) AS dep")
_TEXT_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("note", T.StringType()), T.StructField("dep", T.DoubleType())])
_TEXT_SQL = "SELECT " + ", ".join(c.format(t="VARCHAR") for c in _TEXT_ROWS) + " FROM flights"


@query("s2_null_token_csv_scan", _TEXT_SQL, V)
def null_token_csv_scan(spark, sf):
    path = fresh_path(spark, "null-token")
    csv_files.write_null_token(fx.flights(spark, sf).selectExpr(*[c.format(t="STRING") for c in _TEXT_ROWS]), path, order="id")
    return csv_files.read_null_token(spark, path, _TEXT_SCHEMA)


@query("s3_null_token_csv_sink", "SELECT count(*) AS n_rows, count(note) AS notes, count(*) FILTER (note = '') AS blanks, CAST(0 AS BIGINT) AS reserved_values FROM (" + _TEXT_SQL + ")", V)
def null_token_csv_sink(spark, sf):
    rows = fx.flights(spark, sf).selectExpr(*[c.format(t="STRING") for c in _TEXT_ROWS])
    path = fresh_path(spark, "null-token")
    csv_files.write_null_token(rows, path)
    back = csv_files.read_null_token(spark, path, _TEXT_SCHEMA)
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.count("note").alias("notes"), F.count(F.when(F.col("note") == "", 1)).alias("blanks")
                    ).withColumn("reserved_values", csv_files.reserved_token_count(rows).scalar())


_REPORTS_SQL = """raw AS (SELECT 'ST' || CAST(user_id % 4 AS VARCHAR) AS station, date_trunc('second', ts)::TIMESTAMP AS observed_at, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE round(value, 2) END AS tmpf,
 CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 9 = 0 THEN NULL ELSE 'RA' END AS wxcodes, 'req' || CAST(user_id % 4 AS VARCHAR) AS source_request_id FROM events WHERE event_type = 'view')"""


_HEADER = ",".join(("station", "valid", *REPORT_FIELDS))


def _views(spark, sf):
    return fx.table(spark, sf, "events").filter("event_type = 'view'").withColumn("batch", F.col("user_id") % 4)


def _report_lines(events, station="concat('ST', batch)", valid="date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
                  tmpf="CASE WHEN event_id % 6 = 0 THEN 'M' WHEN event_id % 11 = 0 THEN '' ELSE CAST(round(value, 2) AS STRING) END"):
    """The lines of report files with comments and 'M' tokens."""
    fields = {f: F.lit("M") for f in REPORT_FIELDS}
    fields["tmpf"] = F.expr(tmpf)
    fields["wxcodes"] = F.expr("CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 9 = 0 THEN 'M' ELSE 'RA' END")
    line = F.concat_ws(",", F.expr(station), F.expr(valid), *[fields[f] for f in REPORT_FIELDS])
    return archives.report_file_lines(events.withColumn("line", line), "batch", "event_id", "line", _HEADER)


def _manifest(events, lines):
    """What was sent, from the events themselves and not from the files: one entry per file."""
    windows = events.groupBy("batch").agg(F.date_trunc("second", F.min("ts")).cast("timestamp_ntz").alias("window_start"),
                                          F.max("ts").cast("timestamp_ntz").alias("window_end"))
    counts = lines.filter("position >= 0").groupBy("batch", "part").agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.expr("concat('batch=', batch, '/part=', part) AS source_file"), "n_rows")
    return (archives.declared_files(lines).join(windows, "batch").join(counts, "source_file", "left").fillna({"n_rows": 0})
            .withColumn("stations", F.array(F.expr("concat('ST', batch)"))).withColumn("request_id", F.expr("concat('req', batch)")))


def _read(spark, path):
    raw = archives.read_reports(spark, f"{path}/*/*")
    return raw.withColumn("source_file", archives.file_name(F.col("source_file")))


@query("s4_observation_archive_scan", f"WITH {_REPORTS_SQL} SELECT station, observed_at, tmpf, wxcodes, source_request_id FROM raw")
def observation_archive_scan(spark, sf):
    events, path = _views(spark, sf), fresh_path(spark, "reports")
    lines = materialize(_report_lines(events), "report-lines")
    archives.write_report_files(lines, path)
    problems = archives.file_problems(archives.file_digests(spark, path), _manifest(events, lines))
    return archives.typed_reports(_read(spark, path), archives.sound_files(problems)).select(
        "station", "observed_at", "tmpf", "wxcodes", "source_request_id")


# Some reports are lost, under another station, without a time, late, or no number; the manifest knows what was sent.
_LOST, _FOREIGN, _UNTIMED, _LATE, _JUNK = (f"event_id % {n} = 0" for n in (83, 97, 103, 101, 89))


@query("s4_archive_violations", f"""WITH v AS (SELECT *, user_id % 4 AS batch FROM events WHERE event_type = 'view')
SELECT 'req' || CAST(batch AS VARCHAR) AS request_id, count(*) FILTER (NOT {_LOST}) AS rows_read, count(*) AS rows_expected, count(*) FILTER ({_FOREIGN} AND NOT {_LOST}) AS foreign_station,
 count(*) FILTER ({_UNTIMED} AND NOT {_LOST}) AS missing_time, count(*) FILTER ({_LATE} AND NOT {_UNTIMED} AND NOT {_LOST}) AS out_of_window, count(*) FILTER ({_JUNK} AND NOT {_LOST}) AS non_numeric FROM v GROUP BY batch""")
def archive_violations(spark, sf):
    events, path = _views(spark, sf), fresh_path(spark, "reports")
    faulty = _report_lines(
        events, f"CASE WHEN {_FOREIGN} THEN 'ST9' ELSE concat('ST', batch) END",
        f"CASE WHEN {_UNTIMED} THEN '' ELSE date_format(CASE WHEN {_LATE} THEN ts + INTERVAL 9000 DAYS ELSE ts END, 'yyyy-MM-dd HH:mm:ss') END",
        f"CASE WHEN {_JUNK} THEN 'warm' ELSE CAST(round(value, 2) AS STRING) END")
    archives.write_report_files(faulty.filter(f"position < 0 OR NOT {_LOST.replace('event_id', 'position')}"), path)
    manifest = _manifest(events, materialize(_report_lines(events), "report-lines"))
    found = archives.archive_violations(_read(spark, path), manifest)
    counts = ("rows_read", "rows_expected", "foreign_station", "missing_time", "out_of_window", "non_numeric")
    return found.join(manifest.select("source_file", "request_id"), "source_file").groupBy("request_id").agg(*[F.sum(c).alias(c) for c in counts])


@query("s4_archive_integrity", """WITH v AS (SELECT user_id % 4 AS batch, CAST(ceil(count(*) / 20000) AS BIGINT) AS files FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT problem, CAST(sum(n) AS BIGINT) AS n_files FROM (SELECT 'sound' AS problem, files - CAST(batch IN (0, 3) AS INT) AS n FROM v WHERE batch <> 1 AND batch <> 2 UNION ALL SELECT 'wrong_size', files FROM v WHERE batch = 1
 UNION ALL SELECT 'wrong_hash', files FROM v WHERE batch = 2 UNION ALL SELECT 'missing_file', 1 FROM v WHERE batch = 3 UNION ALL SELECT 'unlisted_file', 1 FROM v WHERE batch = 0) GROUP BY problem HAVING sum(n) > 0""")
def archive_integrity(spark, sf):
    """Files of batch 1 got longer, those of batch 2 changed a letter, one of batch 3 was lost, and one of batch 0 is not listed."""
    events, path = _views(spark, sf), fresh_path(spark, "reports")
    lines = materialize(_report_lines(events), "report-lines")
    changed = lines.withColumn("value", F.when((F.col("position") == -2) & (F.col("batch") == 1), F.concat("value", F.lit(" resent")))
                               .when((F.col("position") == -2) & (F.col("batch") == 2), F.regexp_replace("value", "station", "statiom"))
                               .otherwise(F.col("value")))
    archives.write_report_files(changed.filter("NOT (batch = 3 AND part = 0)"), path)
    problems = archives.file_problems(archives.file_digests(spark, path), archives.declared_files(lines.filter("NOT (batch = 0 AND part = 0)")))
    return problems.groupBy(F.coalesce("problem", F.lit("sound")).alias("problem")).agg(F.count(F.lit(1)).alias("n_files"))


@query("s5_zip_archive_landing", "SELECT flight_id, yr, mo, dom, dep_hhmm, carrier_code, airline FROM flights", V)
def zip_archive_landing(spark, sf):
    rows = fx.flights(spark, sf).select("flight_id", "yr", "mo", "dom", "dep_hhmm", "carrier_code", "airline")
    packed = materialize(archives.zip_by_month(rows.withColumn("dep_hhmm", F.col("dep_hhmm").cast("string")), "yr", "mo"), "packed")
    zipped, landed = fresh_path(spark, "zipped"), fresh_path(spark, "schedules")
    archives.write_archives(packed, zipped)
    archives.land_partitioned(archives.read_zipped(spark, zipped, archives.archive_digests(packed), rows.schema, "yr", "mo"), landed, ["yr", "mo"])
    return spark.read.parquet(landed).select(*rows.columns)


@query("s6_nested_json_scan", """SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS station, s_name AS name, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 170 AS DOUBLE) END AS longitude,
 CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 90 AS DOUBLE) END AS latitude FROM supplier""")
def nested_json_scan(spark, sf):
    suppliers = fx.table(spark, sf, "supplier").selectExpr(
        "concat('S', s_suppkey) AS id", "map('name', s_name) AS properties",
        "named_struct('coordinates', CASE WHEN s_suppkey % 5 <> 0 THEN array(CAST(s_suppkey % 170 AS DOUBLE), CAST(s_suppkey % 90 AS DOUBLE))"
        " ELSE array(1D) END) AS geometry")
    path = fresh_path(spark, "stations")
    # collections of a thousand stations, one indented JSON text per file
    dealt = suppliers.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(suppliers.agg(F.count(F.lit(1)).alias("n")).scalar() / 1000)))
    collections = dealt.groupBy("part").agg(F.collect_list(F.struct("id", "properties", "geometry")).alias("features"))
    (collections.select("part", F.to_json(F.struct("features"), {"pretty": "true"}).alias("value"))
     .repartition("part").write.partitionBy("part").text(path))
    return nested.read_station_collections(spark, path).select(
        "station", F.element_at("properties", "name").alias("name"), "longitude", "latitude")


@query("s7_json_column_decode", """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, round(CAST(json_extract(props, '$.k') AS DOUBLE) / 2 + 1, 6) AS list_sum FROM events""")
def json_column_decode(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", nested.decode_scores(F.col("props")).alias("m"))
    k = F.element_at("m", "k")
    text = F.to_json(F.array(k / 2, F.lit(1.0)))
    return events.select("event_id", k.alias("k"), F.round(F.aggregate(
        nested.decode_list(text), F.lit(0.0), lambda a, x: a + x), 6).alias("list_sum"))


@query("s8_sample_prefix", "SELECT flight_id, mo, distance FROM flights ORDER BY flight_id LIMIT 500", V)
def sample_prefix(spark, sf):
    return csv_files.sample_prefix(fx.flights(spark, sf).select("flight_id", "mo", "distance"), "flight_id", 500)


@query("s9_extract_csv_sink", """SELECT airline, count(*) AS n_rows, round(avg(distance), 6) AS mean_distance, round(avg(distance) / 1e6, 12) AS mean_megamiles FROM flights WHERE airline IS NOT NULL GROUP BY airline""", V)
def extract_csv_sink(spark, sf):
    table = fx.flights(spark, sf).filter("airline IS NOT NULL").groupBy("airline").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("distance").alias("mean_distance"), (F.avg("distance") / 1e6).alias("mean_megamiles"))
    path = fresh_path(spark, "extract")
    csv_files.write_extract(table, path, order=["airline"])
    schema = T.StructType([T.StructField("airline", T.StringType()), T.StructField("n_rows", T.LongType()),
                           T.StructField("mean_distance", T.DoubleType()), T.StructField("mean_megamiles", T.DoubleType())])
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.withColumn("mean_distance", F.round("mean_distance", 6)).withColumn("mean_megamiles", F.round("mean_megamiles", 12))


_EXTRACT_TEXT = "'airline,n_rows' || chr(10) || string_agg(airline || ',' || CAST(n AS VARCHAR), chr(10) ORDER BY airline) || chr(10)"


@query("s9_extract_record", f"""WITH t AS (SELECT airline, count(*) AS n FROM flights WHERE airline IS NOT NULL GROUP BY airline), x AS (SELECT count(*) AS n_rows, {_EXTRACT_TEXT} AS body FROM t)
SELECT n_rows, CAST(strlen(body) AS BIGINT) AS n_bytes, sha256(body) AS sha256 FROM x""", V)
def extract_record(spark, sf):
    table = fx.flights(spark, sf).filter("airline IS NOT NULL").groupBy("airline").agg(F.count(F.lit(1)).alias("n_rows"))
    return csv_files.write_extract(table, fresh_path(spark, "extract"), order=["airline"])


def _ledger(spark, sf):
    return fx.table(spark, sf, "orders").selectExpr("concat('run', o_custkey % 3) AS run_id", "concat('phase', o_orderkey) AS phase_key",
                                                    "o_totalprice AS score")


@query("s10_ledger_upsert", """SELECT 'run' || CAST(o_custkey % 3 AS VARCHAR) AS run_id, 'phase' || CAST(o_orderkey AS VARCHAR) AS phase_key, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS score FROM orders""")
def ledger_upsert(spark, sf):
    old = _ledger(spark, sf)
    folder = fresh_path(spark, "ledger")
    ledger.write_version(spark, old, folder, 1)
    rerun = old.filter(F.substring("phase_key", -1, 1) == "0").withColumn("score", F.col("score") + 1)
    ledger.write_version(spark, ledger.upsert(ledger.latest_version(spark, folder), rerun), folder, 2)
    return ledger.latest_version(spark, folder).select("run_id", "phase_key", "score")


@query("s11_ledger_validated_read", """WITH r AS (SELECT 'run' || CAST(o_custkey % 3 AS VARCHAR) AS run_id, 'phase' || CAST(o_orderkey % 5000 AS VARCHAR) AS phase_key, CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS score FROM orders)
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT phase_key FROM r GROUP BY 1 HAVING count(*) > 1)) AS repeated_phases, count(*) FILTER (run_id <> 'run0') AS foreign_runs, count(*) FILTER (score IS NULL) AS malformed_rows FROM r""")
def ledger_validated_read(spark, sf):
    rows = fx.table(spark, sf, "orders").selectExpr(
        "concat('run', o_custkey % 3) AS run_id", "concat('phase', o_orderkey % 5000) AS phase_key", "CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS score")
    return ledger.ledger_violations(rows, "run0")


@query("s12_ordered_partition_merge", """SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS join_ordinal, value FROM events ORDER BY event_id""")
def ordered_partition_merge(spark, sf):
    numbered = source_rows(fx.table(spark, sf, "events").select("event_id", "value"), "event_id").withColumnRenamed("source_row", "join_ordinal")
    late = numbered.filter("value > 100")
    rest = numbered.filter("NOT value > 100")
    return csv_files.ordered_merge([late, rest], "join_ordinal")


@query("s12_ordinal_check", """WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS o FROM events),
m AS (SELECT o + CASE WHEN event_id % 100 = 0 THEN 1 ELSE 0 END AS o, count(*) AS n, min(event_id) AS id FROM e GROUP BY 1)
SELECT CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_rows, min(o) AS first, max(o) AS last, count(*) FILTER (n > 1) AS repeated,
 count(*) FILTER (id IS DISTINCT FROM event_id) AS misplaced FROM m FULL JOIN e USING (o)""")
def ordinal_check(spark, sf):
    """A merge that moved every hundredth row one place down: its neighbours' places repeat, its own is empty."""
    numbered = source_rows(fx.table(spark, sf, "events").select("event_id"), "event_id").withColumnRenamed("source_row", "join_ordinal")
    moved = numbered.withColumn("join_ordinal", F.col("join_ordinal") + (F.col("event_id") % 100 == 0).cast("bigint"))
    return csv_files.ordinal_check(moved, numbered, "join_ordinal", "event_id")
