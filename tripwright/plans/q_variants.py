"""All declared feature variants at once: features, label encodings and their cross-check."""
from __future__ import annotations

from pyspark.sql import functions as F

from tripwright import fixtures as fx
from tripwright.operators import audit, encode, report
from tripwright.plans import q_models, q_scores, q_windows
from tripwright.plans.experiment import ledger_rows, nested_predictions, record
from tripwright.plans.phases import PHASES, build_variants, encode_variants
from tripwright.plans.q_scores import rounded
from tripwright.plans.registry import query
from tripwright.storage import fresh_path, materialize

V = ("flights",)


def _declared() -> str:
    """The settings of every variant as SQL rows."""
    def text(flag: bool) -> str:
        return "TRUE" if flag else "FALSE"
    rows = []
    for name, v in PHASES.items():
        fill = "both" if v.filling.both_ways else v.filling.conflict
        flags = (v.clock.flags, v.clock.missing == "noon", v.clock.cosine, bool(v.clock.restored), v.slots.counted,
                 v.slots.unknown_hours, v.filling.safe_ratio, v.preset == "baseline")
        rows.append(f"('{name}', '{fill}', {', '.join(map(text, flags))})")
    return "spec(variant, fill, flags, noon, cosine, restores, counts, unknown, safe, baseline) AS (VALUES " + ", ".join(rows) + ")"


_FILLED_SQL = """first_map AS (SELECT carrier_code, arg_min(airline, flight_id) AS fill FROM flights WHERE carrier_code IS NOT NULL AND airline IS NOT NULL GROUP BY 1),
unique_map AS (SELECT carrier_code, min(airline) AS fill FROM flights WHERE carrier_code IS NOT NULL AND airline IS NOT NULL GROUP BY 1 HAVING count(DISTINCT airline) = 1),
back_map AS (SELECT airline, arg_min(carrier_code, flight_id) AS back FROM flights WHERE carrier_code IS NOT NULL AND airline IS NOT NULL GROUP BY 1),
fills AS (SELECT f.flight_id, coalesce(f.airline, a.fill) AS airline_first, coalesce(f.airline, u.fill) AS airline_unique, coalesce(f.carrier_code, b.back) AS carrier_back
 FROM flights f LEFT JOIN first_map a USING (carrier_code) LEFT JOIN unique_map u USING (carrier_code) LEFT JOIN back_map b ON coalesce(f.airline, a.fill) = b.airline)"""


def _code(expression: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY coalesce(CAST({expression} AS VARCHAR), 'MISSING')) - 1 AS INT)"


_LATTICE_SQL = f"""WITH {q_windows.RESTORE_SQL}, {_FILLED_SQL}, {_declared()},
wide AS (SELECT r.*, t.dep_hour AS dep_hour_raw, t.arr_hour AS arr_hour_raw, t.duration AS gap_raw, t.dep_minute AS dep_minute_raw, t.arr_minute AS arr_minute_raw,
  {_code('airline_first')} AS code_first, {_code('airline_unique')} AS code_unique, {_code('carrier_back')} AS code_carrier, {_code('r.tail')} AS code_tail,
  {_code('r.route')} AS code_route, {_code('r.origin')} AS code_origin, {_code('r.dest')} AS code_dest,
  CAST(count(*) OVER (PARTITION BY r.mo, r.dom, r.origin, r.dep_hour) AS DOUBLE) AS at_origin, CAST(count(*) OVER (PARTITION BY r.mo, r.dom, r.dest, r.arr_hour) AS DOUBLE) AS at_dest
 FROM restored r JOIN timed t USING (flight_id) JOIN fills USING (flight_id)),
picked AS (SELECT s.*, w.* EXCLUDE (dep_hour, arr_hour, duration), CASE WHEN restores THEN w.dep_hour ELSE dep_hour_raw END AS dep_hour,
  CASE WHEN restores THEN w.arr_hour ELSE arr_hour_raw END AS arr_hour, CASE WHEN restores THEN w.duration ELSE gap_raw END AS gap FROM wide w CROSS JOIN spec s),
angled AS (SELECT *, 2 * pi() / 24 * CASE WHEN dep_hour >= 0 THEN dep_hour WHEN noon THEN 12 END AS angle FROM picked)
SELECT variant, flight_id, yr, mo, CASE WHEN baseline THEN dom END AS dom, dep_hhmm, arr_hhmm, distance, delay, code_origin AS origin, code_dest AS dest, code_tail AS tail, code_route AS route,
 CASE WHEN baseline THEN code_carrier END AS carrier_code, CASE WHEN fill = 'unique' THEN code_unique ELSE code_first END AS airline, dep_hour, arr_hour,
 CASE WHEN baseline THEN dep_minute_raw END AS dep_minute, CASE WHEN baseline THEN arr_minute_raw END AS arr_minute,
 CASE WHEN flags THEN CAST(dep_hour_raw < 0 AS INT) END AS dep_hour_originally_missing, CASE WHEN flags THEN CAST(arr_hour_raw < 0 AS INT) END AS arr_hour_originally_missing,
 CASE WHEN flags THEN CAST(gap_raw IS NULL AS INT) END AS local_gap_originally_missing, CASE WHEN flags THEN CAST(dep_hour < 0 AS INT) END AS dep_hour_missing,
 CASE WHEN counts AND NOT unknown THEN CAST(dep_hour < 0 AS INT) END AS origin_hour_missing, CASE WHEN counts AND NOT unknown THEN CAST(arr_hour < 0 AS INT) END AS dest_hour_missing,
 CASE WHEN counts AND (unknown OR dep_hour >= 0) THEN at_origin END AS origin_traffic, CASE WHEN counts AND (unknown OR arr_hour >= 0) THEN at_dest END AS dest_traffic,
 round(sin(angle), 9) AS sin_dep_hour, CASE WHEN cosine THEN round(cos(angle), 9) END AS cos_dep_hour,
 CASE WHEN NOT safe THEN gap END AS duration, CASE WHEN NOT safe THEN round(distance / (gap + 1e-5::DOUBLE), 6) END AS speed_ratio,
 CASE WHEN safe THEN gap END AS local_gap_minutes, CASE WHEN safe THEN CAST(coalesce(gap = 0, FALSE) AS INT) END AS gap_zero,
 CASE WHEN safe AND gap > 0 THEN round(distance / gap, 9) END AS distance_per_minute, CASE WHEN safe THEN CAST(coalesce(gap <= 0, TRUE) AS INT) END AS distance_per_minute_missing FROM angled"""


@query("m23_feature_lattice", _LATTICE_SQL, V)
def feature_lattice(spark, sf):
    out = build_variants(fx.flights(spark, sf), PHASES, keep=("flight_id",))
    return rounded(rounded(out, ["sin_dep_hour", "cos_dep_hour", "distance_per_minute"]), ["speed_ratio"], 6)


# ---- label encodings ----------------------------------------------------------

SEED = 42
_P = f"CAST((flight_id * 7919 + {SEED} * 104729) % 997 AS DOUBLE) / 997"


def pseudo_rows(spark, sf):
    """Confident unlabeled rows by a given score, for every outer fold."""
    scored = fx.flights(spark, sf).filter("delay IS NULL").selectExpr("flight_id", f"{SEED} AS seed", f"{_P} AS p")
    chosen = encode.pseudo_labels(scored).select("flight_id", "seed", F.col("pseudo_y").alias("y"))
    return materialize(chosen.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(4)))), "pseudo")


_TE = ("tail", "route", "origin", "dest", "airline")
_USES = {n: (v.filling.conflict, v.encoding.inner_folds, v.encoding.pseudo_labels) for n, v in PHASES.items() if v.encoding.targets}
_ENCODED_SQL = f"""WITH {q_scores.FOLD_SQL}, {_FILLED_SQL},
uses(variant, fill, inner_folds, pseudo) AS (VALUES {", ".join(f"('{n}', '{f}', {i}, {'TRUE' if p else 'FALSE'})" for n, (f, i, p) in _USES.items())}),
ways AS (SELECT DISTINCT fill, inner_folds, pseudo FROM uses),
scored AS (SELECT flight_id, {_P} AS p FROM flights WHERE delay IS NULL), cuts AS (SELECT quantile_cont(p, 0.10) AS lo, quantile_cont(p, 0.98) AS hi FROM scored),
entries AS (SELECT w.*, CAST(o AS INT) AS outer_fold, flight_id, y, CASE WHEN fold = o THEN 'valid' ELSE 'train' END AS part FROM folded, ways w, generate_series(0, 4) AS s(o)
 UNION ALL SELECT w.*, CAST(o AS INT), flight_id, CASE WHEN p >= hi THEN 1 ELSE 0 END, 'train' FROM scored, cuts, ways w, generate_series(0, 4) AS s(o) WHERE w.pseudo AND (p >= hi OR p <= lo)),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY fill, inner_folds, pseudo, outer_fold, y, part ORDER BY sha256(CAST(flight_id AS VARCHAR) || ':fold:{SEED}'), flight_id) - 1) % 5 AS inner_fold FROM entries),
keyed AS (SELECT r.*, CASE WHEN fill = 'unique' THEN airline_unique ELSE airline_first END AS airline, CAST(tail AS VARCHAR) AS tail, CAST(origin AS VARCHAR) AS origin, CAST(dest AS VARCHAR) AS dest,
  CAST(origin AS VARCHAR) || '_' || CAST(dest AS VARCHAR) AS route FROM ranked r JOIN fills USING (flight_id) JOIN flights f USING (flight_id)),
long AS ({" UNION ALL ".join(f"SELECT fill, inner_folds, pseudo, outer_fold, flight_id, y, part, inner_fold, '{c}' AS c, {c} AS k FROM keyed" for c in _TE)}
 UNION ALL SELECT fill, inner_folds, pseudo, outer_fold, flight_id, y, part, inner_fold, '' AS c, '' AS k FROM keyed),
counted AS (SELECT fill, inner_folds, pseudo, outer_fold, c, k, inner_fold, count(*) AS n, sum(y) AS s FROM long WHERE part = 'train' AND k IS NOT NULL GROUP BY ALL),
totals AS (SELECT fill, inner_folds, pseudo, outer_fold, c, k, sum(n) AS n, sum(s) AS s FROM counted GROUP BY ALL),
seen AS (SELECT l.* EXCLUDE (inner_fold, k, y), coalesce(t.n, 0) - CASE WHEN l.part = 'train' AND l.inner_folds > 0 THEN coalesce(o.n, 0) ELSE 0 END AS n,
  coalesce(t.s, 0) - CASE WHEN l.part = 'train' AND l.inner_folds > 0 THEN coalesce(o.s, 0) ELSE 0 END AS s FROM long l
 LEFT JOIN totals t USING (fill, inner_folds, pseudo, outer_fold, c, k) LEFT JOIN counted o USING (fill, inner_folds, pseudo, outer_fold, c, k, inner_fold)),
wide AS (SELECT fill, inner_folds, pseudo, outer_fold, flight_id, part, max(s / n) FILTER (c = '') AS g, {", ".join(f"max(n) FILTER (c = '{c}') AS n_{c}, max(s) FILTER (c = '{c}') AS s_{c}" for c in _TE)} FROM seen GROUP BY ALL)
SELECT variant, {SEED} AS seed, outer_fold, part, flight_id, {", ".join(f"round((s_{c} + 20 * g) / (n_{c} + 20), 9) AS te_{c}" for c in _TE)} FROM wide JOIN uses USING (fill, inner_folds, pseudo)"""


@query("m23_encoded_variants", _ENCODED_SQL, V)
def encoded_variants(spark, sf):
    return encode_variants(fx.flights(spark, sf), PHASES, seeds=[SEED], extra=pseudo_rows(spark, sf), digits=9)


# ---- cross-check --------------------------------------------------------------

_COUNTS = ("dep_hour_original", "dep_hour_residual", "arr_hour_original", "arr_hour_residual", "gap_original")


@query("c9_variant_cross_check", f"""WITH {q_windows.RESTORE_SQL}, {_declared()},
told AS (SELECT count(*) AS n_rows, count(*) FILTER (dep_hour_before = -1) AS a, count(*) FILTER (dep_hour = -1) AS b, count(*) FILTER (arr_hour_before = -1) AS c, count(*) FILTER (arr_hour = -1) AS d, count(*) FILTER (gap_was_missing) AS e FROM restored)
SELECT variant, n_rows, CASE WHEN flags THEN a END AS dep_hour_original, CASE WHEN restores THEN b ELSE a END AS dep_hour_residual, CASE WHEN flags THEN c END AS arr_hour_original,
 CASE WHEN restores THEN d ELSE c END AS arr_hour_residual, CASE WHEN flags THEN e END AS gap_original, TRUE AS agrees FROM told CROSS JOIN spec""", V)
def variant_cross_check(spark, sf):
    """Every variant's missing, restored and flagged counts against the audit of the raw rows."""
    raw = materialize(fx.flights(spark, sf), "rows")
    built = build_variants(raw, PHASES, keep=("flight_id",), codes=False)
    counts = built.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("dep_hour_originally_missing").alias("dep_hour_original"),
        report.count_if(F.col("dep_hour") < 0).alias("dep_hour_residual"), F.sum("arr_hour_originally_missing").alias("arr_hour_original"),
        report.count_if(F.col("arr_hour") < 0).alias("arr_hour_residual"), F.sum("local_gap_originally_missing").alias("gap_original"))
    told = audit.time_restore_accounting(raw).select(F.struct(*_COUNTS).alias("t")).scalar()
    restores = F.col("variant").isin([n for n, v in PHASES.items() if v.clock.restored])
    flagged = F.col("variant").isin([n for n, v in PHASES.items() if v.clock.flags])
    checked = counts.withColumn("_told", told)
    agrees = F.lit(True)
    for name in _COUNTS:
        here, there = F.col(name), F.col("_told").getField(name)
        if name.endswith("residual"):
            there = F.when(restores, there).otherwise(F.col("_told").getField(name.replace("residual", "original")))
            agrees = agrees & (here == there)
        else:
            agrees = agrees & F.when(flagged, here == there).otherwise(here.isNull())
    return checked.withColumn("agrees", agrees).drop("_told")


# ---- whole experiment ---------------------------------------------------------

COMPARED = ("P4", "P6_fixed", "P6_clean")


@query("experiment_ledger")
def experiment_ledger(spark, sf):
    """Three variants from raw rows to the ledger, over all seeds, folds and declared tree counts."""
    predictions = nested_predictions(fx.flights(spark, sf), {n: PHASES[n] for n in COMPARED}, fx.SEEDS, [q_models.PARAMS], q_models.TREES)
    return record(ledger_rows(predictions, "nested"), fresh_path(spark, "ledger"), 1)
