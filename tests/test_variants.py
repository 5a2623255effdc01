"""The variant lattice against one build per variant, and its encodings against one fold at a time."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tripwright import fixtures as fx
from tripwright.operators import clean, encode
from tripwright.plans.phases import PHASES, Lattice, build_features, build_variants, encode_variants
from tripwright.storage import materialize

from conftest import rows

SF = "/root/testdata/sf0.001"


def test_lattice_equals_single_builds_and_fits_each_part_once(spark):
    raw = fx.flights(spark, SF)
    names = ("P1", "P4_clean", "P6_legacy", "P6_fixed", "P6_fixed_ratio")
    written = []

    def noted(df, stem):
        written.append(stem)
        return materialize(df, stem)

    together = build_variants(raw, {n: PHASES[n] for n in names}, keep=("flight_id",), settle=noted)
    for name in names:
        alone = build_features(raw, PHASES[name], keep=("flight_id",))
        mine = together.filter(F.col("variant") == name)
        assert rows(mine, *sorted(alone.columns)) == rows(alone, *sorted(alone.columns))
        lacking = [c for c in together.columns if c not in alone.columns and c != "variant"]
        assert not lacking or mine.filter(F.coalesce(*[F.col(c).cast("string") for c in lacking]).isNotNull()).count() == 0
    # fills: both ways (two mappings), first, unique; one restoration; slots with and without unknown hours
    assert written.count("rows") == 1 and written.count("mapping") == 4
    assert written.count("gap-counts") == 1 and written.count("slots") == 2
    assert written.count("vocabularies") == 3 and written.count("variant-rows") == 1  # P6_fixed and P6_fixed_ratio


def test_empty_rows_build_every_variant(spark):
    out = build_variants(fx.flights(spark, SF).filter("false"), PHASES, keep=("flight_id",))
    assert out.count() == 0 and {"variant", "flight_id", "speed_ratio", "distance_per_minute"} <= set(out.columns)


@pytest.mark.parametrize("name", ["P3", "P4_te0", "P5_honest"])
def test_encodings_equal_one_fold_at_a_time(spark, name):
    spec = PHASES[name]
    raw = materialize(fx.flights(spark, SF).filter("flight_id % 3 = 0 OR delay IS NULL AND flight_id % 5 = 0"), "some")
    extra = raw.filter("delay IS NULL").selectExpr("flight_id", "42 AS seed", "1 AS outer_fold", "CAST(flight_id % 2 AS INT) AS y")
    extra = extra if name == "P5_honest" else None
    every = encode_variants(raw, {name: spec}, seeds=[42], extra=extra)

    filled = Lattice(raw, [spec]).filled(spec)
    folded = materialize(encode.stratified_folds(clean.labeled_rows(filled)), "folded")
    added = None
    if extra is not None:
        added = filled.drop("delay").join(extra.select("flight_id", "y"), "flight_id").withColumn("fold", F.lit(-1)).select(*folded.columns)
    train, (valid,) = encode.oof_target_encode(folded.filter("fold <> 1"), [folded.filter("fold = 1")], inner_splits=spec.encoding.inner_folds,
                                               extra=added, settle=materialize)
    columns = ["flight_id", *[F.round(f"te_{c}", 9) for c in spec.categories]]
    one = every.filter("outer_fold = 1")
    assert rows(one.filter("part = 'train'"), *columns) == rows(train, *columns)
    assert rows(one.filter("part = 'valid'"), *columns) == rows(valid, *columns)
    assert every.filter("part NOT IN ('train', 'valid')").count() == 0


def test_pseudo_rows_are_refused_where_they_do_not_belong(spark):
    raw = fx.flights(spark, SF)
    labeled = raw.filter("delay IS NOT NULL").limit(5).selectExpr("flight_id", "42 AS seed", "0 AS outer_fold", "1 AS y")
    with pytest.raises(ValueError):
        encode_variants(raw, {"P5_honest": PHASES["P5_honest"]}, seeds=[42])
    with pytest.raises(ValueError):
        encode_variants(raw, {"P3": PHASES["P3"]}, seeds=[42], extra=labeled)
    with pytest.raises(Exception, match="is labeled"):
        encode_variants(raw, {"P5_honest": PHASES["P5_honest"]}, seeds=[42], extra=labeled).count()
