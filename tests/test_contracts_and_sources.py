"""Inputs that must be refused, quoted text, shared folders, skewed quantiles and null keys."""
import random

import pytest
from pyspark.sql import functions as F, types as T

from tests.conftest import rows
from tripwright import storage
from tripwright.operators import encode, metrics, report, skew
from tripwright.sources import csv_files


def bins(spark, feature, data):
    df = spark.createDataFrame(data, "v double, m int")
    return [r.b for r in df.select(report.feature_bin(feature, F.col("v"), F.col("m")).alias("b")).collect()]


def test_bins_and_their_contract(spark):
    got = bins(spark, "p01i", [(0.0, 1), (0.0001, 1), (0.02, 1), (0.05, 1), (3.0, 1), (None, 1), (None, 0)])
    assert [b.bin_order for b in got] == [0, 1, 2, 3, 4, 800, 900]
    assert [b.bin_label for b in bins(spark, "age_minutes", [(90.0, 1), (60.0, 1), (59.9, 1)])] == ["[60, 90] minute", "[60, 90] minute", "[30, 60) minute"]
    for feature, row in (("tmpf", (5.0, 0)), ("tmpf", (5.0, None)), ("tmpf", (None, None)), ("sknt", (-1.0, 1)), ("age_minutes", (91.0, 1))):
        with pytest.raises(Exception, match="tmpf|sknt|age_minutes"):
            bins(spark, feature, [row])


def test_quoted_text_survives_both_ways(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.csv").write_text('id,text\n1,"say ""hi"", ok"\n2,"a,b"\n3,\n')
    read = csv_files.read_trips(spark, str(path), schema=schema, short_names=False)
    assert rows(read) == [(1, 'say "hi", ok'), (2, "a,b"), (3, None)]
    csv_files.write_null_token(read, str(tmp_path / "out"))
    assert rows(csv_files.read_null_token(spark, str(tmp_path / "out"), schema)) == rows(read)
    (path / "b.csv").write_text("text,id\nx,9\n")
    with pytest.raises(Exception):
        csv_files.read_trips(spark, str(path), schema=schema, short_names=False).collect()


def test_other_masters_need_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        storage.shared_dir(Session())


def test_an_outlier_leaves_quantile_buckets_even(spark):
    df = spark.range(1, 20_000).selectExpr("CAST(id AS DOUBLE) AS v").union(spark.createDataFrame([(1e15,)], "v double"))
    got = skew.exact_quantile_array(df, [], "v", [0.0, 0.5, 1.0]).first()
    assert got.quantiles == [1.0, 10_000.5, 1e15] and got.n_values == 20_000
    text = skew.exact_quantile_array(df, [], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    cuts = df.agg(F.percentile_approx("v", [i / 256 for i in range(1, 256)], 10_000).alias("c")).first().c
    sizes = df.select(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("v"))).alias("b")).groupBy("b").count()
    assert sizes.agg(F.max("count")).first()[0] < 400


def test_null_groups_keep_their_rows(spark):
    rng = random.Random(1)
    data = [(None if i % 3 == 0 else "a", i % 2, rng.random(), 0.5, int(rng.random() > 0.5)) for i in range(60)]
    df = spark.createDataFrame(data, "k string, y_true int, p double, threshold double, prediction int")
    assert metrics.score_metrics(df, ["k"]).count() == 2
    assert metrics.roc_auc(df, ["k"]).count() == 2
    assert metrics.equal_frequency_bins(df, ["k"], n_bins=5).agg(F.sum("n")).first()[0] == 60
    folded = encode.stratified_folds(spark.range(90).selectExpr("id AS flight_id", "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN 0 END AS y"))
    assert folded.count() == 90 and folded.groupBy("y", "fold").count().agg(F.max("count")).first()[0] == 6


def test_coinciding_cut_offs_are_refused(spark):
    df = spark.createDataFrame([(i, 0.5) for i in range(20)], "flight_id long, p double")
    with pytest.raises(Exception, match="coincide"):
        encode.pseudo_labels(df).collect()
    spread = spark.createDataFrame([(i, i / 100) for i in range(101)], "flight_id long, p double")
    assert rows(encode.pseudo_labels(spread).groupBy("pseudo_y").count()) == [(0, 11), (1, 3)]


def test_positions_of_sparse_ids(spark):
    df = spark.createDataFrame([(f"id{i * 97 % 1009:04d}",) for i in range(1000)], "name string")
    got = skew.row_positions(df, [], [F.col("name").desc()], "place").collect()
    names = sorted((r.name for r in got), reverse=True)
    assert sorted(r.place for r in got) == list(range(1, 1001)) and all(names[r.place - 1] == r.name for r in got)


def test_clean_up_removes_what_was_materialized(spark, monkeypatch):
    monkeypatch.setattr(storage, "_WRITTEN", {})
    kept = storage.materialize(spark.range(5), "five")
    file = kept.inputFiles()[0]
    assert kept.count() == 5 and storage.clean_up(spark) == 1 and storage.clean_up(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(file).count()
