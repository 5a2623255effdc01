"""Entries of many slots are never broadcast, however small Spark takes them to be behind an explode."""
from pyspark.sql import functions as F

from tripwright.operators import models, skew, slots


def joins(df):
    """The equal-key joins of a plan, before and after it ran."""
    before = df._jdf.queryExecution().executedPlan().toString()
    df.collect()
    return [line for line in (before + df._jdf.queryExecution().executedPlan().toString()).splitlines() if "Join" in line]


def table(spark):
    return spark.range(400).select(F.col("id").alias("flight_id"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 7).cast("string").alias("airline"),
                                   (F.col("id") % 11).cast("double").alias("x"))


def test_entries_meet_their_rows_by_a_shuffle(spark, monkeypatch):
    rows = table(spark)
    entries = slots.nested_slots(rows.select("flight_id", "y"), [42], fraction=0)
    seen = {}

    def kept(df, stem):
        seen[stem] = joins(df)
        return df.localCheckpoint()

    monkeypatch.setattr(slots, "materialize", kept)
    found = joins(slots.encode_slots(rows, entries, ["airline"], mean="m"))
    assert seen["cube"] and not any("BroadcastHashJoin" in line for line in seen["cube"])
    assert not any("BroadcastHashJoin" in line for line in found if "flight_id" in line)
    assert any("flight_id" in line for line in found)
    monkeypatch.setattr(models, "materialize", kept)
    models.learning_rows(rows, entries, ())
    assert seen["learning"] and not any("BroadcastHashJoin" in line for line in seen["learning"])


def test_ranks_of_many_keys_carry_by_a_shuffle(spark):
    ranked = slots.hash_ranks(table(spark).withColumn("slot", F.col("flight_id") % 9), ["slot", "y"], F.lit("s"))
    assert not any("Broadcast" in line for line in joins(ranked))
    plain = skew.row_ranks(table(spark).withColumn(skew.BUCKET, F.floor("x")), ["y"], [F.col("x"), F.col("flight_id")], "r")
    same = skew.row_ranks(table(spark).withColumn(skew.BUCKET, F.floor("x")), ["y"], [F.col("x"), F.col("flight_id")], "r", many=True)
    assert sorted(plain.select("flight_id", "r").collect()) == sorted(same.select("flight_id", "r").collect())
