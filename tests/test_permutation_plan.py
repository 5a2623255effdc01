"""The drawn rows of a permutation test are never built into a broadcast relation."""
from pyspark.sql import functions as F

from tripwright.operators import calendar_signal


def broadcast_subtrees(plan: str) -> list[str]:
    """The lines below each broadcast of an explained plan."""
    lines, out = plan.splitlines(), []
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


def test_only_the_days_are_broadcast(spark):
    days = spark.range(60).select(F.col("id").alias("day"), (F.col("id") * 37 % 11).cast("double").alias("v"), (F.col("id") % 7).alias("c"))
    got = calendar_signal.permutation_test(days, "v", "c", "day", draws=300, seed=5)
    assert got.first()["draws"] == 300
    found = broadcast_subtrees(got._jdf.queryExecution().executedPlan().toString())
    assert found and not any("Generate" in tree for tree in found)
