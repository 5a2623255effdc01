"""Tables that grow with the documents are never broadcast, however small Spark takes them to be."""
from pyspark.sql import functions as F

from tests.llm.helpers import awkward
from tripwright.llm import common, components, exact_dedup, minhash_dedup, mixing


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def planned_and_run(df):
    """The plan before and after adaptive execution."""
    before = plan(df)
    df.collect()
    return before + plan(df)


def test_posting_lists_and_their_blocks(spark):
    classes = spark.range(40).select(
        F.col("id").alias("node"), F.lit(5).cast("long").alias("n"), F.array(*[(F.col("id") % 7 + i).cast("int") for i in range(48)]).alias("signature"))
    posted = minhash_dedup.postings(classes, 4)
    assert "BroadcastHashJoin" not in planned_and_run(posted)
    dealt = minhash_dedup.blocks(posted.withColumn("n", F.lit(1)), "key", 4, 10, F.lit(1), F.col("node"))
    assert "BroadcastHashJoin" not in planned_and_run(dealt)
    assert "BroadcastHashJoin" not in planned_and_run(minhash_dedup.matches(classes, 80, 4))


def test_decisions_meet_their_documents(spark):
    docs = awkward(spark)
    decisions = common.pick(docs, "doc_id", "text").select("doc_id", common.text_mark().alias("mark"), F.lit(1).alias("copies"))
    assert "BroadcastHashJoin" not in planned_and_run(common.apply_copies(docs, decisions))
    taken = [line for line in planned_and_run(mixing.mix_sources(docs)).splitlines() if "Join [row#" in line]
    assert taken and not any("Broadcast" in line for line in taken)
    assert "BroadcastHashJoin" not in planned_and_run(minhash_dedup.near_duplicates(docs))


def test_only_frequent_digests_are_broadcast(spark):
    found = planned_and_run(exact_dedup.exact_dedup(awkward(spark)))
    broadcasts = [line for line in found.splitlines() if "Join" in line and "winner" not in line and "BroadcastHashJoin" in line]
    assert "SortMergeJoin [digest" in found and broadcasts


def test_components_still_find_the_smallest_node(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 9)], "a long, b long")
    got = components.components(edges)
    assert "BroadcastHashJoin" not in planned_and_run(got)
    roots = dict(got.collect())
    assert roots[1] == roots[2] == roots[3] and roots[5] == roots[6] == roots[9] and roots[1] != roots[5]
