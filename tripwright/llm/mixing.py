"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id. A document's virtual finish
time is the words its source has sent up to and including it, divided by the source's
target; a source whose target reaches its size sends its documents again, three times at
most. All sendings are range-sorted by finish time and taken until the budget, the size of
the whole corpus, is spent (finish times above 2 are never taken; the budget is spent near
1). Running totals are cut into buckets, so no task holds a source.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share the
budget by weight; a target stops at ``repeats`` times the source's size and the excess goes
to the others by weight.

Nulls and edges: a null text has size 0 and is never taken; a null source is a source of
its own; repeated rows are separate documents; an empty table gives no rows; if all sizes
are 0 all targets are 0. One row per source passes a single ordered window; sources are
taken to be far fewer than documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tripwright.llm.common import WORD, apply_copies, by_shuffle, pick, text_mark, text_or_empty
from tripwright.operators.skew import BUCKET, carry_in, running_totals
from tripwright.storage import materialize

REPEATS = 3
SEED = "mix-1"
BUCKET_ROWS, MOST_BUCKETS = 2048, 65536
LATEST = 2.0


def document_sizes(docs: DataFrame) -> DataFrame:
    """One short row per document, written once."""
    sized = pick(docs, "doc_id", "text", "source").select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.coalesce("source", F.lit("")).alias("source_name"), F.col("source").isNull().alias("no_source"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), text_mark().alias("mark"))
    return materialize(sized, "sizes")


def source_targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Per source: its number, size, rows and target, with the budget and rows of all."""
    everything = Window.partitionBy()
    totals = sizes.groupBy("source_name", "no_source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    weighed = totals.withColumn("number", F.row_number().over(Window.orderBy("no_source", "source_name")))
    weighed = weighed.select(
        "*", (1 + (F.col("number") - 1) % 3).cast("double").alias("weight"),
        (repeats * F.col("source_size")).alias("most"),
        F.sum("source_size").over(everything).alias("budget"), F.sum("source_rows").over(everything).alias("all_rows"))
    # Fill up the sources in the order in which they become full. The level, words per unit
    # of weight, rises while full sources leave more for the rest and is highest at its end.
    fill = Window.orderBy(F.col("most") / F.col("weight"), "number")
    left = F.col("budget") - F.coalesce(
        F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levelled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return levelled.select(
        "source_name", "no_source", "source_size", "source_rows", "number", "budget", "all_rows",
        F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def parts(rows):
    return F.greatest(F.lit(1), F.least(F.lit(MOST_BUCKETS), F.ceil(rows / BUCKET_ROWS)))


def mix_sources(docs: DataFrame, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and the text's mark."""
    sizes = document_sizes(docs)
    targets = materialize(source_targets(sizes, repeats), "targets")
    rows = sizes.join(targets, ["source_name", "no_source"])
    # a shuffle order that any engine can repeat; its first four hex digits order the buckets
    shuffled = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    spot = F.conv(F.substring("shuffled", 1, 4), 16, 10).cast("long")
    queued = (rows.filter("target > 0").withColumn("shuffled", shuffled)
              .withColumn(BUCKET, F.floor(spot * parts(F.col("source_rows")) / 65536)))
    queued = running_totals(queued, ["number"], ["shuffled", "doc_id", "size", "row"], {"sent": F.col("size")})

    rounds = F.least(F.lit(repeats - 1), F.floor(F.col("target") / F.col("source_size")))
    sendings = (queued.withColumn("sending", F.explode(F.sequence(F.lit(0), rounds.cast("int"))))
                .withColumn("finish", (F.col("sending") * F.col("source_size") + F.col("sent")) / F.col("target"))
                .filter(F.col("finish") <= LATEST)
                .withColumn(BUCKET, F.floor(F.col("finish") * parts(F.col("all_rows")))))
    order = ["finish", "number", "sending", "shuffled", "doc_id", "size", "row"]
    spent = running_totals(sendings, [], order, {"spent": F.col("size")})
    taken = (spent.filter(F.col("spent") <= F.col("budget"))
             .groupBy("row").agg(F.sum("size").alias("taken"), F.count(F.lit(1)).alias("copies")))
    return rows.join(by_shuffle(taken), "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        F.when(F.col("size") > 0, F.coalesce("copies", F.lit(0))).otherwise(F.lit(0)).alias("copies"), "mark")


def mixed_documents(docs: DataFrame, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """Each document as often as the mix takes it, with the columns of ``docs``."""
    return apply_copies(docs, mix_sources(docs, repeats, seed).select("doc_id", "mark", "copies"))
