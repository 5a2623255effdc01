"""Exact deduplication by a heavy-hitter split, DataFrame functions only.

Every text becomes a SHA-256 digest of its white-space-normalised form, so only digests
travel. A Misra-Gries summary (one bounded set of counters per task, merged) names every
digest that may be frequent; their exact winners are counted and, at most ``counters``
rows, broadcast, so hot groups are settled where their rows lie. All other digests are
grouped by an ordinary shuffle.

Nulls and edges: a null text counts as empty and empty texts are equal to each other; a
null doc_id never wins against a number; of repeated rows with the same doc_id and text one
is kept; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tripwright.llm.common import apply_copies, by_shuffle, pick, text_mark, text_or_empty
from tripwright.storage import materialize

COUNTERS = 1024
WINNER = "struct(doc_id is null as no_id, doc_id, row)"


def normalised(text):
    """White-space runs become one space; single spaces are left as they are."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digest_rows(docs: DataFrame) -> DataFrame:
    """One short row per document, written once: row number, doc_id, digest, text mark."""
    rows = pick(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.unhex(F.sha2(normalised(text_or_empty()), 256)).alias("digest"), text_mark().alias("mark"))
    return materialize(rows, "digests")


def frequent_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Exact count and winner of every digest that Misra-Gries may call frequent.

    Holds each digest of more than 1 / counters of all rows, and never more than
    ``counters`` rows.
    """
    named = rows.select(F.hex("digest").alias("name")).stat.freqItems(["name"], 1.0 / counters)
    candidates = named.select(F.explode("name_freqItems").alias("name")).select(F.unhex("name").alias("digest"))
    counted = (rows.join(F.broadcast(candidates), "digest")  # at most ``counters`` rows
               .groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.expr(WINNER)).alias("winner")))
    return materialize(counted.filter("group_size > 1"), "frequent-digests")


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256 and the text's mark."""
    rows = digest_rows(docs)
    frequent = frequent_digests(rows, counters)
    hot = rows.join(F.broadcast(frequent), "digest")
    rest = rows.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.expr(WINNER)).alias("winner"))
    settled = hot.unionByName(rest.join(by_shuffle(groups), "digest"))
    return settled.select("doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size",
                          (F.col("winner.row") == F.col("row")).alias("kept"),
                          F.lower(F.hex("digest")).alias("text_sha256"), "mark")


def drop_exact_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with the columns of ``docs``."""
    kept = exact_dedup(docs, counters).filter("kept")
    return apply_copies(docs, kept.select("doc_id", "mark", F.lit(1).alias("copies")))
