"""Document fingerprints by SpotSigs, DataFrame functions only.

A signature is a common word (anchor) with the chain of the next ``chain`` content words,
common words between them skipped; a run of anchors in front of one chain gives one signature
an anchor. A text's fingerprint is the set of its signatures as sorted 32-bit hashes, eight
hexadecimal digits each without a separator. Only distinct signatures count, so repeated lines
do not weigh; two signatures of one text share a hash about once in 2 ** 32 pairs.

Likeness is the Jaccard coefficient of two such sets. Pairs that are given (a text with its
edited form or with the next document) are compared directly. ``near_pairs`` searches: prints
are dealt to partitions by set length so that two sets as alike as asked lie in the same or
in neighbouring ones, posted under their rarest signatures (prefix), and a pair is dropped
as soon as lengths or list positions leave too few signatures for it.

Neighbours are found without a global window: keys are ordered by ranges, each range passes
on its first key only, and a text travels once to its own key; what goes to the document before it is the
part that this one needs.

Nulls and edges: a null text counts as empty and has the empty fingerprint, which is like
an empty one (1.0) and nothing else (0.0); a text without an anchor and chain takes every
word for an anchor, and if it is shorter still its whole word sequence is one signature;
a null doc_id comes after all numbers; rows with equal doc_id follow each other in the order
of their text hash, equal rows directly; a lone document is its own next one; an empty table
gives no rows; other columns are ignored; texts are read whole.
"""
from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwright.llm.common import pick, text_mark, text_or_empty
from tripwright.operators.skew import BUCKET
from tripwright.storage import materialize

CHAIN = 2
DIGITS = 8
KEY = ("no_id", "inv", "mark")

# Frequent function words of English, German, French and Spanish.
COMMON_WORDS = tuple((
    "the of and to in is it that for on with as at by this from are be was or an have not but a "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es "
    "le la les de du et en un une est que qui dans il au aux pour pas par sur ne se ce "
    "el los las del y por con no su al lo como más pero o le si").split())


# ---- fingerprints -------------------------------------------------------------

def with_fingerprint(df: DataFrame, text: str, name: str, *, chain: int = CHAIN,
                     anchors: tuple[str, ...] = COMMON_WORDS) -> DataFrame:
    """``df`` with the packed fingerprint (binary, four bytes a signature) of a text column.

    Work is linear in the text: chains are read off the array of content words, whose
    positions bound the anchors in front of each.
    """
    common = ", ".join(f"'{w}'" for w in dict.fromkeys(anchors))
    kept = list(df.columns)
    tokens = df.select("*", F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("_words"))
    spots = tokens.select(*kept, "_words", F.expr(
        f"filter(transform(_words, (w, i) -> struct(i, w)), s -> NOT s.w IN ({common}))").alias("_content"))
    following = ", ' ', ".join(f"get(_content, k + {j}).w" for j in range(1, chain))
    follow = f", ' ', {following}" if chain > 1 else ""
    signed = spots.select(*kept, "_words", F.expr(f"""
        flatten(transform(_content, (c, k) -> IF(k + {chain} > size(_content) OR c.i = IF(k = 0, 0, get(_content, k - 1).i + 1),
            array(), transform(
                array_distinct(slice(_words, IF(k = 0, 0, get(_content, k - 1).i + 1) + 1, c.i - IF(k = 0, 0, get(_content, k - 1).i + 1))),
                a -> concat(a, ' ', c.w{follow})))))""").alias("_signatures"))
    plain = f"""
        CASE WHEN size(_signatures) > 0 THEN _signatures
             WHEN size(_words) = 0 THEN array()
             WHEN size(_words) <= {chain} THEN array(array_join(_words, ' '))
             ELSE transform(sequence(1, size(_words) - {chain}), i -> array_join(slice(_words, i, {chain + 1}), ' ')) END"""
    chosen = signed.select(*kept, F.expr(plain).alias("_signatures"))
    hashed = F.expr(f"sort_array(array_distinct(transform(_signatures, s -> left(md5(cast(s AS BINARY)), {DIGITS}))))")
    return chosen.select(*kept, F.unhex(F.array_join(hashed, "")).alias(name))


def printed(packed: str) -> Column:
    """The fingerprint as text."""
    return F.lower(F.hex(packed))


def members(packed: str) -> Column:
    """The fingerprint's signatures as an array of hashes."""
    return F.regexp_extract_all(F.hex(packed), F.lit(f".{{{DIGITS}}}"), F.lit(0))


def size(packed: str) -> Column:
    return F.expr(f"octet_length({packed}) * 2 div {DIGITS}")


def likeness(left: str, right: str) -> Column:
    """Jaccard of two packed fingerprints; sets are only opened if both have members and differ."""
    shared = F.size(F.array_intersect(members(left), members(right)))
    return (F.when(F.col(left) == F.col(right), 1.0)
            .when((size(left) == 0) | (size(right) == 0), 0.0)
            .otherwise(shared / (size(left) + size(right) - shared)))


def fingerprints(docs: DataFrame, *, chain: int = CHAIN, anchors: tuple[str, ...] = COMMON_WORDS) -> DataFrame:
    """(doc_id, mark, print): the packed fingerprint of every text."""
    rows = pick(docs, "doc_id", "text").select("doc_id", text_mark().alias("mark"), text_or_empty().alias("text"))
    return with_fingerprint(rows, "text", "print", chain=chain, anchors=anchors).drop("text")


# ---- search -------------------------------------------------------------------

def near_pairs(prints: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """All links of different fingerprints with likeness ``least`` or more, and who has which.

    ``prints`` has doc_id, mark and print. Returns ``links`` (left, right, likeness) between
    class numbers and ``membership`` (doc_id, mark, class); documents with equal
    fingerprints are one class, so copies make no links. Empty fingerprints link nothing.
    """
    if not 0 < least <= 1:
        raise ValueError(f"least must be over 0 and at most 1: {least}")
    classes = materialize(
        prints.filter(size("print") > 0).groupBy("print").agg(F.count(F.lit(1)).alias("members"))
        .select(F.monotonically_increasing_id().alias("class"), "print", size("print").alias("n")), "spot-classes")
    membership = prints.join(classes.select("print", "class"), "print").select("doc_id", "mark", "class")
    step = -log(least) if least < 1 else 0.0
    part = F.floor(F.log("n") / step) if step else F.col("n").cast("long")
    posted = classes.select("class", "n", part.alias("part"), F.explode(members("print")).alias("signature"))
    times = posted.groupBy("signature").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    ranked = posted.join(times, "signature").groupBy("class", "n", "part").agg(
        F.sort_array(F.collect_list(F.struct("times", "signature"))).alias("shared"))
    # signatures that no other class has come first in the order and use up the prefix
    alone = F.col("n") - F.size("shared")
    reach = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1 - alone
    lists = (ranked.filter(reach > 0)
             .select("class", "n", "part", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), reach.cast("int"))).alias("at", "s"))
             .select("class", "n", "part", (F.col("at") + F.col("alone")).alias("at"), F.col("s.signature").alias("signature")))
    lists = materialize(lists, "spot-lists")
    own = lists.select("signature", "part", *[F.col(c).alias(f"l_{c}") for c in ("class", "n", "at")])
    visits = lists.select("signature", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), F.col("part").alias("home"),
                          *[F.col(c).alias(f"r_{c}") for c in ("class", "n", "at")])
    # the rest behind the two places must be able to fill the overlap that ``least`` asks for
    bound = 1 + F.least(F.col("l_n") - F.col("l_at"), F.col("r_n") - F.col("r_at")) - 1
    asked = F.lit(least) / (1 + least) * (F.col("l_n") + F.col("r_n")) - 1e-9
    met = own.join(visits, ["signature", "part"]).filter(
        ((F.col("home") > F.col("part")) | (F.col("l_class") < F.col("r_class")))
        & (F.least("l_n", "r_n") >= F.lit(least) * F.greatest("l_n", "r_n") - 1e-9) & (bound >= asked))
    pairs = met.select(F.least("l_class", "r_class").alias("left"), F.greatest("l_class", "r_class").alias("right")).distinct()
    named = [classes.select(F.col("class").alias(side), F.col("print").alias(f"{side}_print")) for side in ("left", "right")]
    judged = pairs.join(named[0], "left").join(named[1], "right").select(
        "left", "right", likeness("left_print", "right_print").alias("likeness"))
    return judged.filter(F.col("likeness") >= F.lit(least) - 1e-12), membership


# ---- documents and the next ones ----------------------------------------------

def keyed(docs: DataFrame) -> DataFrame:
    """Every document under its place in descending doc_id; equal keys are equal documents."""
    doc_id = F.col("doc_id").cast("long")
    return pick(docs, "doc_id", "text").select(
        doc_id.isNull().alias("no_id"), F.bitwise_not(F.coalesce(doc_id, F.lit(0))).alias("inv"), text_mark().alias("mark"),
        text_or_empty().alias("text"))


def next_links(rows: DataFrame) -> DataFrame:
    """(key of the next, ``before_`` key, take, times): what each document gives to the one before it."""
    ordered = (rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"), F.max(F.length("text")).alias("n_chars"))
               .repartitionByRange(*KEY).withColumn(BUCKET, F.spark_partition_id()))
    ordered = materialize(ordered, "spot-order")
    key = F.struct(*KEY)
    heads = ordered.groupBy(BUCKET).agg(F.min(key).alias("head"))  # a row for each range
    over = Window.orderBy(BUCKET)
    heads = heads.select(BUCKET, F.coalesce(F.lead("head").over(over), F.min("head").over(Window.partitionBy())).alias("onward"))
    within = Window.partitionBy(BUCKET).orderBy(*KEY)
    placed = ordered.withColumn("next", F.lead(key).over(within)).join(heads, BUCKET)
    take = F.floor(F.col("n_chars") / 3).cast("int")
    before = [F.col(k).alias(f"before_{k}") for k in KEY]
    onward = placed.select(F.coalesce("next", "onward").alias("to"), *before, take.alias("take"), F.lit(1).cast("long").alias("times"))
    twins = placed.filter("rows > 1").select(key.alias("to"), *before, take.alias("take"), (F.col("rows") - 1).alias("times"))
    return onward.unionByName(twins).select("to.*", *[f"before_{k}" for k in KEY], "take", "times")


def compare_edited(docs: DataFrame, *, chain: int = CHAIN, anchors: tuple[str, ...] = COMMON_WORDS) -> DataFrame:
    """Per document: doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last third is replaced by the start of the next one.
    """
    rows = keyed(docs)
    prints = with_fingerprint(rows, "text", "print", chain=chain, anchors=anchors)
    one = Window.partitionBy(*KEY).orderBy("text")
    single = prints.withColumn("_once", F.row_number().over(one)).filter("_once = 1").drop("_once")
    given = single.join(next_links(rows), list(KEY)).select(
        *[F.col(f"before_{k}").alias(k) for k in KEY], "times", F.expr("substring(text, 1, take)").alias("start"),
        F.col("print").alias("next_print"))
    own = single.join(given, list(KEY))
    own = own.withColumn("n_chars", F.length("text").cast("long"))
    edited = own.withColumn("edited", F.expr("concat(substring(text, 1, n_chars - n_chars div 3), start)")).drop("text", "start")
    both = with_fingerprint(edited, "edited", "edited_print", chain=chain, anchors=anchors)
    result = both.select(
        F.when(~F.col("no_id"), F.bitwise_not("inv")).alias("doc_id"), "n_chars", "edited", printed("print").alias("fingerprint"),
        printed("edited_print").alias("edited_fingerprint"), likeness("print", "edited_print").alias("near_edited"),
        likeness("print", "next_print").alias("near_next"), "times")
    return result.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times", "_copy")
