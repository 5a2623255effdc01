"""Nested validation of many models at once: who trains where, and encodings from one cube.

A slot is one model's view of the labeled rows: (seed, fold), or (seed, fold, part) for cross-fitting.
Every row has one entry per slot it belongs to, with its part (train, holdout, valid) and, in
training, its inner fold. All splits are hash ranks within the slot and class, so they do
not depend on row order, and one pass of ranks serves all slots.

Label statistics are counted once, by (column, key, slot, inner fold). An encoding is the slot's
total, less the row's own inner fold in training; a key's encodings for all slots and inner folds
are one array, so entries look up once per column and not once per column, seed and fold.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwright.operators.encode import smoothing
from tripwright.operators.skew import BUCKET, by_shuffle, join_null_safe, row_ranks, running_totals
from tripwright.storage import materialize

PARTS = ("train", "holdout", "valid")
START = 16  # digits of a holdout hash that are kept


def hash_ranks(df: DataFrame, within: Sequence[str], salt: Column, identifier: str = "flight_id", name: str = "_rank") -> DataFrame:
    """1-based rank by the salted SHA-256 of the id within the keys; the salt may differ by row."""
    hashed = df.withColumn("_h", F.sha2(F.concat(F.col(identifier).cast("string"), F.lit(":"), salt), 256))
    hashed = hashed.withColumn(BUCKET, F.substring("_h", 1, 4))
    return row_ranks(hashed, within, [F.col("_h"), F.col(identifier)], name, many=True).drop("_h", BUCKET)  # 65,536 buckets a key at most


def folded_rows(labeled: DataFrame, seeds: Sequence[int], k: int, *, label: str = "y", identifier: str = "flight_id") -> DataFrame:
    """(identifier, y, seed, fold): exactly balanced folds per class for every seed."""
    if k < 2:
        raise ValueError(f"k must be at least 2: {k}")
    rows = labeled.select(identifier, label, F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    ranked = hash_ranks(rows, ["seed", label], F.concat(F.lit("fold:"), F.col("seed").cast("string")), identifier)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def _numbered(entries: DataFrame, k: int, parts: int = 1) -> DataFrame:
    """The slot's number: seeds and folds are few, so it is arithmetic on their positions."""
    part = F.col("part_of") if "part_of" in entries.columns else F.lit(0)
    return entries.withColumn("slot", ((F.col("seed_no") * k + F.col("outer_fold")) * parts + part).cast("int"))


def _with_inner(entries: DataFrame, k: int, label: str, identifier: str) -> DataFrame:
    """Training entries get an inner fold (the same salt as ``stratified_folds``); others get none."""
    salt = F.concat(F.lit("fold:"), F.col("seed").cast("string"))
    ranked = hash_ranks(entries.filter("part = 'train'"), ["slot", label], salt, identifier)
    inner = ranked.withColumn("inner", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")
    return inner.unionByName(entries.filter("part <> 'train'").withColumn("inner", F.lit(None).cast("int")))


def _outer(folded: DataFrame, seeds: Sequence[int], k: int) -> DataFrame:
    number = F.array_position(F.array(*map(F.lit, seeds)), F.col("seed")) - 1
    return folded.withColumn("seed_no", number).withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def _holdout_cuts(folded: DataFrame, fraction: float, label: str, identifier: str) -> DataFrame:
    """(seed, label, _cuts): for each outer fold the largest (hash, id) that is held out. Hashes are counted
    by their first digits, and only the rows of the bucket that holds the last place are ordered."""
    outer = folded.select(identifier, label, "seed", F.posexplode("_starts").alias("outer_fold", "_start")).filter("_start IS NOT NULL")
    hashed = outer.withColumn(BUCKET, F.substring("_start", 1, 3))
    keys = ["seed", "outer_fold", label]
    counts = materialize(hashed.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n")), "holdout-buckets")
    until = F.sum("_n").over(Window.partitionBy(*keys).orderBy(BUCKET))  # 4,096 buckets at most
    want = F.round(F.sum("_n").over(Window.partitionBy(*keys)) * fraction)
    hot = counts.withColumns({"_before": until - F.col("_n"), "_want": want}).filter("_want > _before AND _want <= _before + _n")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", identifier))
    found = join_null_safe(hashed, hot.drop("_n"), [*keys, BUCKET]).withColumn("_h", _holdout_hash(F.col("outer_fold"), identifier))
    last = found.withColumn("_place", place).filter("_place + _before = _want")
    entry = F.struct("outer_fold", F.struct(F.col("_h").alias("h"), F.col(identifier).alias("id")))
    return last.groupBy("seed", label).agg(F.map_from_entries(F.collect_list(entry)).alias("_cuts"))  # an entry per outer fold


def _holdout_hash(outer: Column, identifier: str) -> Column:
    return F.sha2(F.concat(F.col(identifier).cast("string"), F.lit(":holdout:"), (F.col("seed") + outer).cast("string")), 256)


def packed_slots(labeled: DataFrame, seeds: Sequence[int], *, k: int = 5, inner_splits: int = 5, fraction: float = 0.2,
                 label: str = "y", identifier: str = "flight_id") -> DataFrame:
    """(identifier, y, entries): a row per row and seed with its entries in all slots of the seed.

    ``fraction`` of each class of the outer training rows is held out; 0 leaves none out.
    All slots of a seed order their training rows by the same hash, so a row is placed once and
    counted for each slot that it trains. Holdout hashes are worked out once and kept by their
    first 16 digits; the whole hash decides where these are equal.
    """
    folded = folded_rows(labeled, seeds, k, label=label, identifier=identifier)
    if fraction:
        starts = [F.when(F.col("fold") != o, F.substring(_holdout_hash(F.lit(o), identifier), 1, START)) for o in range(k)]
        folded = materialize(folded.withColumn("_starts", F.array(*starts)), "folds")
        cuts = F.broadcast(_holdout_cuts(folded, fraction, label, identifier))  # a row per seed and class
        folded = join_null_safe(folded, cuts, ["seed", label], "left")

    def part(o: int) -> Column:
        if not fraction:
            return F.when(F.col("fold") == o, "valid").otherwise("train")
        start, h, cut = F.col("_starts")[o], _holdout_hash(F.lit(o), identifier), F.col("_cuts")[o]
        cut_start = F.substring(cut["h"], 1, START)
        whole = (h < cut["h"]) | ((h == cut["h"]) & (F.col(identifier) <= cut["id"]))
        return F.when(F.col("fold") == o, "valid").when((start < cut_start) | ((start == cut_start) & whole), "holdout").otherwise("train")

    parts = materialize(folded.select(identifier, label, "seed", F.array(*map(part, range(k))).alias("_parts")), "parts")
    hashed = parts.withColumn("_h", F.sha2(F.concat(F.col(identifier).cast("string"), F.lit(":fold:"), F.col("seed").cast("string")), 256))
    trains = {f"_place_{o}": (F.col("_parts")[o] == "train").cast("int") for o in range(k)}
    placed = running_totals(hashed.withColumn(BUCKET, F.substring("_h", 1, 4)), ["seed", label], [F.col("_h"), F.col(identifier)], trains, many=True)
    number = (F.array_position(F.array(*map(F.lit, seeds)), F.col("seed")) - 1) * k
    entries = F.array(*[F.struct(F.col("seed"), F.lit(o).alias("outer_fold"), (number + o).cast("int").alias("slot"), F.col("_parts")[o].alias("part"),
                                 F.when(F.col("_parts")[o] == "train", (F.col(f"_place_{o}") - 1) % inner_splits).cast("int").alias("inner"))
                        for o in range(k)])
    return materialize(placed.select(identifier, label, entries.alias("entries")), "slots")


def nested_slots(labeled: DataFrame, seeds: Sequence[int], *, label: str = "y", identifier: str = "flight_id", **splits) -> DataFrame:
    """(identifier, y, seed, outer_fold, slot, part, inner): the entries of ``packed_slots``, a row each."""
    return packed_slots(labeled, seeds, label=label, identifier=identifier, **splits).select(identifier, label, F.inline("entries"))


def packed(entries: DataFrame, *, label: str = "y", identifier: str = "flight_id") -> DataFrame:
    """Entries of any slots as ``packed_slots`` gives them; packed ones stay as they are."""
    if "entries" in entries.columns:
        return entries
    own = F.struct(*[c for c in entries.columns if c not in (identifier, label)])
    return entries.groupBy(identifier, label).agg(F.collect_list(own).alias("entries"))  # an entry per slot


def with_extra(entries: DataFrame, extra: DataFrame, *, inner_splits: int = 5, label: str = "y", identifier: str = "flight_id") -> DataFrame:
    """Entries with further training rows, (identifier, label, seed, outer_fold): each teaches its own slot
    only and takes part in its inner folds. They are unlabeled rows; one that has an entry already is refused."""
    slot = entries.select("seed", "outer_fold", "slot").distinct()
    taken = extra.join(by_shuffle(entries.select(identifier).distinct().withColumn("_taken", F.lit(True))), identifier, "left")
    refused = F.raise_error(F.lit("an extra training row is labeled")).cast("int")
    fresh = taken.withColumn(label, F.when(F.col("_taken"), refused).otherwise(F.col(label))).join(slot, ["seed", "outer_fold"])
    names = [c for c in entries.columns if c != "inner"]
    joined = entries.select(*names).unionByName(fresh.withColumn("part", F.lit("train")).select(*names))
    return materialize(_with_inner(joined, inner_splits, label, identifier), "slots")


def seeing_themselves(entries: DataFrame) -> DataFrame:
    """Entries for encodings that include a training row's own label: its counts stay with part ``train``,
    what it sees is a second entry of part ``self``, from which nothing is subtracted."""
    return entries.unionByName(entries.filter("part = 'train'").withColumn("part", F.lit("self")))


def crossfit_slots(labeled: DataFrame, seeds: Sequence[int], *, k: int = 5, parts: int = 3, inner_splits: int = 5,
                   label: str = "y", identifier: str = "flight_id") -> DataFrame:
    """Slots per seed, outer fold and part of its training rows; the part itself is what gets scored."""
    rows = _outer(folded_rows(labeled, seeds, k, label=label, identifier=identifier), seeds, k).filter("fold <> outer_fold")
    salt = F.concat(F.lit("fold:"), (F.col("seed") + 20_000).cast("string"))
    ranked = hash_ranks(rows, ["seed", "outer_fold", label], salt, identifier)
    ranked = ranked.withColumn("_own", ((F.col("_rank") - 1) % parts).cast("int")).drop("_rank")
    entries = _numbered(ranked.withColumn("part_of", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), k, parts)
    part = F.when(F.col("_own") == F.col("part_of"), "valid").otherwise("train")
    entries = entries.select(identifier, label, "seed", "outer_fold", "part_of", "slot", part.alias("part"))
    return materialize(_with_inner(entries, inner_splits, label, identifier), "slots")


# ---- label statistics ---------------------------------------------------------

def label_cube(rows: DataFrame, entries: DataFrame, cols: Sequence[str], *, label: str = "y", identifier: str = "flight_id") -> DataFrame:
    """(column, key, of_slot): a map from slot to counts and sums, also by inner fold. The
    entry with an empty column name counts all training rows; null keys are in no other one."""
    train = entries.filter("part = 'train'").select(identifier, "slot", "inner", label)
    return counted_labels(train.join(by_shuffle(rows.select(identifier, *cols)), identifier), cols, label)


def counted_labels(train: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """The cube of training entries (slot, inner, label) that have their row's columns."""
    named = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("key")) for c in cols]
    named.append(F.struct(F.lit("").alias("column"), F.lit("").alias("key")))
    keyed = train.select("slot", "inner", label, F.inline(F.array(*named)))
    counted = keyed.filter(F.col("key").isNotNull()).groupBy("column", "key", "slot", "inner").agg(
        F.count(label).alias("n"), F.sum(label).alias("s"))
    by_slot = counted.groupBy("column", "key", "slot").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"),
        F.map_from_entries(F.collect_list(F.struct("inner", F.struct("n", "s")))).alias("of_inner"))  # one entry per inner fold
    return materialize(by_slot.groupBy("column", "key").agg(  # one entry per slot
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("n", "s", "of_inner")))).alias("of_slot")), "cube")


def encodings(cube: DataFrame, views: int, last: int, m: float, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What each view of each slot sees of a key: (column, key, values, own); and one row with the values of an
    ``unseen`` key, the plain ``means`` and ``own`` of all keys. ``own``: the training entries that have the view.

    View 0 of a slot sees all its training rows, view 1 + i all but those of inner fold i.
    """
    def count(x: str, j: Column) -> Column:
        of_slot = F.col("of_slot")[F.floor(j / views).cast("int")]
        own = F.when(j % views > 0, F.coalesce(of_slot["of_inner"][j % views - 1][x], F.lit(0))).otherwise(0)
        return F.coalesce(of_slot[x], F.lit(0)) - own

    def value(n: Column, s: Column, mean: Column) -> Column:
        found = smoothing(n, s, mean, m)
        return found if digits is None else F.round(found, digits)

    at = F.sequence(F.lit(0), F.lit(last))
    own = F.transform(at, lambda j: F.when(j % views > 0, F.col("of_slot")[F.floor(j / views).cast("int")]["of_inner"][j % views - 1]["n"]))
    whole = cube.filter("column = ''").select(F.transform(at, lambda j: F.try_divide(count("s", j), count("n", j))).alias("means"), own.alias("own"))
    values = F.transform(at, lambda j: value(count("n", j), count("s", j), F.get("_mean", j)))
    keyed = cube.filter("column <> ''").withColumn("_mean", whole.select("means").scalar()).select("column", "key", values.alias("values"), own.alias("own"))
    return materialize(keyed, "encodings"), whole.withColumn("unseen", F.transform("means", lambda g: value(F.lit(0), F.lit(0), g)))


def place_of(views: int) -> Column:
    """Where an entry's encoding is in the values of its key."""
    return F.col("slot") * views + F.when((F.col("part") == "train") & F.col("inner").isNotNull(), F.col("inner") + 1).otherwise(0)


def encode_slots(rows: DataFrame, entries: DataFrame, cols: Sequence[str], *, m: float = 20.0, prefix: str = "te_",
                 mean: str | None = None, digits: int | None = None, label: str = "y", identifier: str = "flight_id") -> DataFrame:
    """Every entry with its row's columns and ``prefix`` encodings of ``cols`` as its slot sees them.

    ``mean`` names a column for the mean that unseen keys get; ``digits`` rounds the encodings.
    An encoding depends on the key, the slot and the inner fold only: it is computed once for each of
    them, and an entry picks its own.
    """
    early = [c for c in rows.columns if c.startswith(prefix)]
    if early:
        raise ValueError(f"encoded columns are not allowed before the split: {sorted(early)}")
    cube = label_cube(rows, entries, cols, label=label, identifier=identifier)
    slot, inner = entries.agg(F.coalesce(F.max("slot"), F.lit(0)), F.coalesce(F.max("inner"), F.lit(-1))).first()
    views = inner + 2
    keyed, whole = encodings(cube, views, (slot + 1) * views - 1, m, digits)
    unseen, means = (whole.select(c).scalar() for c in ("unseen", "means"))
    out = rows.join(by_shuffle(entries.drop(label)), identifier).withColumn("_at", place_of(views))
    for c in cols:
        of_column = keyed.filter(F.col("column") == c).select(F.col("key").alias("_key"), F.col("values").alias(f"_of_{c}"))
        out = out.join(of_column, F.col(c).cast("string") == F.col("_key"), "left").drop("_key")
    kept = [c for c in entries.columns if c not in (identifier, label)]
    found = [F.coalesce(F.get(f"_of_{c}", "_at"), F.get(unseen, "_at")).alias(f"{prefix}{c}") for c in cols]
    return out.select(*rows.columns, *kept, *([F.get(means, "_at").alias(mean)] if mean else []), *found)
