"""Fold assignment and encodings that never let a row see its own label."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwright.operators.skew import BUCKET, exact_quantiles, join_null_safe, row_positions, row_ranks
from tripwright.schemas import CATEGORICAL
from tripwright.storage import Settle, unsettled

NA_TOKEN = "MISSING"


# ---- folds ------------------------------------------------------------------

def _salted(identifier: str, salt: str) -> Column:
    return F.sha2(F.concat(F.col(identifier).cast("string"), F.lit(":" + salt)), 256)


def _hash_ranks(df: DataFrame, within: Sequence[str], identifier: str, salt: str) -> DataFrame:
    """``_rank`` by salted hash within the keys; the first four hex digits are the buckets."""
    hashed = df.withColumn("_h", _salted(identifier, salt))
    hashed = hashed.withColumn(BUCKET, F.substring("_h", 1, 4))
    return row_ranks(hashed, within, [F.col("_h"), F.col(identifier)], "_rank").drop("_h", BUCKET)


def stratified_folds(df: DataFrame, label: str = "y", identifier: str = "flight_id", *, k: int = 5,
                     seed: int = 42, name: str = "fold") -> DataFrame:
    """Exactly balanced folds per class, a function of id and seed only."""
    if k < 2:
        raise ValueError(f"k must be at least 2: {k}")
    ranked = _hash_ranks(df, [label], identifier, f"fold:{seed}")
    return ranked.withColumn(name, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def inner_holdout(df: DataFrame, within: Sequence[str], label: str = "y", identifier: str = "flight_id", *,
                  fraction: float = 0.2, salt: str = "holdout", name: str = "is_holdout",
                  eligible: Column | None = None) -> DataFrame:
    """Mark a stratified share of each (``within``, class) as holdout; only eligible rows may be chosen."""
    if not 0 < fraction < 1:
        raise ValueError(f"fraction must lie in (0, 1): {fraction}")
    usable = F.lit(True) if eligible is None else eligible
    keys = [*within, label]
    marked = df.withColumn("_usable", usable)
    ranked = _hash_ranks(marked, [*keys, "_usable"], identifier, salt)
    sizes = marked.groupBy(*keys).agg(
        F.round(F.count(F.lit(1)) * fraction).alias("_want"), F.count(F.when(F.col("_usable"), 1)).alias("_can"))
    size = F.least(F.col("_want"), F.greatest(F.col("_can") - 1, F.lit(0)))
    return (join_null_safe(ranked, sizes, keys)
            .withColumn(name, F.col("_usable") & (F.col("_rank") <= size))
            .drop("_usable", "_rank", "_want", "_can"))


def outer_training_rows(folded: DataFrame, k: int = 5, fold: str = "fold") -> DataFrame:
    """Each row once per outer fold it trains (all but its own), as ``outer_fold``."""
    outer = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    return folded.withColumn("outer_fold", outer).filter(F.col("outer_fold") != F.col(fold))


# ---- target encoding --------------------------------------------------------

def smoothing(n: Column, total: Column, overall: Column, m: float) -> Column:
    """(sum + m * overall) / (n + m), and the overall mean where both n and m are zero."""
    weight = F.coalesce(n, F.lit(0)) + F.lit(float(m))
    return F.when(weight > 0, (F.coalesce(total, F.lit(0)) + m * overall) / weight).otherwise(overall)


def encoding_statistics(fit: DataFrame, cols: Sequence[str], y: str = "y", fold: str | None = None) -> DataFrame:
    """Label counts and sums per (column, key[, fold]) for all columns in one pass over the rows.

    The entry with an empty column name counts all rows; null keys are in no other entry.
    """
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("key")) for c in cols]
    entries.append(F.struct(F.lit("").alias("column"), F.lit("").alias("key")))
    keep = [y] if fold is None else [y, fold]
    by = ["column", "key"] if fold is None else ["column", "key", fold]
    return (fit.select(*keep, F.inline(F.array(*entries))).filter(F.col("key").isNotNull())
            .groupBy(*by).agg(F.count(y).alias("_n"), F.sum(y).alias("_s")))


def _of_column(statistics: DataFrame, column: str) -> DataFrame:
    return statistics.filter(F.col("column") == column).drop("column")


def encode_from(df: DataFrame, statistics: DataFrame, cols: Sequence[str], *, m: float = 20.0,
                prefix: str = "te_") -> DataFrame:
    """Encode rows that are not part of the statistics; unseen keys get the overall mean."""
    overall = _of_column(statistics, "").agg((F.sum("_s") / F.sum("_n")).alias("g")).scalar()
    out = df
    for c in cols:
        totals = _of_column(statistics, c).groupBy(F.col("key").alias("_key")).agg(
            F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
        out = out.join(totals, F.col(c).cast("string") == F.col("_key"), "left").withColumn(
            f"{prefix}{c}", smoothing(F.col("_n"), F.col("_s"), overall, m)).drop("_key", "_n", "_s")
    return out


def smoothed_target_encode(fit: DataFrame, apply: DataFrame, key: str, y: str = "y", *, m: float = 20.0,
                           prefix: str = "te_") -> DataFrame:
    """Encode ``apply`` from labels of ``fit`` only; unseen keys get the overall mean."""
    if m < 0:
        raise ValueError(f"m must not be negative: {m}")
    return encode_from(apply, encoding_statistics(fit, [key], y), [key], m=m, prefix=prefix)


def out_of_fold_encode(train: DataFrame, fold: str, cols: Sequence[str], y: str = "y", *, m: float = 20.0,
                       prefix: str = "te_", statistics: DataFrame | None = None) -> DataFrame:
    """Encode each training row from the other inner folds: key totals minus the row's own fold.

    One aggregate by (column, key, fold) serves all columns and all folds.
    """
    stats = encoding_statistics(train, cols, y, fold) if statistics is None else statistics
    rows = _of_column(stats, "")
    everything = rows.agg(F.sum("_n").alias("n"), F.sum("_s").alias("s"))
    n_all, s_all = everything.select("n").scalar(), everything.select("s").scalar()
    means = rows.select(F.struct(F.col(fold), F.try_divide(s_all - F.col("_s"), n_all - F.col("_n"))).alias("e"))
    overall = F.element_at(means.agg(F.map_from_entries(F.collect_list("e")).alias("m")).scalar(), F.col(fold))
    out = train.withColumn("_overall", overall)
    of_key = Window.partitionBy("key")  # one row per fold
    for c in cols:
        others = _of_column(stats, c).select(
            F.col("key").alias("_key"), F.col(fold).alias("_fold"),
            (F.sum("_n").over(of_key) - F.col("_n")).alias("_n"), (F.sum("_s").over(of_key) - F.col("_s")).alias("_s"))
        out = out.join(others, (F.col(c).cast("string") == F.col("_key")) & (F.col(fold) == F.col("_fold")), "left")
        out = out.withColumn(f"{prefix}{c}", smoothing(F.col("_n"), F.col("_s"), F.col("_overall"), m)).drop(
            "_key", "_fold", "_n", "_s")
    return out.drop("_overall")


def oof_target_encode(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str] = CATEGORICAL, *, y: str = "y",
                      identifier: str = "flight_id", m: float = 20.0, inner_splits: int = 5, seed: int = 42,
                      prefix: str = "te_", drop_original: bool = False, extra: DataFrame | None = None,
                      settle: Settle = unsettled) -> tuple[DataFrame, list[DataFrame]]:
    """Encode one outer fold: training rows out-of-fold, each other frame from all training labels.

    ``inner_splits=0`` encodes training rows with their own labels included. ``extra`` rows
    (for example selected pseudo labels) join the training side only. ``settle`` may write
    the training rows with their inner folds, and the statistics, once for all uses.
    """
    if inner_splits == 1 or inner_splits < 0:
        raise ValueError(f"inner_splits must be 0 or at least 2: {inner_splits}")
    fit = train if extra is None else train.unionByName(extra)
    present = [c for c in cols if c in fit.columns]
    if inner_splits == 0:
        stats = settle(encoding_statistics(fit, present, y), "statistics")
        encoded = encode_from(fit, stats, present, m=m, prefix=prefix)
    else:
        inner = settle(stratified_folds(fit, y, identifier, k=inner_splits, seed=seed, name="_inner"), "inner-folds")
        stats = settle(encoding_statistics(inner, present, y, "_inner"), "statistics")
        encoded = out_of_fold_encode(inner, "_inner", present, y, m=m, prefix=prefix, statistics=stats).drop("_inner")
    applied = [encode_from(df, stats, present, m=m, prefix=prefix) for df in others]
    if drop_original:
        encoded, applied = encoded.drop(*present), [df.drop(*present) for df in applied]
    return encoded, applied


# ---- categories and pseudo labels -------------------------------------------

def vocabularies(df: DataFrame, cols: Sequence[str], na_token: str = NA_TOKEN) -> DataFrame:
    """(column, value, code) of all columns in one pass: codes follow the sorted values, and missing
    is a value of its own."""
    entries = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(na_token)).alias("value"))
               for c in cols]
    values = df.select(F.inline(F.array(*entries))).distinct()
    ranked = row_positions(values, ["column"], [F.col("value")], "_rank")
    return ranked.select("column", "value", (F.col("_rank") - 1).cast("int").alias("code"))


def apply_codes(df: DataFrame, words: DataFrame, cols: Sequence[str], na_token: str = NA_TOKEN) -> DataFrame:
    out = df
    for c in cols:
        mine = words.filter(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        token = F.coalesce(F.col(c).cast("string"), F.lit(na_token))
        out = out.join(mine, token == F.col("_value"), "left").withColumn(c, F.col("_code")).drop("_value", "_code")
    return out


def categorical_codes(df: DataFrame, cols: Sequence[str] = CATEGORICAL, na_token: str = NA_TOKEN, *,
                      settle: Settle = unsettled) -> DataFrame:
    """Replace text categories by integer codes of the vocabulary of all given rows."""
    present = [c for c in cols if c in df.columns]
    words = settle(vocabularies(df, present, na_token), "vocabularies")
    return apply_codes(df, words, present, na_token).select(*df.columns)


def pseudo_labels(scored: DataFrame, p: str = "p", *, low: float = 10.0, high: float = 98.0,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Confident unlabeled rows with ``pseudo_y``; cut-offs are exact percentiles per key.

    Cut-offs that coincide would make one row both classes and are refused at run time.
    """
    if not 0 <= low < high <= 100:
        raise ValueError(f"need 0 <= low < high <= 100: {low}, {high}")
    cuts = exact_quantiles(scored, keys, p, {"_low": low / 100, "_high": high / 100}).drop("n_values")
    if keys:
        marked = join_null_safe(scored, cuts, keys)
    else:
        marked = scored.withColumns({c: cuts.select(c).scalar() for c in ("_low", "_high")})
    same = F.raise_error(F.lit("the cut-offs of both classes coincide")).cast("int")
    label = (F.when(F.col("_low") == F.col("_high"), same).when(F.col(p) >= F.col("_high"), 1)
             .when(F.col(p) <= F.col("_low"), 0))
    return marked.withColumn("pseudo_y", label).filter(F.col("pseudo_y").isNotNull()).drop("_low", "_high")
