"""What the operators of this subpackage share: safe column picking, words, row-keeping."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwright.operators.skew import by_shuffle

# Words are runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def positional(df: DataFrame) -> DataFrame:
    """The same columns named by position, so that no name of the input can clash."""
    return df.toDF(*[f"_in{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """Positional name of a column; an exact match wins over one that differs in case."""
    if name in df.columns:
        return f"_in{df.columns.index(name)}"
    lowered = [c.lower() for c in df.columns]
    if name.lower() in lowered:
        return f"_in{lowered.index(name.lower())}"
    raise ValueError(f"no column {name!r} among {df.columns}")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds."""
    return positional(df).select(*[F.col(place(df, n)).alias(n) for n in names])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_mark(name: str = "text") -> Column:
    """Tells texts under one doc_id apart when a decision is brought back to its row."""
    return F.xxhash64(text_or_empty(name))


def doc_remainder(modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo; a null doc_id counts as the empty text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % modulus


def apply_copies(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Documents repeated as often as decided, with exactly the columns of ``docs``.

    ``decisions`` has doc_id, mark (``text_mark``) and copies. Rows of ``docs`` that agree
    in doc_id and mark count once and come out with the sum of their copies; rows without
    a decision go. The join key holds the text's mark, so one repeated id stays spread.
    """
    wanted = (decisions.filter(F.col("copies") > 0)
              .groupBy(F.coalesce("doc_id", F.lit(0)).alias("_k"), F.col("doc_id").isNull().alias("_n"),
                       F.col("mark").alias("_m"))
              .agg(F.sum("copies").alias("_copies")))
    flat = positional(docs)
    doc_id, text = place(docs, "doc_id"), place(docs, "text")
    keyed = flat.select("*", F.coalesce(doc_id, F.lit(0)).alias("_k"), F.col(doc_id).isNull().alias("_n"),
                        text_mark(text).alias("_m"))
    joined = keyed.join(by_shuffle(wanted), ["_k", "_n", "_m"])
    once = Window.partitionBy("_k", "_n", "_m").orderBy(text)
    kept = (joined.withColumn("_once", F.row_number().over(once)).filter("_once = 1")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))))
    return kept.select(*[F.col(c).alias(name) for c, name in zip(flat.columns, docs.columns)])


def utf8_slices(sizes: Sequence[int], limit: int) -> list[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about ``limit``; a larger item stands alone."""
    out, start, held = [], 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            out.append((start, i))
            start, held = i, 0
        held += size
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def word_codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    distinct = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return distinct[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, np.uint64)


def multipliers(n: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit factors for hashing sequences of word codes."""
    return np.random.default_rng(seed).integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
