"""Token counts by a SentencePiece model, in Arrow batches that return lengths only.

A model of this kind joins no symbols across the place before a space that follows a
non-space (checked against its vocabulary), so a text is cut there without changing its
tokens; what stands behind the space is encoded by itself, as the model puts a space in
front of every text. Long texts so never reach the encoder whole, batches hold about the
same number of bytes whatever the texts' lengths, and a piece that recurs is encoded once.

Nulls and edges: a null text counts as empty and has 0 bytes and 0 tokens; texts of any
length are cut, a piece without a space is encoded as one; repeated rows each get a row; an
empty table gives no rows; a null doc_id stays null; other columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tripwright.llm.common import pick, text_or_empty, utf8_slices

LIMIT = 4096
BATCH_BYTES = 1 << 20
KNOWN_PIECES = 300_000
# U+2581 is the model's sign for a space; one in the text is not told apart from it.
CUT = re.compile("(?<=[^ ▁]) ")
_known: dict[str, dict[str, int]] = {}


@lru_cache(maxsize=2)
def model(path: str):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError(f"{path} has pieces that reach across a space; texts can't be cut there")
    if len(processor.encode(["a  b", " a", "a "], out_type=str)[1]) != 2:
        raise ValueError(f"{path} drops or adds white space; texts can't be cut there")
    return processor


def count_tokens(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Tokens of each text; each distinct piece of the batch goes through the encoder once."""
    processor, known = model(path), _known.setdefault(path, {"": 1})
    if len(known) > KNOWN_PIECES:
        known.clear()
        known[""] = 1  # a space with nothing behind it
    pieces = [CUT.split(t) for t in texts]
    new = list({p for parts in pieces for p in parts}.difference(known))
    for a, b in utf8_slices([len(p) for p in new], batch_bytes):
        known.update(zip(new[a:b], map(len, processor.encode(new[a:b], num_threads=1))))
    return [sum(map(known.__getitem__, parts)) if text else 0 for text, parts in zip(texts, pieces)]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens and whether n_tokens exceeds ``limit``."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, column = batch.column(0), batch.column(2), batch.column(1)
            for a, b in utf8_slices(sizes.to_pylist(), batch_bytes):
                counts = count_tokens(column.slice(a, b - a).to_pylist(), path, batch_bytes)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), sizes.slice(a, b - a), pa.array(counts, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"])

    rows = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
        F.octet_length(text_or_empty()).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
