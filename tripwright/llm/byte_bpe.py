"""Byte-level BPE by overlapping chunks: ids of whole texts, and their decoding.

A text of up to ``chunk`` characters is encoded where its row lies. A longer one is cut into
chunks that overlap; the chunks are pre-tokenised in parallel, each from its own first
character. Where a boundary found from the left also is one found from the chunk itself,
both scans agree from there on, as a match depends only on the text to its right: the
chunks are stitched there and the pieces between the stitches are encoded in parallel.
Where no boundary resynchronises inside an overlap (a match longer than the overlap), the
rest of that document is one piece. Decoding joins the bytes of the ids.

Nulls and edges: a null text counts as empty and has no ids (both hashes are those of
nothing); repeated rows each get a row; a null doc_id stays null; an
empty table gives no rows; other columns are ignored. Strings of special tokens are
ordinary text.
"""
from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tripwright.llm.common import by_shuffle, pick, text_or_empty
from tripwright.storage import materialize

CHUNK, OVERLAP = 32768, 512
PIECE_ROWS = 256


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def matcher(pattern: str):
    import regex

    return regex.compile(pattern)


def encode_short(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, PIECE_ROWS):
                part = batch.slice(a, PIECE_ROWS)
                ids = [bpe.encode_ordinary(text.as_py()) for text in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode_bytes, ids), pa.binary())],
                    ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(encode, "doc_id long, ids array<int>, decoded binary")


def cut_chunks(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, n, last, doc_id, text): overlapping chunks of the long texts, dealt out evenly."""
    kinds = "row long, doc_id long, n int, last boolean, text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(c for c in batch.columns)):
                whole = text.as_py()
                starts = range(0, len(whole), chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.as_py()] * len(starts), pa.int64()), pa.array([doc_id.as_py()] * len(starts), pa.int64()),
                     pa.array(range(len(starts)), pa.int32()), pa.array([s + chunk >= len(whole) for s in starts]),
                     pa.array([whole[s:s + chunk + overlap] for s in starts])],
                    ["row", "doc_id", "n", "last", "text"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(cut, kinds).repartition("row", "n")


def pretokenise(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row, n, last, head, tail): match ends near both seams, as offsets in the document."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = matcher(pattern)
        for batch in batches:
            head, tail = [], []
            for n, last, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                whole = text.as_py()
                found = [0, *(m.end() for m in scan.finditer(whole))]
                if not last:  # a match that touches the end of the chunk may go on behind it
                    found = found[:bisect_left(found, len(whole))]
                base = n * chunk
                head.append([base + e for e in found[:bisect_left(found, overlap + 1)]])
                tail.append([base + e for e in found[bisect_left(found, chunk):]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2),
                 pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))],
                ["row", "n", "last", "head", "tail"])

    return chunks.select("row", "n", "last", "text").mapInArrow(
        ends, "row long, n int, last boolean, head array<long>, tail array<long>")


def stitches(heads: list[list[int]], tails: list[list[int]]) -> list[int]:
    """Where each piece starts; fewer than chunks if a seam never resynchronises."""
    cuts = [0]
    for tail, head in zip(tails, heads[1:]):
        common = set(head).intersection(e for e in tail if e >= cuts[-1])
        if not common:
            break
        cuts.append(min(common))
    return cuts


def piece_ranges(ends: DataFrame, chunk: int) -> DataFrame:
    """(row, piece, n, start, stop): which part of chunk n belongs to which piece."""

    def ranges(key, frame):
        import pandas as pd

        frame = frame.sort_values("n")
        cuts, chunks = stitches(list(frame["head"]), list(frame["tail"])), len(frame)
        out = [(i, i, cuts[i], cuts[i + 1]) for i in range(len(cuts) - 1)]
        whole = range(len(cuts) - 1, chunks)  # the last piece: one chunk, or the rest of the document
        out += [(len(cuts) - 1, n, max(cuts[-1], n * chunk), -1 if n == chunks - 1 else (n + 1) * chunk) for n in whole]
        return pd.DataFrame([(key[0], *o) for o in out], columns=["row", "piece", "n", "start", "stop"])

    return ends.groupBy("row").applyInPandas(ranges, "row long, piece int, n int, start long, stop long")


def encode_long(rows: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    chunks = materialize(cut_chunks(rows, chunk, overlap), "chunks")
    ranges = piece_ranges(pretokenise(chunks, pattern, chunk, overlap), chunk)
    base = F.col("n") * chunk
    length = F.when(F.col("stop") < 0, F.length("text")).otherwise((F.col("stop") - F.col("start")).cast("int"))
    parts = chunks.join(by_shuffle(ranges), ["row", "n"]).select(
        "row", "doc_id", "piece", "n", F.substring("text", (F.col("start") - base + 1).cast("int"), length).alias("part"))
    in_order = F.array_sort(F.collect_list(F.struct("n", "part")))
    pieces = parts.groupBy("row", "doc_id", "piece").agg(F.array_join(F.transform(in_order, lambda p: p["part"]), "").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = bpe.encode_ordinary(batch.column(3)[i].as_py())
                one = batch.slice(i, 1)
                # a piece starts and ends with a match, so its bytes are whole characters
                yield pa.RecordBatch.from_arrays(
                    [one.column(0), one.column(1), one.column(2), pa.array([ids], pa.list_(pa.int32())),
                     pa.array([bpe.decode_bytes(ids).decode("utf-8")])], ["row", "doc_id", "piece", "ids", "decoded"])

    encoded = pieces.select("row", "doc_id", "piece", "text").mapInArrow(
        encode, "row long, doc_id long, piece int, ids array<int>, decoded string")
    whole = encoded.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "ids", "decoded"))).alias("pieces"))
    return whole.select("doc_id", F.flatten(F.transform("pieces", lambda p: p["ids"])).alias("ids"),
                        F.array_join(F.transform("pieces", lambda p: p["decoded"]), "").cast("binary").alias("decoded"))


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document: doc_id, its ids, and the bytes that the ids decode to."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    short = encode_short(rows.filter(F.length("text") <= chunk), path, pattern)
    return short.unionByName(encode_long(rows.filter(F.length("text") > chunk), path, pattern, chunk, overlap))


def encoding_digests(encoded: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256."""
    written = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of tables that hold (doc_id, ids) alone; ids of no characters become U+FFFD."""

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, PIECE_ROWS):
                part = batch.slice(a, PIECE_ROWS)
                texts = [bpe.decode_bytes(i or []).decode("utf-8", "replace") for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(encoded, "doc_id", "ids").mapInArrow(text, "doc_id long, text string")
