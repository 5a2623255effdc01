"""Fill-in-the-middle texts over seekable compressed frames.

A text is stored as independent zstandard frames of at most ``frame_bytes`` bytes, cut between
code points, with the cumulative numbers of units and code points at the end of each. A
unit (a word with the white space in front of it, or white space at the end) counts in the
frame in which it ends, so a unit longer than a frame does no harm. A cut is found in the
cumulative counts, and only the frame that holds it is decompressed; all others move to
their place in the output as they are. The output is again an array of frames (joined,
they are one zstandard stream); digests and the way back stream them in order, so that no
text is held whole once it is stored.

Nulls and edges: a null or empty text has no units and stays plain; a null doc_id is hashed
as the empty text; texts of any length are cut into frames; equal rows each give a row; an
empty table gives no rows; other columns are ignored. Texts that contain a marker stay
plain, so the way back can't mistake text for one: markers do not overlap each other.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from tripwright.llm.common import pick, text_or_empty, utf8_slices

FRAME_BYTES, LEVEL = 1 << 16, 1
BATCH_BYTES = 4 << 20
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
# The order of the parts in the output of each form.
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

STORE = "doc_id long, marked boolean, n long, units array<long>, chars array<long>, frames array<binary>"
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"


# ---- one text -----------------------------------------------------------------

def unit_ends(data: np.ndarray) -> np.ndarray:
    """Byte offsets behind the units of a text; of a frame, the last stands for a unit that ends with it."""
    word = ~SPACES[data]
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    return np.append(ends, len(data)) if len(data) else ends


def starts_of_points(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def to_frames(text: bytes, frame_bytes: int, press) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Cumulative units and code points at the end of each frame, and the frames."""
    data = np.frombuffer(text, np.uint8)
    bounds, begin = [0], 0
    while begin < len(text):
        end = min(begin + max(frame_bytes, 4), len(text))
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        bounds.append(end)
        begin = end
    ends, points = unit_ends(data), np.concatenate([[0], np.cumsum(starts_of_points(data))])
    frames = [press(text[a:b]) for a, b in zip(bounds, bounds[1:])]
    return np.searchsorted(ends, bounds[1:], "right"), points[bounds[1:]], frames


class Cut:
    """Where a number of units ends: frame, byte offset in it and code points up to there."""

    def __init__(self, at: int, units: np.ndarray, chars: np.ndarray, read):
        if at == 0 or not len(units):
            self.frame = self.offset = self.chars = 0
            return
        self.frame = int(np.searchsorted(units, at))
        before = self.frame - 1
        data = np.frombuffer(read(self.frame), np.uint8)
        self.offset = int(unit_ends(data)[at - (int(units[before]) if self.frame else 0) - 1])
        self.chars = (int(chars[before]) if self.frame else 0) + int(starts_of_points(data[:self.offset]).sum())


def between(first: Cut | None, last: Cut | None, frames: list[bytes], read, press) -> list[bytes]:
    """Frames from one cut to another (None: the end); only frames with a cut are pressed anew."""
    begin, skip = (first.frame, first.offset) if first else (0, 0)
    end, stop = (last.frame, last.offset) if last else (len(frames), 0)
    if begin == end:
        part = read(begin)[skip:stop] if stop > skip else b""
        return [press(part)] if part else []
    head = read(begin)[skip:] if skip else None
    out = ([press(head)] if head else []) if skip else [frames[begin]]
    out += frames[begin + 1:end]
    return out + [press(read(end)[:stop])] if stop else out


def parts_of(a: int, b: int, units, chars, frames: list[bytes], press, unpress) -> tuple[dict[str, list[bytes]], int, int]:
    """Prefix, middle and suffix as frames, and the code points of the first two."""
    opened: dict[int, bytes] = {}

    def read(i: int) -> bytes:
        if i not in opened:
            opened[i] = unpress(frames[i])
        return opened[i]

    first, last = Cut(a, units, chars, read), Cut(b, units, chars, read)
    parts = {"prefix": between(None, first, frames, read, press), "middle": between(first, last, frames, read, press),
             "suffix": between(last, None, frames, read, press)}
    return parts, first.chars, last.chars - first.chars


def output_digests(frames: list[bytes], form: str, unpress) -> tuple[str, str]:
    """SHA-256 of the output and of the text rebuilt from it, frame by frame."""
    whole, sizes = sha256(), []
    order = ORDER.get(form, ())
    wanted, found, tail, begin = [MARKS[p] for p in order], [], b"", 0
    for frame in frames:
        data = unpress(frame)
        whole.update(data)
        sizes.append(len(data))
        seen, base, start = tail + data, begin - len(tail), 0
        while len(found) < len(wanted) and (at := seen.find(wanted[len(found)], start)) >= 0:
            found.append(base + at)
            start = at + 3
        tail = seen[max(start, len(seen) - 2):]
        begin += len(data)
    if not order:
        return whole.hexdigest(), whole.hexdigest()
    if len(found) < len(wanted):
        raise ValueError(f"output of form {form} lacks its markers")
    ranges = dict(zip(order, zip([p + 3 for p in found], [*found[1:], begin])))
    bounds, rebuilt = np.concatenate([[0], np.cumsum(sizes)]), sha256()
    for part in ("prefix", "middle", "suffix"):
        low, high = ranges[part]
        i = int(np.searchsorted(bounds, low, "right")) - 1
        while low < high:
            upto = min(high, int(bounds[i + 1]))
            if upto > low:
                rebuilt.update(unpress(frames[i])[low - int(bounds[i]):upto - int(bounds[i])])
            low, i = upto, i + 1
    return whole.hexdigest(), rebuilt.hexdigest()


# ---- tables -------------------------------------------------------------------

def store_frames(docs: DataFrame, *, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> DataFrame:
    """Every text as frames with cumulative counts; ``marked`` says whether it contains a marker."""

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=level).compress
        for batch in source:
            for a, b in utf8_slices(pc.binary_length(batch.column(2)).to_pylist(), BATCH_BYTES):
                part = batch.slice(a, b - a)
                packed = [to_frames(t.as_buffer().to_pybytes(), frame_bytes, press) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([int(u[-1]) if len(u) else 0 for u, _, _ in packed], pa.int64()),
                     pa.array([u for u, _, _ in packed], pa.list_(pa.int64())), pa.array([c for _, c, _ in packed], pa.list_(pa.int64())),
                     pa.array([f for _, _, f in packed], pa.list_(pa.binary()))],
                    ["doc_id", "marked", "n", "units", "chars", "frames"])

    text = text_or_empty()
    marked = F.contains(text, F.lit("<P>")) | F.contains(text, F.lit("<S>")) | F.contains(text, F.lit("<M>"))
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), marked.alias("marked"), text.alias("text"))
    return rows.mapInArrow(pack, STORE)


def with_cuts(store: DataFrame, *, seed: str = "42", fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """The store with the two cuts (``a``, ``b`` units) and the form, drawn from a hash of doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    one, two = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    form = (F.when((F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= fim_percent), "plain")
            .when(h[3] % 100 < spm_percent, "spm").otherwise("psm"))
    return store.select("*", F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), form.alias("form"))


def fill_in_middle(docs: DataFrame, *, frame_bytes: int = FRAME_BYTES, level: int = LEVEL, seed: str = "42",
                   fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (null if plain) and the output's frames."""

    def move(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, unpress = zstandard.ZstdCompressor(level=level).compress, zstandard.ZstdDecompressor().decompress
        marks = {part: press(mark) for part, mark in MARKS.items()}
        for batch in source:
            sizes = pc.binary_length(batch.column("frames").flatten())
            offsets = batch.column("frames").offsets
            totals = np.concatenate([[0], np.cumsum(sizes)])
            bounds = offsets.to_numpy() - offsets[0].as_py()
            for begin, end in utf8_slices(np.diff(totals[bounds]).tolist(), BATCH_BYTES):
                out = []
                for row in batch.slice(begin, end - begin).to_pylist():
                    if row["form"] == "plain":
                        out.append((None, None, row["frames"]))
                        continue
                    parts, prefix, middle = parts_of(row["a"], row["b"], np.array(row["units"]), np.array(row["chars"]), row["frames"], press, unpress)
                    out.append((prefix, middle, [f for p in ORDER[row["form"]] for f in (marks[p], *parts[p])]))
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n"), part.column("form"), pa.array([o[0] for o in out], pa.int64()),
                     pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.binary()))],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"])

    cut = with_cuts(store_frames(docs, frame_bytes=frame_bytes, level=level), seed=seed, fim_percent=fim_percent, spm_percent=spm_percent)
    return cut.drop("marked").mapInArrow(move, OUTPUT)


def output_texts(outputs: DataFrame) -> DataFrame:
    """The outputs as texts: doc_id, n, form, prefix_chars, middle_chars, output."""

    def open_frames(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in source:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                text = b"".join(map(unpress, row.column("frames")[0].as_py())).decode()
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([text])], [*row.schema.names[:-1], "output"])

    return outputs.mapInArrow(open_frames, OUTPUT.replace("frames array<binary>", "output string"))


def digests(outputs: DataFrame) -> DataFrame:
    """The outputs with output_sha256 and restored_sha256 instead of their frames."""

    def stream(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in source:
            both = [output_digests(frames.as_py(), form.as_py(), unpress) for frames, form in zip(batch.column("frames"), batch.column("form"))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([b[0] for b in both], pa.string()), pa.array([b[1] for b in both], pa.string())],
                [*batch.schema.names[:-1], "output_sha256", "restored_sha256"])

    return outputs.mapInArrow(stream, OUTPUT.replace("frames array<binary>", "output_sha256 string, restored_sha256 string"))
