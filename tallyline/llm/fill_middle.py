"""Fill-in-the-middle over texts kept as independent compressed frames.

A text is stored as Zstandard frames of bounded size that decompress alone, each
with the units (lines or characters) and code points it holds, so their running sums
lead from a unit to its frame.  A cut opens one frame; all others are handed on as
they are, since frames in a row are one valid stream.  The transformed text is
such a stream too, and everything read from it (digests, the original text) streams
it frame by frame.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.text import few_at_a_time, utf8
from tallyline.staging import stage

#: Bytes of text in a frame; a frame ends at a code point.
FRAME = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
STORE_SCHEMA = ("doc_id long, n_units long, marked boolean, "
                "frames array<struct<ends: long, chars: long, size: long, data: binary>>")
RESULT_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>"
_CONTINUES = bytes(range(0x80, 0xC0))


def n_chars(data: bytes) -> int:
    return len(data.translate(None, _CONTINUES))


def char_at(data: bytes, k: int) -> int:
    """Byte at which code point ``k`` starts; the length beyond the last."""
    starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return int(starts[k]) if k < len(starts) else len(data)


def line_end(data: bytes, k: int) -> int:
    """Byte after the ``k``-th newline (``k`` from 1); the length if there are fewer."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    return int(ends[k - 1]) + 1 if k <= len(ends) else len(data)


def pieces(text: bytes, frame: int = FRAME) -> Iterator[bytes]:
    """The text in order, in pieces of at most ``frame`` bytes (4 at least) that end at code points."""
    at = 0
    while at < len(text):
        end = min(len(text), at + frame)
        while end < len(text) and 0x80 <= text[end] < 0xC0:
            end -= 1
        yield text[at:end]
        at = end


class Frames:
    """Running unit, character and byte counts of one text's frames; opens only frames that a cut falls into."""

    def __init__(self, frames: list[dict], unit: str):
        self.data = [f["data"] for f in frames]
        self.unit, self.opened = unit, 0
        sums = lambda name: np.concatenate([[0], np.cumsum([f[name] for f in frames], dtype=np.int64)])
        self.units, self.chars = sums("ends" if unit == "line" else "chars"), sums("chars")

    def open(self, k: int) -> bytes:
        self.opened += 1
        return _expand(self.data[k])

    def cut(self, units: int) -> tuple[int, bytes, bytes, int]:
        """``(frame, head, tail, code points before)``: the place after so many units, inside frame ``frame``.

        ``head`` and ``tail`` are the frame's text on both sides, both empty if the place is the frame's start.
        """
        if units <= 0:
            return 0, b"", b"", 0
        k = int(np.searchsorted(self.units, units)) - 1  # the first frame whose running count reaches it
        if k >= len(self.data):  # only the last unit of a text can lack an end
            return len(self.data), b"", b"", int(self.chars[-1])
        if units == self.units[k + 1] and self.unit != "line":
            return k + 1, b"", b"", int(self.chars[k + 1])
        text, inside = self.open(k), int(units - self.units[k])
        at = line_end(text, inside) if self.unit == "line" else char_at(text, inside)
        if at == len(text):
            return k + 1, b"", b"", int(self.chars[k + 1])
        return k, text[:at], text[at:], int(self.chars[k]) + n_chars(text[:at])


_tools: list = []


def _shrink(data: bytes) -> bytes:
    if not _tools:
        _tools.extend([zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()])
    return _tools[0].compress(data)


def _expand(data: bytes) -> bytes:
    if not _tools:
        _tools.extend([zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()])
    return _tools[1].decompress(data)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", frame: int = FRAME) -> DataFrame:
    """``doc_id, n_units, marked, frames``: every text as independent frames with their counts.

    A line is ``[^\\n]*\\n|[^\\n]+``; with ``unit="character"`` every code point is a unit.
    ``marked`` tells texts that contain one of the three marks.  Null texts are empty
    and have no frames; null ids, ties and repeated rows are rows like others, and
    columns other than the two named are not read.
    """
    if unit not in ("line", "character"):
        raise ValueError("a unit is a line or a character")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                text = text or b""
                frames = [{"ends": p.count(b"\n"), "chars": n_chars(p), "size": len(p), "data": _shrink(p)} for p in pieces(text, frame)]
                lines = sum(f["ends"] for f in frames) + (text[-1:] not in (b"", b"\n"))
                rows.append({"doc_id": doc, "n_units": lines if unit == "line" else sum(f["chars"] for f in frames),
                             "marked": any(m in text for m in MARKS), "frames": frames})
            yield pa.RecordBatch.from_pylist(rows, _store_type())

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, STORE_SCHEMA)


def _store_type() -> pa.Schema:
    counts = [pa.field(c, pa.int64()) for c in ("ends", "chars", "size")]
    return pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("marked", pa.bool_()),
                      ("frames", pa.list_(pa.struct([*counts, pa.field("data", pa.binary())])))])


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits that depend only on the seed and the id (nothing for null)."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).hexdigest()
    return [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]


def transformed(doc_id: int | None, n: int, marked: bool, frames: Frames, seed: int, rate: int, spm_rate: int) -> tuple:
    """``(form, prefix characters, middle characters, output frames)`` of one stored text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not frames.data or marked or h3 % 100 >= rate:
        return "plain", None, None, frames.data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, a_head, a_tail, start), (b, b_head, b_tail, end) = frames.cut(low), frames.cut(high)
    small = lambda t: [_shrink(t)] if t else []
    prefix = frames.data[:a] + small(a_head)
    if a == b and a_tail:  # both cuts fall into one frame
        middle, suffix = small(a_tail[: len(b_head) - len(a_head)]), small(b_tail) + frames.data[b + 1:]
    else:
        middle = (small(a_tail) + frames.data[a + 1: b] if a_tail else frames.data[a:b]) + small(b_head)
        suffix = small(b_tail) + frames.data[b + 1:] if b_tail else frames.data[b:]
    p, s, m = map(_shrink, MARKS)
    if h4 % 100 < spm_rate:
        return "spm", start, end - start, [s, *suffix, p, *prefix, m, *middle]
    return "psm", start, end - start, [p, *prefix, s, *suffix, m, *middle]


def fill_in_middle(stored: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: texts of ``store`` with their middle moved to the end.

    Cuts, order (``psm``: prefix, suffix, middle; ``spm``: suffix, prefix, middle) and
    the share of texts transformed (``rate`` percent) follow from the seed and the id
    alone, so reruns agree wherever a task runs.  ``output`` is a list of frames in
    order; ``texts`` turns it into text.  Texts that are empty or contain a mark stay
    ``plain``, with null counts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                for doc, n, marked, frames in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    rows.append((doc, n, *transformed(doc, n, marked, Frames(frames, unit), seed, rate, spm_rate)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return stored.select("doc_id", "n_units", "marked", "frames").mapInArrow(run, RESULT_SCHEMA)


def stream(frames: list[bytes]) -> Iterator[bytes]:
    for frame in frames:
        yield _expand(frame)


def sections(chunks: Iterator[bytes], marks: tuple[bytes, ...]) -> Iterator[tuple[int, bytes]]:
    """``(section, bytes)`` of a streamed text whose sections begin with the given marks in turn.

    No mark can overlap a mark's true place, for none begins as another or itself
    ends; so the first occurrence is the place, also where a chunk's end cuts it.
    """
    at, rest = -1, b""
    for chunk in chunks:
        rest += chunk
        while at + 1 < len(marks) and (place := rest.find(marks[at + 1])) >= 0:
            if place:
                yield at, rest[:place]
            rest, at = rest[place + len(marks[at + 1]):], at + 1
        keep = len(marks[at + 1]) - 1 if at + 1 < len(marks) else 0
        if len(rest) > keep:
            yield at, rest[: len(rest) - keep]
            rest = rest[len(rest) - keep:] if keep else b""
    if rest:
        yield at, rest


def restored(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The original text, in order, from a transformed text and its form."""
    if form == "plain":
        yield from stream(frames)
        return
    marks, last = ((PREFIX, SUFFIX, MIDDLE), 1) if form == "psm" else ((SUFFIX, PREFIX, MIDDLE), 0)
    yield from (data for k, data in sections(stream(frames), marks) if k != last)  # prefix, then middle
    for k, data in sections(stream(frames), marks):
        if k > last:
            break
        if k == last:
            yield data


def _digest(chunks: Iterator[bytes]) -> str:
    out = hashlib.sha256()
    for chunk in chunks:
        out.update(chunk)
    return out.hexdigest()


def _with(made: DataFrame, schema: str, add) -> DataFrame:
    kept = [c for c in made.columns if c not in ("output", "output_text", "original_text", "output_sha256", "restored_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [add(o, f) for o, f in zip(part.column("output").to_pylist(), part.column("form").to_pylist())]
                new = {name: pa.array([r[name] for r in rows]) for name in rows[0]}
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *new.values()], [*kept, *new])

    types = dict(made.dtypes)
    return made.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in kept], schema]))


def texts(made: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``output_text`` instead of frames."""
    return _with(made, "output_text string", lambda o, f: {"output_text": b"".join(stream(o)).decode("utf-8", "replace")})


def originals(made: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``original_text``, rebuilt from output and form."""
    return _with(made, "original_text string", lambda o, f: {"original_text": b"".join(restored(o, f)).decode("utf-8", "replace")})


def digests(made: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with SHA-256 of the output and of the text rebuilt from it, streamed by frames."""
    return _with(made, "output_sha256 string, restored_sha256 string",
                 lambda o, f: {"output_sha256": _digest(stream(o)), "restored_sha256": _digest(restored(o, f))})


def fill_in_middle_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line",
                           frame: int = FRAME, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """Store the texts as frames in a table, transform them from it, and take digests of both directions.

    The store is written once, so a lost executor repeats only the transformation of
    its rows; nothing is shuffled.  An empty table gives no rows.
    """
    stored = stage(store(docs, id_col, text_col, unit, frame), "frames")
    return digests(fill_in_middle(stored, unit, seed, rate, spm_rate))
