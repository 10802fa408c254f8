"""Packing of tokenised documents into sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyline.llm.text import few_at_a_time, give_back
from tallyline.llm.token_counts import byte_letters
from tallyline.staging import stage

#: Distinct words whose ids one Python worker remembers (about 200 MB); beyond it, and after a partition, the memory starts anew.
REMEMBERED = 250_000
#: Pieces of one length that are numbered together in one window group.
GROUP = 1 << 16


class PieceEncoder:
    """Token ids of texts, remembered by word with its leading space.

    A byte-level pre-tokenizer never joins text across a space between two visible
    characters: the space begins the next pre-token. Texts are cut there, and each
    distinct part is encoded once. Where the file's ids are its merge ranks, parts
    are encoded by those ranks, which takes a fraction of the library's time for the
    same ids; otherwise, and for texts with special strings, by the library.
    """

    _PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    #: White space that is rare in prose, and white space in a row; without them every space is such a place.
    _RARE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"] + ["  ", " \n", "\n ", "\n\n"]
    _CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.by_rank = self._ranked(path)

    def _ranked(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        step = spec.get("pre_tokenizer") or {}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        plain = (step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and spec.get("normalizer") is None
                 and all(x < y for x, y in zip(made, made[1:])) and sorted(vocab[c] for c in byte_of) == list(range(256))
                 and all(set(t) <= byte_of.keys() for t in vocab))
        if not plain:
            return None
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocab.items()}
        return tiktoken.Encoding("ranks", pat_str=self._PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_words(self, parts: list[str]) -> list[bytes]:
        return [array("I", self.by_rank(p)).tobytes() for p in parts] if self.by_rank else self._encode(parts)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        cut: list[list[str]] = []
        for text in texts:
            if not text:
                cut.append([])
            elif any(s in text for s in self.special):
                cut.append(["\0", text])  # encoded whole
            else:
                odd = text[0] in " \n" or text[-1] in " \n" or any(c in text for c in self._RARE)
                cut.append(self._CUT.split(text) if odd else text.split(" "))
        later = set().union(*(c[1:] for c in cut if c and c[0] != "\0"))
        missing = [w for w in later if w not in self.known]
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = list(later)
        self.known.update(zip(missing, self._encode_words([" " + w for w in missing])))
        first = self._encode([(c[1] if c[0] == "\0" else c[0]) if c else "" for c in cut])
        known = self.known.__getitem__
        return [f + b"".join(map(known, c[1:])) if c and c[0] != "\0" else f for f, c in zip(first, cut)]


_encoders: dict[str, PieceEncoder] = {}


def _pieces(path: str, room: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = PieceEncoder(path)
        try:
            for batch in few_at_a_time(batches):
                rows: list[tuple] = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), _encoders[path].ids(batch.column("text").to_pylist())):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, room):
                        part = ids[4 * start: 4 * (start + room)]
                        rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        finally:
            _encoders[path].known.clear()
            give_back()
    return run


def place(histogram: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces, longest first: rows ``(length, first_rank, n, first_sequence, offset)``.

    The pieces of a length with ranks ``first_rank ...`` go to ``n`` consecutive
    sequences at one offset. A pattern is a run of sequences filled alike; each step
    takes the shortest pack (the pattern with most room), and splits it when it has
    more sequences than pieces are left.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    fresh = most = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            while most >= length and not open_[most]:
                most -= 1
            if most >= length:
                first, n = open_[most].pop()
                space = most
            else:
                first, n, space = fresh, left, room
                fresh += left
            take = min(n, left)
            rows.append((length, rank, take, first, room - space))
            if take < n:
                open_[space].append((first + take, n - take))
            open_[space - length].append((first, take))
            most = max(most, space - length)
            rank, left = rank + take, left - take
    return rows


def pack(docs: DataFrame, vocabulary: str, room: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row per piece.

    A document's ids and the end id are cut into full pieces of ``room`` and a rest.
    The histogram of rests has at most ``room`` entries, so it is placed on the
    driver; the placing table is bounded by it as well and is broadcast. Pieces get
    their rank within a length from hash groups of bounded size and the groups'
    running totals, so a very common length needs no single task.
    Null and empty texts have one piece, the end id. Repeated rows are packed as
    often as they occur; null ids are packed too.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    cut = stage(plain.mapInArrow(_pieces(vocabulary, room, end_id),
                                 "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    spark = docs.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    groups = max(1, sum(histogram.values()) // GROUP)
    rows = place(histogram, room)
    places = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, first_rank long, n long, first_sequence long, shift long")
    grouped = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    before = (grouped.groupBy("length", "part").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).drop("n"))
    inside = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32"))
    ranked = (grouped.withColumn("inside", inside).join(stage(before, "before"), ["length", "part"])
              .withColumn("rank", F.col("before") + F.col("inside") - 1))
    at = F.col("rank") - F.col("first_rank")
    return (ranked.join(F.broadcast(places), "length").where((at >= 0) & (at < F.col("n")))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                    (F.col("first_sequence") + at).alias("sequence_id"), F.col("shift").alias("offset")))
