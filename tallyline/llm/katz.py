"""Language-model scoring: Katz backoff over hash-partitioned n-gram tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.language_id import held_out
from tallyline.llm.text import few_at_a_time, hashed_words, mix, utf8
from tallyline.staging import stage

#: Text of the documents that ask the tables together, and of the share of the corpus that one table partition counts.
CHUNK = 8 << 20
#: Counts up to this are discounted by Good-Turing.
DISCOUNTED = 5
#: Part of an event that every history keeps free, so that one with only frequent successors can back off too.
RESERVE = 0.5
_START, _END = np.uint64(0x5EED0001A5A5A5A5), np.uint64(0x5EED0002B6B6B6B6)
_WORD, _PAIR = 1, 2


def _pack(x: np.ndarray) -> bytes:
    """An integer array as compressed byte planes; planes of high bytes are mostly zero."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T if len(x) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _slices(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """Partition number and extent of the sorted keys that belong to it."""
    place = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.searchsorted(place, np.arange(parts + 1, dtype=np.uint64))
    return [(p, int(cuts[p]), int(cuts[p + 1])) for p in range(parts) if cuts[p] < cuts[p + 1]]


class Chunk:
    """Tokens of some documents as places in their sorted distinct words; every document ends with the end token."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, ends: np.ndarray, held: np.ndarray):
        self.words, self.tokens, self.ends, self.held = words, tokens, ends, held  # ends: token offsets, one per document

    @classmethod
    def of(cls, texts: list[bytes | None], held: np.ndarray) -> Chunk:
        hashes, at = hashed_words(texts)
        tokens = np.insert(hashes, at[1:], _END)
        words, tokens = np.unique(tokens, return_inverse=True)
        return cls(words, tokens.astype(np.uint32), at[1:] + np.arange(1, len(at)), held)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def history(self) -> np.ndarray:
        """Word hash before each token; the start mark before a document's first."""
        before = np.empty(len(self.tokens), np.uint64)
        before[1:] = self.words[self.tokens[:-1]]
        before[np.concatenate([[0], self.ends[:-1]]).astype(int)] = _START
        return before

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct pair hashes, and each token's place among them."""
        return np.unique(mix(mix(self.history() + np.uint64(1)) + self.words[self.tokens]), return_inverse=True)

    def pack(self) -> tuple[bytes, ...]:
        return _pack_sorted(self.words), _pack(self.tokens), _pack(self.ends.astype(np.int64)), self.held.astype(np.uint8).tobytes()

    @classmethod
    def unpack(cls, words: bytes, tokens: bytes, ends: bytes, held: bytes) -> Chunk:
        return cls(_unpack_sorted(words), _unpack(tokens, np.uint32), _unpack(ends, np.int64), np.frombuffer(held, np.uint8).astype(bool))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks named by the task that forms them and their number in it; they are written once and read from there."""
    task, n = TaskContext.get().partitionId(), 0
    for batch in few_at_a_time(batches, most=CHUNK):
        if batch.num_rows:
            chunk = Chunk.of(utf8(batch.column("text")), batch.column("held").to_numpy(zero_copy_only=False).astype(bool))
            columns = [[task << 32 | n], [batch.column("doc_id").to_pylist()], *([x] for x in chunk.pack())]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk", "doc_ids", "words", "tokens", "ends", "held"])
            n += 1


def _asked(parts: int):
    """Every chunk asks each table partition for its words and pairs, and reports their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *packed in zip(*(batch.column(c) for c in ("chunk", "words", "tokens", "ends", "held"))):
                chunk = Chunk.unpack(*(x.as_py() for x in packed))
                train = ~chunk.held[chunk.doc]
                pair_keys, pair = chunk.pairs()
                rows = []
                for kind, keys, at in ((_WORD, chunk.words, chunk.tokens), (_PAIR, pair_keys, pair)):
                    counts = np.bincount(at[train], minlength=len(keys)).astype(np.uint32)
                    rows += [(kind, p, name.as_py(), _pack_sorted(keys[low:high]), _pack(counts[low:high])) for p, low, high in _slices(keys, parts)]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                     pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.binary())], ["kind", "part", "chunk", "keys", "counts"])
    return run


def _answered(rows: pd.DataFrame) -> pd.DataFrame:
    """One partition of a table: the total of every key, sent back in the order asked.

    An answer is twice the total, plus one for the first chunk that asks for the key;
    that chunk alone accounts for it in the backoff weights. The row with chunk null
    holds the partition's counts of counts, its tokens and its types.
    """
    rows = rows.sort_values("chunk", kind="stable")
    keys = [_unpack_sorted(k) for k in rows["keys"]]
    counts = [_unpack(c, np.uint32) for c in rows["counts"]]
    _, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    totals = np.bincount(place, weights=np.concatenate(counts).astype(float)).astype(np.uint64)
    answer = totals[place] * np.uint64(2)
    answer[first] += np.uint64(1)
    ends = np.cumsum([len(k) for k in keys])
    sent = [_pack(answer[e - len(k): e]) for k, e in zip(keys, ends)]
    kind, part = rows["kind"].iloc[0], rows["part"].iloc[0]
    table = [int((totals == r).sum()) for r in range(1, DISCOUNTED + 2)] + [int(totals.sum()), int((totals > 0).sum())]
    return pd.DataFrame({"kind": kind, "part": part, "chunk": pd.array([*rows["chunk"].tolist(), None], dtype="Int64"),
                         "answer": [*sent, None], "table": [*[None] * len(sent), table]})


def good_turing(counts_of_counts: list[int]) -> np.ndarray:
    """Discount factors of counts 0, 1, ... ``DISCOUNTED``, then of all larger ones (1).

    Where the counts of counts are too few for the Katz formula to lie between 0 and
    1, half an event is taken instead.
    """
    n = [0, *counts_of_counts[: DISCOUNTED + 1]]
    d = np.ones(DISCOUNTED + 2)
    rest = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        value = ((r + 1) * n[r + 1] / n[r] / r - rest) / (1.0 - rest) if n[r] and rest < 1.0 else 0.0
        d[r] = value if 0.0 < value < 1.0 else (r - 0.5) / r
    return d


class Model:
    """Scalars of the model: totals, types and discounts; the counts come from the tables."""

    def __init__(self, words: list[int], pairs: list[int]):
        self.tokens, self.types = words[-2], words[-1]
        self.word_discount, self.pair_discount = good_turing(words), good_turing(pairs)
        free = RESERVE + sum((1.0 - self.word_discount[r]) * r * words[r - 1] for r in range(1, DISCOUNTED + 1))
        self.unknown = free / (self.tokens + RESERVE)

    def discounted(self, counts: np.ndarray, discount: np.ndarray) -> np.ndarray:
        return discount[np.minimum(counts, DISCOUNTED + 1)] * counts

    def word(self, counts: np.ndarray) -> np.ndarray:
        """Probability of a word by its count; all unseen words are one event."""
        return np.where(counts > 0, self.discounted(counts, self.word_discount) / (self.tokens + RESERVE), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def _scored(model: Model, parts: int):
    """Scores all tokens but for the backoff weights of unseen pairs.

    Yields one row per document, and for each partition of histories one row with
    what the chunk knows of their backoff weights and which of its documents need them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.unpack(row["words"], row["tokens"], row["ends"], row["held"])
                got = {kind: np.concatenate([_unpack(a["answer"], np.uint64) for a in sorted(row["answers"], key=lambda a: a["part"]) if a["kind"] == kind])
                       for kind in (_WORD, _PAIR)}
                pair_keys, pair = chunk.pairs()
                if len(got[_WORD]) != len(chunk.words) or len(got[_PAIR]) != len(pair_keys):
                    raise RuntimeError("answers do not fit their chunk")
                word_count = (got[_WORD] >> np.uint64(1)).astype(np.int64)
                pair_count, owner = (got[_PAIR] >> np.uint64(1)).astype(np.int64), (got[_PAIR] & np.uint64(1)).astype(bool)
                count, seen, doc = word_count[chunk.tokens], pair_count[pair] > 0, chunk.doc
                history = chunk.history()
                docs = len(chunk.ends)
                first = np.concatenate([[0], chunk.ends[:-1]]).astype(int)
                history_count = np.empty(len(count), np.int64)
                history_count[1:] = count[:-1]
                history_count[first] = row["train_docs"]
                p_word = model.word(count)
                known_history = history_count > 0
                log_p = np.where(seen, np.log10(np.maximum(model.discounted(pair_count[pair], model.pair_discount), 1e-300))
                                 - np.log10(history_count + RESERVE), np.log10(p_word))
                backs_off = ~seen & known_history

                def per_doc(x: np.ndarray) -> np.ndarray:
                    return np.add.reduceat(x, first)

                n = len(row["doc_ids"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]] * docs, pa.int64()), pa.array(np.arange(docs), pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(chunk.held), pa.array(np.diff(chunk.ends, prepend=0).astype(np.int64)), pa.array(per_doc((count > 0).astype(np.int64))),
                     pa.array(per_doc(model.base(count))), pa.array(per_doc(log_p)), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 5], _FIELDS)
                # pairs this chunk accounts for, at their first place here
                places = np.unique(pair, return_index=True)[1]
                mine = places[owner & (pair_count > 0)]
                taken = pair_count[pair[mine]]
                names, back = np.unique(np.concatenate([history[mine], history[backs_off]]), return_inverse=True)
                own, need = back[: len(mine)], back[len(mine):]
                mass = np.bincount(own, weights=p_word[mine], minlength=len(names))
                free = np.bincount(own, weights=((1.0 - model.pair_discount[np.minimum(taken, DISCOUNTED + 1)]) * taken), minlength=len(names))
                counts = np.zeros(len(names), np.int64)
                counts[own] = history_count[mine]
                counts[need] = history_count[backs_off]
                order = np.argsort(need, kind="stable")
                need, need_doc = need[order], doc[backs_off][order]
                rows = []
                for p, low, high in _slices(names, parts):
                    a, b = np.searchsorted(need, [low, high])
                    rows.append((p, _pack_sorted(names[low:high]), _pack(counts[low:high]), _pack(np.column_stack([mass, free])[low:high].reshape(-1)),
                                 _pack((need[a:b] - low).astype(np.uint32)), _pack(need_doc[a:b].astype(np.uint32))))
                columns = list(zip(*rows)) if rows else [[]] * 6
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()),
                     pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(columns[0], pa.int32()),
                     *[pa.array(c, pa.binary()) for c in columns[1:]]], _FIELDS)
    return run


_FIELDS = ["chunk", "place", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "part", "names", "counts", "sums", "need", "need_doc"]
_SCORED = ("chunk long, place long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
           "part int, names binary, counts binary, sums binary, need binary, need_doc binary")


def _weighed(rows: pd.DataFrame) -> pd.DataFrame:
    """One partition of histories: exact backoff weights, summed up for the documents that need them."""
    rows = rows.sort_values("chunk", kind="stable")  # the same sums in the same order on every run
    names = [_unpack_sorted(x) for x in rows["names"]]
    sums = np.concatenate([_unpack(x, np.float64).reshape(-1, 2) for x in rows["sums"]])
    counts = np.concatenate([_unpack(x, np.int64) for x in rows["counts"]])
    distinct, place = np.unique(np.concatenate(names), return_inverse=True)
    mass, free = (np.bincount(place, weights=sums[:, k], minlength=len(distinct)) for k in (0, 1))
    count = np.zeros(len(distinct), np.int64)
    count[place] = counts
    weight = np.log10((free + RESERVE) / (count + RESERVE) / np.maximum(1.0 - mass, 1e-12))
    out, at = [], 0
    for chunk, keys, need, need_doc in zip(rows["chunk"], names, rows["need"], rows["need_doc"]):
        need, need_doc = _unpack(need, np.uint32), _unpack(need_doc, np.uint32)
        total = np.bincount(need_doc, weights=weight[place[at: at + len(keys)]][need])
        who = np.unique(need_doc)
        out.append((chunk, _pack(who), _pack(total[who])))
        at += len(keys)
    return pd.DataFrame(out, columns=["chunk", "places", "weights"])


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """The backoff weights of one chunk's documents over all partitions of histories."""
    places = np.concatenate([_unpack(x, np.uint32) for x in rows["places"]])
    weights = np.concatenate([_unpack(x, np.float64) for x in rows["weights"]])
    total = np.bincount(places, weights=weights)
    who = np.unique(places)
    return pd.DataFrame({"chunk": rows["chunk"].iloc[0], "place": who.astype("int64"), "weight": total[who]})


def score(docs: DataFrame, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row per input row.

    The model is learned from the rows outside the held-out fold. Probability of a
    token after its history: the discounted share of the pair if it was seen in
    training; otherwise the history's backoff weight times the probability of the
    word alone; a history never seen leaves the word alone. A word's own probability
    is its discounted share; unseen words together have what the discounts free.

    Counts live in tables partitioned by key hash, so no key, however common, gathers
    rows: a chunk of documents sends every partition its distinct keys with their
    counts, and receives the totals. The sums for the backoff weights travel the same
    way, and each history's weight makes the probabilities after it sum to one. Chunks
    are written once under names of their own, so equal texts may fill several.

    Null and blank texts are one end token. Null ids belong to no held-out fold.
    Repeated rows are counted and scored each. Without training rows all words are
    unseen and have probability one, together.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    plain = plain.withColumn("held", held_out("doc_id", folds, fold))
    size = plain.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held")).alias("train")).first()
    parts = max(4, -(-(size["bytes"] or 0) // CHUNK))
    chunks = stage(plain.mapInArrow(_packed, "chunk long, doc_ids array<long>, words binary, tokens binary, ends binary, held binary"), "chunks")
    asked = chunks.drop("doc_ids").mapInArrow(_asked(parts), "kind int, part int, chunk long, keys binary, counts binary")
    answered = stage(asked.groupBy("kind", "part").applyInPandas(
        _answered, "kind int, part int, chunk long, answer binary, table array<long>"), "answers")
    tables = {r["kind"]: [r[f"t{k}"] for k in range(DISCOUNTED + 3)] for r in answered.where("chunk is null").groupBy("kind").agg(
        *[F.sum(F.col("table")[k]).alias(f"t{k}") for k in range(DISCOUNTED + 3)]).collect()}
    nothing = [0] * (DISCOUNTED + 3)
    model = Model(tables.get(_WORD, nothing), tables.get(_PAIR, nothing))
    answers = answered.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("kind", "part", "answer")).alias("answers"))
    scored = stage(chunks.join(answers, "chunk", "left").withColumn("train_docs", F.lit(size["train"]))
                   .mapInArrow(_scored(model, parts), _SCORED), "scored")
    weights = (scored.where("part is not null").select("chunk", *_FIELDS[8:]).groupBy("part")
               .applyInPandas(_weighed, "chunk long, places binary, weights binary")
               .groupBy("chunk").applyInPandas(_summed, "chunk long, place long, weight double"))
    rows = scored.where("part is null").select(*_FIELDS[:8])
    return rows.join(weights, ["chunk", "place"], "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score",
        (F.col("score") + F.coalesce("weight", F.lit(0.0))).alias("score"))
