"""Token counts of a word-ending BPE vocabulary by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.text import few_at_a_time, utf8

#: Distinct words whose counts one Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 600_000
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    fresh = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(fresh)) for b in range(256)]


class RankMerger:
    """Counts the symbols that are left of many pre-tokens at once.

    All pre-tokens lie in one flat symbol array. In a round every pre-token finds its
    lowest-ranked adjacent pair and merges all places of that pair, left to right
    without overlap. Where the merged symbol takes part in a merge of lower rank,
    only the first place is merged, because that merge would come next.
    """

    def __init__(self, merges: list, vocab: dict[str, int], suffix: str):
        left, right, made = (np.array(x, np.int64) for x in zip(*(
            (vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges))))
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        first_use = np.full(max(vocab.values()) + 1, _NONE)
        np.minimum.at(first_use, left, np.arange(len(left)))
        np.minimum.at(first_use, right, np.arange(len(left)))
        self.one_place = first_use[made] < np.arange(len(made))
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def counts(self, pretokens: list[bytes]) -> np.ndarray:
        sizes = np.array([len(p) for p in pretokens], np.int64)
        out = sizes.copy()
        raw = np.frombuffer(b"".join(pretokens), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        while len(symbols) > 1:
            pair = np.full(len(symbols), _NONE)
            inside = owner[1:] == owner[:-1]
            pair[:-1][inside] = self._rank(symbols[:-1][inside], symbols[1:][inside])
            starts = np.flatnonzero(np.concatenate([[True], ~inside]))
            least = np.minimum.reduceat(pair, starts)
            reps = np.diff(np.concatenate([starts, [len(symbols)]]))
            least_here = np.repeat(least, reps)
            chosen = (pair == least_here) & (pair != _NONE)
            places = np.flatnonzero(chosen)
            if len(places) == 0:
                break
            # runs of touching places (equal symbols) merge at every second place
            fresh = np.concatenate([[True], np.diff(places) > 1])
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            keep = (np.arange(len(places)) - run_start) % 2 == 0
            first = np.concatenate([[True], owner[places[1:]] != owner[places[:-1]]])
            keep &= first | ~self.one_place[pair[places]]
            places = places[keep]
            symbols[places] = self.made[pair[places]]
            np.subtract.at(out, owner[places], 1)
            stay = np.repeat(least != _NONE, reps)
            stay[places + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return out


class WordCounter:
    """Tokens of white-space separated words, remembered by word."""

    _ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.rules = Tokenizer.from_file(path)
        self.merger = RankMerger(model["merges"], model["vocab"], model["end_of_word_suffix"])
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        special = [re.escape(t["content"].encode()) for t in spec["added_tokens"]]
        self.special = re.compile(b"(" + b"|".join(sorted(special, key=len, reverse=True)) + b")") if special else None
        self.known: dict[bytes, int] = {}

    def _pretokens(self, piece: bytes) -> list[bytes]:
        if piece.isascii():
            return self._ASCII.findall(piece.lower())
        text = self.rules.normalizer.normalize_str(piece.decode("utf-8", "replace"))
        return [bytes(self.byte_of[c] for c in shown) for shown, _ in self.rules.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, words: set[bytes]) -> None:
        fixed, parts = {}, {}
        for word in words:
            pieces = self.special.split(word) if self.special and b"<|" in word else [word]
            fixed[word] = len(pieces) // 2
            parts[word] = [p for piece in pieces[::2] for p in self._pretokens(piece)]
        distinct = list({p for ps in parts.values() for p in ps})
        count = dict(zip(distinct, self.merger.counts(distinct).tolist())) if distinct else {}
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        for word in words:
            self.known[word] = fixed[word] + sum(map(count.__getitem__, parts[word]))

    def tokens(self, texts: list[bytes | None]) -> np.ndarray:
        split = [t.split() if t else [] for t in texts]
        missing = set().union(*split) - self.known.keys()
        if missing:
            self.learn(missing | (set().union(*split) if len(self.known) + len(missing) > REMEMBERED else set()))
        known = self.known.__getitem__
        return np.array([sum(map(known, words)) for words in split], np.int64)


_counters: dict[str, WordCounter] = {}


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = WordCounter(path)
        for batch in few_at_a_time(batches):
            texts = utf8(batch.column("text"))
            n = _counters[path].tokens(texts)
            sizes = np.array([len(t or b"") for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(n), pa.array(n > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``: one row per input row, no shuffle.

    ``vocabulary`` is the path of a tokenizer file with word ends, present on every
    machine. Texts are cut at ASCII white space, where no pre-token can reach
    across; each distinct word is counted once per worker memory. A special token's
    string inside a text counts as one token. Null and blank texts have no tokens;
    null ids and repeated rows are kept as they are.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return plain.mapInArrow(_count(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
