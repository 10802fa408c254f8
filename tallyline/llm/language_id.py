"""Language identification by cross-parsing with suffix automata over the UTF-8 bytes of letters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyline.llm.text import give_back
from tallyline.staging import stage

#: Training bound: so many rows of each language at most, and so many bytes of their letters together, shared evenly.
SAMPLE_ROWS, SAMPLE_SYMBOLS = 64, 24_000
#: Texts are parsed in blocks of so many symbols, all blocks in step.
BLOCK = 256
UNKNOWN = "und"

_lower: np.ndarray | None = None


def _lowered() -> np.ndarray:
    """For every code point its lower-case letter, or 0 where it is no letter."""
    global _lower
    if _lower is None:
        table = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low[0]) if low[0].isalpha() else cp
        _lower = table
    return _lower


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, 0 for other characters, with offsets."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    return _lowered()[flat], np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def squeeze(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of other characters become one boundary; offsets follow."""
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    keep[offsets[:-1][offsets[:-1] < len(points)]] = True
    return points[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the lower-case letters of all texts, a zero byte for each run of other characters, with offsets."""
    points, offsets = squeeze(*code_points(texts))
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.empty(at[-1], np.uint8)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)
    for n in range(1, 5):
        which = np.flatnonzero(width == n)
        some, first = points[which], at[:-1][which]
        out[first] = lead[n] | (some >> np.uint32(6 * (n - 1)))
        for k in range(1, n):
            out[first + k] = 0x80 | ((some >> np.uint32(6 * (n - 1 - k))) & np.uint32(0x3F))
    return out, at[offsets]


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of every state; 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols.tolist():
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in step[p]:
            step[p][s] = new
            p = link[p]
        if p >= 0:
            q = step[p][s]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(s) == q:
                    step[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Automaton:
    """Cross-parsing table of one training text.

    The states are those of the text's suffix automaton, so following transitions
    from the root finds the longest match of what is parsed.  Without a transition the
    phrase ends and parsing goes on from the root with the same symbol; a symbol that
    the text lacks is a phrase of its own.  Transitions lie in one array: that of
    ``state`` by ``symbol`` at ``base[state] + symbol`` if ``owner`` there is the state.
    """

    def __init__(self, sample: np.ndarray):
        step = suffix_automaton(sample)
        total = sum(map(len, step))
        base, owner, to = [0] * len(step), [-1] * (2 * total + 1024), [0] * (2 * total + 1024)
        free = probe = 256  # lone transitions go to the first free place, others are sought from a place that moves on
        for state in sorted(range(len(step)), key=lambda k: -len(step[k])):
            out = step[state]
            if not out:
                continue
            least = min(out)
            if len(out) == 1:
                while owner[free] >= 0:
                    free += 1
            at = begin = free if len(out) == 1 else probe
            while True:
                if at + 512 > len(owner):
                    owner += [-1] * len(owner)
                    to += [0] * len(to)
                if owner[at] < 0 and all(owner[at - least + s] < 0 for s in out):
                    break
                at += 1
            probe = at if at - begin > 16 else probe
            base[state] = at - least
            for s, nxt in out.items():
                owner[at - least + s], to[at - least + s] = state, nxt
        self.base, self.owner, self.to = (np.array(x, np.int32) for x in (base, owner, to))
        self.first, self.odd = np.zeros(256, np.int32), np.ones(256, np.int32)
        for s, nxt in step[0].items():
            self.first[s], self.odd[s] = nxt, 0
        self.size = len(sample)

    def parse(self, columns: list[np.ndarray]) -> np.ndarray:
        """Phrases of texts given column by column, the longest texts first."""
        state = np.zeros(len(columns[0]) if columns else 0, np.int32)
        ended = np.zeros(len(state), np.int32)
        for column in columns:
            n = len(column)
            now = state[:n].copy()
            at = self.base[now] + column
            held = self.owner[at] == now
            fails = np.flatnonzero(~held)
            state[:n] = self.to[at]
            if len(fails):
                symbol = column[fails]
                # what was open ends, unless nothing was; an odd symbol is one more phrase
                ended[fails] += (now[fails] != 0) + self.odd[symbol]
                state[fails] = self.first[symbol]
        return ended + (state != 0)


def phrase_counts(symbols: np.ndarray, offsets: np.ndarray, automata: list[Automaton]) -> np.ndarray:
    """Phrases of every text under every automaton: ``[text, automaton]``; a phrase ends at a block's end."""
    sizes = np.diff(offsets)
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = offsets[:-1][owner] + within * BLOCK
    length = np.minimum(BLOCK, offsets[1:][owner] - start)
    order = np.argsort(-length, kind="stable")
    start, length, owner = start[order], length[order], owner[order]
    columns = []
    for k in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -k, side="left"))  # blocks longer than k
        columns.append(symbols[start[:n] + k])
    out = np.zeros((len(sizes), len(automata)))
    for k, machine in enumerate(automata):
        np.add.at(out[:, k], owner, machine.parse(columns))
    return out


class CrossParser:
    """Languages with their training bytes; automata are built once per worker and are small."""

    def __init__(self, samples: dict[str, np.ndarray]):
        self.names = sorted(samples)
        self.samples = [samples[name] for name in self.names]

    def automata(self) -> list[Automaton]:
        key = (tuple(self.names), tuple(s.tobytes() for s in self.samples))
        if _built.get("key") != key:
            _built.update(key=key, automata=[Automaton(s) for s in self.samples])
        return _built["automata"]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        symbols, offsets = letters([t or "" for t in texts])
        lettered = np.diff(np.concatenate([[0], np.cumsum(symbols > 0)])[offsets]) > 0
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        phrases = phrase_counts(symbols, offsets, self.automata())
        cost = phrases * np.log2([len(s) + 1.0 for s in self.samples]) / np.maximum(1, np.diff(offsets))[:, None]
        best = cost.argmin(axis=1)
        low = cost[np.arange(len(cost)), best]
        cost[np.arange(len(cost)), best] = np.inf
        second = cost.min(axis=1)
        sure = np.where(np.isinf(second), 1.0, 1.0 - low / np.where(np.isinf(second), 1.0, np.maximum(low + second, 1e-300)))
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], np.where(lettered, sure, 0.0)


_built: dict = {}


def even_shares(texts: list[np.ndarray], most: int) -> np.ndarray:
    """The starts of all texts, of one length at most, that together have ``most`` symbols; a zero ends each."""
    sizes = np.sort([len(t) + 1 for t in texts])
    left, share = most, 0
    for k, size in enumerate(sizes):
        share = left // (len(sizes) - k)
        if size > share:
            break
        left, share = left - size, most
    return np.concatenate([np.append(t[:max(0, share - 1)], np.uint8(0)) for t in texts]) if texts else np.zeros(0, np.uint8)


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text falls in the fold; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(labelled: DataFrame) -> CrossParser:
    """From ``doc_id, text, lang``: the rows of each language with the least hash, up to the training bound."""
    usable = labelled.where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    first = F.row_number().over(W.partitionBy("lang").orderBy("mark", "doc_id"))
    chosen = stage(usable.select("doc_id", "lang", F.xxhash64("doc_id", "lang").alias("mark")).withColumn("n", first)
                   .where(F.col("n") <= SAMPLE_ROWS), "chosen")
    rows = (usable.join(chosen.select("doc_id", "lang").distinct(), ["doc_id", "lang"], "left_semi")
            .select("lang", F.xxhash64("doc_id", "lang").alias("mark"), F.left("text", F.lit(SAMPLE_SYMBOLS)).alias("text")))
    texts: dict[str, list[tuple]] = {}
    for r in rows.collect():
        texts.setdefault(r["lang"], []).append((r["mark"], r["text"]))
    samples = {}
    for lang, found in texts.items():
        symbols, offsets = letters([t for _, t in sorted(found)])
        samples[lang] = even_shares([symbols[a:b] for a, b in zip(offsets[:-1], offsets[1:])], SAMPLE_SYMBOLS)
    return CrossParser(samples)


def with_language(docs: DataFrame, parser: CrossParser, text_col: str = "text", name: str = "found") -> DataFrame:
    """Adds the struct ``name`` of ``lang_pred`` and ``score``; all rows and columns stay."""
    def of_batch(texts: pd.Series) -> pd.DataFrame:
        parts, low = [], 0
        ends = texts.str.len().fillna(0).cumsum().to_numpy()
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (1 << 20), "right")))
            names, score = parser.predict([t if isinstance(t, str) else None for t in texts.iloc[low:high]])
            parts.append(pd.DataFrame({"lang_pred": names, "score": score}))
            low = high
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": [], "score": []})

    @F.pandas_udf("lang_pred string, score double")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for texts in batches:
                yield of_batch(texts)
        finally:  # workers live on; the next partition builds them again
            _built.clear()
            give_back()

    # a filter on the outcome must not evaluate it a second time
    found = found.asNondeterministic()
    return docs.withColumn(name, found(F.col(f"`{text_col}`").cast("string")))


def identify(docs: DataFrame, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: one row per input row.

    Trained on rows outside the held-out fold that have a language and a letter, at
    most ``SAMPLE_ROWS`` rows and ``SAMPLE_SYMBOLS`` bytes per language. Symbols are the
    UTF-8 bytes of letters, so every script has its own. Each text is parsed greedily
    into phrases that occur in a language's training text; the language with the
    fewest phrases, each costing log2 of the training length, per symbol wins, ties
    to the smaller name. Score is 1 - best / (best + second).
    Null texts and texts without a letter are ``und`` with score 0, as are all texts
    when nothing is labelled; an empty table gives no rows. Whole texts are parsed, in
    blocks of ``BLOCK`` symbols. Repeated rows have one row each, a null id is a row
    like others outside the held-out fold, other columns are not read.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                        F.col(f"`{lang_col}`").cast("string").alias("lang"))
    parser = fit(plain.where(~held_out("doc_id", folds, fold)))
    found = with_language(plain.select("doc_id", "text"), parser)
    return found.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "found.lang_pred", "found.score")
