"""Interaction of quality filters that run one after another, in every order at once.

A row's outcome depends only on which filters it fails.  Rows are therefore counted
by failure pattern inside each part first, and the orders are settled on patterns:
with a mask matrix (0 where a pattern fails a filter, infinity elsewhere) and the
inverse permutations of the orders (the step at which each filter runs), the
min-plus product of the two is the step that removes a pattern, infinity if none
does.  Scattering the patterns' weights by these steps gives all counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.text import few_at_a_time, utf8
from tallyline.staging import stage

#: Filters of one audit; the orders are their permutations.
MOST_FILTERS = 7

_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_CONTINUES = bytes(range(0x80, 0xC0))
_SIGNS = re.compile(rb"[#$%&*|]")


def removal_steps(fails: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(steps, positions)``: the step (from 1) that removes each pattern in each order, infinity if none does.

    ``fails`` is patterns x filters (boolean), ``orders`` holds one permutation of the filters per row.
    """
    positions = np.argsort(orders, axis=1) + 1.0
    masks = np.where(fails, 0.0, np.inf)
    steps = np.full((len(masks), len(positions)), np.inf)
    for f in range(masks.shape[1]):
        np.minimum(steps, masks[:, f, None] + positions[None, :, f], out=steps)
    return steps, positions


def interactions(fails: np.ndarray, weights: np.ndarray, orders: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of one part from its patterns; ``weights`` is patterns x measures, the first one the rows.

    ``removed`` is measures x orders x steps, ``kept``, ``redundant`` and ``letter``
    (the filter of a step) are orders x steps, ``unique`` and ``shapley`` are per filter.
    """
    n_orders, n = orders.shape
    steps, positions = removal_steps(fails, orders)
    gone, at = np.nonzero(np.isfinite(steps))
    removed = np.zeros((weights.shape[1], n_orders, n), np.int64)
    for m in range(weights.shape[1]):
        np.add.at(removed[m], (at, steps[gone, at].astype(np.int64) - 1), weights[gone, m])
    redundant = np.zeros((n_orders, n), np.int64)
    for f in range(n):
        late, order = np.nonzero(fails[:, f, None] & (steps < positions[None, :, f]))
        np.add.at(redundant, (order, positions[order, f].astype(np.int64) - 1), weights[late, 0])
    alone = fails & (fails.sum(axis=1, keepdims=True) == 1)
    shapley = np.zeros(n, np.int64)
    np.add.at(shapley, orders, removed[0])
    return {"removed": removed, "kept": weights[:, 0].sum() - np.cumsum(removed[0], axis=1), "redundant": redundant,
            "letter": orders, "unique": (alone * weights[:, :1]).sum(axis=0), "shapley": shapley}


def audit(rows: DataFrame, fails: Mapping[str, Column], part: Column, measures: Mapping[str, Column] | None = None,
          count: Column | None = None) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``fails`` maps one-letter filter names to boolean columns (null: passes),
    ``measures`` maps names to numbers that are summed over the rows a step removes
    and returned as ``<name>_lost``; ``count`` is how many rows a row stands for.
    Columns: ``part, filter_order, step, kept, removed, redundant, unique_fails,
    <name>_lost ..., shapley``.

    Before the shuffle a task's rows are summed by part and pattern, so a part that
    holds most rows sends as little as any other; the orders are settled on at most
    ``2 ** filters`` patterns of a part.  A null part counts as the empty string; an
    empty table has no parts and no rows.
    """
    names, measures = list(fails), dict(measures or {})
    if not names or len(names) > MOST_FILTERS or any(len(x) != 1 for x in names):
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters with names of one letter")
    count = F.lit(1) if count is None else count
    pattern = F.lit(0)
    for i, name in enumerate(names):
        pattern = pattern + F.when(fails[name], 1 << i).otherwise(0)
    wide = ["n", *(f"m{i}" for i in range(len(measures)))]
    values = [count, *(F.coalesce(m, F.lit(0)) * count for m in measures.values())]
    counted = (rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), pattern.alias("pattern"),
                           *[v.cast("long").alias(w) for v, w in zip(values, wide)])
               .groupBy("part", "pattern").agg(*[F.sum(w).alias(w) for w in wide]))
    per_part = counted.groupBy("part").agg(F.collect_list(F.struct("pattern", *wide)).alias("patterns"))
    orders = np.array(list(permutations(range(len(names)))))
    lost = [f"{m}_lost" for m in measures]
    columns = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in columns[2:])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = np.repeat([names[f] for o in orders for f in o], 1).reshape(orders.shape)
        texts = np.repeat(["".join(o) for o in spelled], len(names))
        for batch in batches:
            for name, patterns in zip(batch.column("part").to_pylist(), batch.column("patterns").to_pylist()):
                codes = np.array([p["pattern"] for p in patterns])
                failing = (codes[:, None] >> np.arange(len(names)) & 1).astype(bool)
                found = interactions(failing, np.array([[p[w] for w in wide] for p in patterns], np.int64), orders)
                numbers = [found["kept"], found["removed"][0], found["redundant"], found["unique"][orders],
                           *found["removed"][1:], found["shapley"][orders]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * texts.size), pa.array(texts.tolist()),
                     pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders))),
                     *[pa.array(x.reshape(-1)) for x in numbers]], ["part", *columns])

    return per_part.mapInArrow(settle, schema)


def _marks(text: bytes | None) -> tuple[bool, bool, bool, bool, bytes]:
    text = text or b""
    words = text.split()
    distinct = len(set(words))
    points, upper = len(text.translate(None, _CONTINUES)), len(text.translate(None, _NOT_UPPER))
    return (len(words) < 200, 100 * distinct < 50 * len(words), 100 * upper > 2 * points,
            _SIGNS.search(text) is not None, hashlib.sha256(text).digest())


def _text_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_at_a_time(batches):
        *marks, digests = zip(*map(_marks, utf8(batch.column("text"))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), *[pa.array(m) for m in marks], pa.array(digests, pa.binary())],
            ["doc_id", "part", "A", "B", "C", "D", "digest"])


def document_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, A, B, C, D, E, n``: which of five filters the documents fail; ``n`` equal rows are one.

    Words are runs of bytes other than ASCII white space, case kept.  A: under 200
    words; B: fewer distinct words than half the words; C: over 2 % of the code points
    are A to Z; D: one of ``#$%&*|``; E: the text (its SHA-256) also belongs to a
    smaller id anywhere in the table.  Null texts are empty, and empty texts are equal
    texts.  A row without an id has no smaller id and is none, so it never fails E.
    The texts are read once and never move; a group of copies of any size meets as
    one minimum per task.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    marks = plain.mapInArrow(_text_marks, "doc_id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary")
    rows = stage(marks.groupBy("doc_id", "part", "A", "B", "C", "D", "digest").agg(F.count(F.lit(1)).alias("n")), "marks")
    known = rows.where(F.col("doc_id").isNotNull())
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    # joined on both, so a text that many documents share is no hot key
    judged = known.join(first, ["digest", "doc_id"], "left").withColumn("E", F.col("first").isNull())
    nameless = rows.where(F.col("doc_id").isNull()).withColumn("E", F.lit(False))
    columns = ["doc_id", "part", "A", "B", "C", "D", "E", "n"]
    return judged.select(*columns).unionByName(nameless.select(*columns))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source") -> DataFrame:
    """Audit of the five filters of ``document_marks`` in all 120 orders, per source.

    ``good_lost`` and ``toxic_lost`` count removed documents with a label row of
    quality 1 or toxic 1; several label rows of an id count once, documents without
    one count as neither.  Repeated rows count as often as they occur.  Other columns
    of both tables, clashing names included, are not read.
    """
    marks = document_marks(docs, id_col, text_col, part_col)
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    told = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")))
    known = marks.where(F.col("doc_id").isNotNull()).join(told, "doc_id", "left")
    nameless = marks.where(F.col("doc_id").isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    rows = known.unionByName(nameless)
    return audit(rows, {f: F.col(f) for f in "ABCDE"}, F.col("part"),
                 {"good": F.col("good"), "toxic": F.col("toxic")}, F.col("n"))
