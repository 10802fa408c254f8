"""Isotonic regression by pooling blocks: ranges of the scores pool on their own, then neighbouring results together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.staging import stage

#: Blocks that one task pools at a time; more are pooled in several rounds.
FAN = 100_000
SCHEMA = "low double, high double, total double, n double"


def pooled(low: np.ndarray, high: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbours whose means fall become one block, until means rise.

    What is pooled already may be pooled again with its neighbours: the outcome is that of all points at once.
    """
    out: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), total.tolist(), n.tolist()):
        out.append(list(block))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, high_, total_, n_ = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = high_, out[-1][2] + total_, out[-1][3] + n_
    columns = np.array(out, float).reshape(-1, 4)
    return tuple(columns[:, i] for i in range(4))


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a sorted partition; a batch joins the blocks kept so far."""
    kept = tuple(np.zeros(0) for _ in range(4))
    for batch in batches:
        kept = pooled(*(np.concatenate([k, batch.column(c).to_numpy()]) for k, c in zip(kept, ("low", "high", "total", "n"))))
    yield pa.RecordBatch.from_arrays([pa.array(k) for k in kept], ["low", "high", "total", "n"])


class Isotonic:
    """Rising step values between block ends; between blocks the line, outside the first and last value."""

    def __init__(self, low: np.ndarray, high: np.ndarray, value: np.ndarray):
        x = np.stack([low, high], axis=1).reshape(-1)
        y = np.repeat(value, 2)
        keep = np.concatenate([[True], (x[1:] != x[:-1])]) if len(x) else np.zeros(0, bool)
        self.x, self.y, self.blocks = x[keep], y[keep], len(low)

    def __call__(self, prob: Column) -> Column:
        x, y = self.x, self.y

        @F.pandas_udf("double")
        def at(values: pd.Series) -> pd.Series:
            v = values.to_numpy(dtype=float, na_value=np.nan)
            return pd.Series(np.where(np.isnan(v) | (len(x) == 0), np.nan, np.interp(v, x, y) if len(x) else np.nan)).astype(object).where(lambda s: s.notna(), None)

        return at(prob)


def fit(rows: DataFrame, prob: str, label: str) -> Isotonic:
    """Fit of ``label`` on ``prob``; rows without either are left out.

    Equal scores become one point by a sum that combines before the shuffle.  Points are
    cut into ranges of scores, each range pools its own, and rounds go on over the
    ranges' blocks until few are left; only those come to the driver.
    """
    usable = rows.where(F.col(prob).isNotNull() & F.col(label).isNotNull())
    blocks = stage(usable.groupBy(F.col(prob).cast("double").alias("low")).agg(
        F.sum(F.col(label).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
        .select("low", F.col("low").alias("high"), "total", "n"), "points")
    size = blocks.count()
    while True:
        parts = -(-size // FAN)
        ranges = blocks.repartitionByRange(max(1, parts), "low").sortWithinPartitions("low")
        blocks = stage(ranges.mapInArrow(_pool, SCHEMA), "pooled")
        before, size = size, blocks.count()
        if parts <= 1:
            break
        if size > before // 2:  # scores that rise almost everywhere pool no further
            break
    found = sorted(tuple(r) for r in blocks.collect())
    low, high, total, n = pooled(*(np.array(c, float) for c in zip(*found))) if found else (np.zeros(0),) * 4
    return Isotonic(low, high, total / n if len(n) else n)
