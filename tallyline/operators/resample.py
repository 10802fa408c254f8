"""Bootstrap intervals of ratios with all replicates of a group held as one array.

A task adds its rows into one array of replicate sums per group and sends that, so
neither the rows nor the shuffle grow with rows times replicates.  Draws depend on
the row's id and the replicate alone: reruns and any partitioning agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups whose arrays a task holds; beyond, it sends them on and starts anew.
HELD = 256
#: Rows drawn at a time.
ROWS = 64
#: Arrays of a group meet in so many places before one.
LANES = 64
#: What a replicate adds to a row's number.
STEP = 2654435769


def poisson_limits() -> list[int]:
    """Cumulative Poisson(1) probabilities as 32-bit limits: a draw is the number of limits a number reaches.

    All counts that 32 bits can tell apart are there; none is cut off.
    """
    out, term, total = [], math.exp(-1), 0.0
    while int((total + term) * 2 ** 32) < 2 ** 32 - 1:
        total += term
        out.append(int(total * 2 ** 32))
        term /= len(out)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit finaliser; fixed values: its two multipliers and three shifts."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(2246822507)
    x ^= x >> np.uint32(13)
    x *= np.uint32(3266489909)
    x ^= x >> np.uint32(16)
    return x


def draws(ids: np.ndarray, reps: int) -> np.ndarray:
    """Rows x replicates: how often each row enters each replicate."""
    ids = ids.astype(np.int64).view(np.uint64)
    base = mixed((ids ^ (ids >> np.uint64(32))).astype(np.uint32))
    x = mixed(base[:, None] + np.arange(reps, dtype=np.uint32) * np.uint32(STEP))
    times = np.zeros(x.shape, np.uint8)
    for limit in poisson_limits():
        times += x >= np.uint32(limit)
    return times


def draws_sql(row: str, rep: str) -> tuple[list[tuple[str, str]], str]:
    """The same draws as SQL: columns to compute one after another, and the count from the last."""
    low = "4294967295::ubigint"

    def mix(x: str, name: str) -> list[tuple[str, str]]:
        return [(f"{name}1", f"(xor({x}, {x} >> 16) * 2246822507::ubigint) & {low}"),
                (f"{name}2", f"(xor({name}1, {name}1 >> 13) * 3266489909::ubigint) & {low}"), (f"{name}3", f"xor({name}2, {name}2 >> 16)")]
    steps = [("a0", f"({row})::ubigint & {low}"), *mix("a0", "a"), ("b0", f"(a3 + {rep}::ubigint * {STEP}::ubigint) & {low}"), *mix("b0", "b")]
    return steps, " + ".join(f"(b3 >= {limit})::int" for limit in poisson_limits())


def replicate_sums(df: DataFrame, keys: Sequence[str], row_id: str, values: Sequence[str], reps: int) -> DataFrame:
    """``keys, sums``: per group the values' sums in every replicate, one array (values x replicates) as doubles.

    Each row enters a replicate a Poisson(1) number of times, the one-pass form of
    drawing n rows with replacement.  Null values count as zero.
    """
    keys, n = list(keys), len(values)
    types = {f.name: f.dataType for f in df.schema}
    own = [T.StructField(k, types[k]) for k in keys]
    sums_schema = T.StructType([*own, T.StructField("lane", T.IntegerType()), T.StructField("sums", T.BinaryType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lane = TaskContext.get().partitionId() % LANES
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def sent() -> pa.RecordBatch:
            rows = list(held)
            out = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(
                [*out, pa.array([lane] * len(rows), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())],
                [*keys, "lane", "sums"])

        for batch in batches:
            kinds = [batch.column(k).type for k in keys]
            names = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            groups: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                groups.setdefault(name, []).append(i)
            ids = batch.column(row_id).to_numpy(zero_copy_only=False)
            wide = np.nan_to_num(np.array([batch.column(v).cast(pa.float64()).to_numpy(zero_copy_only=False) for v in values]))
            for name, at in groups.items():
                if name not in held:
                    if len(held) >= HELD:
                        yield sent()
                        held.clear()
                    held[name] = np.zeros((n, reps))
                for low in range(0, len(at), ROWS):
                    some = at[low: low + ROWS]
                    held[name] += wide[:, some] @ draws(ids[some], reps)
        if held:
            yield sent()

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(n * reps), None
        for batch in batches:
            first = batch if first is None and batch.num_rows else first
            for blob in batch.column("sums"):
                total += np.frombuffer(blob.as_buffer())
        yield pa.RecordBatch.from_arrays([*[first.column(k).slice(0, 1) for k in keys], pa.array([0], pa.int32()),
                                          pa.array([total.tobytes()], pa.binary())], [*keys, "lane", "sums"])

    sums = df.select(*keys, F.col(row_id), *values).mapInArrow(partial, sums_schema)
    met = sums.groupBy(*keys, "lane").applyInArrow(added, sums_schema)
    return met.groupBy(*keys).applyInArrow(added, sums_schema).drop("lane")


def ratio_interval(df: DataFrame, keys: Sequence[str], row_id: str, over: str, under: str, reps: int, level: float,
                   scale: float, names: tuple[str, str]) -> DataFrame:
    """Percentile interval of ``scale * sum(over) / sum(under)``; replicates without any ``under`` are left out."""
    keys, tail = list(keys), 100 * (1 - level) / 2
    found = replicate_sums(df, keys, row_id, [over, under], reps)
    types = {f.name: f.dataType for f in found.schema}
    schema = T.StructType([*[T.StructField(k, types[k]) for k in keys], *[T.StructField(x, T.DoubleType()) for x in names]])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, at = [], [], []
            for i, blob in enumerate(batch.column("sums")):
                top, below = np.frombuffer(blob.as_buffer()).reshape(2, reps)
                ratios = top[below > 0] / below[below > 0] * scale
                if len(ratios):
                    a, b = np.percentile(ratios, [tail, 100 - tail])
                    low, high, at = [*low, a], [*high, b], [*at, i]
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[kept.column(k) for k in keys], pa.array(low, pa.float64()), pa.array(high, pa.float64())], [*keys, *names])

    return found.mapInArrow(ends, schema)
