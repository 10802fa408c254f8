"""Stakes on one bankroll as composable maps.

A bet with share ``s`` and return ``g`` takes a bankroll ``m`` to ``m * (1 + s * g)``
if the stake ``m * s`` reaches the minimum, and leaves it alone otherwise: a map that scales
by one factor below its break ``minimum / s`` and by another above.  Bets in a row
compose to a map of the same kind with more breaks, and composition is
associative.  A chunk of bets is folded into its map without knowing the bankroll it
will meet, all chunks in parallel; the bankroll at the start of each chunk then
follows by looking up one factor per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces of a map in one row of the table of maps.
BLOCK = 512

# starts of pieces in order, the first one 0; the factor of each piece
Map = tuple[np.ndarray, np.ndarray]


def _placed(node: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Pairs that sort by node, then value."""
    out = np.empty(len(value), np.complex128)
    out.real, out.imag = node, value
    return out


def _pairs(starts: np.ndarray, factors: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compose neighbours: maps 0 and 1, 2 and 3, ...; an odd last one stays.

    A piece of the first map scales its interval by ``c``; the breaks of the second
    map inside that image, divided by ``c``, cut the piece.  Bankrolls of zero or less
    stake nothing any more, so such pieces are never cut.
    """
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    node = np.repeat(np.arange(n), sizes)
    ends = np.append(starts[1:], np.inf)
    ends[bounds[1:] - 1] = np.inf
    paired = (node | 1) < n
    first = np.flatnonzero((node % 2 == 0) & paired)
    left = np.flatnonzero(~paired)  # the odd one
    right = _placed(node, starts)  # sorted, since nodes and starts within them are
    c, partner = factors[first], node[first] + 1
    alive = c > 0
    with np.errstate(invalid="ignore"):
        low = np.where(alive, c * starts[first], 0.0)
        high = np.where(alive, c * ends[first], 0.0)
    lo = np.searchsorted(right, _placed(partner, low), side="right") - 1  # the piece the interval starts in
    hi = np.searchsorted(right, _placed(partner, high), side="left")  # the first piece beyond it
    count = np.maximum(hi - lo, 1)
    source = np.repeat(np.arange(len(first)), count)
    at = lo[source] + np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
    inner = at > lo[source]
    scale = c[source]
    with np.errstate(divide="ignore", invalid="ignore"):
        new_starts = np.where(inner, starts[at] / np.where(scale > 0, scale, 1.0), starts[first][source])
    new_factors = scale * factors[at]
    new_sizes = np.bincount(node[first][source] // 2, minlength=(n + 1) // 2)
    if len(left):
        new_starts, new_factors = np.append(new_starts, starts[left]), np.append(new_factors, factors[left])
        new_sizes[-1] += len(left)
    return new_starts, new_factors, new_sizes


def bets_map(shares: Sequence[float], returns: Sequence[float], minimum: float) -> Map:
    """The map of bets in order; ``returns`` is what a unit staked brings on top (-1 if lost)."""
    shares, returns = np.asarray(shares, float), np.asarray(returns, float)
    staked = np.isfinite(shares) & (shares > 0)
    shares, returns = shares[staked], returns[staked]
    if not len(shares):
        return np.zeros(1), np.ones(1)
    starts = np.stack([np.zeros(len(shares)), minimum / shares], axis=1).reshape(-1)
    factors = np.stack([np.ones(len(shares)), 1 + shares * returns], axis=1).reshape(-1)
    sizes = np.full(len(shares), 2)
    while len(sizes) > 1:
        starts, factors, sizes = _pairs(starts, factors, sizes)
    return starts, factors


def compose(first: Map, second: Map) -> Map:
    """The map that applies ``first``, then ``second``."""
    out = _pairs(np.concatenate([first[0], second[0]]), np.concatenate([first[1], second[1]]),
                 np.array([len(first[0]), len(second[0])]))
    return out[0], out[1]


def applied(m: Map, bankroll: float) -> float:
    return float(bankroll * m[1][max(int(np.searchsorted(m[0], bankroll, side="right")) - 1, 0)])


def chunk_starts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], share: str, gain: str,
                 bankroll: float, minimum: float) -> DataFrame:
    """``keys, chunk, start``: the bankroll each chunk after the first of its key starts with.

    ``rows`` has the whole chunks that others follow, numbered from 0 in ``chunk``.
    One task per chunk folds its bets into a map, kept in blocks of pieces.  A key's
    maps then stream through one task in order, which looks up one factor in each:
    16 bytes a bet are read in turn, and nothing is kept but the bankroll.
    """
    keys, order = list(keys), list(order)
    types = {f.name: f.dataType for f in rows.schema}
    own = [T.StructField(k, types[k]) for k in keys]
    maps_schema = T.StructType([*own, *[T.StructField(c, T.IntegerType()) for c in ("chunk", "block")],
                                *[T.StructField(c, T.BinaryType()) for c in ("starts", "factors")]])
    starts_schema = T.StructType([*own, T.StructField("chunk", T.IntegerType()), T.StructField("start", T.DoubleType())])

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        starts, factors = bets_map(table.column(share).to_numpy(), table.column(gain).to_numpy(), minimum)
        blocks = range(0, len(starts), BLOCK)
        return pa.table([*[pa.array([k.as_py()] * len(blocks), k.type) for k in key], pa.array(range(len(blocks)), pa.int32()),
                         *[pa.array([x[i: i + BLOCK].tobytes() for i in blocks], pa.binary()) for x in (starts, factors)]],
                        names=[*keys, "chunk", "block", "starts", "factors"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, factor, kinds = None, bankroll, 1.0, []

        def ended() -> pa.RecordBatch:
            columns = [pa.array([k], kind) for k, kind in zip(at[:-1], kinds)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([at[-1] + 1], pa.int32()), pa.array([before * factor])], starts_schema.names)

        for batch in batches:
            kinds = [batch.column(k).type for k in keys]
            names = list(zip(*(batch.column(k).to_pylist() for k in [*keys, "chunk"])))
            for i, name in enumerate(names):
                if name != at:
                    if at is not None:
                        yield ended()
                    before = before * factor if at is not None and at[:-1] == name[:-1] else bankroll
                    at, factor = name, 1.0
                starts, factors = (np.frombuffer(batch.column(c)[i].as_buffer()) for c in ("starts", "factors"))
                if starts[0] <= before:  # later blocks begin higher; the last one that does not is the place
                    factor = float(factors[np.searchsorted(starts, before, side="right") - 1])
        if at is not None:
            yield ended()

    maps = rows.select(*dict.fromkeys([*keys, "chunk", *order, share, gain])).groupBy(*keys, "chunk").applyInArrow(fold, maps_schema)
    return maps.repartition(*keys).sortWithinPartitions(*keys, "chunk", "block").mapInArrow(walk, starts_schema)
