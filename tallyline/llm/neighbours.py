"""Nearest neighbours by inner product through shifted Hilbert orderings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyline.llm.vectors import bounded_sample, matrix, sound
from tallyline.staging import stage

#: Orderings, projected dimensions of each and bits of each dimension.
CURVES, DIMENSIONS, BITS = 3, 6, 8
#: Key ranges of each ordering; a window is a number of neighbouring ranges.
RANGES = 24
#: Rows of a range that meet a block of queries in one task.
BLOCK = 4096
#: Vectors that scale the orderings and set the window.
SAMPLE = 4096
#: Queries on which the window is set, and the recall they must reach.
TRIED, RECALL = 256, 0.96


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer cells ``[row, dimension]`` of ``bits`` bits (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            t = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | ((x[i] >> b) & 1)
    return key


class Orderings:
    """Random projections, scaled to the sample's quantiles and shifted by a part of a cell for each curve."""

    def __init__(self, sample: np.ndarray, curves: int, seed: int = 11):
        draw = np.random.default_rng(seed)
        dims = min(DIMENSIONS, sample.shape[1])
        self.curves = []
        for k in range(curves):
            base, _ = np.linalg.qr(draw.normal(size=(sample.shape[1], dims)))
            shown = sample @ base
            low, high = np.quantile(shown, [0.01, 0.99], axis=0)
            self.curves.append((base, low, np.maximum(high - low, 1e-300), k / curves))

    def keys(self, rows: np.ndarray) -> np.ndarray:
        top = (1 << BITS) - 1
        out = []
        for base, low, span, shift in self.curves:
            cell = (rows @ base - low) / span * (top - 1) * 0.75 + shift * (top >> 2)
            out.append(hilbert(np.clip(cell, 0, top).astype(np.int64), BITS))
        return np.stack(out, axis=1)


def _keyed(orderings: Orderings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = orderings.keys(matrix(batch.column("vector"))) if batch.num_rows else np.zeros((0, len(orderings.curves)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(list(keys), pa.list_(pa.int64()))],
                                             ["vec_id", "vector", "keys"])
    return run


def best_of(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` nearest rows of each query, ties to the smaller id, never the query's own id.

    A product of matrices finds who can be among them; the scores themselves are
    summed component by component, so equal vectors have equal scores.
    """
    found = []
    rough = queries @ rows.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    if rough.shape[1] > k:
        bar = np.partition(rough, -k, axis=1)[:, -k]
    else:
        bar = np.full(len(queries), -np.inf)
    slack = 1e-9 * (1.0 + np.abs(np.where(np.isfinite(bar), bar, 0.0)))
    at = [np.flatnonzero((r >= b - s) & (r > -np.inf)) for r, b, s in zip(rough, bar, slack)]
    who = np.repeat(np.arange(len(queries)), [len(a) for a in at])
    at = np.concatenate(at) if len(at) else np.zeros(0, int)
    score = np.zeros(len(at))
    for d in range(rows.shape[1]):
        score += queries[who, d] * rows[at, d]
    order = np.lexsort((ids[at], -score, who))
    who, at, score = who[order], at[order], score[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    keep = place < k
    found = pd.DataFrame({"query_id": query_ids[who[keep]], "vec_id": ids[at[keep]], "score": score[keep]})
    return found


def _search(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"query_id": np.zeros(0, "int64"), "vec_id": np.zeros(0, "int64"), "score": np.zeros(0)})
        rows, ids = np.stack(left["vector"].to_numpy()).astype(float), left["vec_id"].to_numpy()
        queries, query_ids = np.stack(right["vector"].to_numpy()).astype(float), right["vec_id"].to_numpy()
        return pd.concat([best_of(ids, rows, query_ids[q: q + 512], queries[q: q + 512], k) for q in range(0, len(queries), 512)])
    return run


def window_for(recall: float, sample: np.ndarray, tried: np.ndarray, orderings: Orderings, k: int, ranges: int) -> int:
    """Ranges a query looks at in each ordering, so that the tried queries reach the recall within the sample."""
    keys, asked = orderings.keys(sample), orderings.keys(tried)
    n = len(sample)
    near = np.argpartition(-(tried @ sample.T), min(k, n - 1), axis=1)[:, : min(k, n)]
    gap = np.full((len(tried), near.shape[1]), ranges, np.int64)
    for c in range(keys.shape[1]):
        cuts = np.sort(keys[:, c])[(np.arange(1, ranges) * n) // ranges]
        place, mine = np.searchsorted(cuts, keys[:, c], "right"), np.searchsorted(cuts, asked[:, c], "right")
        # the smallest window width that covers the neighbour's range, windows being pushed inside at the ends
        for w in range(1, ranges + 1):
            first = np.clip(mine - (w - 1) // 2, 0, ranges - w)
            hit = (place[near] >= first[:, None]) & (place[near] < first[:, None] + w)
            gap = np.where(hit & (gap > w), w, gap)
    return int(np.quantile(gap.ravel(), recall, method="higher")) if gap.size else 1


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, curves: int = CURVES, recall: float = RECALL,
               id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each query.

    Queries are the rows whose id is divisible by ``every``. Each ordering sorts all
    vectors by the Hilbert key of a shifted random projection into ``RANGES`` ranges of
    equal size. A query looks at a window of ranges around its own in every ordering;
    the windows' results are merged and reranked by exact scores. The window width is
    set on a bounded sample, so that its queries reach the wanted recall; it is a share
    of the table and behaves alike at every size.
    Vectors that are null, zero or hold null or non-finite components, rows with a
    null id and vectors of another length take no part. Repeated rows of an id are
    one candidate.
    """
    plain = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    usable = plain.where(sound("vector") & F.col("vec_id").isNotNull())
    sample = bounded_sample(usable, SAMPLE, usable.count())
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if len(sample) == 0:
        return empty
    orderings = Orderings(sample, curves)
    width = window_for(recall, sample, sample[:TRIED], orderings, k, RANGES)
    usable = usable.where(F.size("vector") == sample.shape[1]).dropDuplicates(["vec_id"])
    keyed = stage(usable.mapInArrow(_keyed(orderings), "vec_id long, vector array<double>, keys array<long>"), "keyed")
    cuts = keyed.agg(*[F.percentile_approx(F.col("keys")[c], [r / RANGES for r in range(1, RANGES)], 10000) for c in range(curves)]).first()
    blocks = max(1, keyed.count() // (RANGES * BLOCK))
    own = [sum((F.col("keys")[c] >= cut).cast("int") for cut in (cuts[c] or [])) for c in range(curves)]
    place = keyed.select("vec_id", "vector", F.posexplode(F.array(*own)).alias("curve", "place"))
    rows = place.select("curve", "place", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "vector")
    first = F.least(F.greatest(F.col("place") - (width - 1) // 2, F.lit(0)), F.lit(RANGES - width))
    asked = (place.where(F.col("vec_id") % every == 0)
             .withColumn("place", F.explode(F.sequence(first, first + width - 1)))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
             .select("curve", "place", "block", "vec_id", "vector"))
    key = ["curve", "place", "block"]
    found = (rows.groupBy(*key).cogroup(asked.groupBy(*key))
             .applyInPandas(_search(k), "query_id long, vec_id long, score double"))
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
