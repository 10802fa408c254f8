"""Near-duplicate embeddings: pivot-permutation index, verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.graph import components
from tallyline.llm.vectors import bounded_sample, matrix, sound, unit
from tallyline.staging import stage

#: Rows per reference point, and the bounds of their number. The sample that gives them is bounded by the latter.
ROWS_PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 400, 48, 4096
#: Nearest reference points that describe a vector, and how many of them a pair must share.
DESCRIBED, SHARED = 8, 2
#: Rows of an inverted list that meet another such block in one task.
BLOCK = 1024


def _describe(pivots: np.ndarray, described: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit(matrix(batch.column("vector"))) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            near = rows @ pivots.T
            # nearest first, ties to the smaller number
            order = np.argsort(-near, axis=1, kind="stable")[:, :described].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "label", "vector")),
                 pa.array(list(order), pa.list_(pa.int32()))], ["vec_id", "label", "vector", "near"])
    return run


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """Least reachable row number of every row of a symmetric link matrix."""
    n = len(linked)
    least = np.arange(n)
    while n:
        best = np.where(linked, least[None, :], n).min(axis=1)
        new = np.minimum(least, best)
        new = new[new]
        if (new == least).all():
            break
        least = new
    return least


def _meet(at_least: float, shared: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["vec_id"], kind="stable").reset_index(drop=True)
        pivot = int(rows["pivot"].iloc[0])
        near = np.stack(rows["near"].to_numpy())
        local, at = np.unique(near, return_inverse=True)
        described = np.zeros((len(rows), len(local)), np.float32)
        np.put_along_axis(described, at.reshape(near.shape), 1.0, axis=1)
        counts = described @ described.T
        earlier = described[:, local < pivot]
        # a pair is judged in the list of the first reference point it shares
        linked = (counts >= shared) & (earlier @ earlier.T == 0)
        np.fill_diagonal(linked, False)
        block, i, j = rows["block"].to_numpy(), rows["i"].iloc[0], rows["j"].iloc[0]
        if i != j:
            linked &= block[:, None] != block[None, :]
        if linked.any():
            vectors = unit(np.stack(rows["vector"].to_numpy()).astype(np.float64))
            linked &= vectors @ vectors.T >= at_least
        some = linked.any(axis=1)
        roots = _local_roots(linked[np.ix_(some, some)])
        ids = rows["vec_id"].to_numpy()[some]
        return pd.DataFrame({"vec_id": ids, "n": linked[some].sum(axis=1).astype("int64"), "root": ids[roots]})
    return run


def vector_duplicates(vectors: DataFrame, at_least: float = 0.98, described: int = DESCRIBED, shared: int = SHARED,
                      id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per input row.

    Reference points are a bounded sample whose size follows the rows. A vector is
    described by its nearest reference points; it stands in the inverted list of
    each, within its label. Pairs of a list that share enough points are verified by
    cosine, once, in the list of the first point they share. Lists are cut into
    blocks that meet two by two, so no task holds a whole list, and a task returns
    link counts and a spanning forest, never its pairs.
    Vectors that are null, zero or hold null or non-finite components, rows without
    a label and vectors of another length than most have no links. Rows with a null
    id stay alone. Repeated rows count as separate vectors with one id: they link
    with each other's copies in the counts.
    """
    plain = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
                           F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    usable = plain.where(sound("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    total = usable.count()
    sample = bounded_sample(usable, int(min(MOST_PIVOTS, max(LEAST_PIVOTS, total // ROWS_PER_PIVOT))), total)
    if len(sample) == 0:
        return plain.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                            F.lit(True).alias("kept"))
    pivots = unit(sample)
    usable = usable.where(F.size("vector") == pivots.shape[1])
    near = stage(usable.mapInArrow(_describe(pivots, min(described, len(pivots))),
                                   usable.select("vec_id", "label", "vector").withColumn("near", F.lit(None).cast("array<int>")).schema), "near")
    listed = near.withColumn("pivot", F.explode("near"))
    sizes = listed.groupBy("label", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    met = (listed.join(stage(sizes, "lists"), ["label", "pivot"])
           .withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
           .select("label", "pivot", "i", "j", "block", "vec_id", "near", "vector"))
    links = stage(met.groupBy("label", "pivot", "i", "j").applyInPandas(
        _meet(at_least, min(shared, len(pivots))), "vec_id long, n long, root long"), "links")
    parts = components(links.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "vec_id")
    counts = links.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    return (plain.select("vec_id").join(counts, "vec_id", "left").join(parts, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
