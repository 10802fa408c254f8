"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyline.llm.text import few_at_a_time, utf8, word_counts
from tallyline.staging import stage

#: Documents of a source rounded together in one leaf, and children of one node of the reduction tree.
LEAF, FAN = 4096, 256
#: Sources numbered together.
RANGE = 4096


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_at_a_time(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"),
                                          pa.array(word_counts(utf8(batch.column("text"))))], ["doc_id", "source", "size"])


def numbered(keys: DataFrame, key: str) -> DataFrame:
    """Adds ``place``, the rank of each distinct key in code point order from 0, null last, without one global task."""
    parts = max(1, keys.count() // RANGE)
    ordered = (keys.withColumn("__null", F.col(key).isNull()).repartitionByRange(parts, "__null", key)
               .withColumn("__part", F.spark_partition_id()))
    ordered = stage(ordered, "keys")
    before = ordered.groupBy("__part").agg(F.count("*").alias("__n")).withColumn(
        "__before", F.sum("__n").over(W.orderBy("__part")) - F.col("__n"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy("__null", key)) - 1
    return (ordered.withColumn("__inside", inside).join(before, "__part")
            .withColumn("place", (F.col("__before") + F.col("__inside")).cast("long"))
            .drop("__part", "__n", "__before", "__inside", "__null"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target``: targets in proportion to weight, none above ``most`` times its source.

    What sources cannot take is shared again among the others by weight, until no
    target is above its bound. Each round is one small aggregate over the sources.
    """
    sources = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stage(sources.withColumn("weight", weight), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    unit, full = None, F.lit(False)
    while True:
        r = sources.withColumn("full", full).agg(
            F.sum(F.when(F.col("full"), most * F.col("source_size"))).alias("taken"),
            F.sum(F.when(~F.col("full"), F.col("weight"))).alias("open"), F.count_if("full").alias("n")).first()
        unit = max(0.0, share * total - (r["taken"] or 0.0)) / r["open"] if r["open"] else 0.0
        full = full | (F.col("weight") * unit > most * F.col("source_size"))
        if sources.where(full).count() == r["n"]:
            break
    return sources.select("source", "source_size",
                          F.when(full, most * F.col("source_size")).otherwise(F.col("weight") * unit).cast("double").alias("target"))


def pivotal(chance: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds the chances pairwise, keeping the sum of ``size * chance``; at most one stays open.

    Returns the chances and the open place, or -1. The expected value of every chance
    is unchanged: of the two possible transfers, each is taken with the probability
    that makes the other's loss its gain.
    """
    chance = chance.astype(float).copy()
    open_ = -1
    uniform = draw.random(len(chance))
    for k in range(len(chance)):
        if not 0.0 < chance[k] < 1.0:
            continue
        if open_ < 0:
            open_ = k
            continue
        i, j = open_, k
        ratio = size[j] / size[i]
        up = min(1.0 - chance[i], chance[j] * ratio)          # i gains, j pays
        down = min(chance[i], (1.0 - chance[j]) * ratio)      # i pays, j gains
        if uniform[k] * (up + down) < down:
            full_i = up == 1.0 - chance[i]
            chance[i], chance[j] = (1.0, chance[j] - up / ratio) if full_i else (chance[i] + up, 0.0)
        else:
            empty_i = down == chance[i]
            chance[i], chance[j] = (0.0, chance[j] + down / ratio) if empty_i else (chance[i] - down, 1.0)
        for x in (i, j):
            if chance[x] < 1e-12 or chance[x] > 1.0 - 1e-12:
                chance[x] = round(chance[x])
        open_ = next((x for x in (i, j) if 0.0 < chance[x] < 1.0), -1)
    return chance, open_


def _round_node(last: bool, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # neighbours of like size resolve each other, so what stays open is small
        rows = rows.sort_values(["size", "mark", "doc_id", "copy"], ascending=[False, True, True, True]).reset_index(drop=True)
        draw = np.random.default_rng([seed, int(rows["mark"].iloc[0]) & 0x7FFFFFFFFFFFFFFF, len(rows)])
        chance, open_ = pivotal(rows["chance"].to_numpy(), rows["size"].to_numpy(), draw)
        if last and open_ >= 0:
            chance[open_] = float(draw.random() < chance[open_])
        return rows.assign(chance=chance)
    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, source``: one row per input row.

    A document's expected copies are its source's target over its source's size. The
    whole part is certain; the fractions of a source are rounded by transfers
    between pairs that keep the sum of words, longest documents first, so a source ends
    within one short document of its target. Leaves are hash groups of a source of bounded size; the open
    document of each leaf goes to its parent, and so on to one root per source.
    Marks and draws depend on the rows only, so reruns agree.
    Null texts have size 0, a null source is a source of its own, sorted last.
    Documents of size 0 are taken with their whole copies and change no sum.
    Repeated rows are separate documents.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    sizes = stage(plain.mapInArrow(_sizes, "doc_id long, source string, size long"), "sizes")
    aims = stage(targets(sizes, weights, share, most), "aims")
    n = sizes.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    leaves = max(1, -(-n // LEAF))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = (sizes.join(F.broadcast(aims) if aims.count() <= RANGE else aims, sizes["source"].eqNullSafe(aims["source"]))
             .select("doc_id", sizes["source"], "size", "source_size", "target", rate.alias("rate")))
    cut = (rated.withColumn("whole", F.floor(F.col("rate") + 1e-12))
           .withColumn("chance", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
           .withColumn("mark", F.xxhash64("doc_id", "source", F.lit(seed)))
           .withColumn("node", F.pmod("mark", F.lit(leaves)).cast("long")))
    # repeated rows share a mark and so a leaf; ``copy`` tells them apart
    cut = stage(cut.withColumn("copy", F.row_number().over(W.partitionBy("source", "node", "mark", "doc_id").orderBy("size"))), "cut")
    names = ["source", "node", "doc_id", "size", "copy", "mark", "source_size", "target", "whole", "chance"]
    level = cut.where("size > 0 and chance > 1e-12").select(*names)
    decided = cut.where("size = 0 or chance <= 1e-12").select(*names[:-1], F.lit(0.0).alias("chance"))
    while True:
        done = leaves == 1
        level = stage(level.groupBy("source", "node").applyInPandas(_round_node(done, seed), level.schema), "level")
        decided = decided.unionByName(level if done else level.where("chance in (0.0, 1.0)"))
        if done:
            break
        leaves = -(-leaves // FAN)
        level = level.where("chance > 0.0 and chance < 1.0").withColumn("node", F.pmod("node", F.lit(leaves)).cast("long"))
    copies = (F.col("whole") + F.col("chance")).cast("long")
    return decided.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
                          copies.alias("copies"), "source")
