"""Connected components of a large sparse graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.staging import stage


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: a spanning forest as (child, root)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    rows = [(x, root(x)) for x in parent]
    pairs = np.array([r for r in rows if r[0] != r[1]], np.int64).reshape(-1, 2)
    for low in range(0, len(pairs), 100_000):
        part = pairs[low: low + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["child", "parent"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id with a link; the component is its smallest reachable id.

    Each partition first shrinks its links to a spanning forest by union-find. The
    forests are merged by rounds of hooking (an id with several parents links them)
    and pointer jumping, until every id hangs below its root: about log(depth) rounds. Each round
    is written out, so the plan stays short and lost executors cost one round.
    """
    links = links.select(F.col(a).cast("long"), F.col(b).cast("long")).where(F.col(a) != F.col(b))
    edges = stage(links.mapInArrow(_forest, "child long, parent long").distinct(), "links")
    while True:
        least = stage(edges.groupBy("child").agg(F.min("parent").alias("least"), F.count("*").alias("n")), "least")
        up = least.select(F.col("child").alias("parent"), F.col("least").alias("above"))
        if least.where("n > 1").isEmpty() and edges.join(up, "parent", "left_semi").isEmpty():
            # every id hangs directly below a root
            return least.select(F.col("child").alias("id"), F.col("least").alias("component")).union(
                edges.select("parent", "parent").distinct())
        hooked = edges.join(least, "child").select(
            F.inline(F.array(
                F.struct(F.col("child"), F.col("least").alias("parent")),
                F.struct(F.col("parent").alias("child"), F.col("least").alias("parent")),
            ))
        ).where("child != parent").distinct()
        edges = stage(hooked.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"))
                      .distinct(), "links")
