"""Exact best inner products through paged metric trees.

Vectors lie in clusters around sampled rows, and clusters in trees of bounded size;
a tree's pages are rows of a table.  A page has a pivot, a covering radius, the
distance of its pivot to the parent's pivot, its longest vector and its smallest id.
For a query q at distance d from a point x, q.x = (|q|^2 + |x|^2 - d^2) / 2, so a least
distance is a greatest score.  Search takes pages best bound first.  Before a distance
to a page or vector is computed, |d(q, parent) - d(x, parent)| bounds it from below,
and what that already rules out is never computed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyline.llm.vectors import matrix
from tallyline.staging import stage

#: Bytes of vectors in a tree; its rows follow from their length.
TREE_BYTES = 2 << 20
#: Vectors in a leaf page, children of an inner page.
PAGE = 64
#: Queries that one task asks a tree at once.
QUERIES = 512
#: Rows of least hash that serve as cluster centres and as first scores of a query.
CENTRES = 1024
#: A vector's squared length stays below, so every score fits 64 bits.
LONGEST = 2.0 ** 62

POINT_SCHEMA = "vec_id long, dims int, cluster int, gap double, square double, x binary"
PAGE_SCHEMA = ("dims int, cluster int, split int, page int, parent int, radius double, to_parent double, square double, "
               "least_id long, pivot binary, ids binary, gaps binary, x binary")
FOUND_SCHEMA = "query_id long, vec_id long, score long"


def whole_vector(vector: str):
    """Not null and without null or non-finite components."""
    v = F.col(f"`{vector}`")
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, float rows)`` of the lists of each length."""
    sizes = np.diff(column.offsets.to_numpy())
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, matrix(column.take(pa.array(at))).reshape(len(at), size)


def scaled(rows: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(which, integers, squared lengths)``: floor(scale * x) of rows short enough for 64-bit scores."""
    rows = np.floor(rows * scale)
    squares = (rows * rows).sum(axis=1)
    which = np.flatnonzero(squares < LONGEST)
    return which, rows[which].astype(np.int64), squares[which]


def products(points: np.ndarray, query: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products; doubles hold them while |q||x| (``largest``) stays below 2^53."""
    if largest < 2.0 ** 52:
        return (points.astype(np.float64) @ query.astype(np.float64).T).astype(np.int64)
    return points @ query.T


def numbers(blob: bytes, dims: int, kind=np.int64) -> np.ndarray:
    flat = np.frombuffer(blob, kind)
    return flat.reshape(-1, dims) if dims else flat.reshape(len(flat), 0)


# -- building -----------------------------------------------------------------

def _distances(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    gap = points.astype(np.float64) - pivot.astype(np.float64)
    return np.sqrt((gap * gap).sum(axis=1))


def bulk_load(ids: np.ndarray, points: np.ndarray, page: int = PAGE) -> list[dict]:
    """Pages of an M-tree over the points; page 0 is the root.  Ids order equal points, so pages of copies differ in ids.

    A set is divided among up to ``page`` of its points, spread evenly over it, each point
    to the nearest; a division that leaves (almost) all points together, as with
    copies, is made by id instead.
    """
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], points[order]
    real = points.astype(np.float64)
    squares = (real * real).sum(axis=1)
    pages: list[dict] = []
    todo = [(np.arange(len(ids)), -1, None)]
    while todo:
        rows, parent, above = todo.pop()
        middle = real[rows].mean(axis=0)
        pivot = points[rows[int(np.argmin(((real[rows] - middle) ** 2).sum(axis=1)))]]
        gaps = _distances(points[rows], pivot)
        number = len(pages)
        entry = {"page": number, "parent": parent, "radius": float(gaps.max()), "square": float(squares[rows].max()),
                 "to_parent": 0.0 if above is None else float(_distances(pivot[None], above)[0]),
                 "least_id": int(ids[rows[0]]), "pivot": pivot.tobytes(), "ids": None, "gaps": None, "x": None}
        pages.append(entry)
        if len(rows) <= page:
            entry.update(ids=ids[rows].tobytes(), gaps=gaps.tobytes(), x=points[rows].tobytes())
            continue
        ways = min(page, -(-len(rows) // page))
        seeds = rows[np.linspace(0, len(rows) - 1, ways).astype(int)]
        near = np.empty(len(rows), np.int64)
        for at in range(0, len(rows), 1024):
            part = real[rows[at: at + 1024]]
            near[at: at + 1024] = np.argmin((real[seeds] ** 2).sum(axis=1) - 2 * part @ real[seeds].T, axis=1)
        if np.bincount(near).max() > 0.9 * len(rows):
            near = np.arange(len(rows)) * ways // len(rows)
        todo.extend((rows[near == k], number, pivot) for k in np.unique(near))
    return pages


def _load(key: tuple, table: pa.Table) -> pa.Table:
    dims, cluster, split = (k.as_py() for k in key)
    points = numbers(b"".join(table.column("x").to_pylist()), dims) if dims else np.zeros((table.num_rows, 0), np.int64)
    pages = bulk_load(table.column("vec_id").to_numpy().astype(np.int64), points)
    return pa.Table.from_pylist([{"dims": dims, "cluster": cluster, "split": split} | p for p in pages], _page_type())


def _page_type() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in PAGE_SCHEMA.split(", "))])


# -- searching ----------------------------------------------------------------

class Tree:
    """The pages of one tree, ready for queries; ``computed`` counts distances and products taken."""

    def __init__(self, pages: list[dict], dims: int):
        pages = sorted(pages, key=lambda p: p["page"])
        self.computed = 0
        column = lambda name: np.array([p[name] for p in pages])
        self.radius, self.to_parent, self.square, self.least = map(column, ("radius", "to_parent", "square", "least_id"))
        self.pivots = np.array([np.frombuffer(p["pivot"], np.int64) for p in pages]).astype(np.float64).reshape(len(pages), dims)
        children: dict[int, list[int]] = {}
        for p in pages[1:]:
            children.setdefault(p["parent"], []).append(p["page"])
        self.children = {k: np.array(v) for k, v in children.items()}
        self.leaves = {}
        for p in pages:
            if p["ids"] is not None:
                ids = np.frombuffer(p["ids"], np.int64)
                x = np.frombuffer(p["x"], np.int64).reshape(len(ids), dims)
                real = x.astype(np.float64)
                self.leaves[p["page"]] = ids, np.frombuffer(p["gaps"]), x, real, (real * real).sum(axis=1)

    def best(self, own: int, query: np.ndarray, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """``(score, id)`` of the ``k`` best vectors of other ids that score ``floor`` or more, ties to smaller ids."""
        q = query.astype(np.float64)
        square = float(q @ q)
        largest = np.sqrt(square * float(self.square[0]))
        slack = 1.0 + 1e-9 * (square + float(self.square[0]))  # above any rounding of the bounds
        found: list[tuple[int, int]] = []  # heap of (score, -id)
        limit = floor

        def bound(squares, nearest):
            return (square + squares - np.maximum(nearest, 0.0) ** 2) / 2 + slack

        def worth(bounds, least):
            return (bounds > limit) | ((bounds == limit) & (least < own_limit))

        own_limit = np.iinfo(np.int64).max
        d = float(np.sqrt(((q - self.pivots[0]) ** 2).sum()))
        self.computed += 1
        heap = [(-float(np.floor(bound(self.square[0], d - self.radius[0]))), int(self.least[0]), 0, d)]
        while heap:
            high, least, page, d = heapq.heappop(heap)
            if -high < limit:
                break
            if -high == limit and least > own_limit:
                continue
            if page in self.leaves:
                ids, gaps, x, real, squares = self.leaves[page]
                high_each = np.floor(bound(squares, np.abs(d - gaps)))
                at = np.flatnonzero((ids != own) & ((high_each > limit) | ((high_each == limit) & (ids < own_limit))))
                if not len(at):
                    continue
                self.computed += len(at)
                scores = np.rint(real[at] @ q).astype(np.int64) if largest < 2.0 ** 52 else x[at] @ query
                for j in np.flatnonzero(scores >= limit):
                    item = (int(scores[j]), -int(ids[at[j]]))
                    if len(found) < k:
                        heapq.heappush(found, item)
                    elif item > found[0]:
                        heapq.heapreplace(found, item)
                if len(found) == k:
                    limit, own_limit = found[0][0], -found[0][1]
                continue
            below = self.children[page]
            # the stored distance to the parent first, then the distance itself where it is still open
            high_each = np.floor(bound(self.square[below], np.abs(d - self.to_parent[below]) - self.radius[below]))
            below = below[worth(high_each, self.least[below])]
            if not len(below):
                continue
            self.computed += len(below)
            gap = q - self.pivots[below]
            near = np.sqrt((gap * gap).sum(axis=1))
            high_each = np.floor(bound(self.square[below], near - self.radius[below]))
            open_ = worth(high_each, self.least[below])
            for h, c, n in zip(high_each[open_], below[open_], near[open_]):
                heapq.heappush(heap, (-float(h), int(self.least[c]), int(c), float(n)))
        return [(s, -i) for s, i in found]


def _ask(k: int):
    def run(key: tuple, pages: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        if pages.num_rows and queries.num_rows:
            dims = key[0].as_py()
            tree = Tree(pages.to_pylist(), dims)
            for query, x, floor in zip(*(queries.column(c).to_pylist() for c in ("query_id", "x", "floor"))):
                found = tree.best(query, np.frombuffer(x, np.int64), k, -np.inf if floor is None else floor)
                rows.extend((query, i, s) for s, i in found)
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], names=["query_id", "vec_id", "score"])
    return run


# -- jobs ---------------------------------------------------------------------

def sample(vectors: DataFrame, total: int, n: int = CENTRES) -> list[tuple[int, list[float]]]:
    """The ``n`` distinct rows of least hash; only hashes under a bound that lets about ``8 * n`` pass are ordered."""
    marked = vectors.withColumn("mark", F.xxhash64("vec_id", "vector"))
    bound = -(1 << 63) + int((1 << 64) * min(1.0, 8 * n / max(1, total)))
    for few in ([marked.where(F.col("mark") < F.lit(bound))] if bound < (1 << 63) else []) + [marked]:
        rows = few.distinct().orderBy("mark", "vec_id").limit(n).collect()
        if len(rows) >= n:
            break
    return [(r["vec_id"], list(r["vector"])) for r in rows]


class Top:
    """What every task knows: the sampled rows and, once counted, each cluster's radius and longest vector."""

    def __init__(self, rows: list[tuple[int, list[float]]], clusters: int, scale: float):
        self.scale = scale
        kinds: dict[int, list] = {}
        for vec_id, v in rows:
            kinds.setdefault(len(v), []).append((vec_id, v))
        self.ids, self.points, self.centres = {}, {}, {}
        first = 0
        for dims, some in kinds.items():
            which, x, _ = scaled(np.array([v for _, v in some], float).reshape(len(some), dims), scale)
            self.ids[dims], self.points[dims] = np.array([some[i][0] for i in which], np.int64), x
            share = max(1, clusters * len(some) // len(rows))
            centres = np.unique(x, axis=0) if len(x) else x  # copies make one centre
            centres = centres[np.unique(np.linspace(0, len(centres) - 1, min(share, len(centres))).astype(int))] if len(centres) else centres
            if len(centres):
                self.centres[dims] = first, centres
                first += len(centres)
        self.radius, self.square = np.zeros(first), np.zeros(first)

    def nearest(self, dims: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if dims not in self.centres:  # a length that the sample does not have
            return np.full(len(x), -1), np.zeros(len(x))
        first, centres = self.centres[dims]
        real, c = x.astype(np.float64), centres.astype(np.float64)
        near = np.argmin((c * c).sum(axis=1) - 2 * real @ c.T, axis=1)
        return first + near, np.sqrt(((real - c[near]) ** 2).sum(axis=1))

    def floor(self, own: int, query: np.ndarray, k: int) -> float | None:
        """The ``k``-th best score among the sampled rows of other ids: the k best of all score that or more."""
        dims = len(query)
        points = self.points.get(dims, np.zeros((0, dims), np.int64))
        points = points[self.ids[dims] != own] if len(points) else points
        if len(points) < k:
            return None
        norms = np.sqrt(((points.astype(float) ** 2).sum(axis=1)).max() * float((query.astype(float) ** 2).sum()))
        return float(np.partition(products(points, query, norms), len(points) - k)[len(points) - k])

    def clusters(self, query: np.ndarray, floor: float | None) -> list[int]:
        """Clusters that may hold a vector scoring ``floor`` or more."""
        if len(query) not in self.centres:
            return [-1]
        first, centres = self.centres[len(query)]
        at = slice(first, first + len(centres))
        q = query.astype(np.float64)
        d = np.maximum(np.sqrt(((q - centres) ** 2).sum(axis=1)) - self.radius[at], 0.0)
        high = (q @ q + self.square[at] - d * d) / 2
        open_ = high + 1.0 + 1e-9 * (q @ q + self.square[at]) >= (-np.inf if floor is None else floor)
        return (first + np.flatnonzero(open_)).tolist()


def _points(top: Top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for at, rows in by_length(batch.column("vector")):
                which, x, squares = scaled(rows, top.scale)
                dims, n = rows.shape[1], len(which)
                cluster, gap = top.nearest(dims, x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at[which]]), pa.array(np.full(n, dims, np.int32)), pa.array(cluster.astype(np.int32)),
                     pa.array(gap), pa.array(squares), pa.array([r.tobytes() for r in x], pa.binary())],
                    ["vec_id", "dims", "cluster", "gap", "square", "x"])
    return run


def _asks(top: Top, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, x in zip(batch.column("vec_id").to_pylist(), batch.column("x").to_pylist()):
                query = np.frombuffer(x, np.int64)
                floor = top.floor(own, query, k)
                rows.extend((own, len(query), c, floor, x) for c in top.clusters(query, floor))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)],
                                             ["query_id", "dims", "cluster", "floor", "x"])
    return run


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best inner products of floor(scale * x), exactly.

    Queries are the rows whose id is divisible by ``every``, candidates all rows of
    other ids and of the same length.  Every candidate row counts, so a row that occurs
    twice can take two ranks; ties go to smaller ids.  A query id with several vectors
    asks with the least of them.  Vectors that are null or hold null or non-finite
    components take no part, nor do rows without an id, nor vectors of which a score could
    leave 64 bits (squared length 2^62 or more after scaling).  Fewer candidates than
    ``k`` give fewer rows, an empty table gives none; other columns are not read.

    The sample (``CENTRES`` rows) gives centres and each query's first bound, nothing else:
    all rows are indexed and all results are exact.  A cluster of any size is cut into
    trees of bounded bytes by row number, so copies of one vector spread over trees.
    A query goes to the clusters whose bound reaches its first scores, and meets
    each tree there in groups of about ``QUERIES`` queries.
    """
    sound = (vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
             .where(F.col("vec_id").isNotNull() & whole_vector("vector")))
    size = sound.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).first()
    per_tree = max(PAGE, TREE_BYTES // (8 * max(1, size["dims"] or 0)))
    clusters = min(CENTRES, max(1, size["n"] // per_tree))
    top = Top(sample(sound, size["n"]), clusters, scale)
    points = stage(sound.mapInArrow(_points(top), POINT_SCHEMA), "points")
    about = stage(points.groupBy("dims", "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"), F.max("square").alias("square")), "clusters")
    for r in about.where("cluster >= 0").collect():  # at most one row per sampled row
        top.radius[r["cluster"]], top.square[r["cluster"]] = r["radius"], r["square"]
    rows_of_tree = F.greatest(F.lit(PAGE), F.floor(TREE_BYTES / (8.0 * F.greatest("dims", F.lit(1)))))
    splits = about.select("dims", "cluster", F.ceil(F.col("n") / rows_of_tree).alias("splits"))
    tree = ["dims", "cluster", "split"]
    numbered = points.withColumn("row", F.xxhash64(F.monotonically_increasing_id()))
    pages = stage(numbered.join(splits, ["dims", "cluster"])
                  .select("vec_id", "x", "dims", "cluster", F.pmod("row", "splits").cast("int").alias("split"))
                  .groupBy(*tree).applyInArrow(_load, PAGE_SCHEMA), "pages")

    queries = points.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    asks = stage(queries.mapInArrow(_asks(top, k), "query_id long, dims int, cluster int, floor double, x binary"), "asks")
    lanes = stage(asks.groupBy("dims", "cluster").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("lanes"))
                  .join(splits, ["dims", "cluster"]), "lanes")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    asked = (asks.join(lanes, ["dims", "cluster"])
             .withColumn("lane", F.pmod(F.xxhash64("query_id"), F.col("lanes")).cast("int")).withColumn("split", all_of("splits")))
    trees = pages.join(lanes.drop("splits"), ["dims", "cluster"]).withColumn("lane", all_of("lanes"))
    group = [*tree, "lane"]
    found = (trees.select(*group, *[f.split()[0] for f in PAGE_SCHEMA.split(", ")[3:]]).groupBy(*group)
             .cogroup(asked.select(*group, "query_id", "floor", "x").groupBy(*group)).applyInArrow(_ask(k), FOUND_SCHEMA))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
