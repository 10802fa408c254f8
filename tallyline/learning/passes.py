"""Boosted trees over all rows of a table that is too large for one task.

All fits grow side by side, one level of a tree per pass over the persisted blocks of the
binned table.  A task adds up directions and curvatures by node, feature and bin for every
fit; the tasks' sums of a fit are added and its splits chosen in Spark; the driver sees only those.
Sums are counted in units of a power of two and so are exact: reruns agree, however
blocks are dealt to tasks.  Scores are persisted every ``KEPT`` trees, a pass adds the trees since.
Passes are jobs of an RDD because hundreds of them run, and one takes less than half the time of a planned query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.learning.boosting import CODES, Spec, best_splits, first_score, loss_of, pull

#: Trees after which scores are stored anew.
KEPT = 8
#: Ranges into which a pass cuts the spread of a median, and passes for a median.
RANGES, NARROWINGS = 512, 3
#: Unit of a block's loss.
LOSS_UNIT = 2.0 ** -20

#: Fold, part, bins, labels and scores of a block; the scores are by fit.
Block = tuple[int, int, bytes, bytes, dict[int, bytes]]


@dataclass
class Growth:
    """A fit under way."""

    label: int
    fold: int
    seed: int
    spec: Spec
    below: int  # it learns from the folds below
    stop: int | None  # the fold that decides when to stop
    tested: int  # rows of that fold
    units: tuple[float, float]  # of sums of directions and of curvatures
    base: float
    low: float  # least and largest value a median is taken of
    high: float
    phase: str = "level"  # or base, leaf: a median
    trees: list = field(default_factory=list)
    stored: int = 0  # trees in the stored scores
    tree: tuple[list, list] = ((), ())  # the levels grown so far, in heap order
    cuts: list = field(default_factory=list)  # ranges chosen by the narrowings so far: of the two middle values, by leaf
    ranks: list = field(default_factory=list)  # of the two middle values in them
    best: float = 0.0
    best_n: int = 0

    @property
    def level(self) -> int:
        return (len(self.tree[0]) + 1).bit_length() - 1


# -- inside a task ---------------------------------------------------------------

def _node(feature: list, high: list, levels: int, columns: np.ndarray) -> np.ndarray:
    """Node of each row after some levels of a tree."""
    node = np.zeros(columns.shape[1], np.min_scalar_type(2 ** levels))
    for level in range(levels):
        right = np.zeros(columns.shape[1], bool)
        for k in range(2 ** level):
            f, cut = feature[2 ** level - 1 + k], high[2 ** level - 1 + k]
            if cut < 255:
                right |= (node == k) & (columns[f] > cut)
        node = 2 * node + right
    return node


def _scores(g: Growth, columns: np.ndarray, stored: np.ndarray | None) -> np.ndarray:
    at = np.full(columns.shape[1], g.base) if stored is None else stored.copy()
    for feature, high, value in g.trees[g.stored:] if stored is not None else g.trees:
        at += np.asarray(value)[_node(feature, high, g.spec.depth, columns)]
    return at


def _ranges(g: Growth, gap: np.ndarray, node: np.ndarray, taken: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one or both middle values: each row's range of the present narrowing, and which rows are still in."""
    for target in (0, 1) if g.cuts else (0,):
        low, step, inside = np.full(2 ** g.level, g.low), max((g.high - g.low) / RANGES, 1e-290), taken
        for turn in range(len(g.cuts) + 1):
            with np.errstate(over="ignore"):
                at = np.clip((gap - low[node]) / step, 0, RANGES - 1).astype(np.int64)
            if turn < len(g.cuts):
                chosen = np.array(g.cuts[turn][target])
                inside = inside & (at == chosen[node])
                low, step = low + chosen * step, max(step / RANGES, 1e-300)
        yield at, inside


def _sums(g: Growth, columns: np.ndarray, codes: np.ndarray, y: np.ndarray, at: np.ndarray, fold: int, part: int) -> np.ndarray:
    """What a block adds to a fit's pass: curvatures and directions by feature, node and bin, or rows by leaf and range."""
    taken, y = ~np.isnan(y), np.nan_to_num(y)
    if g.phase != "base" and g.spec.sample < 1:
        key = [x & 0xFFFFFFFF for x in (g.seed, len(g.trees), fold, part)]
        taken &= np.random.default_rng(key).random(len(y), np.float32) < g.spec.sample
    node = _node(*g.tree, g.level, columns)
    if g.phase == "level":
        many = 2 ** g.level
        weights = [np.where(taken, np.rint(x / unit), 0) for x, unit in zip(pull(g.spec, y, at), g.units)]
        first = node.astype(np.int64) * CODES
        return np.array([[np.bincount(first + c, w, many * CODES) for c in codes] for w in weights])
    gap = y if g.phase == "base" else y - at
    out = []
    for ranges, inside in _ranges(g, gap, node, taken):
        cell, many = (node.astype(np.int64) * RANGES + ranges)[inside], 2 ** g.level * RANGES
        out.append([np.bincount(cell, minlength=many).astype(float)])
        if len(g.cuts) == NARROWINGS - 1:
            out[-1].append(np.bincount(cell, gap[inside], many))
    return np.array(out)


def _open(block: Block, width: int, n_labels: int) -> tuple[int, int, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """A block with its features by rows, its labels and its scores as arrays."""
    fold, part, bins, labels, scores = block
    columns = np.ascontiguousarray(np.frombuffer(bins, np.uint8).reshape(-1, width).T)
    return fold, part, columns, np.frombuffer(labels).reshape(n_labels, -1), {i: np.frombuffer(x) for i, x in scores.items()}


def _added(growing: dict[int, Growth], width: int, n_labels: int):
    """For each fit of a task: its sums, its loss on the fold that decides, least and largest gap."""
    def run(blocks: Iterator[Block]) -> Iterator[tuple[int, tuple]]:
        sums: dict[int, tuple] = {}
        for block in blocks:
            fold, part, columns, labels, stored = _open(block, width, n_labels)
            codes = columns.astype(np.int64)
            for i, g in growing.items():
                if fold >= g.fold or (fold == g.stop and (g.phase != "level" or g.level)):
                    continue
                y = labels[g.label]
                known = ~np.isnan(y)
                if not known.any():
                    continue
                at, low, high, loss, more = _scores(g, columns, stored.get(i)), np.inf, -np.inf, 0.0, 0.0
                if fold == g.stop:
                    loss = float(np.rint(loss_of(g.spec, y[known], at[known]) * known.sum() / LOSS_UNIT))
                else:
                    more = _sums(g, columns, codes, y, at, fold, part)
                    if g.spec.loss == "absolute" and g.phase == "level" and g.level == 0:
                        gap = y[known] - at[known]
                        low, high = float(gap.min()), float(gap.max())
                mine = more, loss, low, high
                sums[i] = _both(sums[i], mine) if i in sums else mine
        yield from sums.items()
    return run


def _both(one: tuple, two: tuple) -> tuple:
    return one[0] + two[0], one[1] + two[1], min(one[2], two[2]), max(one[3], two[3])


def _stored(growing: dict[int, Growth], width: int, n_labels: int):
    """A block with the present scores of the fits under way."""
    def run(block: Block) -> Block:
        fold, part, columns, _, stored = _open(block, width, n_labels)
        return *block[:4], {i: _scores(g, columns, stored.get(i)).tobytes() for i, g in growing.items() if fold < g.fold}
    return run


def _middle(g: Growth, sums: np.ndarray) -> dict:
    """The ranges of the two middle values of every leaf, or the medians after the last narrowing."""
    sums = sums.reshape(2 if g.cuts else 1, -1, 2 ** g.level, RANGES)
    cuts, ranks, values = [], [], []
    for target in (0, 1):
        counts, n = sums[-1 if g.cuts and target else 0, 0], sums[0, 0].sum(axis=1)
        rank = np.array(g.ranks[target]) if g.cuts else np.maximum(0, (n - 1) // 2 if target == 0 else n // 2)
        until = counts.cumsum(axis=1)
        cut = np.minimum((until <= rank[:, None]).sum(axis=1), RANGES - 1)
        leaf = np.arange(len(cut))
        cuts.append(cut.tolist())
        ranks.append((rank - until[leaf, cut] + counts[leaf, cut]).tolist())
        if sums.shape[1] == 2:
            values.append(sums[target, 1][leaf, cut] / np.maximum(1, counts[leaf, cut]))
    # rounded, so that the order of a sum does not show
    return {"value": [float(f"{x:.12g}") for x in (values[0] + values[1]) / 2]} if values else {"cut": cuts, "rank": ranks}


def _chosen(growing: dict[int, Growth], width: int):
    """A fit's splits, ranges or medians from its sums."""
    def run(fit: tuple[int, tuple]) -> tuple[int, dict]:
        i, (sums, loss, low, high) = fit
        g, found = growing[i], {"loss": loss * LOSS_UNIT, "low": low, "high": high}
        if g.phase == "level":
            pulls, curves = np.reshape(sums, (2, width, -1, CODES)) * np.reshape(g.units, (2, 1, 1, 1))
            feature, cut, value = best_splits(pulls, curves, g.spec)
            return i, found | {"feature": feature.tolist(), "high_bin": cut.tolist(), "value": value.tolist()}
        return i, found | _middle(g, sums)
    return run


# -- the driver's part -------------------------------------------------------------

def _ended(g: Growth, loss: float) -> bool:
    """Whether the fold that decides ends the fit after its trees so far."""
    now, n = loss / g.tested, len(g.trees)
    if n == 0 or now < g.best - 1e-7:
        g.best, g.best_n = now, n
    return n >= g.spec.trees or (n > 0 and n - g.best_n >= g.spec.patience)


def _advance(g: Growth, found: dict) -> bool:
    """Takes a pass's result; true when the fit is done."""
    if g.phase == "level":
        if g.level == 0:
            if g.stop is not None and _ended(g, found["loss"]):
                return True
            g.low, g.high = found["low"], found["high"]
        g.tree = ([*g.tree[0], *found["feature"]], [*g.tree[1], *found["high_bin"]])
        if g.level < g.spec.depth:
            return False
        if g.spec.loss == "absolute":
            g.phase = "leaf"
            return False
    elif "cut" in found:
        g.cuts, g.ranks = [*g.cuts, found["cut"]], found["rank"]
        return False
    value, base, g.phase, g.cuts, g.ranks = found["value"], g.phase == "base", "level", [], []
    if base:
        g.base = value[0]
        return False
    g.trees.append((*g.tree, [g.spec.rate * v for v in value]))
    g.tree = ((), ())
    return g.stop is None and len(g.trees) >= g.spec.without_stop


def _begun(rows: DataFrame, labels: list[str], tasks: list[dict]) -> dict[int, Growth]:
    """A growth for each task that has rows to learn from."""
    facts = rows.where("fold is not null").groupBy("fold").agg(*[
        f(F.nanvl(F.col(c), F.lit(None))).alias(f"{name}{k}") for k, c in enumerate(labels)
        for name, f in (("n", F.count), ("sum", F.sum), ("low", F.min), ("high", F.max))]).collect()
    folds, out = sorted(facts, key=lambda r: r["fold"]), {}
    for i, t in enumerate(tasks):
        k, spec = t["label"], t["spec"]
        before = [r for r in folds if r["fold"] < t["fold"]]
        held = len(before) > 1 and before[-1][f"n{k}"] > 0 and any(r[f"n{k}"] for r in before[:-1])
        learnt = [r for r in (before[:-1] if held else before) if r[f"n{k}"]]
        n = sum(r[f"n{k}"] for r in learnt)
        if n == 0 or (not held and spec.without_stop == 0):
            continue
        low, high = min(r[f"low{k}"] for r in learnt), max(r[f"high{k}"] for r in learnt)
        most = 1.0 if spec.loss in ("logistic", "absolute") else min(spec.delta if spec.loss == "huber" else np.inf, max(2 * (high - low), 1e-9))
        mean = float(f"{sum(r[f'sum{k}'] for r in learnt) / n:.12g}")
        out[i] = Growth(k, t["fold"], t["seed"], spec, before[-1]["fold"] if held else t["fold"], before[-1]["fold"] if held else None,
                        before[-1][f"n{k}"] if held else 0, tuple(2.0 ** (np.ceil(np.log2(n * x)) - 52) for x in (most, 1.0)),
                        first_score(spec, mean), low, high, "base" if spec.loss == "absolute" else "level")
    return out


def grow_together(rows: DataFrame, blocks: DataFrame, labels: list[str], width: int, tasks: list[dict]) -> list[dict]:
    """Models of tasks ``{label, fold, seed, spec}``, ``label`` a place in ``labels``; ``rows`` are what ``blocks`` hold."""
    growing, models, width_of = _begun(rows, labels, tasks), {}, (width, len(labels))
    last = max((g.fold for g in growing.values()), default=0)
    at_once = blocks.sparkSession.sparkContext.defaultParallelism
    here = (blocks.where(F.col("fold") < last).select("fold", "part", "bins", "labels").repartition(max(at_once, blocks.rdd.getNumPartitions())).rdd
            .map(lambda r: (r[0], r[1], bytes(r[2]), bytes(r[3]), {})).persist(StorageLevel.MEMORY_AND_DISK))
    while growing:
        if max(len(g.trees) - g.stored for g in growing.values()) >= KEPT:
            last = max(g.fold for g in growing.values())
            there = here.filter(lambda block, last=last: block[0] < last).map(_stored(growing, *width_of)).persist(StorageLevel.MEMORY_AND_DISK)
            there.count()
            here.unpersist()
            here, growing = there, {i: replace(g, stored=len(g.trees)) for i, g in growing.items()}
        found = (here.mapPartitions(_added(growing, *width_of)).reduceByKey(_both, min(len(growing), at_once))
                 .map(_chosen(growing, width)).collect())
        for i, result in found:
            g = growing[i]
            if _advance(g, result):
                models[i] = {"base": g.base, "depth": g.spec.depth, "logistic": g.spec.loss == "logistic",
                             "trees": g.trees if g.stop is None else g.trees[:g.best_n]}
                del growing[i]
    here.unpersist()
    return [models.get(i) for i in range(len(tasks))]
