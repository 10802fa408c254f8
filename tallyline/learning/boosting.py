"""Boosted trees for many folds, seeds and settings at once.

Features are cut into bins once, as bytes, in one stored table that all fits share.
A fit learns from all rows before its fold and grows trees until the newest year before the
fold stops improving.  Up to ``TASK_ROWS`` rows of a table, each fit is one task that gets its rows;
larger tables are read by passes that grow all fits together (``passes``).
Every row is scored, by a scan of the same table.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.staging import stage

#: Rows of a table that a task may hold; fits on larger ones are spread over tasks.
TASK_ROWS = 500_000
#: Bound for trials of such tasks: rows a fit learns from at most, the same share of every year. There is none by default.
FIT_ROWS = math.inf
#: Cuts of a feature; 0 is the code of missing values.
BINS = 62
CODES = BINS + 2
#: Rows of one block of the binned table.
BLOCK = 8192


@dataclass(frozen=True)
class Spec:
    """Setting of a fit.  ``trees`` is a bound: early stopping ends a fit that has a year to stop on."""

    loss: str = "logistic"  # or squared, absolute, huber
    trees: int = 400
    depth: int = 3
    rate: float = 0.06
    patience: int = 25
    without_stop: int = 60  # trees when no year is left to stop on
    sample: float = 0.8
    ridge: float = 5.0
    delta: float = 30.0  # of the Huber loss


# -- one fit, inside a task ----------------------------------------------------

def pull(spec: Spec, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Downhill direction and curvature of the loss at the present scores."""
    if spec.loss == "logistic":
        p = 1 / (1 + np.exp(-at))
        return y - p, p * (1 - p)
    gap = y - at
    if spec.loss == "absolute":
        gap = np.sign(gap)
    elif spec.loss == "huber":
        gap = np.clip(gap, -spec.delta, spec.delta)
    return gap, np.ones(len(y))


def loss_of(spec: Spec, y: np.ndarray, at: np.ndarray) -> float:
    gap = np.abs(y - at)
    if spec.loss == "logistic":
        return float(np.mean(np.logaddexp(0, at) - y * at))
    if spec.loss == "squared":
        return float(np.mean(gap * gap))
    if spec.loss == "huber":
        return float(np.mean(np.where(gap <= spec.delta, gap * gap / 2, spec.delta * (gap - spec.delta / 2))))
    return float(np.mean(gap))


def best_splits(pulls: np.ndarray, curves: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and highest bin to the left of each node, and the scores of its two children, from sums by feature, node and bin."""
    left_g, left_h = pulls.cumsum(axis=2), curves.cumsum(axis=2)
    all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g ** 2 / (left_h + spec.ridge) + right_g ** 2 / (right_h + spec.ridge) - all_g ** 2 / (all_h + spec.ridge)
    gain[(left_h < 2) | (right_h < 2)] = 0
    at, node = gain.argmax(axis=2), np.arange(gain.shape[1])
    top = np.take_along_axis(gain, at[:, :, None], axis=2)[:, :, 0]
    feature = top.argmax(axis=0)
    split = top[feature, node] > 1e-9
    feature = np.where(split, feature, 0)
    cut = at[feature, node]
    left, right = ((np.where(split, g[feature, node, cut], whole), np.where(split, h[feature, node, cut], weight)) for g, h, whole, weight in (
        (left_g, left_h, all_g[0, :, 0], all_h[0, :, 0]), (right_g, right_h, 0.0, 0.0)))
    value = np.stack([g / (h + spec.ridge) for g, h in (left, right)], axis=1).ravel()
    return feature, np.where(split, cut, 255), value


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree in heap order: feature and highest bin to the left of each inner node, and each row's leaf."""
    n, width = bins.shape
    feature, high = np.zeros(2 ** spec.depth - 1, np.int32), np.full(2 ** spec.depth - 1, 255, np.int32)
    node = np.zeros(n, np.int64)
    for level in range(spec.depth):
        many, first = 2 ** level, 2 ** level - 1
        cells = [node * CODES + bins[:, f] for f in range(width)]
        pulls, curves = (np.array([np.bincount(cell, w, many * CODES) for cell in cells]).reshape(width, many, CODES) for w in (g, h))
        feature[first: first + many], high[first: first + many], _ = best_splits(pulls, curves, spec)
        node = 2 * node + (bins[np.arange(n), feature[first + node]] > high[first + node])
    return feature, high, node


def fall(tree: tuple, bins: np.ndarray, depth: int) -> np.ndarray:
    """Leaf of each row."""
    feature, high, rows = np.asarray(tree[0]), np.asarray(tree[1]), np.arange(len(bins))
    node = np.zeros(len(bins), np.int64)
    for level in range(depth):
        first = 2 ** level - 1
        node = 2 * node + (bins[rows, feature[first + node]] > high[first + node])
    return node


def first_score(spec: Spec, mean: float) -> float:
    """Score before any tree: of all losses but the absolute one it follows from the mean label."""
    if spec.loss == "logistic":
        p = np.clip(mean, 0.01, 0.99)
        return float(np.log(p / (1 - p)))
    return float(mean)


def fit(bins: np.ndarray, y: np.ndarray, stop_on: np.ndarray, spec: Spec, seed: int) -> dict:
    """A model as plain lists; ``stop_on`` marks the rows that decide when to stop and are not learnt from."""
    draw = np.random.default_rng(seed)
    held = bool(stop_on.any()) and not stop_on.all()
    learn = np.flatnonzero(~stop_on) if held else np.arange(len(y))
    test_bins, test_y = bins[stop_on], y[stop_on]
    bins, y = bins[learn], y[learn]
    if not len(y):
        base = 0.0
    else:
        base = float(np.median(y)) if spec.loss == "absolute" else first_score(spec, y.mean())
    at, test_at = np.full(len(y), base), np.full(len(test_y), base)
    trees, best, best_n = [], loss_of(spec, test_y, test_at) if held else 0.0, 0
    for k in range(spec.trees if held else spec.without_stop):
        if not len(y):
            break
        g, h = pull(spec, y, at)
        some = np.flatnonzero(draw.random(len(y)) < spec.sample)
        feature, high, leaf = grow(bins[some], g[some], h[some], spec)
        if spec.loss == "absolute":
            gap = y[some] - at[some]
            value = np.array([np.median(gap[leaf == x]) if (leaf == x).any() else 0.0 for x in range(2 ** spec.depth)])
        else:
            total_g, total_h = (np.bincount(leaf, w[some], 2 ** spec.depth) for w in (g, h))
            value = total_g / (total_h + spec.ridge)
        tree = (feature.tolist(), high.tolist(), (spec.rate * value).tolist())
        trees.append(tree)
        step = np.array(tree[2])
        at += step[fall(tree, bins, spec.depth)]
        if held:
            test_at += step[fall(tree, test_bins, spec.depth)]
            now = loss_of(spec, test_y, test_at)
            if now < best - 1e-7:
                best, best_n = now, k + 1
            elif k + 1 - best_n >= spec.patience:
                break
    return {"base": base, "depth": spec.depth, "logistic": spec.loss == "logistic", "trees": trees[:best_n] if held else trees}


def predict(model: dict, bins: np.ndarray) -> np.ndarray:
    at = np.full(len(bins), model["base"])
    for tree in model["trees"]:
        at += np.asarray(tree[2])[fall(tree, bins, model["depth"])]
    return 1 / (1 + np.exp(-at)) if model["logistic"] else at


# -- the shared table and the jobs ----------------------------------------------

def _numbers(batch: pa.RecordBatch, name: str, row: int, kind: type) -> np.ndarray:
    """The numbers of one block, read where the batch holds them."""
    return np.frombuffer(batch.column(name)[row].as_buffer(), kind)


class Binned:
    """A table's features as bytes in blocks of one fold each; ``fold`` orders the rows in time."""

    def __init__(self, df: DataFrame, features: Sequence[str], labels: Sequence[str], fold: str = "year", key: str = "game_id"):
        self.features, self.labels = list(features), list(labels)
        wide = df.select(F.col(key).cast("long").alias("key"), F.col(fold).cast("int").alias("fold"),
                         *[F.col(c).cast("double").alias(c) for c in [*self.features, *self.labels]])
        self.rows = stage(wide, "wide")
        shares = F.array(*[F.lit((i + 1) / (BINS + 1)) for i in range(BINS)])
        cuts = self.rows.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, shares, 2000).alias(f"c{i}") for i, c in enumerate(self.features)]).first()
        self.n = cuts["n"]
        self.edges = [np.unique(np.array(cuts[f"c{i}"] or [], float)) for i in range(len(self.features))]
        self.sizes = {r["fold"]: r["n"] for r in self.rows.where("fold is not null").groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
        parts = self.rows.where("fold is not null").withColumn(
            "part", F.pmod(F.xxhash64("key"), F.lit(max(1, max(self.sizes.values(), default=1) // BLOCK))).cast("int"))
        self.blocks = stage(parts.groupBy("fold", "part").applyInArrow(self._block(), "fold int, part int, keys binary, bins binary, labels binary"), "bins")

    def _block(self):
        features, labels, edges = self.features, self.labels, self.edges

        def run(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by("key")
            bins = np.zeros((table.num_rows, len(features)), np.uint8)
            for i, (c, cut) in enumerate(zip(features, edges)):
                x = table.column(c).to_numpy()
                bins[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(cut, x, side="left"))
            y = np.stack([table.column(c).to_numpy() for c in labels]) if labels else np.zeros((0, table.num_rows))
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *[
                pa.array([x.tobytes()], pa.binary()) for x in (table.column("key").to_numpy(), bins, y)]],
                names=["fold", "part", "keys", "bins", "labels"])
        return run

    def picked(self) -> DataFrame:
        """The blocks with the rows that fits learn from: all, unless ``FIT_ROWS`` is set."""
        if self.n <= FIT_ROWS:
            return self.blocks.drop("keys")
        width, n_labels, share = len(self.features), len(self.labels), FIT_ROWS / self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids = _numbers(batch, "keys", i, np.int64)
                    hashed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                    kept = np.flatnonzero(hashed < share * 2 ** 32)
                    bins = _numbers(batch, "bins", i, np.uint8).reshape(len(ids), width)[kept]
                    y = _numbers(batch, "labels", i, np.float64).reshape(n_labels, -1)[:, kept]
                    yield pa.RecordBatch.from_arrays([batch.column("fold").slice(i, 1), batch.column("part").slice(i, 1), *[
                        pa.array([x.tobytes()], pa.binary()) for x in (bins, y)]], ["fold", "part", "bins", "labels"])

        return self.blocks.mapInArrow(run, "fold int, part int, bins binary, labels binary")

    def fits(self, tasks: list[dict]) -> list[dict]:
        """Models of tasks ``{label, fold, seed, spec}``, learnt from all rows of the folds before ``fold``."""
        if not tasks:
            return []
        if min(self.n, FIT_ROWS) > TASK_ROWS:
            from tallyline.learning import passes
            models = passes.grow_together(self.rows, self.blocks, self.labels, len(self.features), [{**t, "label": self.labels.index(t["label"])} for t in tasks])
        else:
            models = self._grown_in_tasks(tasks)
        empty = {"base": 0.0, "depth": 1, "logistic": False, "trees": []}
        return [{**(model or empty), **{k: v for k, v in t.items() if k != "spec"}} for model, t in zip(models, tasks)]

    def _grown_in_tasks(self, tasks: list[dict]) -> list[dict | None]:
        """A task of Spark for each model."""
        width, n_labels = len(self.features), len(self.labels)
        specs = [{**t, "spec": asdict(t["spec"]), "label": self.labels.index(t["label"])} for t in tasks]
        before = [max((f for f in self.sizes if f < t["fold"]), default=None) for t in tasks]
        first = min(self.sizes, default=None)

        def run(key: tuple, table: pa.Table) -> pa.Table:
            t, stop = specs[key[0].as_py()], before[key[0].as_py()]
            table = table.sort_by([("fold", "ascending"), ("part", "ascending")])
            bins, y, folds = [], [], []
            for fold, b, labels in zip(*(table.column(c).to_pylist() for c in ("fold", "bins", "labels"))):
                value = np.frombuffer(labels).reshape(n_labels, -1)[t["label"]]
                kept = np.flatnonzero(~np.isnan(value))
                bins.append(np.frombuffer(b, np.uint8).reshape(len(value), width)[kept])
                y.append(value[kept])
                folds.append(np.full(len(kept), fold))
            folds = np.concatenate(folds)
            # the newest year before the fold decides, if there are years before it to learn from
            stop_on = (folds == stop) if stop is not None and stop > first else np.zeros(len(folds), bool)
            model = fit(np.concatenate(bins), np.concatenate(y), stop_on, Spec(**t["spec"]), t["seed"])
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([json.dumps(model)])], names=["task", "model"])

        wanted = F.array(*[F.struct(F.lit(i).alias("task"), F.lit(t["fold"]).alias("fold")) for i, t in enumerate(tasks)])
        dealt = self.picked().withColumn("task", F.explode(F.transform(F.filter(wanted, lambda t: t["fold"] > F.col("fold")), lambda t: t["task"])))
        models = dealt.repartition(len(tasks), "task").groupBy("task").applyInArrow(run, "task int, model string").collect()
        found = {r["task"]: json.loads(r["model"]) for r in models}  # a model has a few hundred small trees
        return [found.get(i) for i in range(len(tasks))]

    def scores(self, models: list[dict], names: Sequence[str] = ("seed",)) -> DataFrame:
        """``key, fold, label, value, trees`` and ``names``: every row of a model's fold under that model."""
        width, kinds = len(self.features), ["double" if isinstance(models[0][n], float) else "string" if isinstance(models[0][n], str) else "int" for n in names] if models else []
        by_fold: dict[int, list[dict]] = {}
        for model in models:
            by_fold.setdefault(model["fold"], []).append(model)
        own = [T.StructField(n, {"double": T.DoubleType(), "string": T.StringType(), "int": T.IntegerType()}[k]) for n, k in zip(names, kinds or ["int"] * len(names))]
        schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("fold", T.IntegerType()), T.StructField("label", T.StringType()),
                               T.StructField("value", T.DoubleType()), T.StructField("trees", T.IntegerType()), *own])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, fold in enumerate(batch.column("fold").to_pylist()):
                    ids = _numbers(batch, "keys", i, np.int64)
                    bins = _numbers(batch, "bins", i, np.uint8).reshape(len(ids), width)
                    for model in by_fold.get(fold, []):
                        n = len(ids)
                        rest = [pa.array([model[f.name]] * n, {"double": pa.float64(), "string": pa.string(), "integer": pa.int32()}[f.dataType.typeName()]) for f in own]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids), pa.array(np.full(n, fold, np.int32)), pa.array([model["label"]] * n), pa.array(predict(model, bins)),
                             pa.array(np.full(n, len(model["trees"]), np.int32)), *rest], schema.names)

        if not models:
            return self.rows.sparkSession.createDataFrame([], schema)
        return self.blocks.where(F.col("fold").isin(list(by_fold))).select("fold", "keys", "bins").mapInArrow(run, schema)


def walk(df: DataFrame, features: Sequence[str], folds: Sequence[int], label: str, spec: Spec, seeds: Sequence[int],
         out: str, fold: str = "year", key: str = "game_id") -> DataFrame:
    """``df`` with out-of-fold predictions: a row per seed, with the number of trees; folds without earlier rows have none."""
    binned = Binned(df, features, [label], fold, key)
    usable = [f for f in folds if any(g < f for g in binned.sizes)]
    models = binned.fits([{"label": label, "fold": f, "seed": s, "spec": spec} for f in usable for s in seeds])
    found = binned.scores(models).select(F.col("key").alias(key), F.col("value").alias(out), "trees", "seed")
    return df.join(found, key)


def importances(model: dict, features: Sequence[str]) -> dict[str, int]:
    """How many splits a feature has."""
    out = dict.fromkeys(features, 0)
    for feature, high, _ in model["trees"]:
        for f, b in zip(feature, high):
            out[features[f]] += b < 255
    return out


def halving(df: DataFrame, groups: dict[str, Sequence[str]], specs: Sequence[Spec], folds: Sequence[int], seeds: Sequence[int], label: str,
            score, keep: float = 0.5) -> list[tuple[str, Spec, float, int, float]]:
    """Successive halving over feature groups times settings.

    All start with one seed; the better half goes on with twice the seeds until one round
    has them all.  Rows ``(group, spec, loss, seeds, mean trees)``, the finalists first.
    ``score`` takes out-of-fold rows (``game_id``, ``value``) and gives a loss.  A group's
    settings, folds and seeds share its binned table.
    """
    tables = {g: Binned(df, some, [label]) for g, some in groups.items()}
    alive, done, n = [(g, s) for g in groups for s in specs], [], 1
    while True:
        n, ranked = min(n, len(seeds)), []
        grown: dict[int, list[dict]] = {}
        for g, table in tables.items():  # all settings of a group at once, so that they share the passes over its table
            mine = [k for k, (h, _) in enumerate(alive) if h == g]
            models = table.fits([{"label": label, "fold": f, "seed": s, "spec": alive[k][1]} for k in mine for f in folds for s in seeds[:n]])
            each = len(models) // max(1, len(mine))
            grown |= {k: models[i * each: (i + 1) * each] for i, k in enumerate(mine)}
        for k, (g, spec) in enumerate(alive):
            models = grown[k]
            oof = tables[g].scores(models).groupBy(F.col("key").alias("game_id")).agg(F.avg("value").alias("value"))
            ranked.append((g, spec, score(oof), n, float(np.mean([len(m["trees"]) for m in models]) if models else 0.0)))
        ranked.sort(key=lambda r: r[2])
        if n == len(seeds):
            return ranked + done
        cut = max(1, int(len(ranked) * keep))
        done, alive, n = ranked[cut:] + done, [(g, s) for g, s, *_ in ranked[:cut]], 2 * n
