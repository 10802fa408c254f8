"""Forecast evaluation and data guardrails as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import scalars as s
from tallyline.operators.scan import running
from tallyline.staging import stage

EPS = 1e-6


# -- classification and regression -------------------------------------------

def log_loss(p: Column, y: Column, eps: float = EPS) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q))


def classification(df: DataFrame, prob: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, log-loss, Brier score and the majority baseline over rows with both values."""
    p, y = F.col(prob), F.col(label)
    rows = df.where(p.isNotNull() & y.isNotNull())
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(((p >= 0.5).cast("int") == y).cast("double")).alias("accuracy"),
        F.avg(log_loss(p, y)).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(y.cast("double")).alias("base"))
    return out.select("*", F.greatest("base", 1 - F.col("base")).alias("baseline_accuracy")).drop("base")


def auc(df: DataFrame, prob: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counting half.

    Rows are first counted per distinct score; each score then needs only the
    number of negatives below it.
    """
    keys = list(keys)
    rows = df.where(F.col(prob).isNotNull() & F.col(label).isNotNull())
    counts = stage(rows.groupBy(*keys, F.col(prob).alias("__p")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"),
        F.sum((F.col(label) != 1).cast("bigint")).alias("neg")), "scores")
    placed = running(counts, keys, ["__p"], {"below": ("sum", F.col("neg"))})
    wins = F.col("pos") * (F.coalesce("below", F.lit(0)) + F.col("neg") / 2.0)
    return placed.groupBy(*keys).agg(F.try_divide(
        F.sum(wins), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def regression(df: DataFrame, pred: str, truth: str, keys: Sequence[str] = ()) -> DataFrame:
    err = F.col(truth) - F.col(pred)
    return df.where(err.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(((F.col(pred) > 0) == (F.col(truth) > 0)).cast("double")).alias("direction_accuracy"))


# -- reliability -------------------------------------------------------------

def _band(p: Column, edges: Sequence[float], closed: bool) -> Column:
    """Index of the band holding p; the last one is closed on request, else p is clamped into it."""
    index = F.lit(0)
    for edge in edges[1:-1]:
        index = index + (p >= edge).cast("int")
    inside = (p >= edges[0]) & (p <= edges[-1])
    return F.when(inside, index) if closed else index


def reliability(df: DataFrame, prob: str, label: str, edges: Sequence[float], empty: str = "keep",
                closed: bool = True) -> DataFrame:
    """Mean prediction, observed rate and drift per band; ``empty`` bands are kept or dropped.

    ``closed`` leaves values outside the edges out; otherwise they join the end bands.
    """
    rows = df.where(F.col(prob).isNotNull() & F.col(label).isNotNull())
    sums = rows.groupBy(_band(F.col(prob), edges, closed).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(prob).alias("predicted_mean"),
        F.avg(F.col(label).cast("double")).alias("observed_rate"), F.sum(F.col(label)).cast("bigint").alias("successes"))
    bands = df.sparkSession.createDataFrame(
        [(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))], "bin int, lo double, hi double")
    out = bands.join(sums, "bin", "left" if empty == "keep" else "inner")
    return out.select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "predicted_mean", "observed_rate",
                      (F.col("observed_rate") - F.col("predicted_mean")).alias("drift"),
                      F.coalesce("successes", F.lit(0)).alias("successes"))


def drift_flags(bins: DataFrame, min_n: int = 5, threshold: float = 0.15) -> DataFrame:
    """A band drifts when it is populated, far off and its interval excludes the prediction."""
    low, high = s.wilson(F.col("successes"), F.col("n"))
    out = bins.select("*", low.alias("ci_low"), high.alias("ci_high"), (F.col("n") >= min_n).alias("sufficient"))
    outside = (F.col("predicted_mean") < F.col("ci_low")) | (F.col("predicted_mean") > F.col("ci_high"))
    far = F.abs("drift") > threshold
    drifting = F.coalesce(F.col("sufficient") & far & outside, F.lit(False))
    state = (F.when(F.col("n") == 0, "empty").when(drifting, "DRIFT").when(~F.col("sufficient"), "thin")
             .when(far, "noisy").otherwise("ok"))
    return out.select("*", drifting.alias("drift_flag"), state.alias("state"))


# -- comparison of forecasters -----------------------------------------------

def pairwise_agreement(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share of equal picks for every two forecasters (``pick_<name>``), in one pass."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    wide = df.agg(*[F.avg((F.col(f"pick_{a}") == F.col(f"pick_{b}")).cast("double")).alias(f"{a}_vs_{b}")
                    for a, b in pairs])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(f"{a}_vs_{b}")
                                                    .alias("agreement")) for a, b in pairs])).alias("r")).select("r.*")


def discordance(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Both right, one right, none right, accuracy gap and the approximate McNemar z."""
    ca, cb = F.col(f"correct_{a}"), F.col(f"correct_{b}")

    def count(x: int, y: int, name: str) -> Column:
        return F.count(F.when((ca == x) & (cb == y), 1)).alias(name)

    out = df.groupBy(*keys).agg(count(1, 1, "both_right"), count(1, 0, "first_only"), count(0, 1, "second_only"),
                                count(0, 0, "both_wrong"), (F.avg(ca) - F.avg(cb)).alias("accuracy_gap"))
    split = F.col("first_only") + F.col("second_only")
    return out.withColumn("mcnemar_z", F.when(
        split > 0, (F.col("first_only") - F.col("second_only")) / F.sqrt(split.cast("double"))).otherwise(0.0))


def seed_dispersion(per_seed: DataFrame, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation and range of a metric over seeds."""
    return per_seed.groupBy(*keys).agg(
        F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"),
        (F.max(metric) - F.min(metric)).alias("range"), F.count(F.lit(1)).alias("n_seeds"))


def fold_dispersion(predictions: DataFrame, prob: str, label: str, fold: str, seed: str, row: str) -> DataFrame:
    """Per fold: seed losses against the loss of the seed-averaged probability."""
    seeds = predictions.groupBy(fold, seed).agg(F.avg(log_loss(F.col(prob), F.col(label))).alias("ll"))
    spread = seeds.groupBy(fold).agg(F.avg("ll").alias("seed_mean_log_loss"),
                                     F.stddev_pop("ll").alias("seed_std_log_loss"))
    mean = predictions.groupBy(fold, row).agg(F.avg(prob).alias("p"), F.max(label).alias("y"))
    pooled = mean.groupBy(fold).agg(F.count(F.lit(1)).alias("n"),
                                    F.avg(log_loss(F.col("p"), F.col("y"))).alias("ensemble_log_loss"))
    return spread.join(pooled, fold)


def delta_verdict(report: DataFrame, name: str, metric: str, baseline: str, noise: float) -> DataFrame:
    """Difference to the baseline row and BETTER / WORSE / NOISE around the noise floor (lower is better)."""
    base = report.where(F.col(name) == baseline).agg(F.first(metric).alias("__base"))
    delta = F.col(metric) - F.col("__base")
    # one scalar row on the right: a key that is equal everywhere, no product of tables
    joined = report.withColumn("__k", F.lit(1)).join(base.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return joined.select(*report.columns, delta.alias("delta"), F.when(F.abs(delta) < noise, "NOISE").when(
        delta < 0, "BETTER").otherwise("WORSE").alias("verdict"))


def tie_bands(report: DataFrame, delta: str, noise: float) -> Column:
    """Verdict of a variant: better, within noise, slightly worse (below 3x noise) or worse."""
    d = F.col(delta)
    return (F.when(d < -noise, "BETTER").when(d < noise, "TIE").when(d < 3 * noise, "SLIGHTLY WORSE")
            .otherwise("WORSE"))


# -- coverage and guardrails -------------------------------------------------

def coverage(df: DataFrame, columns: Sequence[str], max_null_rate: float = 0.5) -> DataFrame:
    """Null rate of every wanted column in one pass; missing columns count as all null."""
    have = [c for c in columns if c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"r_{c}") for c in have])
    rows = wide.select("n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.col(f"r_{c}") if c in have else F.lit(1.0)).alias("null_rate"),
                 F.lit(c not in have).alias("missing")) for c in columns])).alias("r")).select("n", "r.*")
    offends = F.col("missing") | F.coalesce(F.col("null_rate") > max_null_rate, F.lit(False))
    return rows.select("*", F.when(F.col("missing"), "column_missing").when(offends, "nan").alias("reason"))



def guardrails(df: DataFrame, probs: Sequence[str] = ("home_win_prob", "analytical_home_prob"),
               line: str = "home_line", keys: Sequence[str] = ()) -> DataFrame:
    """One row per check with its level and measured value, all from a single aggregate."""
    # fixed values: limits of the checks
    constant, clamp, clamp_rate, line_rate, disagree = 0.02, (0.02, 0.98), 0.30, 0.80, 0.30
    a, b = probs
    gap = F.abs(F.col(a) - F.col(b)) >= disagree
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[x for p in probs for x in (
            F.count(p).alias(f"n_{p}"), F.stddev_pop(p).alias(f"sd_{p}"),
            F.avg(((F.col(p) <= clamp[0] + 1e-6) | (F.col(p) >= clamp[1] - 1e-6)).cast("double")).alias(f"clamp_{p}"))],
        F.avg(F.col(line).isNotNull().cast("double")).alias("line"),
        F.count(F.when(gap, 1)).cast("double").alias("disagree"))

    def row(check: str, value: Column, level: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), value.alias("value"), level.alias("level"))

    checks = []
    for p in probs:
        flat = (F.col(f"n_{p}") >= 2) & (F.col(f"sd_{p}") < constant)
        checks.append(row(f"constant_output:{p}", F.col(f"sd_{p}"), F.when(flat, "fail").otherwise("pass")))
        checks.append(row(f"clamp_saturation:{p}", F.col(f"clamp_{p}"),
                          F.when(F.col(f"clamp_{p}") > clamp_rate, "warn").otherwise("pass")))
    checks.append(row("line_coverage", F.col("line"), F.when(F.col("line") < line_rate, "warn").otherwise("pass")))
    checks.append(row("model_disagreement", F.col("disagree"), F.when(F.col("disagree") >= 2, "warn").when(
        F.col("disagree") >= 1, "info").otherwise("pass")))
    return wide.select(*keys, F.explode(F.array(*checks)).alias("c")).select(*keys, "c.*")


def overall_level(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Worst level; info counts as pass."""
    rank = F.max(F.when(F.col("level") == "fail", 2).when(F.col("level") == "warn", 1).otherwise(0))
    return checks.groupBy(*keys).agg(F.when(rank == 2, "fail").when(rank == 1, "warn").otherwise("pass").alias("level"))


def tip_accuracy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Games, games with a pick and right picks per round."""
    scored = F.col("predicted_winner").isNotNull() & (F.col("predicted_winner") != "")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(scored, 1)).alias("scored"),
        F.count(F.when(scored & (F.col("predicted_winner") == F.col("winner")), 1)).alias("correct"))


def crowd(tips: DataFrame, keys: Sequence[str] = ("game_id",)) -> DataFrame:
    """Mean confidence and margins, number of tips and of right ones, per game."""
    means = [c for c in ("confidence", "hconfidence", "margin", "hmargin") if c in tips.columns]
    extra = [F.sum("correct").alias("n_correct")] if "correct" in tips.columns else []
    return tips.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in means],
                                   F.count("source").alias("n_models"), *extra)
