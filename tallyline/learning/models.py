"""Training and scoring protocols.

Boosted trees of all folds, seeds and settings are fitted side by side (``boosting``),
other models by MLlib over a short list of folds; rows never come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import scalars as s
from tallyline.learning import boosting, isotonic
from tallyline.operators import metrics
from tallyline.operators.joins import keep_last
from tallyline.staging import stage

LABEL = "home_win"
Fit = Callable[[DataFrame, Sequence[str], int], PipelineModel]

# fixed values: seeds of the ensembles
SEEDS = (42, 123, 256, 789, 1337)
# fits submitted together; each is a distributed job of its own
FITS_AT_ONCE = 4


# -- splits ------------------------------------------------------------------

def split_by_year(df: DataFrame, train_to: int, validate: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train up to a year, validate on one year, test on the later ones."""
    year = F.col("year")
    return df.where(year <= train_to), df.where(year == validate), df.where(year > validate)


def last_rows(df: DataFrame, n: int, order: Sequence[str] = ("date", "game_id")) -> DataFrame:
    """The n latest rows (a top-n, no full sort)."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


# -- feature matrix ----------------------------------------------------------

def with_missing_flags(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}__na") for c in features])


def matrix_stages(features: Sequence[str], flags: bool = True) -> list:
    """Mean imputation plus missing flags, since MLlib trees reject missing values."""
    filled = [f"{c}__in" for c in features]
    extra = [f"{c}__na" for c in features] if flags else []
    return [Imputer(inputCols=list(features), outputCols=filled, strategy="mean"),
            VectorAssembler(inputCols=filled + extra, outputCol="features")]


def classifier(train: DataFrame, features: Sequence[str], seed: int = 42, iterations: int = 5, depth: int = 3,
               step: float = 0.2, validate_on: Column | None = None) -> PipelineModel:
    """Boosted trees; with ``validate_on`` training stops when those rows stop improving."""
    gbt = GBTClassifier(labelCol=LABEL, featuresCol="features", maxIter=iterations, maxDepth=depth, stepSize=step,
                        seed=seed, subsamplingRate=0.8)
    rows = with_missing_flags(train, features)
    if validate_on is not None:
        rows = rows.withColumn("__validate", validate_on)
        gbt = gbt.setValidationIndicatorCol("__validate")
    return Pipeline(stages=[*matrix_stages(features), gbt]).fit(rows)


def margin_model(train: DataFrame, features: Sequence[str], seed: int = 42, iterations: int = 5, depth: int = 3,
                 loss: str = "absolute", label: str = "margin") -> PipelineModel:
    """Regressor of the margin: absolute, squared or Huber loss."""
    if loss == "huber":
        model = LinearRegression(labelCol=label, featuresCol="features", loss="huber", regParam=0.1, maxIter=20)
    else:
        model = GBTRegressor(labelCol=label, featuresCol="features", maxIter=iterations, maxDepth=depth, lossType=loss,
                             seed=seed, subsamplingRate=0.8)
    return Pipeline(stages=[*matrix_stages(features), model]).fit(with_missing_flags(train, features))


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    """Probability of class 1, or the prediction of a regressor, in column ``out``."""
    scored = model.transform(with_missing_flags(df, features))
    value = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    return scored.select(*df.columns, value.alias(out))


# -- walk forward ------------------------------------------------------------

#: Boosted fits by the function that names them; early stopping decides the number of trees.
BOOSTED = {classifier: boosting.Spec(), margin_model: boosting.Spec(loss="absolute")}


def walk_forward(df: DataFrame, features: Sequence[str], years: Sequence[int], fit: Fit | boosting.Spec = classifier,
                 out: str = "prob", seeds: Sequence[int] = (42,), need: str = LABEL,
                 min_train: int = 1, min_test: int = 1) -> DataFrame:
    """Out-of-fold predictions: year Y is predicted by models of the years before it.

    One row per test row and seed.  Folds with too little data are skipped.
    ``classifier``, ``margin_model`` and settings of ``boosting`` are fitted all at once
    and stop early on the last year before the fold, if there are earlier ones; other
    fits run a few at a time.
    """
    rows = df.where(F.col(need).isNotNull())
    sizes = {r["year"]: r["n"] for r in rows.groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect()}
    folds = [year for year in years if sum(n for y, n in sizes.items() if y < year) >= min_train and sizes.get(year, 0) >= min_test]

    spec = fit if isinstance(fit, boosting.Spec) else BOOSTED.get(fit)
    if spec is not None:
        return stage(boosting.walk(rows, features, folds, need, spec, seeds, out).drop("trees"), "oof")

    def run(task: tuple[int, int]) -> DataFrame:
        year, seed = task
        train, test = rows.where(F.col("year") < year), rows.where(F.col("year") == year)
        return score(fit(train, features, seed), test, features, out).withColumn("seed", F.lit(seed))

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        parts = list(pool.map(run, [(year, seed) for year in folds for seed in seeds]))
    if not parts:
        return rows.where(F.lit(False)).select("*", F.lit(None).cast("double").alias(out), F.lit(0).alias("seed"))
    return stage(reduce(DataFrame.unionByName, parts), "oof")


def seed_mean(oof: DataFrame, value: str, key: str = "game_id") -> DataFrame:
    """Mean prediction over the seeds."""
    return oof.groupBy(key).agg(F.avg(value).alias(value))


def fold_metrics(oof: DataFrame, prob: str = "prob", label: str = LABEL) -> DataFrame:
    """Per-fold rows and the pooled row (year null)."""
    per_fold = metrics.classification(oof, prob, label, ["year"]).join(metrics.auc(oof, prob, label, ["year"]), "year")
    pooled = metrics.classification(oof, prob, label).withColumn("__k", F.lit(1)).join(
        metrics.auc(oof.withColumn("__k", F.lit(1)), prob, label, ["__k"]), "__k").drop("__k")
    return per_fold.unionByName(pooled.withColumn("year", F.lit(None).cast("int")), allowMissingColumns=True)


# -- calibration -------------------------------------------------------------

def fit_isotonic(oof: DataFrame, prob: str, label: str = LABEL) -> isotonic.Isotonic:
    """Isotonic fit of outcome on probability; equal scores are averaged first, with weights."""
    return isotonic.fit(oof, prob, label)


def calibrate(model: isotonic.Isotonic, df: DataFrame, prob: str, out: str) -> DataFrame:
    """Calibrated and clipped probability; outside the fitted range the end values hold."""
    return df.select(*df.columns, s.clip_probability(model(F.col(prob).cast("double"))).alias(out))


def calibrate_forward(oof: DataFrame, prob: str, out: str) -> DataFrame:
    """Each year's out-of-fold probabilities, calibrated on earlier years' only.

    The first year has nothing to be calibrated on and is left out.
    """
    years = sorted(r["year"] for r in oof.select("year").distinct().collect())
    parts = [calibrate(fit_isotonic(oof.where(F.col("year") < year), prob), oof.where(F.col("year") == year), prob, out) for year in years[1:]]
    if not parts:
        return oof.where(F.lit(False)).withColumn(out, F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, parts)


# -- studies -----------------------------------------------------------------

def compare_features(df: DataFrame, configs: dict[str, Sequence[str]], years: Sequence[int], seeds: Sequence[int],
                     baseline: str, fit: Fit = classifier) -> DataFrame:
    """Pooled walk-forward metrics of feature sets, with the delta to the baseline.

    The noise floor is the deviation of the baseline's loss over seeds.
    """
    reports, noise = [], 0.0
    for name, features in configs.items():
        oof = walk_forward(df, features, years, fit, seeds=seeds)
        per_seed = metrics.classification(oof, "prob", LABEL, ["seed"])
        if name == baseline:
            noise = metrics.seed_dispersion(per_seed, "log_loss").first()["std"] or 0.0
        mean = seed_mean(oof, "prob").join(df.select("game_id", LABEL), "game_id")
        reports.append(metrics.classification(mean, "prob", LABEL).withColumn("config", F.lit(name)))
    report = stage(reduce(DataFrame.unionByName, reports), "configs")
    return metrics.delta_verdict(report, "config", "log_loss", baseline, noise)


def grid_search(df: DataFrame, groups: dict[str, Sequence[str]], params: Sequence[dict], years: Sequence[int],
                seeds: Sequence[int] = SEEDS) -> DataFrame:
    """Settings times feature groups by successive halving, ranked by pooled walk-forward loss of the seeds' mean.

    ``seeds`` says in how many a setting took part, ``trees`` how many it grew on average before it stopped.
    """
    rows = stage(df.where(F.col(LABEL).isNotNull()), "grid")
    labels = rows.select("game_id", LABEL)

    def loss(oof: DataFrame) -> float:
        return metrics.classification(oof.join(labels, "game_id"), "value", LABEL).first()["log_loss"]

    found = boosting.halving(rows, groups, [boosting.Spec(**p) for p in params], years, seeds, LABEL, loss)
    written = {boosting.Spec(**p): ", ".join(f"{k}={v}" for k, v in sorted(p.items())) for p in params}
    return df.sparkSession.createDataFrame([(i + 1, g, written[spec], value, n, trees) for i, (g, spec, value, n, trees) in enumerate(found)],
                                           "place int, group string, params string, log_loss double, seeds int, trees double")


META = ("clf_prob", "clf_confidence", "margin_pred", "margin_abs", "clf_margin_agree")


def meta_features(oof: DataFrame) -> DataFrame:
    """From out-of-fold probability and margin to the inputs of the second level."""
    p, m = F.col("clf_prob"), F.col("margin_pred")
    return oof.select("*", F.abs(p - 0.5).alias("clf_confidence"), F.abs(m).alias("margin_abs"),
                      s.signs_agree(p, m).alias("clf_margin_agree"))


def logistic(train: DataFrame, features: Sequence[str], seed: int = 42) -> PipelineModel:
    model = LogisticRegression(labelCol=LABEL, featuresCol="features", regParam=0.01, maxIter=20)
    return Pipeline(stages=[*matrix_stages(features), model]).fit(with_missing_flags(train, features))


def base_oof(df: DataFrame, features: Sequence[str], years: Sequence[int], seeds: Sequence[int] = SEEDS) -> DataFrame:
    """Rows of the fold years with seed-averaged out-of-fold probability and margin."""
    prob = seed_mean(walk_forward(df, features, years, classifier, "clf_prob", seeds), "clf_prob")
    points = seed_mean(walk_forward(df, features, years, margin_model, "margin_pred", seeds, need="margin"), "margin_pred")
    return stage(df.join(prob, "game_id").join(points, "game_id"), "base-oof")


def stacking(df: DataFrame, features: Sequence[str], years: Sequence[int], seeds: Sequence[int] = SEEDS) -> DataFrame:
    """Second-level model on earlier years' out-of-fold rows only, against the first level."""
    meta = meta_features(base_oof(df, features, years, seeds))
    second = walk_forward(meta, META, years, logistic, "meta_prob", min_train=50, min_test=10)
    raw = metrics.classification(second, "clf_prob", LABEL, ["year"])
    top = metrics.classification(second, "meta_prob", LABEL, ["year"])
    return raw.select("year", "n", F.col("log_loss").alias("raw_ll"), F.col("accuracy").alias("raw_acc")).join(
        top.select("year", F.col("log_loss").alias("meta_ll"), F.col("accuracy").alias("meta_acc")), "year").select(
        "*", (F.col("meta_ll") - F.col("raw_ll")).alias("delta_ll"), (F.col("meta_acc") - F.col("raw_acc")).alias("delta_acc"))


def two_stage_margin(df: DataFrame, features: Sequence[str], years: Sequence[int], seeds: Sequence[int] = SEEDS) -> DataFrame:
    """Sign from the classifier, size from one regressor per winning side; all folds, seeds and the three fits side by side."""
    margin = F.col("margin")
    sized = stage(df.where(margin.isNotNull()).withColumns({
        "size_home": F.when(margin > 0, margin).cast("double"), "size_away": F.when(margin <= 0, -margin).cast("double")}), "sized")
    kinds = {LABEL: BOOSTED[classifier], "size_home": BOOSTED[margin_model], "size_away": BOOSTED[margin_model]}
    binned = boosting.Binned(sized, features, list(kinds))
    models = binned.fits([{"label": label, "fold": y, "seed": seed, "spec": spec} for y in years for seed in seeds for label, spec in kinds.items()])
    mean = binned.scores(models).groupBy(F.col("key").alias("game_id")).pivot("label", list(kinds)).agg(F.avg("value"))
    named = mean.select("game_id", F.col(LABEL).alias("prob"), "size_home", "size_away")
    out = sized.drop("size_home", "size_away").join(named, "game_id")
    return stage(out.withColumn("pred", F.when(F.col("prob") >= 0.5, F.abs("size_home")).otherwise(-F.abs("size_away"))), "two-stage")


def conditioned_margin(df: DataFrame, features: Sequence[str], years: Sequence[int], seeds: Sequence[int] = SEEDS) -> DataFrame:
    """Margin model with the classifier's out-of-fold probability as an extra feature."""
    prob = seed_mean(walk_forward(df, features, years, classifier, "clf_prob", seeds), "clf_prob")
    rows = stage(df.join(prob, "game_id"), "conditioned")
    reports = []
    for name, some in (("plain", features), ("with clf_prob", [*features, "clf_prob"])):
        mean = seed_mean(walk_forward(rows, some, years[1:], margin_model, "pred", seeds, need="margin"), "pred").join(rows.select("game_id", "margin"), "game_id")
        reports.append(metrics.regression(mean, "pred", "margin").withColumn("config", F.lit(name)))
    return reduce(DataFrame.unionByName, reports)


def loss_comparison(df: DataFrame, features: Sequence[str], years: Sequence[int],
                    losses: Sequence[str] = ("absolute", "squared", "huber"), seeds: Sequence[int] = SEEDS) -> DataFrame:
    reports = []
    for loss in losses:
        oof = seed_mean(walk_forward(df, features, years, boosting.Spec(loss=loss), "pred", seeds, need="margin"), "pred")
        reports.append(metrics.regression(oof.join(df.select("game_id", "margin"), "game_id"), "pred", "margin").withColumn("loss", F.lit(loss)))
    return reduce(DataFrame.unionByName, reports)


def pooled_metrics(df: DataFrame, features: Sequence[str], years: Sequence[int], seeds: Sequence[int] = SEEDS) -> DataFrame:
    """Walk-forward metrics of the seeds' mean."""
    mean = seed_mean(walk_forward(df, features, years, seeds=seeds), "prob").join(df.select("game_id", LABEL), "game_id")
    return metrics.classification(mean, "prob", LABEL)


# -- explanations ------------------------------------------------------------

def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Feature importances, sorted; imputation flags count with their feature."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    names = [*features, *features]
    return (spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")
            .groupBy("feature").agg(F.round(F.sum("importance"), 4).alias("importance"))
            .orderBy(F.desc("importance"), "feature"))


def contributions(train: DataFrame, rows: DataFrame, features: Sequence[str], top: int = 10) -> DataFrame:
    """Exact log-odds contributions coef * (x - mean) of a logistic model, the largest first, and the base value."""
    model = LogisticRegression(labelCol=LABEL, featuresCol="features", regParam=0.01, maxIter=20)
    fitted = Pipeline(stages=[*matrix_stages(features, flags=False), model]).fit(train)
    means = fitted.stages[0].surrogateDF.first()
    lr = fitted.stages[-1]
    base = float(lr.intercept + sum(c * means[f] for c, f in zip(lr.coefficients, features)))
    terms = F.array(*[F.struct((-F.abs(v)).alias("size"), F.lit(f).alias("name"), F.col(f).cast("double").alias("value"),
                               v.alias("contribution"))
                      for f, c in zip(features, lr.coefficients)
                      for v in [F.lit(float(c)) * (F.coalesce(F.col(f), F.lit(means[f])) - F.lit(means[f]))]])
    best = rows.select("game_id", F.posexplode(F.slice(F.array_sort(terms), 1, top)).alias("pos", "t"))
    return best.select("game_id", (F.col("pos") + 1).alias("rank"), "t.name", "t.value", "t.contribution",
                       F.lit(base).alias("base_value"))


# -- serving -----------------------------------------------------------------

def score_upcoming(history: DataFrame, upcoming: DataFrame, features: Sequence[str], years: Sequence[int],
                   seeds: Sequence[int] = SEEDS) -> DataFrame:
    """Seed-averaged, calibrated and clipped probability, margin, winner and confidence of upcoming games.

    Upcoming games are one more fold after all years, so they share the binned table and the fits.
    """
    last = history.agg(F.max("year")).first()[0] or 0
    after = last + 1
    own = ["game_id", "year", LABEL, "margin", *features]
    both = history.select(*own).unionByName(upcoming.select(*own).withColumns({
        "year": F.lit(after), LABEL: F.lit(None).cast("int"), "margin": F.lit(None).cast("double")}))
    binned = boosting.Binned(both, features, [LABEL, "margin"])
    tasks = [{"label": LABEL, "fold": y, "seed": seed, "spec": BOOSTED[classifier]} for y in [*years, after] for seed in seeds]
    tasks += [{"label": "margin", "fold": after, "seed": seed, "spec": BOOSTED[margin_model]} for seed in seeds]
    mean = stage(binned.scores(binned.fits(tasks)).groupBy(F.col("key").alias("game_id"), "fold", "label").agg(F.avg("value").alias("value")), "mean")
    past = mean.where(F.col("fold") != after).join(history.select("game_id", LABEL), "game_id")
    calibrator = fit_isotonic(past, "value")
    now = mean.where(F.col("fold") == after)
    raw = now.where(F.col("label") == LABEL).select("game_id", F.col("value").alias("home_win_prob_raw"))
    points = now.where("label = 'margin'").select("game_id", F.col("value").alias("predicted_margin"))
    out = calibrate(calibrator, upcoming.join(raw, "game_id").join(points, "game_id"), "home_win_prob_raw", "home_win_prob")
    p = F.col("home_win_prob")
    return out.select(
        "game_id", "date", "year", "round", "home_team", "away_team", "home_win_prob_raw", "home_win_prob",
        (1 - p).alias("away_win_prob"), s.predicted_winner(p, F.col("home_team"), F.col("away_team")).alias("predicted_winner"),
        s.confidence(p).alias("confidence"), "predicted_margin")


def compare_models(old: DataFrame, new: DataFrame, names: Sequence[str]) -> DataFrame:
    """Metric rows of two models side by side with their difference."""
    def long(df: DataFrame, tag: str) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(tag))
                                             for n in names])).alias("m")).select("m.*")
    return long(old, "old").join(long(new, "new"), "metric").withColumn("delta", F.col("new") - F.col("old"))


def missing_snapshots(predictions: DataFrame, explained: DataFrame) -> DataFrame:
    """Latest prediction per game that has no stored explanation of that date."""
    latest = keep_last(predictions, ["game_id"], ["snapshot_date"])
    return latest.join(explained.select("game_id", "snapshot_date").distinct(), ["game_id", "snapshot_date"], "left_anti")
