"""Model training, evaluation and serving queries (M).

Every year with results before it is a fold, and every row of it is scored by five seeds.
The number of trees is what early stopping leaves of a bound of 400.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import scalars as s
from tallyline.learning import boosting, models as m
from tallyline.operators import history, joins, markets, metrics, ratings
from tallyline.plans.ctes import r6 as q
from tallyline.plans.lookups import prediction_history
from tallyline.plans.registry import Tables, query, rounded
from tallyline.sources import ingest
from tallyline.staging import stage

FORM = ["win_rate_diff_5", "avg_margin_diff_5", "score_for_diff_5", "score_against_diff_5"]
RATING = ["elo_diff", "elo_expected"]
MARKET = ["implied_home_open", "overround_open", "home_line_close"]
MOVES = ["implied_home_open", "overround_open", "odds_move", "odds_move_magnitude", "overround_change"]
BASE = RATING + FORM + ["rest_diff", "home_had_bye", "away_had_bye"]


def featured(t: Tables) -> DataFrame:
    """History, ratings and prices of every game, stored; the label is null for upcoming games."""
    rows = history.numbered(t.games)
    parts = [history.rolling_form(rows), ratings.elo(t.games), history.rest_days(rows),
             markets.add_moves(markets.add_implied(t.prices))]
    joined = reduce(lambda a, b: a.join(b, "game_id", "left"), parts, t.games)
    done = history.is_done()
    doubles = [F.col(c).cast("double").alias(c) for c in dict.fromkeys([*BASE, *MARKET, *MOVES])]
    return stage(joined.select(
        *t.games.columns, *doubles, F.when(done, s.home_win(F.col("home_score"), F.col("away_score"))).alias(m.LABEL),
        F.when(done, (F.col("home_score") - F.col("away_score")).cast("double")).alias("margin"),
        "home_odds_open", "away_odds_open"), "features")


def known(df: DataFrame) -> DataFrame:
    return df.where(F.col(m.LABEL).isNotNull())


def fold_years(df: DataFrame) -> list[int]:
    """Every year that has results and results before it."""
    years = [r["year"] for r in known(df).select("year").distinct().orderBy("year").collect()]
    return years[1:]


@query("m1_chronological_split", "contests", """select game_id, case when year <= 1996 then 'train' when year = 1997 then 'validate' else 'test' end as part,
  row_number() over (order by date desc, game_id desc) <= 207 as in_last_207 from contests where home_score is not null""")
def chronological_split(t: Tables) -> DataFrame:
    done = t.games.where("home_score is not null")
    parts = zip(("train", "validate", "test"), m.split_by_year(done, 1996, 1997))
    rows = reduce(DataFrame.unionByName, [df.select("game_id", F.lit(name).alias("part")) for name, df in parts])
    last = m.last_rows(done, 207).select("game_id", F.lit(True).alias("l"))
    return rows.join(last, "game_id", "left").select("game_id", "part", F.coalesce("l", F.lit(False)).alias("in_last_207"))


@query("m2_feature_matrix")
def feature_matrix(t: Tables) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    rows = m.with_missing_flags(featured(t), BASE + MARKET)
    out = Pipeline(stages=m.matrix_stages(BASE + MARKET)).fit(rows).transform(rows)
    return out.select("game_id", vector_to_array("features").alias("v")).select(
        "game_id", F.size("v").alias("width"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("m2_market_matrix", "contests prices", f"""
with r as (select c.game_id, (1 / home_odds_open) / (1 / home_odds_open + 1 / away_odds_open) as a, 1 / home_odds_open + 1 / away_odds_open as b, home_line_close as l
  from contests c left join prices p using (game_id))
select game_id, 6 as width, {q('coalesce(a, avg(a) over ()) + coalesce(b, avg(b) over ()) + coalesce(l, avg(l) over ()) + 3 * (a is null)::int')} as total from r""")
def market_matrix(t: Tables) -> DataFrame:
    """Prices only: means for games without prices, and their flags."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    priced = t.games.select("game_id").join(markets.add_implied(t.prices), "game_id", "left")
    rows = m.with_missing_flags(stage(priced.select("game_id", *[F.col(c).cast("double") for c in MARKET]), "market"), MARKET)
    out = Pipeline(stages=m.matrix_stages(MARKET)).fit(rows).transform(rows).select("game_id", vector_to_array("features").alias("v"))
    return rounded(out.select("game_id", F.size("v").alias("width"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("m3_classifier_early_stop")
def classifier_early_stop(t: Tables) -> DataFrame:
    """The newest year, by fits that stop on the year before; ``most_trees`` stays below the bound."""
    df = known(featured(t))
    oof = boosting.walk(df, BASE, fold_years(df)[-1:], m.LABEL, m.BOOSTED[m.classifier], m.SEEDS, "prob")
    mean = stage(oof.groupBy("game_id", m.LABEL).agg(F.avg("prob").alias("prob"), F.max("trees").alias("trees")), "oof")
    most = mean.agg(F.max("trees")).first()[0]
    return rounded(metrics.classification(mean, "prob", m.LABEL).withColumns({
        "most_trees": F.lit(most).cast("int"), "bound": F.lit(m.BOOSTED[m.classifier].trees)}))


@query("m4_margin_regressor")
def margin_regressor(t: Tables) -> DataFrame:
    df = featured(t).where("margin is not null")
    oof = boosting.walk(df, BASE, fold_years(df)[-1:], "margin", m.BOOSTED[m.margin_model], m.SEEDS, "pred")
    mean = oof.groupBy("game_id", "margin").agg(F.avg("pred").alias("pred"))
    return rounded(metrics.regression(mean, "pred", "margin"))


@query("m5_walk_forward")
def walk_forward(t: Tables) -> DataFrame:
    df = featured(t)
    oof = m.walk_forward(df, BASE, fold_years(df), seeds=m.SEEDS)
    return rounded(m.fold_metrics(oof.groupBy("game_id", "year", m.LABEL).agg(F.avg("prob").alias("prob"))))


@query("m6_seed_ensemble")
def seed_ensemble(t: Tables) -> DataFrame:
    df = featured(t)
    oof = m.walk_forward(df, BASE, fold_years(df), seeds=m.SEEDS)
    return rounded(metrics.fold_dispersion(oof, "prob", m.LABEL, "year", "seed", "game_id"))


@query("m7_isotonic_calibration", "contests forecasts", f"""
with p as (select model_prob as x, sum(case when home_score > away_score then 1e0 else 0e0 end) as s, count(*) as n
  from contests c join forecasts f using (game_id) where home_score is not null group by 1),
r as (select *, row_number() over (order by x) as i, sum(s) over (order by x) as cs, sum(n) over (order by x) as cn from p),
a as (select j.i as j, k.i as k, (k.cs - j.cs + j.s) / (k.cn - j.cn + j.n) as mean from r j join r k on k.i >= j.i),
b as (select j, k as i, min(mean) over (partition by j order by k desc) as least from a),
f as (select i, max(least) as y from b group by 1)
select c.game_id, {q('model_prob')} as model_prob, {q('least(0.98, greatest(0.02, y))')} as calibrated
from contests c join forecasts g using (game_id) join r on r.x = g.model_prob join f using (i) where home_score is not null""")
def isotonic_calibration(t: Tables) -> DataFrame:
    """Hand-made forecasts of every finished game, calibrated."""
    df = t.games.where("home_score is not null").join(t.forecasts, "game_id").withColumn(
        m.LABEL, s.home_win(F.col("home_score"), F.col("away_score")))
    out = m.calibrate(m.fit_isotonic(df, "model_prob"), df, "model_prob", "calibrated")
    return rounded(out.select("game_id", "model_prob", "calibrated"))


@query("m8_grid_search")
def grid_search(t: Tables) -> DataFrame:
    df = featured(t)
    return rounded(m.grid_search(df, {"form": FORM, "form+rating": FORM + RATING}, 
                                 [{"depth": d, "rate": r} for d in (2, 3, 4) for r in (0.03, 0.1)], fold_years(df)))


@query("m9_feature_ablation")
def feature_ablation(t: Tables) -> DataFrame:
    df = featured(t)
    return rounded(m.compare_features(df, {"base": BASE, "no rating": [c for c in BASE if c not in RATING], "+market": BASE + MARKET},
                                      fold_years(df), m.SEEDS, "base"))


@query("m10_stacking")
def stacking(t: Tables) -> DataFrame:
    df = featured(t)
    return rounded(m.stacking(df, BASE, fold_years(df)))


@query("m11_two_stage_margin")
def two_stage_margin(t: Tables) -> DataFrame:
    df = featured(t)
    return rounded(metrics.regression(m.two_stage_margin(df, BASE, fold_years(df)), "pred", "margin"))


@query("m12_conditioned_margin")
def conditioned_margin(t: Tables) -> DataFrame:
    df = featured(t)
    return rounded(m.conditioned_margin(df, BASE, fold_years(df)))


@query("m13_loss_comparison")
def loss_comparison(t: Tables) -> DataFrame:
    df = featured(t)
    return rounded(m.loss_comparison(df, BASE, fold_years(df)))


@query("m14_market_variants")
def market_variants(t: Tables) -> DataFrame:
    """Price-only models against the market itself on the games all of them cover."""
    df = featured(t)
    years = fold_years(df)
    common = joins.common_sample(df, MARKET + MOVES)
    variants = {"open+line": MARKET, "open+movement": MOVES}
    rows = [m.pooled_metrics(common, fs, years).withColumn("config", F.lit(name)) for name, fs in variants.items()]
    market = known(common).where(F.col("year").isin(years))
    rows.append(metrics.classification(market, "implied_home_open", m.LABEL).withColumn("config", F.lit("market")))
    return rounded(metrics.delta_verdict(reduce(DataFrame.unionByName, rows), "config", "log_loss", "market", 0.00174))


@query("m15_feature_importance")
def feature_importance(t: Tables) -> DataFrame:
    """Share of the splits of the current model, five seeds that stop on the newest year."""
    df = known(featured(t))
    after = (df.agg(F.max("year")).first()[0] or 0) + 1
    models = boosting.Binned(df, BASE, [m.LABEL]).fits(
        [{"label": m.LABEL, "fold": after, "seed": seed, "spec": m.BOOSTED[m.classifier]} for seed in m.SEEDS])
    counts = {f: sum(boosting.importances(model, BASE)[f] for model in models) for f in BASE}
    total = max(1, sum(counts.values()))
    rows = [(f, round(n / total, 4)) for f, n in counts.items()]
    return t.spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


@query("m16_contributions")
def contributions(t: Tables) -> DataFrame:
    df = featured(t)
    return rounded(m.contributions(known(df), df.where(F.col(m.LABEL).isNull()), BASE, top=5))


@query("m17_score_upcoming")
def score_upcoming(t: Tables) -> DataFrame:
    df = featured(t)
    upcoming = df.where(F.col(m.LABEL).isNull())
    return rounded(m.score_upcoming(known(df), upcoming, BASE, fold_years(df)).withColumn("date", s.day_key(F.col("date"))))


@query("m18_model_comparison")
def model_comparison(t: Tables) -> DataFrame:
    df = featured(t)
    years = fold_years(df)
    old, new = (m.pooled_metrics(df, fs, years) for fs in (FORM, BASE))
    return rounded(m.compare_models(old, new, ["accuracy", "log_loss", "brier"]))


@query("m19_backfill", "history contests", """
select h.game_id, h.snapshot_date from (select game_id, max(snapshot_date) as snapshot_date from history where game_id in (
    select game_id from contests where home_score is not null) group by 1) h
where not exists (select 1 from history e where e.game_id = h.game_id and e.snapshot_date = h.snapshot_date and e.game_id % 3 = 0)""")
def backfill(t: Tables) -> DataFrame:
    """Finished games whose newest prediction has no stored explanation (a third have one)."""
    done = t.games.where("home_score is not null").select("game_id")
    rows = prediction_history(t)
    explained = rows.where("game_id % 3 = 0")
    return m.missing_snapshots(rows.join(done, "game_id", "left_semi"), explained).select("game_id", "snapshot_date")


@query("m19_backfill_scores")
def backfill_scores(t: Tables) -> DataFrame:
    """Past games scored by the current model, dated by their day, put over the stored history."""
    df = featured(t)
    scored = m.score(m.classifier(known(df), BASE), known(df), BASE, "home_win_prob").select(
        "game_id", s.day_key(F.col("date")).alias("snapshot_date"), "home_win_prob")
    return rounded(ingest.upsert(prediction_history(t), scored, ["game_id", "snapshot_date"]))


@query("m20_walk_forward_betting")
def walk_forward_betting(t: Tables) -> DataFrame:
    """Out-of-fold probabilities, each year calibrated on the years before it, staked at opening and closing prices."""
    df = featured(t)
    years = fold_years(df)
    oof = m.walk_forward(df, BASE, years, seeds=m.SEEDS).groupBy("game_id", "year", m.LABEL).agg(F.avg("prob").alias("prob"))
    probs = m.calibrate_forward(stage(oof, "oof"), "prob", "model_prob").select("game_id", "model_prob")
    market = t.games.join(t.prices, "game_id").join(probs, "game_id")
    parts = []
    for kind in ("open", "close"):
        bets = markets.with_outcome(markets.candidate_bets(market, 0.05, 1.0, kind=kind)).withColumn("source", F.lit(kind))
        parts.append(bets.select("source", "league", "year", "date", "game_id", "bet_fraction", "odds", "won", "edge"))
    bets = stage(parts[0].unionByName(parts[1]), "bets")
    keys = ["source", "league", "year"]
    placed = stage(markets.ledger(bets, keys, carry=["date", "odds", "won", "edge"]), "ledger")
    fall = markets.max_drawdown(placed, keys, ["date", "game_id"]).groupBy("source").agg(F.max("max_drawdown").alias("max_drawdown"))
    return rounded(markets.bet_stats(placed, ["source"]).join(markets.yearly_roi(placed, ["source"]), "source").join(fall, "source"))
