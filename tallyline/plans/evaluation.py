"""Forecast evaluation and guardrail queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import scalars as s
from tallyline.operators import joins, metrics
from tallyline.plans.columns import strategy_picks
from tallyline.plans.ctes import define, r6 as q
from tallyline.plans.registry import Tables, query, rounded
from tallyline.sources.fixtures import table
from tallyline.staging import stage

define("scored", "contests forecasts", """select f.*, league, year, case when home_score > away_score then 1 else 0 end as y,
    home_score - away_score as margin from contests c join forecasts f using (game_id) where home_score is not null""")
TENTHS = [i / 10 for i in range(11)]
DRIFT_EDGES = [0.0, 0.2, 0.35, 0.5, 0.65, 0.8, 1.0]


def scored(t: Tables) -> DataFrame:
    done = t.games.where("home_score is not null")
    return done.join(t.forecasts, "game_id").select(
        "game_id", "league", "year", "model_prob", "alt_prob", s.home_win(F.col("home_score"), F.col("away_score")).alias("y"),
        (F.col("home_score") - F.col("away_score")).alias("margin"))


def _edges(edges: list[float]) -> str:
    return "(values " + ", ".join(f"({i}, {lo}e0, {hi}e0)" for i, (lo, hi) in enumerate(zip(edges, edges[1:]))) + ") b(bin, lo, hi)"


@query("a14_reliability_bins", "scored", f"""
select bin, {q('lo')} as lo, {q('hi')} as hi, count(y) as n, {q('avg(model_prob)')} as predicted_mean, {q('avg(y)')} as observed_rate,
  {q('avg(y) - avg(model_prob)')} as drift, cast(coalesce(sum(y), 0) as bigint) as successes
from {_edges(TENTHS)} left join scored on model_prob >= lo and (model_prob < hi or (bin = 9 and model_prob <= 1)) group by bin, lo, hi""")
def reliability_bins(t: Tables) -> DataFrame:
    return rounded(metrics.reliability(scored(t), "model_prob", "y", TENTHS))


@query("a14_reliability_labels", "", f"""
with p as (select l.doc_id, l.quality as y, (d.n_chars % 101) / 100e0 as p from labels l join documents d on d.doc_id = l.doc_id)
select bin, {q('lo')} as lo, {q('hi')} as hi, count(y) as n, {q('avg(p)')} as predicted_mean, {q('avg(y)')} as observed_rate,
  {q('avg(y) - avg(p)')} as drift, cast(coalesce(sum(y), 0) as bigint) as successes
from {_edges(TENTHS)} join p on (p >= lo or bin = 0) and (p < hi or bin = 9) group by bin, lo, hi""")
def reliability_labels(t: Tables) -> DataFrame:
    """Bins without rows are dropped; values at the ends join the end bins."""
    docs = table(t.spark, t.sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 101) / 100.0).alias("p"))
    rows = table(t.spark, t.sf_dir, "labels").join(docs, "doc_id")
    return rounded(metrics.reliability(rows, "p", "quality", TENTHS, empty="drop", closed=False))


_Z = "1.96e0"
_WILSON = (f"({{x}} + {_Z}*{_Z}/(2*n) {{sign}} {_Z} * sqrt({{x}}*(1-{{x}})/n + {_Z}*{_Z}/(4*n*n))) / (1 + {_Z}*{_Z}/n)")


@query("a15_wilson_interval", "scored", f"""
with g as (select league, year, sum(y) as k, count(*)::double as n, sum(y) / count(*)::double as p from scored group by 1, 2)
select league, year, {q(_WILSON.format(sign='-', x='p'))} as ci_low, {q(_WILSON.format(sign='+', x='p'))} as ci_high, 0e0 as empty_low, 1e0 as empty_high from g""")
def wilson_interval(t: Tables) -> DataFrame:
    groups = scored(t).groupBy("league", "year").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = s.wilson(F.col("k"), F.col("n"))
    none_low, none_high = s.wilson(F.col("k") * 0, F.col("n") * 0)
    return rounded(groups.select("league", "year", low.alias("ci_low"), high.alias("ci_high"),
                                 none_low.alias("empty_low"), none_high.alias("empty_high")))


@query("a16_drift_flags", "scored", f"""
with b as (select bin, count(y)::double as n, avg(model_prob) as m, avg(y) as o, sum(y) as k from {_edges(DRIFT_EDGES)}
  left join scored on (model_prob >= lo or bin = 0) and (model_prob < hi or bin = 5) group by bin),
w as (select *, case when n = 0 then 0e0 else greatest(0, {_WILSON.format(sign='-', x='o')}) end as lo,
  case when n = 0 then 1e0 else least(1, {_WILSON.format(sign='+', x='o')}) end as hi from b)
select bin, cast(n as bigint) as n, {q('m')} as predicted_mean, {q('o')} as observed_rate, {q('o - m')} as drift, {q('lo')} as ci_low, {q('hi')} as ci_high,
  n >= 5 as sufficient, coalesce(n >= 5 and abs(o - m) > 0.15 and (m < lo or m > hi), false) as drift_flag,
  case when n = 0 then 'empty' when n >= 5 and abs(o - m) > 0.15 and (m < lo or m > hi) then 'DRIFT' when n < 5 then 'thin'
    when abs(o - m) > 0.15 then 'noisy' else 'ok' end as state from w""")
def drift_flags(t: Tables) -> DataFrame:
    bins = metrics.reliability(scored(t), "model_prob", "y", DRIFT_EDGES, closed=False)
    return rounded(metrics.drift_flags(bins).drop("lo", "hi", "successes"))


_LL = "-(case when y = 1 then ln(least(greatest({p}, 1e-6), 1 - 1e-6)) else ln(1 - least(greatest({p}, 1e-6), 1 - 1e-6)) end)"


@query("a20_classification_metrics", "scored", f"""select league, count(*) as n, {q('avg(cast((model_prob >= 0.5) = (y = 1) as int))')} as accuracy,
  {q(f"avg({_LL.format(p='model_prob')})")} as log_loss, {q('avg((model_prob - y) * (model_prob - y))')} as brier,
  {q('greatest(avg(y), 1 - avg(y))')} as baseline_accuracy from scored group by league""")
def classification_metrics(t: Tables) -> DataFrame:
    return rounded(metrics.classification(scored(t), "model_prob", "y", ["league"]))


@query("a21_roc_auc", "scored", f"""
with r as (select league, y, rank() over (partition by league order by p) + (count(*) over (partition by league, p) - 1) / 2e0 as rk
  from (select *, round(model_prob, 2) as p from scored))
select league, {q('(sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2e0) / (count(*) filter (y = 1) * count(*) filter (y = 0))')} as auc
from r group by league""")
def roc_auc(t: Tables) -> DataFrame:
    # scores at two decimals, so that ties matter
    rows = scored(t).withColumn("p", F.round("model_prob", 2))
    return rounded(metrics.auc(rows, "p", "y", ["league"]))


@query("a22_regression_metrics", "scored", f"""
with e as (select league, margin, (model_prob - 0.5) * 60 as pred from scored)
select league, count(*) as n, {q('avg(abs(margin - pred))')} as mae, {q('sqrt(avg((margin - pred) * (margin - pred)))')} as rmse,
  {q('avg(cast((pred > 0) = (margin > 0) as int))')} as direction_accuracy from e group by league""")
def regression_metrics(t: Tables) -> DataFrame:
    rows = scored(t).withColumn("pred", (F.col("model_prob") - 0.5) * 60)
    return rounded(metrics.regression(rows, "pred", "margin", ["league"]))


_COMMON = "select * from picks where pick_model is not null and pick_market is not null and pick_tipster is not null"


@query("a23_pairwise_agreement", "picks", f"""with c as ({_COMMON})
select 'model_vs_market' as pair, {q('avg((pick_model = pick_market)::int)')} as agreement from c
union all select 'model_vs_tipster', {q('avg((pick_model = pick_tipster)::int)')} from c
union all select 'market_vs_tipster', {q('avg((pick_market = pick_tipster)::int)')} from c""")
def pairwise_agreement(t: Tables) -> DataFrame:
    names = ["model", "market", "tipster"]
    common = joins.common_sample(strategy_picks(t), [f"pick_{n}" for n in names])
    return rounded(metrics.pairwise_agreement(common, names))


@query("a23_discordance", "picks", f"""with c as (select year, (pick_model = y)::int as a, (pick_market = y)::int as b from ({_COMMON})),
d as (select year, count(*) filter (a = 1 and b = 1) as both_right, count(*) filter (a = 1 and b = 0) as first_only,
  count(*) filter (a = 0 and b = 1) as second_only, count(*) filter (a = 0 and b = 0) as both_wrong, avg(a) - avg(b) as gap from c group by year)
select year, both_right, first_only, second_only, both_wrong, {q('gap')} as accuracy_gap,
  {q('case when first_only + second_only > 0 then (first_only - second_only) / sqrt(first_only + second_only) else 0 end')} as mcnemar_z from d""")
def discordance(t: Tables) -> DataFrame:
    common = joins.common_sample(strategy_picks(t), ["pick_model", "pick_market", "pick_tipster"])
    return rounded(metrics.discordance(common, "model", "market", ["year"]))


# five pseudo-seeds: the forecast shifted a little per seed
define("seeded", "scored", """select s.*, seed, least(greatest(model_prob + ((game_id * 7 + seed * 13) % 11 - 5) / 100e0, 0.01), 0.99) as p
  from scored s, range(5) r(seed)""")


def seeded(t: Tables) -> DataFrame:
    rows = scored(t).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(4))))
    shift = ((F.col("game_id") * 7 + F.col("seed") * 13) % 11 - 5) / 100.0
    return rows.withColumn("p", F.least(F.greatest(F.col("model_prob") + shift, F.lit(0.01)), F.lit(0.99)))


@query("a24_seed_dispersion", "seeded", f"""with l as (select seed, avg({_LL.format(p='p')}) as ll from seeded group by 1)
select {q('avg(ll)')} as mean, {q('stddev_pop(ll)')} as std, {q('max(ll) - min(ll)')} as range, count(*) as n_seeds from l""")
def seed_dispersion(t: Tables) -> DataFrame:
    per_seed = metrics.classification(seeded(t), "p", "y", ["seed"])
    return rounded(metrics.seed_dispersion(per_seed, "log_loss"))


@query("a24_fold_dispersion", "seeded", f"""
with l as (select year, seed, avg({_LL.format(p='p')}) as ll from seeded group by 1, 2),
m as (select year, game_id, max(y) as y, avg(p) as p from seeded group by 1, 2),
e as (select year, count(*) as n, avg({_LL.format(p='p')}) as ll from m group by 1)
select l.year, {q('avg(l.ll)')} as seed_mean_log_loss, {q('stddev_pop(l.ll)')} as seed_std_log_loss, any_value(e.n) as n, {q('any_value(e.ll)')} as ensemble_log_loss
from l join e on e.year = l.year group by l.year""")
def fold_dispersion(t: Tables) -> DataFrame:
    return rounded(metrics.fold_dispersion(stage(seeded(t), "seeded"), "p", "y", "year", "seed", "game_id"))


_COVER = ["home_score", "home_odds_open", "model_prob", "rain_mm", "wind_kmh", "humidity"]


@query("a25_column_coverage", "market weathered", "with m as (select a.*, w.rain_mm, w.wind_kmh from market a join weathered w on w.game_id = a.game_id) " + " union all ".join(
    (f"select (select count(*) from m) as n, '{c}' as feature, 1e0 as null_rate, true as missing, 'column_missing' as reason" if c == "humidity" else
     f"select count(*), '{c}', {q(f'avg(({c} is null)::int)')}, false, case when avg(({c} is null)::int) > 0.3 then 'nan' end from m")
    if i else f"select count(*) as n, '{c}' as feature, {q(f'avg(({c} is null)::int)')} as null_rate, false as missing, case when avg(({c} is null)::int) > 0.3 then 'nan' end as reason from m"
    for i, c in enumerate(_COVER)))
def column_coverage(t: Tables) -> DataFrame:
    from tallyline.plans.columns import weather_table
    sky = joins.join_weather(t.games, weather_table(t), t.venue_dim).select("game_id", "rain_mm", "wind_kmh")
    return rounded(metrics.coverage(t.market.join(sky, "game_id"), _COVER, 0.3))


define("upcoming_pred", "market", """select game_id, league, home_team, away_team, round, least(greatest(1.15 * model_prob - 0.075, 0.02), 0.98) as home_win_prob,
    alt_prob as analytical_home_prob, home_line_close as home_line from market where home_score is null""")


def upcoming_predictions(t: Tables) -> DataFrame:
    return t.market.where("home_score is null").select(
        "game_id", "league", "home_team", "away_team", "round", s.clip_probability(1.15 * F.col("model_prob") - 0.075).alias("home_win_prob"),
        F.col("alt_prob").alias("analytical_home_prob"), F.col("home_line_close").alias("home_line"))


def _clamped(c: str) -> str:
    return f"avg((({c} <= 0.020001) or ({c} >= 0.979999))::int)"


_G = "league, round"
define("guard", "upcoming_pred", " union all ".join([
    f"select {_G}, 'constant_output:{c}' as \"check\", stddev_pop({c}) as value, case when count({c}) >= 2 and stddev_pop({c}) < 0.02 then 'fail' else 'pass' end as level from upcoming_pred group by {_G}"
    for c in ("home_win_prob", "analytical_home_prob")] + [
    f"select {_G}, 'clamp_saturation:{c}', {_clamped(c)}, case when {_clamped(c)} > 0.30 then 'warn' else 'pass' end from upcoming_pred group by {_G}"
    for c in ("home_win_prob", "analytical_home_prob")] + [
    f"select {_G}, 'line_coverage', avg((home_line is not null)::int), case when avg((home_line is not null)::int) < 0.8 then 'warn' else 'pass' end from upcoming_pred group by {_G}",
    f"select {_G}, 'model_disagreement', count(*) filter (abs(home_win_prob - analytical_home_prob) >= 0.30)::double, case when count(*) filter (abs(home_win_prob - analytical_home_prob) >= 0.30) >= 2 then 'warn' when count(*) filter (abs(home_win_prob - analytical_home_prob) >= 0.30) = 1 then 'info' else 'pass' end from upcoming_pred group by {_G}"]))


@query("a26_guardrails", "guard", f"select league, round, \"check\", {q('value')} as value, level from guard")
def guardrails(t: Tables) -> DataFrame:
    return rounded(metrics.guardrails(upcoming_predictions(t), keys=["league", "round"]))


@query("a26_overall_level", "guard", """select league, round, case when count(*) filter (level = 'fail') > 0 then 'fail'
  when count(*) filter (level = 'warn') > 0 then 'warn' else 'pass' end as level from guard group by 1, 2""")
def overall_level(t: Tables) -> DataFrame:
    checks = metrics.guardrails(upcoming_predictions(t), keys=["league", "round"])
    return metrics.overall_level(checks, ["league", "round"])


@query("a28_delta_verdict", "scored", f"""
with r as (select 'year ' || year as config, avg({_LL.format(p='model_prob')}) as log_loss from scored group by 1),
d as (select *, log_loss - (select log_loss from r where config = 'year 1997') as delta from r)
select config, {q('log_loss')} as log_loss, {q('delta')} as delta, case when abs(delta) < 0.00174 then 'NOISE' when delta < 0 then 'BETTER' else 'WORSE' end as verdict,
  case when delta < -0.00174 then 'BETTER' when delta < 0.00174 then 'TIE' when delta < 3 * 0.00174e0 then 'SLIGHTLY WORSE' else 'WORSE' end as band from d""")
def delta_verdict(t: Tables) -> DataFrame:
    report = metrics.classification(scored(t), "model_prob", "y", ["year"]).select(
        F.concat(F.lit("year "), F.col("year").cast("string")).alias("config"), "log_loss")
    out = metrics.delta_verdict(report, "config", "log_loss", "year 1997", 0.00174)
    return rounded(out.withColumn("band", metrics.tie_bands(out, "delta", 0.00174)))


@query("a29_tip_accuracy", "market", """
with w as (select league, year, round, case when home_score > away_score then home_team when away_score > home_score then away_team end as winner,
    case when home_odds_open is null then null when abs(model_prob - 0.5) <= 0.02 then '' when model_prob > 0.5 then home_team else away_team end as pick
  from market where home_score is not null)
select league, year, round, count(*) as total, count(*) filter (pick is not null and pick <> '') as scored,
  count(*) filter (pick <> '' and pick = winner) as correct from w group by 1, 2, 3""")
def tip_accuracy(t: Tables) -> DataFrame:
    h, a, p = F.col("home_score"), F.col("away_score"), F.col("model_prob")
    pick = F.when(F.abs(p - 0.5) <= 0.02, "").when(p > 0.5, F.col("home_team")).otherwise(F.col("away_team"))
    rows = t.market.where("home_score is not null").select(
        "league", "year", "round", F.when(h > a, F.col("home_team")).when(a > h, F.col("away_team")).alias("winner"),
        F.when(F.col("home_odds_open").isNotNull(), pick).alias("predicted_winner"))
    return metrics.tip_accuracy(rows, ["league", "year", "round"])
