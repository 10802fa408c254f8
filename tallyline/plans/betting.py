"""Market, staking and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import scalars as s
from tallyline.operators import markets
from tallyline.operators.resample import draws_sql
from tallyline.plans.columns import candidates
from tallyline.plans.ctes import define, r6 as q
from tallyline.plans.feeds import quotes
from tallyline.plans.lookups import settled_bets
from tallyline.plans.registry import Tables, query, rounded
from tallyline.staging import stage


@query("a1_crowd_aggregate", "tips contests", f"""select t.game_id, {q('avg(hconfidence)')} as mean_hconfidence, {q('avg(abs(hconfidence - 50) + 50)')} as mean_confidence,
  {q('avg((hconfidence - 50) / 2)')} as mean_hmargin, {q('avg(abs(hconfidence - 50) / 2)')} as mean_margin, count(*) as n_models,
  cast(sum(case when (hconfidence > 50) = (home_score > away_score) then 1 end) as bigint) as n_correct
from tips t join contests c on c.game_id = t.game_id group by t.game_id""")
def crowd_aggregate(t: Tables) -> DataFrame:
    from tallyline.operators.metrics import crowd
    h = F.col("hconfidence")
    right = F.when((h > 50) == (F.col("home_score") > F.col("away_score")), 1)
    tips = t.tips.join(t.games.select("game_id", "home_score", "away_score"), "game_id").select(
        "game_id", "source", "hconfidence", (F.abs(h - 50) + 50).alias("confidence"), ((h - 50) / 2).alias("hmargin"),
        (F.abs(h - 50) / 2).alias("margin"), right.alias("correct"))
    return rounded(crowd(tips))


@query("a2_team_totals", "player_stats", "select mid, team, " + ", ".join(
    f"{q(f'coalesce(sum({c}), 0)')} as {c}" for c in ("d", "g", "ho", "i50", "cl", "r50")) + " from player_stats group by 1, 2")
def team_totals(t: Tables) -> DataFrame:
    from tallyline.operators.rosters import team_totals as totals
    return rounded(totals(t.player_stats, ["d", "g", "ho", "i50", "cl", "r50"]))


def _quote_median(market: str, side: str, value: str) -> str:
    return f"median({value}) filter (market = '{market}' and side = '{side}')"


@query("a3_quote_consensus", "quotes", f"""select match_id, {q("max(price) filter (market = 'h2h' and side = 'home')")} as home_odds_best,
  {q("max(price) filter (market = 'h2h' and side = 'away')")} as away_odds_best,
  count(*) filter (market = 'h2h' and side = 'home') as n_home_quotes, count(*) filter (market = 'h2h' and side = 'away') as n_away_quotes,
  count(*) filter (market = 'spreads' and side = 'home') as n_line_bookmakers,
  {q(_quote_median('h2h', 'home', 'price'))} as home_odds, {q(_quote_median('h2h', 'away', 'price'))} as away_odds,
  {q(_quote_median('spreads', 'home', 'point'))} as home_line, {q(_quote_median('spreads', 'away', 'point'))} as away_line,
  {q(_quote_median('spreads', 'home', 'price'))} as home_line_odds, {q(_quote_median('spreads', 'away', 'price'))} as away_line_odds
from quotes group by match_id""")
def quote_consensus(t: Tables) -> DataFrame:
    return rounded(markets.quote_consensus(stage(quotes(t), "quotes"), ["match_id"]))


@query("a3_best_quotes", "quotes", f"""select match_id, {q("max(price) filter (market = 'h2h' and side = 'home')")} as home_odds,
  {q("max(price) filter (market = 'h2h' and side = 'away')")} as away_odds from quotes group by match_id""")
def best_quotes(t: Tables) -> DataFrame:
    return rounded(markets.best_quotes(quotes(t), ["match_id"]))


MOVEMENT_SQL = f"""
with e as (select match_id, arg_min(home_odds, (fetched_at, event_id)) as ho, arg_min(away_odds, (fetched_at, event_id)) as ao,
    arg_max(home_odds, (fetched_at, event_id)) as hc, arg_max(away_odds, (fetched_at, event_id)) as ac, count(*) as n,
    min(fetched_at) as f, max(fetched_at) as l from snapshots group by 1),
i as (select *, (1/ho)/(1/ho+1/ao) as io, (1/hc)/(1/hc+1/ac) as ic from e)
select match_id, {q('ho')} as home_odds_open, {q('ao')} as away_odds_open, {q('hc')} as home_odds_current, {q('ac')} as away_odds_current,
  {q('io')} as implied_home_open, {q('ic')} as implied_home_current, {q('ic - io')} as implied_move, {q('abs(ic - io)')} as move_magnitude,
  n as n_snapshots, strftime(f, '%Y-%m-%d %H:%M:%S') as first_seen, strftime(l, '%Y-%m-%d %H:%M:%S') as last_seen from i"""


def movement_text(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"))
                   .withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss")))


@query("a7_price_movement", "snapshots", MOVEMENT_SQL)
def price_movement(t: Tables) -> DataFrame:
    return movement_text(markets.price_movement(t.snapshots, ["match_id"], "fetched_at", "event_id"))


_SUMMARY = f"""count(*) as total, count(*) filter (status = 'pending') as pending, count(*) filter (status in ('won', 'lost')) as settled,
  count(*) filter (status = 'won') as won, count(*) filter (status = 'lost') as lost,
  {q("coalesce(sum(bet_amount) filter (status in ('won', 'lost')), 0)")} as total_staked,
  {q("coalesce(sum(profit_loss) filter (status in ('won', 'lost')), 0)")} as total_pl,
  {q("coalesce(sum(bet_amount) filter (status = 'pending'), 0)")} as pending_exposure,
  {q("coalesce(sum(profit_loss) filter (status in ('won', 'lost')) / nullif(sum(bet_amount) filter (status in ('won', 'lost')), 0), 0)")} as roi,
  {q("coalesce(count(*) filter (status = 'won') / nullif(count(*) filter (status in ('won', 'lost')), 0)::double, 0)")} as win_rate"""


@query("a8_betting_summary", "settled", f"select {_SUMMARY} from settled")
def betting_summary(t: Tables) -> DataFrame:
    return rounded(markets.betting_summary(settled_bets(t)))


@query("a9_round_breakdown", "settled", f"select round, {_SUMMARY} from settled where status in ('won', 'lost') group by round")
def round_breakdown(t: Tables) -> DataFrame:
    return rounded(markets.betting_summary(settled_bets(t).where(F.col("status").isin("won", "lost")), ["round"]))


# flat-stake results of every completed candidate bet
define("flat", "bets", """select *, case when bet_side = 'home' then home_score > away_score else home_score <= away_score end as won,
    least(greatest(0, 0.25 * (bet_prob * (odds - 1) - (1 - bet_prob)) / (odds - 1)), 0.1) as bet_fraction,
    100e0 as bet_amount, case when (bet_side = 'home') = (home_score > away_score) then 100e0 * (odds - 1) else -100e0 end as profit,
    case when odds < 2 then 'favorite' else 'underdog' end as role,
    case when m is null then 'UNKNOWN' when m > 0.005 then 'AGREE' when m < -0.005 then 'DISAGREE' else 'NEUTRAL' end as move_class
  from (select *, case when bet_side = 'home' then round(odds_move, 12) else -round(odds_move, 12) end as m from bets) where home_score is not null""")


def flat_bets(t: Tables) -> DataFrame:
    bets = markets.with_outcome(candidates(t).where("home_score is not null"))
    move = F.round("odds_move", 12)
    own = F.when(F.col("bet_side") == "home", move).otherwise(-move)
    return bets.select("*", F.lit(100.0).alias("bet_amount"),
                       F.when(F.col("won"), 100.0 * (F.col("odds") - 1)).otherwise(-100.0).alias("profit"),
                       s.price_role(F.col("odds")).alias("role"), s.move_class(own).alias("move_class"))


_STATS = f"""count(*) as n_bets, {q('coalesce(sum(profit), 0)')} as profit, {q('coalesce(sum(bet_amount), 0)')} as total_wagered,
  {q('coalesce(avg(won::int), 0)')} as win_rate, {q('coalesce(avg(edge), 0)')} as avg_edge, {q('coalesce(avg(odds), 0)')} as avg_odds,
  {q('coalesce(sum(profit) / nullif(sum(bet_amount), 0) * 100, 0)')} as roi"""


@query("a10_bet_summary", "flat", f"select {_STATS} from flat")
def bet_summary(t: Tables) -> DataFrame:
    return rounded(markets.bet_stats(flat_bets(t)))


@query("a11_breakdown", "flat", " union all ".join(
    f"select '{d}' as dimension, cast({d} as varchar) as value, {_STATS} from flat group by {d}" for d in ("bet_side", "role", "year")))
def breakdown(t: Tables) -> DataFrame:
    """Several dimensions at once: each bet counts in one value of each."""
    keys = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
                               for d in ("bet_side", "role", "year")]))
    rows = flat_bets(t).select("profit", "bet_amount", "won", "edge", "odds", keys.alias("k")).select("*", "k.*")
    return rounded(markets.bet_stats(rows, ["dimension", "value"]))


_ODDS = ", ".join(f"({lo}e0, {hi}e0, '{markets.band_label(lo, hi)}')" for lo, hi in markets.ODDS_BANDS)


@query("a11_odds_buckets", "flat", f"select label as odds_band, {_STATS} from flat join (values {_ODDS}) b(lo, hi, label) on odds >= lo and odds < hi group by label")
def odds_buckets(t: Tables) -> DataFrame:
    return rounded(markets.bet_stats(markets.explode_bands(flat_bets(t), "odds", markets.ODDS_BANDS, "odds_band"), ["odds_band"]))


_CLASSES = ", ".join(f"('{name}', '{m}')" for name, members in markets.CLASS_GROUPS.items() for m in members)
_CROSS = ", ".join(["(-1e9, 1e9, 'ALL')"] + [f"({lo}e0, {hi}e0, '{markets.band_label(lo, hi)}')" for lo, hi in markets.EDGE_BANDS[:5]])


@query("a12_class_band_table", "flat", f"""select g.name as class_group, b.label as band, {_STATS} from flat f
  join (values {_CLASSES}) g(name, cls) on g.cls = f.move_class join (values {_CROSS}) b(lo, hi, label) on edge >= lo and edge < hi group by 1, 2""")
def class_band_table(t: Tables) -> DataFrame:
    return rounded(markets.class_band_table(flat_bets(t), markets.EDGE_BANDS[:5]))


@query("a13_yearly_roi", "flat", """with y as (select league, year, sum(profit) / sum(bet_amount) * 100 as roi from flat group by 1, 2)
select league, count(*) filter (roi > 0) as profitable_years, count(*) as total_years from y group by 1""")
def yearly_roi(t: Tables) -> DataFrame:
    return markets.yearly_roi(flat_bets(t), ["league"])


@query("a13_roi_by_year", "flat", f"""select league, year, count(*) as n_bets, {q('sum(bet_amount)')} as staked, {q('sum(profit)')} as profit,
  {q('sum(profit) / sum(bet_amount) * 100')} as roi from flat group by 1, 2""")
def roi_by_year(t: Tables) -> DataFrame:
    return rounded(markets.roi_by_year(flat_bets(t), ["league"]))


# the ledger as a recursion over bet numbers
define("numbered_bets", "filtered", """select f.*, least(greatest(0, 0.25 * (bet_prob * (odds - 1) - (1 - bet_prob)) / (odds - 1)), 0.1) as frac,
    case when bet_side = 'home' then home_score > away_score else home_score <= away_score end as won,
    row_number() over (partition by filter, league, year order by date, game_id) as rn from filtered f where home_score is not null""")
_LEDGER = """with recursive walk as (
  select filter, league, year, cast(0 as bigint) as rn, cast(null as bigint) as game_id, cast(0 as double) as amount, 0e0 as profit, 1000e0 as bank
    from (select distinct filter, league, year from numbered_bets)
  union all
  select w.filter, w.league, w.year, b.rn, b.game_id, w.bank * frac, case when w.bank * frac < 1 then 0e0 when won then w.bank * frac * (odds - 1) else -w.bank * frac end,
    w.bank + case when w.bank * frac < 1 then 0e0 when won then w.bank * frac * (odds - 1) else -w.bank * frac end
  from walk w join numbered_bets b on b.filter = w.filter and b.league = w.league and b.year = w.year and b.rn = w.rn + 1),
ledger as (select w.filter, w.league, w.year, w.game_id, amount as bet_amount, profit, bank as bankroll, b.won, b.edge, b.odds, b.date
  from walk w join numbered_bets b on b.filter = w.filter and b.league = w.league and b.year = w.year and b.rn = w.rn where amount >= 1)"""
LEDGER_KEYS = ["filter", "league", "year"]


def filtered_bets(t: Tables) -> DataFrame:
    return markets.with_outcome(markets.explode_filters(candidates(t)).where("home_score is not null"))


def ledger_rows(t: Tables) -> DataFrame:
    """All filters, leagues and seasons in one pass."""
    return markets.ledger(filtered_bets(t), LEDGER_KEYS, carry=["date", "odds", "won", "edge"])


@query("w21_staking_ledger", "numbered_bets", f"""{_LEDGER} select filter, league, year, game_id, {q('log10(bet_amount)')} as log_amount,
  {q('profit / bet_amount')} as bet_return, {q('log10(bankroll)')} as log_bankroll from ledger""")
def staking_ledger(t: Tables) -> DataFrame:
    """Amounts compound to many digits, so they are compared by their logarithm."""
    return rounded(markets.ledger(filtered_bets(t), LEDGER_KEYS).select(
        *LEDGER_KEYS, "game_id", F.log10("bet_amount").alias("log_amount"),
        (F.col("profit") / F.col("bet_amount")).alias("bet_return"), F.log10("bankroll").alias("log_bankroll")))


@query("w21_compound_ledger", "flat", f"""
select game_id, league, {q('3 + sum(log10(1 + bet_fraction * case when won then odds - 1 else -1 end)) over (partition by league, year order by date, game_id)')} as log_bankroll from flat""")
def compound_ledger(t: Tables) -> DataFrame:
    bets = stage(flat_bets(t).select("league", "year", "date", "game_id", "bet_fraction", "odds", "won"), "bets")
    return rounded(markets.ledger_compound(bets, ["league", "year"]).select(
        "game_id", "league", F.log10("bankroll").alias("log_bankroll")))


@query("w22_cumulative_profit", "settled", f"""select game_id, row_number() over (order by date, game_id) as idx,
  round(sum(profit_loss) over (order by date, game_id) + 1.2345e-9, 2) + 0e0 as cumulative from settled where status in ('won', 'lost')""")
def cumulative_profit(t: Tables) -> DataFrame:
    bets = stage(settled_bets(t).select("date", "game_id", "status", "profit_loss"), "settled")
    return rounded(markets.cumulative_profit(bets, ["date", "game_id"]).select("game_id", "idx", "cumulative"), 2)


def _draws(key: str, table: str) -> str:
    """CTEs up to ``t``: every bet in every replicate with its draw ``n``."""
    steps, times = draws_sql("game_id", "rep")
    ctes = [f"d as (select {key}, rep, profit, bet_amount, game_id from {table}, range(2000) r(rep))"]
    for i, (name, value) in enumerate(steps):
        ctes.append(f"d{i} as (select *, {value} as {name} from d{i - 1 if i else ''})")
    return ", ".join([*ctes, f"t as (select *, {times} as n from d{len(steps) - 1})"])


@query("a17_bootstrap_roi", "flat", f"""
with {_draws("league", "flat")},
r as (select league, rep, sum(profit * n) / sum(bet_amount * n) * 100 as roi from t where n > 0 group by 1, 2)
select league, {q('quantile_cont(roi, 0.025)')} as roi_ci_low, {q('quantile_cont(roi, 0.975)')} as roi_ci_high from r group by 1""")
def bootstrap_roi(t: Tables) -> DataFrame:
    return rounded(markets.bootstrap_roi(flat_bets(t).select("league", "game_id", "profit", "bet_amount"), ["league"]))


@query("a18_max_drawdown", "numbered_bets", f"""{_LEDGER},
p as (select *, greatest(1000, max(bankroll) over (partition by filter, league, year order by date, game_id)) as peak from ledger)
select filter, league, year, {q('max((peak - bankroll) / peak)')} as max_drawdown from p group by 1, 2, 3""")
def max_drawdown(t: Tables) -> DataFrame:
    return rounded(markets.max_drawdown(stage(ledger_rows(t), "ledger"), LEDGER_KEYS, ["date", "game_id"]))


@query("a19_holdout", "flat", """select league, game_id from (select *, row_number() over (partition by league order by date, game_id) - 1 as pos,
  count(*) over (partition by league) as n from flat) where pos >= floor(n * 0.70e0)""")
def holdout(t: Tables) -> DataFrame:
    bets = stage(flat_bets(t).select("league", "date", "game_id"), "bets")
    return markets.holdout(bets, ["league"], ["date", "game_id"]).select("league", "game_id")


@query("a27_strategy_scorecard", "numbered_bets", f"""{_LEDGER},
st as (select filter, {_STATS}, sum(won::int) as wins from ledger group by 1),
wi as (select filter, n_bets as n, wins / n_bets::double as p from st),
yr as (select filter, count(*) filter (roi > 0) as profitable_years, count(*) as total_years from (
  select filter, year, sum(profit) / sum(bet_amount) * 100 as roi from ledger group by 1, 2) group by 1),
ho as (select filter, count(*) as holdout_n, sum(profit) / sum(bet_amount) * 100 as hroi from (
  select *, row_number() over (partition by filter order by date, game_id) - 1 as pos, count(*) over (partition by filter) as n from ledger)
  where pos >= floor(n * 0.70e0) group by 1),
dd as (select filter, max((peak - bankroll) / peak) as dd from (select *, greatest(1000, max(bankroll) over (
  partition by filter, league, year order by date, game_id)) as peak from ledger) group by 1),
{_draws("filter", "ledger")},
r as (select filter, rep, sum(profit * n) / sum(bet_amount * n) * 100 as roi from t where n > 0 group by 1, 2),
ci as (select filter, quantile_cont(roi, 0.025) as lo, quantile_cont(roi, 0.975) as hi from r group by 1),
fl as (select st.filter, case when n_bets >= 100 then 'N' else '' end || case when roi >= 5 then 'R' else '' end ||
  case when profitable_years >= 5 then 'Y' else '' end || case when lo > 0 then 'C' else '' end || case when hroi > 0 then 'H' else '' end as flags
  from st join yr using (filter) join ci using (filter) join ho using (filter))
select st.* exclude (wins, profit, total_wagered), {q('(p + 3.8416/(2*n) - 1.96 * sqrt(p*(1-p)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n)')} as wilson_low,
  {q('(p + 3.8416/(2*n) + 1.96 * sqrt(p*(1-p)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n)')} as wilson_high,
  {q('lo')} as roi_ci_low, {q('hi')} as roi_ci_high, profitable_years, total_years, holdout_n, {q('hroi')} as holdout_roi, {q('dd')} as max_drawdown,
  flags, case when len(flags) = 5 then 'PASS' else len(flags) || '/5' end as verdict, len(flags) = 5 as passes
from st join wi using (filter) join yr using (filter) join ho using (filter) join dd using (filter) join ci using (filter) join fl using (filter)""")
def strategy_scorecard(t: Tables) -> DataFrame:
    return rounded(markets.strategy_report(ledger_rows(t)).drop("profit", "total_wagered"))
