"""Join, set and ordering queries (J, Q, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import scalars as s
from tallyline.operators import joins, markets, ratings, rosters
from tallyline.operators.metrics import crowd
from tallyline.plans.columns import candidates, price_ranges, weather_table
from tallyline.plans.ctes import define, r6 as q
from tallyline.plans.form import ELO
from tallyline.plans.registry import Tables, query, rounded
from tallyline.sources import ingest
from tallyline.sources.tables import KeyedTable
from tallyline.staging import new_path


@query("j1_left_join_by_id", "contests tips", f"""select c.game_id, {q('h')} as mean_hconfidence from contests c left join (
  select game_id, avg(hconfidence) as h from tips where game_id % 5 <> 0 group by 1) t on t.game_id = c.game_id""")
def left_join_by_id(t: Tables) -> DataFrame:
    crowd = t.tips.where("game_id % 5 <> 0").groupBy("game_id").agg(F.avg("hconfidence").alias("mean_hconfidence"))
    return rounded(t.games.select("game_id").join(crowd, "game_id", "left"))


@query("j2_left_join_distinct", "contests", """select c.game_id, a.attendance from contests c left join (
  select distinct year, round, home_team, away_team, 1000 + (year * 31 + round * 7) % 997 as attendance from contests where game_id % 3 = 0) a
  on a.year = c.year and a.round = c.round and a.home_team = c.home_team and a.away_team = c.away_team""")
def left_join_distinct(t: Tables) -> DataFrame:
    crowd_size = t.games.where("game_id % 3 = 0").select(
        "year", "round", "home_team", "away_team", (1000 + (F.col("year") * 31 + F.col("round") * 7) % 997).alias("attendance"))
    return joins.join_distinct(t.games, crowd_size, ["year", "round", "home_team", "away_team"]).select("game_id", "attendance")


@query("j3_join_on_day", "contests prices", f"""select c.game_id, {q('p.home_odds_close')} as home_odds_close from contests c left join (
  select date + interval 5 hour as date, home_team, away_team, home_odds_close from contests join prices using (game_id)) p
  on cast(p.date as date) = cast(c.date as date) and p.home_team = c.home_team and p.away_team = c.away_team""")
def join_on_day(t: Tables) -> DataFrame:
    priced = t.games.join(t.prices, "game_id").select(
        (F.col("date") + F.expr("interval 5 hours")).alias("date"), "home_team", "away_team", "home_odds_close")
    return rounded(joins.join_on_day(t.games, priced).select("game_id", "home_odds_close"))


define("team_mids", "player_stats contests", """select p.mid, p.team, c.year, sum(g) as g, sum(ho) as ho from player_stats p
  join contests c on c.game_id = p.mid where p.mid % 4 <> 0 and not (c.year % 3 = 0 and p.mid % 2 = 0) group by 1, 2, 3""")
define("mids", "team_mids", """select mid, year, min(team) || '|' || max(team) as pair from team_mids group by mid, year having count(*) = 2""")
define("pair_first", "mids", "select pair, arg_min(year, mid) as first_year from mids group by pair")
define("paired", "contests mids pair_first", """select g.game_id, m.mid from (
    select game_id, c.pair, source_year, row_number() over (partition by c.pair, source_year order by date, game_id) as n
    from (select x.*, case when exists (select 1 from mids m where m.pair = x.pair and m.year = x.year) then x.year else f.first_year end
        as source_year from (select *, least(home_team, away_team) || '|' || greatest(home_team, away_team) as pair from contests) x
      join pair_first f on f.pair = x.pair) c) g
  join (select *, row_number() over (partition by pair, year order by mid) as n from mids) m
  on m.pair = g.pair and m.year = g.source_year and m.n = g.n""")


@query("j4_ordinal_pairing", "paired contests team_mids", f"""select c.game_id, p.mid, {q('h.g')} as home_g, {q('a.g')} as away_g, {q('h.ho')} as home_ho,
  {q('a.ho')} as away_ho, coalesce(cast(cast(h.g as bigint) <> c.home_score // 6 as int), 0) as goal_mismatch
from contests c left join paired p on p.game_id = c.game_id
left join team_mids h on h.mid = p.mid and h.team = c.home_team left join team_mids a on a.mid = p.mid and a.team = c.away_team""")
def ordinal_pairing(t: Tables) -> DataFrame:
    years = t.games.select(F.col("game_id").alias("mid"), "year")
    stats = rosters.team_totals(t.player_stats, ["g", "ho"]).join(years, "mid").where(
        "mid % 4 <> 0 and not (year % 3 = 0 and mid % 2 = 0)")
    games = t.games.withColumn("home_goals", F.floor(F.col("home_score") / 6))
    return rounded(joins.pair_ids(games, stats, ["g", "ho"], goals="g").select(
        "game_id", "mid", "home_g", "away_g", "home_ho", "away_ho", "goal_mismatch"))


define("ladder_then", "contests standings", """with s as (select league, year, round from standings group by 1, 2, 3),
  t as (select game_id, c.league, home_team, away_team, c.year,
      case when c.round > 1 then (select max(round) from s where s.league = c.league and s.year = c.year and s.round <= c.round - 1) end as r,
      (select max(round) from s where s.league = c.league and s.year = c.year - 1) as last from contests c)
  select t.game_id, h.rank as hr, a.rank as ar, h.percentage as hp, a.percentage as ap from t
  left join standings h on h.league = t.league and h.year = case when r is null then t.year - 1 else t.year end
    and h.round = coalesce(r, last) and h.team = t.home_team
  left join standings a on a.league = t.league and a.year = case when r is null then t.year - 1 else t.year end
    and a.round = coalesce(r, last) and a.team = t.away_team""")


@query("j5_standings_as_of", "ladder_then", f"""select game_id, hr as home_ladder_rank, ar as away_ladder_rank, {q('hp')} as home_percentage,
  {q('ap')} as away_percentage from ladder_then""")
def standings_as_of(t: Tables) -> DataFrame:
    return rounded(joins.standings_as_of(t.games, t.standings).select(
        "game_id", "home_ladder_rank", "away_ladder_rank", "home_percentage", "away_percentage"))


@query("j6_ladder_features", "ladder_then", f"""select game_id, ar - hr as ladder_rank_diff, {q('hp - ap')} as percentage_diff,
  cast(hr <= 4 as bigint) as home_top4, cast(ar <= 4 as bigint) as away_top4, cast(hr <= 8 as bigint) as home_top8,
  cast(ar <= 8 as bigint) as away_top8 from ladder_then""")
def ladder_features(t: Tables) -> DataFrame:
    return rounded(joins.ladder_features(joins.standings_as_of(t.games, t.standings)).select(
        "game_id", "ladder_rank_diff", "percentage_diff", "home_top4", "away_top4", "home_top8", "away_top8"))


@query("p29_market_crowd_features", "rated_games price_ranges weathered tips", f"""{ELO},
tp as (select game_id, avg(hconfidence) as mh, avg(greatest(hconfidence, 100 - hconfidence)) as mc, avg((hconfidence - 50) / 2) as mm from tips group by 1)
select c.game_id, {q('home_odds_max - home_odds_min')} as home_odds_range, {q('away_odds_max - away_odds_min')} as away_odds_range,
  {q('(home_odds_max - home_odds_min) - (away_odds_max - away_odds_min)')} as odds_range_diff,
  {q('mh / 100')} as tipster_prob, {q('100 - mc')} as tipster_disagreement,
  {q('mh / 100 - 1e0 / (1e0 + power(10e0, (away_elo - home_elo - 30e0) / 400e0))')} as tipster_vs_elo, {q('mm')} as tipster_margin,
  {q('rain_mm * (1 - is_roofed)')} as rain_x_open
from contests c join tp on tp.game_id = c.game_id join weathered w on w.game_id = c.game_id join elo e on e.game_id = c.game_id
  left join price_ranges r on r.game_id = c.game_id""")
def market_crowd_features(t: Tables) -> DataFrame:
    """The spread of prices over bookmakers, the crowd against the rating, rain where there is no roof."""
    sky = joins.join_weather(t.games, weather_table(t), t.venue_dim).select("game_id", "rain_mm", "is_roofed")
    h = F.col("hconfidence")
    tips = t.tips.withColumns({"confidence": F.greatest(h, 100 - h), "hmargin": (h - 50) / 2})  # confidence in the tipped side
    rows = (t.games.select("game_id").join(price_ranges(t), "game_id", "left").join(crowd(tips), "game_id").join(sky, "game_id")
            .join(ratings.elo(t.games).select("game_id", "elo_expected"), "game_id"))
    spread = lambda side: F.col(f"{side}_odds_max") - F.col(f"{side}_odds_min")
    tip = F.col("mean_hconfidence")
    return rounded(rows.select(
        "game_id", spread("home").alias("home_odds_range"), spread("away").alias("away_odds_range"),
        (spread("home") - spread("away")).alias("odds_range_diff"), (tip / 100).alias("tipster_prob"),
        (100 - F.col("mean_confidence")).alias("tipster_disagreement"), (tip / 100 - F.col("elo_expected")).alias("tipster_vs_elo"),
        F.col("mean_hmargin").alias("tipster_margin"), (F.col("rain_mm") * (1 - F.col("is_roofed"))).alias("rain_x_open")))


@query("j7_weather_join", "weathered", f"""select game_id, {q('temp_c')} as temp_c, {q('rain_mm')} as rain_mm, {q('wind_kmh')} as wind_kmh,
  {q('wind_gust_kmh')} as wind_gust_kmh, {q('humidity')} as humidity, is_roofed, is_wet, wind_strong from weathered""")
def weather_join(t: Tables) -> DataFrame:
    return rounded(joins.join_weather(t.games, weather_table(t), t.venue_dim).select(
        "game_id", "temp_c", "rain_mm", "wind_kmh", "wind_gust_kmh", "humidity", "is_roofed", "is_wet", "wind_strong"))


@query("j8_dimension_lookup", "contests team_dim venue_dim", """select c.game_id, h.state as home_state, a.state as away_state, v.state as venue_state
from contests c left join team_dim h on h.team = c.home_team left join team_dim a on a.team = c.away_team
left join venue_dim v on v.venue = c.venue""")
def dimension_lookup(t: Tables) -> DataFrame:
    def state(side: str) -> DataFrame:
        return t.team_dim.select(F.col("team").alias(f"{side}_team"), F.col("state").alias(f"{side}_state"))
    venue = t.venue_dim.select("venue", F.col("state").alias("venue_state"))
    return (t.games.join(state("home"), "home_team", "left").join(state("away"), "away_team", "left")
            .join(venue, "venue", "left").select("game_id", "home_state", "away_state", "venue_state"))


# rosters by id for even games, dated selections for rounds 1-6, undated ones for some pairs
define("roster", "player_stats", "select mid, team, array_to_string(list_sort(list(player)), ',') as roster from player_stats group by 1, 2")
define("by_id", "roster contests", """select c.game_id, h.roster as hr, a.roster as ar from contests c
  join roster h on h.mid = c.game_id and h.team = c.home_team left join roster a on a.mid = c.game_id and a.team = c.away_team
  where c.game_id % 2 = 0""")
define("sel", "roster contests", """select c.year, c.round, home_team, away_team, max(h.roster || '+') as hr, max(a.roster || '+') as ar
  from contests c join roster h on h.mid = c.game_id and h.team = c.home_team
  join roster a on a.mid = c.game_id and a.team = c.away_team where c.round <= 6 group by 1, 2, 3, 4""")
define("sel_any", "roster contests", """select home_team, away_team, max(h.roster || '*') as hr, max(a.roster || '*') as ar
  from contests c join roster h on h.mid = c.game_id and h.team = c.home_team
  join roster a on a.mid = c.game_id and a.team = c.away_team where c.round = 12 group by 1, 2""")


def _side_rosters(t: Tables) -> DataFrame:
    sets = rosters.roster_sets(t.player_stats)
    home = sets.select(F.col("mid").alias("game_id"), F.col("team").alias("home_team"), F.col("roster").alias("home_roster"))
    away = sets.select(F.col("mid").alias("game_id"), F.col("team").alias("away_team"), F.col("roster").alias("away_roster"))
    return (t.games.select("game_id", "year", "round", "home_team", "away_team")
            .join(home, ["game_id", "home_team"]).join(away, ["game_id", "away_team"], "left"))


def _text(roster: str):
    return F.array_join(roster, ",")


@query("j9_roster_fallback", "contests by_id sel sel_any", """
select c.game_id, case when i.hr is not null and i.ar is not null then i.hr when s.hr is not null then s.hr else y.hr end as home_roster,
  case when i.hr is not null and i.ar is not null then i.ar when s.hr is not null then s.ar else y.ar end as away_roster
from contests c left join by_id i on i.game_id = c.game_id
left join sel s on s.year = c.year and s.round = c.round and s.home_team = c.home_team and s.away_team = c.away_team
left join sel_any y on y.home_team = c.home_team and y.away_team = c.away_team""")
def roster_fallback(t: Tables) -> DataFrame:
    pairs = _side_rosters(t)
    by_id = pairs.where("game_id % 2 = 0").select("game_id", "home_roster", "away_roster")
    whole = pairs.where("away_roster is not null")

    def marked(df: DataFrame, keys: list, mark: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.array(F.max(F.concat(_text(f"{x}_roster"), F.lit(mark)))).alias(f"{x}_roster")
                                       for x in ("home", "away")])

    dated = marked(whole.where("round <= 6"), ["year", "round", "home_team", "away_team"], "+")
    undated = marked(whole.where("round = 12"), ["home_team", "away_team"], "*")
    selections = dated.unionByName(undated, allowMissingColumns=True)
    return joins.roster_of_game(t.games, by_id, selections).select(
        "game_id", _text("home_roster").alias("home_roster"), _text("away_roster").alias("away_roster"))


define("full_names", "player_stats", """select distinct team, mid, 'F' || (cast(substr(player, 2) as int) % 20) as player,
  'Full ' || player as full_name from player_stats where cast(substr(player, 2) as int) % 5 <> 0""")


@query("j10_alias_resolution", "player_stats full_names", """
select p.mid, p.team, p.player as listed, coalesce(l.full_name, 'F' || (cast(substr(p.player, 2) as int) % 20)) as player
from player_stats p left join (select team, player, arg_max(full_name, (mid, full_name)) as full_name from full_names group by 1, 2) l
  on l.team = p.team and l.player = 'F' || (cast(substr(p.player, 2) as int) % 20)""")
def alias_resolution(t: Tables) -> DataFrame:
    number = F.substring("player", 2, 10).cast("int")
    short = F.concat(F.lit("F"), (number % 20).cast("string"))
    names = t.player_stats.where(number % 5 != 0).select(
        "team", "mid", short.alias("player"), F.concat(F.lit("Full "), "player").alias("full_name"))
    listed = t.player_stats.select("mid", "team", F.col("player").alias("listed"), short.alias("player"))
    return joins.resolve_alias(listed, ["team", "player"], names, "player", "mid")


@query("j11_anti_join", "contests", "select game_id, league from contests c where not exists (select 1 from contests k where k.game_id = c.game_id and k.game_id % 3 = 0)")
def anti_join(t: Tables) -> DataFrame:
    known = t.games.where("game_id % 3 = 0").select("game_id")
    return t.games.select("game_id", "league").join(known, "game_id", "left_anti")


@query("j12_semi_join", "contests prices", "select game_id, year from contests where game_id in (select game_id from prices where home_odds_open > 2)")
def semi_join(t: Tables) -> DataFrame:
    return t.games.select("game_id", "year").join(t.prices.where("home_odds_open > 2").select("game_id"), "game_id", "left_semi")


# a bet per candidate; settled ones of the past years keep their status
define("bet_log", "bets", """select game_id, date, year, round, league, home_team, away_team, bet_team, bet_side, odds, edge,
    1000e0 * least(greatest(0, 0.15 * (bet_prob * (odds - 1) - (1 - bet_prob)) / (odds - 1)), 0.1) as bet_amount,
    case when game_id % 10 = 0 then 'void' else 'pending' end as status from bets""")
define("last_result", "contests", """select home_team, away_team, arg_max(home_score, (date, game_id)) as h, arg_max(away_score, (date, game_id)) as a
  from contests where home_score is not null group by 1, 2""")
define("settled", "bet_log last_result", """select b.* exclude (status), case when status <> 'pending' or h is null then status when h = a then 'void'
      when (h > a) = (bet_team = b.home_team) then 'won' else 'lost' end as status,
    case when status <> 'pending' or h is null then null when h = a then 0e0
      when (h > a) = (bet_team = b.home_team) then bet_amount * (odds - 1) else -bet_amount end as profit_loss
  from bet_log b left join last_result r on r.home_team = b.home_team and r.away_team = b.away_team""")


def bet_log(t: Tables) -> DataFrame:
    bets = markets.candidate_bets(t.market, fraction=0.15)
    return bets.select("game_id", "date", "year", "round", "league", "home_team", "away_team", "bet_team", "bet_side", "odds",
                       "edge", (F.col("bet_fraction") * 1000.0).alias("bet_amount"),
                       F.when(F.col("game_id") % 10 == 0, "void").otherwise("pending").alias("status"),
                       F.lit(None).cast("double").alias("profit_loss"))


def settled_bets(t: Tables) -> DataFrame:
    return markets.settle(bet_log(t), t.games)


@query("j13_settlement", "settled", f"select game_id, bet_team, status, {q('profit_loss')} as profit_loss from settled")
def settlement(t: Tables) -> DataFrame:
    return rounded(settled_bets(t).select("game_id", "bet_team", "status", "profit_loss"))


@query("j14_value_columns", "market", f"""
with b as (select *, case when game_id % 3 = 0 then home_odds_close else home_odds_open end as h,
    case when game_id % 3 = 0 then away_odds_close else away_odds_open end as a from market),
e as (select *, case when h > 1 and a > 1 then model_prob - (1/h)/(1/h+1/a) end as x from b),
v as (select *, case when x > 0 then h when x < 0 then a end as o, case when x > 0 then model_prob when x < 0 then 1 - model_prob end as p from e)
select game_id, {q('abs(x)')} as edge, case when x > 0 then home_team when x < 0 then away_team end as value_team, {q('o')} as value_odds,
  {q('p * (o - 1) - (1 - p)')} as ev_per_dollar, {q('case when o is not null then greatest(0, 0.15 * (p * (o - 1) - (1 - p)) / (o - 1)) end')} as kelly_pct
from v""")
def value_columns(t: Tables) -> DataFrame:
    best = F.col("game_id") % 3 == 0
    prices = t.prices.select("game_id", F.col("home_odds_open").alias("home_odds"), F.col("away_odds_open").alias("away_odds"),
                             F.when(best, F.col("home_odds_close")).alias("home_odds_best"),
                             F.when(best, F.col("away_odds_close")).alias("away_odds_best"))
    predictions = t.games.join(t.forecasts, "game_id").select(
        "game_id", "home_team", "away_team", F.col("model_prob").alias("home_win_prob"))
    return rounded(markets.value_columns(predictions, prices, ["game_id"]).select(
        "game_id", "edge", "value_team", "value_odds", "ev_per_dollar", "kelly_pct"))


# three prediction snapshots per game with a forecast that drifts
define("history", "forecasts contests", """select f.game_id, strftime(c.date - to_days(cast(n as int)), '%Y-%m-%d') as snapshot_date,
    model_prob + n / 1000e0 as home_win_prob
  from forecasts f join contests c using (game_id), range(1, 4) r(n) where (f.game_id + n) % 4 <> 0""")


def prediction_history(t: Tables) -> DataFrame:
    rows = t.games.select("game_id", "date").join(t.forecasts, "game_id").select(
        "game_id", "date", "model_prob", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    return rows.where((F.col("game_id") + F.col("n")) % 4 != 0).select(
        "game_id", F.date_format(F.date_sub(F.to_date("date"), F.col("n")), "yyyy-MM-dd").alias("snapshot_date"),
        (F.col("model_prob") + F.col("n") / 1000.0).alias("home_win_prob"))


@query("j15_results_latest_prediction", "contests history", f"""
select c.game_id, c.home_score, h.snapshot_date, {q('h.home_win_prob')} as home_win_prob from contests c
left join (select *, row_number() over (partition by game_id order by snapshot_date desc) as rn from history where game_id % 9 <> 0) h
  on h.game_id = c.game_id and h.rn = 1 where c.home_score is not null""")
def results_latest_prediction(t: Tables) -> DataFrame:
    results = t.games.where("home_score is not null").select("game_id", "home_score")
    return rounded(joins.with_latest_prediction(results, prediction_history(t).where("game_id % 9 <> 0")))


_NEXT = """select * from (select *, year || '-' || round as roundname from contests where home_score is null)"""
define("upcoming", "contests", _NEXT)
define("next_games", "upcoming", """select * from upcoming where roundname = (select roundname from upcoming order by date, game_id limit 1)""")
define("latest_roster", "player_stats", """select team, array_to_string(list_sort(list(distinct player)), ',') as roster from player_stats p
  where mid = (select max(mid) from player_stats x where x.team = p.team) group by team""")


def upcoming_games(t: Tables) -> DataFrame:
    return t.games.where("home_score is null").withColumn(
        "roundname", F.concat_ws("-", "year", "round"))


@query("j16_projected_roster", "next_games latest_roster", """
select g.game_id, case when g.game_id % 4 = 0 then 'official' else h.roster end as home_roster,
  case when g.game_id % 4 = 0 then 'official' else a.roster end as away_roster, g.game_id % 4 <> 0 as projected
from next_games g left join latest_roster h on h.team = g.home_team left join latest_roster a on a.team = g.away_team
where g.game_id % 4 = 0 or (h.roster is not null and a.roster is not null)""")
def projected_roster(t: Tables) -> DataFrame:
    games = upcoming_games(t)
    official = games.where("game_id % 4 = 0").select("game_id", F.array(F.lit("official")).alias("home_roster"),
                                                     F.array(F.lit("official")).alias("away_roster"))
    return joins.projected_roster(games, official, rosters.latest_rosters(t.player_stats)).select(
        "game_id", _text("home_roster").alias("home_roster"), _text("away_roster").alias("away_roster"), "projected")


@query("j17_common_sample", "picks", """select game_id, pick_model, pick_market, pick_tipster from picks where pick_model is not null
  and pick_market is not null and pick_tipster is not null""")
def common_sample(t: Tables) -> DataFrame:
    from tallyline.plans.columns import strategy_picks
    names = ["pick_model", "pick_market", "pick_tipster"]
    return joins.common_sample(strategy_picks(t), names).select("game_id", *names)


@query("j18_bets_with_match_data", "bets contests", """select b.game_id, b.bet_side, c.venue, c.round, b.odds < 2 as favourite from bets b
  left join contests c on c.game_id = b.game_id and c.round <> 6""")
def bets_with_match_data(t: Tables) -> DataFrame:
    meta = t.games.where("round <> 6").select("game_id", "venue", "round")
    return candidates(t).select("game_id", "bet_side", "odds").join(meta, "game_id", "left").select(
        "game_id", "bet_side", "venue", "round", (F.col("odds") < 2).alias("favourite"))


@query("j19_unpivot_team_rows", "tg", "select game_id, side, team, opponent, sf, sa, sf > sa as won from tg")
def unpivot_team_rows(t: Tables) -> DataFrame:
    from tallyline.operators.history import team_games
    return team_games(t.contests).select("game_id", "side", "team", "opponent", "sf", "sa", (F.col("sf") > F.col("sa")).alias("won"))


@query("j20_explanation_fallback", "history contests", """
with h as (select game_id, snapshot_date, snapshot_date || ' ' || game_id as body from history where game_id % 5 <> 0),
l as (select game_id, 'live ' || game_id as body from contests where game_id % 3 = 0),
r as (select game_id, strftime(date - interval 2 day, '%Y-%m-%d') as asked_date from contests)
select r.game_id, asked_date, coalesce(e.body, l.body, n.body) as body,
  case when e.body is not null then 'exact' when l.body is not null then 'live' when n.body is not null then 'newest' end as found
from r left join h e on e.game_id = r.game_id and e.snapshot_date = r.asked_date left join l on l.game_id = r.game_id
left join (select game_id, arg_max(body, snapshot_date) as body from h group by 1) n on n.game_id = r.game_id""")
def explanation_fallback(t: Tables) -> DataFrame:
    history = prediction_history(t).where("game_id % 5 <> 0").withColumn(
        "body", F.concat_ws(" ", "snapshot_date", F.col("game_id").cast("string")))
    live = t.games.where("game_id % 3 = 0").select(
        "game_id", F.concat(F.lit("live "), F.col("game_id").cast("string")).alias("body"))
    asked = t.games.select("game_id", F.date_format(F.date_sub(F.to_date("date"), 2), "yyyy-MM-dd").alias("asked_date"))
    return joins.explanation_lookup(asked, live, history)


# -- order, top n, sets ------------------------------------------------------

@query("q1_chronological_sort", "contests", "select game_id, strftime(date, '%Y-%m-%d') as day, home_team, away_team from contests order by date, game_id")
def chronological_sort(t: Tables) -> DataFrame:
    return t.contests.orderBy("date", "game_id").select("game_id", s.day_key(F.col("date")).alias("day"), "home_team", "away_team")


_CONTRIB = ["model_prob - 0.5", "alt_prob - 0.5", "(game_id % 7 - 3) / 10e0", "(game_id % 11 - 5) / 20e0"]
define("contributions", "forecasts", " union all ".join(
    f"select game_id, 'f{i}' as name, {e} as value from forecasts" for i, e in enumerate(_CONTRIB)))


def contributions(t: Tables) -> DataFrame:
    g = F.col("game_id")
    values = [F.col("model_prob") - 0.5, F.col("alt_prob") - 0.5, (g % 7 - 3) / 10.0, (g % 11 - 5) / 20.0]
    return t.forecasts.select("game_id", F.explode(F.array(*[
        F.struct(F.lit(f"f{i}").alias("name"), v.alias("value")) for i, v in enumerate(values)])).alias("c")
    ).select("game_id", "c.*")


def top_by_size(df: DataFrame, key: str, name: str, value: str, n: int) -> DataFrame:
    """The n largest absolute values per key with their rank.  A key holds one row per feature."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.abs(value)).alias("size"), F.col(name), F.col(value))))
    return (df.groupBy(key).agg(F.slice(ranked, 1, n).alias("top"))
            .select(key, F.posexplode("top").alias("pos", "t"))
            .select(key, (F.col("pos") + 1).alias("rank"), f"t.{name}", f"t.{value}"))


@query("q2_top_contributions", "contributions", f"""select game_id, cast(rn as int) as rank, name, {q('value')} as value from (
  select *, row_number() over (partition by game_id order by abs(value) desc, name) as rn from contributions) where rn <= 3""")
def top_contributions(t: Tables) -> DataFrame:
    return rounded(top_by_size(contributions(t), "game_id", "name", "value", 3))


@query("q3_top_importances", "contributions contests", f"""select name || ':' || league as feature, {q('avg(abs(value))')} as importance, min(name) as grp
from contributions join contests using (game_id) group by name, league order by avg(abs(value)) desc, feature limit 10""")
def top_importances(t: Tables) -> DataFrame:
    rows = contributions(t).join(t.games.select("game_id", "league"), "game_id")
    sizes = rows.groupBy(F.concat_ws(":", "name", "league").alias("feature")).agg(
        F.avg(F.abs("value")).alias("importance"), F.min("name").alias("grp"))
    return rounded(sizes.orderBy(F.desc("importance"), "feature").limit(10))


@query("q4_ranked_value_list", "bets", f"select game_id, bet_team, {q('edge')} as edge from bets where edge >= 0.15 and edge < 0.30 order by edge desc, game_id")
def ranked_value_list(t: Tables) -> DataFrame:
    return rounded(markets.candidate_bets(t.market, 0.15, 0.30).orderBy(F.desc("edge"), "game_id").select("game_id", "bet_team", "edge"))


@query("q5_best_worst_bet", "settled", f"""select league, arg_max(game_id, (profit_loss, game_id)) as best_bet, {q('max(profit_loss)')} as best_profit,
  arg_min(game_id, (profit_loss, game_id)) as worst_bet, {q('min(profit_loss)')} as worst_profit from settled where status in ('won', 'lost') group by league""")
def best_worst_bet(t: Tables) -> DataFrame:
    # compared at six decimals so that equal profits tie
    order = F.struct("profit_loss", "game_id")
    settled = settled_bets(t).where(F.col("status").isin("won", "lost"))
    return rounded(settled.groupBy("league").agg(
        F.max_by("game_id", order).alias("best_bet"), F.max("profit_loss").alias("best_profit"),
        F.min_by("game_id", order).alias("worst_bet"), F.min("profit_loss").alias("worst_profit")))


@query("u1_union_ragged", "contests", """select game_id, home_score, cast(null as varchar) as venue from contests where game_id % 3 = 0
  union all select game_id, null, venue from contests where game_id % 3 <> 0""")
def union_ragged(t: Tables) -> DataFrame:
    return t.games.where("game_id % 3 = 0").select("game_id", "home_score").unionByName(
        t.games.where("game_id % 3 <> 0").select("game_id", "venue"), allowMissingColumns=True)


@query("u2_dedupe_keep_first", "contests", """select league, home_team, away_team, year, game_id, home_score from (select *, row_number() over (
  partition by league, home_team, away_team, year order by date, game_id) as rn from contests) where rn = 1""")
def dedupe_keep_first(t: Tables) -> DataFrame:
    rows = t.contests.select("league", "home_team", "away_team", "year", "date", "game_id", "home_score")
    return joins.keep_first(rows, ["league", "home_team", "away_team", "year"], ["date", "game_id"]).drop("date")


@query("u3_array_sets", "player_stats contests", """
with r as (select mid, team, list_sort(list(player)) as p from player_stats group by 1, 2)
select c.game_id, array_to_string(list_sort(list_filter(h.p, lambda x: not list_contains(a.p, x))), ',') as only_home,
  array_to_string(list_sort(list_filter(h.p, lambda x: list_contains(a.p, x))), ',') as in_both,
  array_to_string(list_sort(list_distinct(list_concat(h.p, a.p))), ',') as in_any
from contests c join r h on h.mid = c.game_id and h.team = c.home_team join r a on a.mid = c.game_id and a.team = c.away_team""")
def array_sets(t: Tables) -> DataFrame:
    pairs = _side_rosters(t).where("away_roster is not null")

    def text(c):
        return F.array_join(F.array_sort(c), ",")
    return pairs.select("game_id", text(F.array_except("home_roster", "away_roster")).alias("only_home"),
                        text(F.array_intersect("home_roster", "away_roster")).alias("in_both"),
                        text(F.array_union("home_roster", "away_roster")).alias("in_any"))


@query("u4_round_list", "contests", """
with n as (select case round when 1 then 'Opening Round' when 12 then 'Grand Final' else 'Round ' || round end || case when round % 2 = 0 then '' else ' ' || year end as roundname,
    home_score from contests),
u as (select distinct roundname from n where home_score is null), p as (select distinct roundname from n where home_score is not null)
select roundname, kind, case when lower(roundname) like 'opening%' then 0 when regexp_matches(roundname, '\\d') then cast(regexp_extract(roundname, '(\\d+)', 1) as int)
  when lower(roundname) like '%final%' then 900 else 500 end as sort_key
from (select roundname, 'past' as kind from p where roundname not in (select roundname from u) union all select roundname, 'upcoming' from u)
order by sort_key, roundname""")
def round_list(t: Tables) -> DataFrame:
    r = F.col("round")
    name = F.when(r == 1, "Opening Round").when(r == 12, "Grand Final").otherwise(F.concat(F.lit("Round "), r.cast("string")))
    named = t.games.withColumn("roundname", F.when(r % 2 == 0, name).otherwise(F.concat_ws(" ", name, "year")))
    past = named.where("home_score is not null")
    return joins.round_list(past, named.where("home_score is null"))


@query("w23_latest_per_key", "history", f"select game_id, max(snapshot_date) as snapshot_date, {q('arg_max(home_win_prob, snapshot_date)')} as home_win_prob from history group by 1")
def latest_per_key(t: Tables) -> DataFrame:
    return rounded(joins.keep_last(prediction_history(t), ["game_id"], ["snapshot_date"]))


@query("w24_next_round", "upcoming", """with f as (select roundname, min(date) as d from upcoming group by 1)
select game_id, roundname from upcoming where roundname = (select roundname from f order by d, roundname limit 1)""")
def next_round(t: Tables) -> DataFrame:
    return joins.next_round(upcoming_games(t)).select("game_id", "roundname")


@query("a5_roster_sets", "player_stats", """select mid, team, count(*) as n, array_to_string(list_sort(list(player)), ',') as roster from player_stats group by 1, 2""")
def roster_sets(t: Tables) -> DataFrame:
    return rosters.roster_sets(t.player_stats).select(
        "mid", "team", F.size("roster").cast("bigint").alias("n"), _text("roster").alias("roster"))


@query("a6_latest_roster", "latest_roster", "select team, roster from latest_roster")
def latest_roster(t: Tables) -> DataFrame:
    return rosters.latest_rosters(t.player_stats).select("team", _text("roster").alias("roster"))


# -- merging tables (S11-S14) ------------------------------------------------

@query("s11_keyed_upsert", "history", f"""
select game_id, snapshot_date, {q('home_win_prob')} as home_win_prob from history where (game_id, snapshot_date) not in (select (game_id, snapshot_date) from history where game_id % 3 = 0)
union all select game_id, snapshot_date, {q('1 - home_win_prob')} from history where game_id % 3 = 0""")
def keyed_upsert(t: Tables) -> DataFrame:
    rows = prediction_history(t)
    table = KeyedTable(t.spark, new_path(t.spark, "predictions"), rows.schema, ["game_id", "snapshot_date"])
    table.upsert(rows)
    table.upsert(table.read().where("game_id % 3 = 0").withColumn("home_win_prob", 1.0 - F.col("home_win_prob")))
    return rounded(table.read())


@query("s12_incremental_ingest", "contests", """
select game_id, league, 0 as batch from contests where game_id % 4 < 2
union all select game_id, league, 1 from contests where game_id % 4 >= 2""")
def incremental_ingest(t: Tables) -> DataFrame:
    existing = t.games.where("game_id % 4 < 2").select("game_id", "league", F.lit(0).alias("batch"))
    # every new game arrives twice, the first copy counts
    incoming = t.games.where("game_id % 4 >= 1").select("game_id", "league", F.explode(F.array(F.lit(1), F.lit(2))).alias("batch"))
    return ingest.add_new(existing, incoming, "game_id", ["batch"])


@query("s13_work_list", "contests weather", """select distinct venue, strftime(date, '%Y-%m-%d') as date_str from contests
  except select venue, date_str from weather""")
def work_list(t: Tables) -> DataFrame:
    wanted = t.games.select("venue", s.day_key(F.col("date")).alias("date_str"))
    return ingest.missing_keys(wanted, weather_table(t), ["venue", "date_str"])


@query("s14_source_fallback", "prices", f"""
with s as (select 2 as priority, game_id, home_odds_open as o from prices union all select 3, game_id, home_odds_close from prices
  union all select 1, game_id, home_odds_open from prices where home_odds_open < 0)
select game_id, priority, {q('o')} as home_odds from s where priority = (select min(priority) from s)""")
def source_fallback(t: Tables) -> DataFrame:
    rows = (t.prices.where("home_odds_open < 0").select(F.lit(1).alias("priority"), "game_id", F.col("home_odds_open").alias("home_odds"))
            .unionByName(t.prices.select(F.lit(2).alias("priority"), "game_id", F.col("home_odds_open").alias("home_odds")))
            .unionByName(t.prices.select(F.lit(3).alias("priority"), "game_id", F.col("home_odds_close").alias("home_odds"))))
    return rounded(ingest.first_source(rows))


@query("s14_source_fallback_per_key", "tips", f"""
with s as (select game_id, source as priority, case when (game_id + source) % 3 = 0 then hconfidence end as hconfidence from tips)
select game_id, priority, {q('hconfidence')} as hconfidence from s where (game_id, priority) in (
  select (game_id, min(priority)) from s where hconfidence is not null group by game_id)""")
def source_fallback_per_key(t: Tables) -> DataFrame:
    """Every source names every game but has a value for a third of them; the first value wins."""
    value = F.when((F.col("game_id") + F.col("source")) % 3 == 0, F.col("hconfidence"))
    rows = t.tips.select("game_id", F.col("source").alias("priority"), value.alias("hconfidence"))
    return rounded(ingest.first_source(rows.where("hconfidence is not null"), per_key=["game_id"]))
