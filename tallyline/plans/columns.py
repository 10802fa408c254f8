"""Column-expression queries (P)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import scalars as s
from tallyline.operators import history, joins, markets
from tallyline.plans.ctes import define, r6 as q
from tallyline.plans.registry import Tables, query, rounded
from tallyline.sources import ingest

define("implied", "prices", """select *, (1/home_odds_open)/(1/home_odds_open+1/away_odds_open) as iho,
  (1/home_odds_close)/(1/home_odds_close+1/away_odds_close) as ihc, 1/home_odds_open+1/away_odds_open as oo,
  1/home_odds_close+1/away_odds_close as oc from prices""")
define("market", "contests implied forecasts", """select c.*, p.* exclude (game_id), f.* exclude (game_id), ihc - iho as odds_move
  from contests c left join implied p on p.game_id = c.game_id join forecasts f on f.game_id = c.game_id""")


@query("p1_canonical_names", "contests aliases", """
with n as (select game_id, case game_id % 5 when 0 then home_team || ' FC' when 1 then '  ' || home_team || ' '
    when 2 then lower(home_team) when 3 then lower(home_team) || ' fc' else home_team || ' United' end as raw from contests)
select game_id, raw, coalesce((select min(team) from aliases a where a.alias = trim(raw)),
  (select arg_min(team, alias) from aliases a where lower(a.alias) = lower(trim(raw)))) as team from n""")
def canonical_names(t: Tables) -> DataFrame:
    g, h = F.col("game_id") % 5, F.col("home_team")
    raw = (F.when(g == 0, F.concat(h, F.lit(" FC"))).when(g == 1, F.concat(F.lit("  "), h, F.lit(" ")))
           .when(g == 2, F.lower(h)).when(g == 3, F.concat(F.lower(h), F.lit(" fc")))
           .otherwise(F.concat(h, F.lit(" United"))))
    return joins.canonical_names(t.contests.select("game_id", raw.alias("raw")), "raw", t.aliases, "team")


_ROUND_NAME = "case round when 1 then 'Opening Round' when 12 then 'Grand Final' when 11 then null when 10 then '' when 9 then 'Bye' else 'Round ' || round end"


def _round_name():
    r = F.col("round")
    return (F.when(r == 1, "Opening Round").when(r == 12, "Grand Final").when(r == 11, None).when(r == 10, "")
            .when(r == 9, "Bye").otherwise(F.concat(F.lit("Round "), r.cast("string"))))


@query("p2_round_number", "contests", f"""
select game_id, try_cast(nullif(regexp_extract({_ROUND_NAME}, '(\\d+)', 1), '') as int) as round_number from contests""")
def round_number(t: Tables) -> DataFrame:
    return t.contests.select("game_id", s.round_number(_round_name()).alias("round_number"))


@query("p3_day_key", "", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def day_key(t: Tables) -> DataFrame:
    return t.raw("orders").select("o_orderkey", s.day_key(F.col("o_orderdate")).alias("day"))


@query("p4_numeric_coercion", "", """select p_partkey, try_cast(regexp_replace(p_brand, '[^0-9]', '', 'g') as double) as brand_no,
  try_cast(p_name as double) as name_no, try_cast(cast(p_size as varchar) as double) as size_no from part""")
def numeric_coercion(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", s.number(F.regexp_replace("p_brand", "[^0-9]", "")).alias("brand_no"),
                                s.number(F.col("p_name")).alias("name_no"),
                                s.number(F.col("p_size").cast("string")).alias("size_no"))


@query("p5_targets", "contests", """select game_id, case when home_score > away_score then 1 else 0 end as home_win,
  home_score - away_score as margin from contests""")
def targets(t: Tables) -> DataFrame:
    h, a = F.col("home_score"), F.col("away_score")
    return t.contests.select("game_id", s.home_win(h, a).alias("home_win"), s.margin(h, a).alias("margin"))


@query("p6_implied_probability", "implied", f"""select game_id, {q('iho')} as implied_home_open,
  {q('(1/away_odds_open)/oo')} as implied_away_open, {q('oo')} as overround_open, {q('ihc')} as implied_home_close,
  {q('(1/away_odds_close)/oc')} as implied_away_close, {q('oc')} as overround_close from implied""")
def implied_probability(t: Tables) -> DataFrame:
    return rounded(markets.add_implied(t.prices).select("game_id", *[
        f"{c}_{k}" for k in ("open", "close") for c in ("implied_home", "implied_away", "overround")]))


_SHIFT = "case when game_id % 7 = 0 then 1e0 when game_id % 11 = 0 then null else home_odds_open end"


@query("p7_guarded_probability", "prices", f"""
select game_id, case when h > 1 and a > 1 then {q('(1/h)/(1/h+1/a)')} end as p_market
from (select game_id, {_SHIFT} as h, away_odds_open as a from prices)""")
def guarded_probability(t: Tables) -> DataFrame:
    g = F.col("game_id")
    h = F.when(g % 7 == 0, 1.0).when(g % 11 != 0, F.col("home_odds_open"))
    return rounded(t.prices.select("game_id", s.guarded_implied(h, F.col("away_odds_open")).alias("p_market")))


@query("p8_edge", "market", f"""select game_id, {q('model_prob - iho')} as home_edge,
  {q('(1 - model_prob) - (1 - iho)')} as away_edge from market where iho is not null""")
def edge(t: Tables) -> DataFrame:
    p, fair = F.col("model_prob"), s.implied(F.col("home_odds_open"), F.col("away_odds_open"))
    return rounded(t.market.where("home_odds_open is not null").select(
        "game_id", s.edge(p, fair).alias("home_edge"), s.edge(1.0 - p, 1.0 - fair).alias("away_edge")))


@query("p9_kelly_stake", "market", f"""
select game_id, {q('least(greatest(0, 0.25 * (model_prob * b - (1 - model_prob)) / b), 0.10)')} as stake_share,
  {q('greatest(0, 0.25 * (model_prob * b - (1 - model_prob)) / b)')} as uncapped
from (select *, home_odds_open - 1 as b from market) where b is not null""")
def kelly_stake(t: Tables) -> DataFrame:
    p, o = F.col("model_prob"), F.col("home_odds_open")
    return rounded(t.market.where("home_odds_open is not null").select(
        "game_id", s.kelly(p, o, 0.25, 0.10).alias("stake_share"), s.kelly(p, o).alias("uncapped")))


@query("p10_expected_value", "market", f"""select game_id, {q('model_prob * (home_odds_open - 1) - (1 - model_prob)')} as ev
  from market where home_odds_open is not null""")
def expected_value(t: Tables) -> DataFrame:
    return rounded(t.market.where("home_odds_open is not null").select(
        "game_id", s.expected_value(F.col("model_prob"), F.col("home_odds_open")).alias("ev")))


@query("p11_price_move", "implied", f"""select game_id, {q('ihc - iho')} as odds_move, {q('abs(ihc - iho)')} as odds_move_magnitude,
  {q('oc - oo')} as overround_change from implied""")
def price_move(t: Tables) -> DataFrame:
    return rounded(markets.add_moves(markets.add_implied(t.prices)).select(
        "game_id", "odds_move", "odds_move_magnitude", "overround_change"))


def _moves(t: Tables) -> DataFrame:
    return markets.add_moves(markets.add_implied(t.market)).withColumn(
        "bet_side", F.when(F.col("model_prob") >= 0.5, "home").otherwise("away"))


# moves that are zero but for rounding noise are set to exactly zero on both sides
_MV = "round(odds_move, 12)"


@query("p12_move_aligned", "market", f"""select game_id, coalesce(case when model_prob >= 0.5 then {_MV} > 0 else {_MV} < 0 end, false)
  as aligned from market""")
def move_aligned(t: Tables) -> DataFrame:
    return _moves(t).select("game_id", s.aligned(F.col("bet_side"), F.round("odds_move", 12)).alias("aligned"))


@query("p13_move_class", "market", f"""select game_id, case when m is null then 'UNKNOWN' when m > 0.005 then 'AGREE'
  when m < -0.005 then 'DISAGREE' else 'NEUTRAL' end as move_class
  from (select game_id, case when model_prob >= 0.5 then {_MV} else -({_MV}) end as m from market)""")
def move_class(t: Tables) -> DataFrame:
    move = F.round("odds_move", 12)
    own = F.when(F.col("bet_side") == "home", move).otherwise(-move)
    return _moves(t).select("game_id", s.move_class(own).alias("move_class"))


@query("p14_travel_distance", "travel", f"""select game_id, {q('home_km')} as home_travel_km, {q('away_km')} as away_travel_km,
  {q('home_km - away_km')} as travel_distance_diff from travel""")
def travel_distance(t: Tables) -> DataFrame:
    return rounded(joins.attach_travel(t.games, t.team_dim, t.venue_dim).select(
        "game_id", "home_travel_km", "away_travel_km", "travel_distance_diff"))


define("grounds", "contests", """select home_team as team, arg_min(venue, venue) as v1, max(venue) as v2 from contests
  where game_id % 3 = 0 group by 1""")


@query("p15_interstate_home_ground", "travel grounds contests", """select c.game_id, home_interstate, away_interstate,
  away_interstate - home_interstate as interstate_diff, coalesce(cast(c.venue in (h.v1, h.v2) as int), 0) as home_at_home_ground,
  coalesce(cast(c.venue in (a.v1, a.v2) as int), 0) as away_at_home_ground
from contests c join travel t on t.game_id = c.game_id left join grounds h on h.team = c.home_team
left join grounds a on a.team = c.away_team""")
def interstate_home_ground(t: Tables) -> DataFrame:
    grounds = t.games.where("game_id % 3 = 0").groupBy(F.col("home_team").alias("team")).agg(
        F.array(F.min("venue"), F.max("venue")).alias("venues"))
    places = joins.attach_travel(t.games, t.team_dim, t.venue_dim)
    return joins.attach_home_ground(places, grounds).select(
        "game_id", "home_interstate", "away_interstate", "interstate_diff", "home_at_home_ground",
        "away_at_home_ground")


define("weather", "contests", """select distinct venue, strftime(date, '%Y-%m-%d') as date_str,
    cast(dayofyear(date) % 30 as double) as temp_c, case when dayofyear(date) % 6 <> 0 then (dayofyear(date) % 40) / 10e0 end as rain_mm,
    case when dayofyear(date) % 5 <> 0 then cast(dayofyear(date) % 45 as double) end as wind_kmh,
    cast(dayofyear(date) % 45 + dayofyear(date) % 11 as double) as wind_gust_kmh,
    case when dayofyear(date) % 7 <> 0 then cast(30 + dayofyear(date) % 70 as double) end as humidity
  from contests where dayofyear(date) % 4 <> 0""")
define("weathered", "contests weather venue_dim", """select c.game_id, w.temp_c, w.rain_mm, w.wind_kmh, w.wind_gust_kmh, w.humidity, coalesce(v.roofed, 0) as is_roofed,
    coalesce(cast(case when v.roofed = 1 then 0 else w.rain_mm end > 1 as int), 0) as is_wet,
    coalesce(cast(w.wind_kmh > 25 as int), 0) as wind_strong
  from contests c left join weather w on w.venue = c.venue and w.date_str = strftime(c.date, '%Y-%m-%d')
  left join venue_dim v on v.venue = c.venue""")


def weather_table(t: Tables) -> DataFrame:
    """Day-of-year weather per venue and day, with gaps."""
    d = F.dayofyear("date")
    return t.games.where(d % 4 != 0).select(
        "venue", s.day_key(F.col("date")).alias("date_str"), (d % 30).cast("double").alias("temp_c"),
        F.when(d % 6 != 0, (d % 40) / 10.0).alias("rain_mm"),
        F.when(d % 5 != 0, (d % 45).cast("double")).alias("wind_kmh"), (d % 45 + d % 11).cast("double").alias("wind_gust_kmh"),
        F.when(d % 7 != 0, (30 + d % 70).cast("double")).alias("humidity")).distinct()


define("price_ranges", "prices", """select game_id,
    case when game_id % 11 <> 0 then least(home_odds_open, home_odds_close) * (1 - (game_id % 17) / 200e0) end as home_odds_min,
    greatest(home_odds_open, home_odds_close) * (1 + (game_id % 19) / 150e0) as home_odds_max,
    least(away_odds_open, away_odds_close) * (1 - (game_id % 23) / 250e0) as away_odds_min,
    case when game_id % 12 <> 0 then greatest(away_odds_open, away_odds_close) * (1 + (game_id % 29) / 300e0) end as away_odds_max
  from prices""")


def price_ranges(t: Tables) -> DataFrame:
    """Lowest and highest price of each side over all bookmakers, some unknown."""
    g = F.col("game_id")

    def end(pick, side: str, share: Column) -> Column:
        return pick(f"{side}_odds_open", f"{side}_odds_close") * (1 + share)

    return t.prices.select(
        "game_id", F.when(g % 11 != 0, end(F.least, "home", -(g % 17) / 200.0)).alias("home_odds_min"),
        end(F.greatest, "home", (g % 19) / 150.0).alias("home_odds_max"), end(F.least, "away", -(g % 23) / 250.0).alias("away_odds_min"),
        F.when(g % 12 != 0, end(F.greatest, "away", (g % 29) / 300.0)).alias("away_odds_max"))


@query("p16_weather_flags", "weathered", "select game_id, is_roofed, is_wet, wind_strong from weathered")
def weather_flags(t: Tables) -> DataFrame:
    return joins.join_weather(t.games, weather_table(t), t.venue_dim).select(
        "game_id", "is_roofed", "is_wet", "wind_strong")


@query("p17_composite_score", "player_stats", f"""select mid, team, player, {q('''coalesce(d, 0) + 6e0 * coalesce(g, 0)
  + 1.5e0 * coalesce(ho, 0) + 2e0 * coalesce(i50, 0) + 2e0 * coalesce(cl, 0) + 1.5e0 * coalesce(r50, 0)''')} as score
  from player_stats""")
def composite_score(t: Tables) -> DataFrame:
    from tallyline.operators.rosters import SCORE_WEIGHTS
    have = t.player_stats.columns
    weights = {c: w for c, w in SCORE_WEIGHTS.items() if c in have}
    return rounded(t.player_stats.select("mid", "team", "player", s.weighted_score(weights).alias("score")))


@query("p18_player_role", "player_stats", """select mid, team, player, case when coalesce(ho, 0) >= 15 then 'ruck'
  when coalesce(g, 0) >= 1.5 and coalesce(i50, 0) >= 3 then 'forward'
  when coalesce(cl, 0) >= 3 or coalesce(d, 0) >= 25 then 'midfielder'
  when coalesce(r50, 0) >= 3 then 'defender' when coalesce(i50, 0) >= 3 then 'forward' else 'other' end as role
  from player_stats""")
def player_role(t: Tables) -> DataFrame:
    return t.player_stats.select("mid", "team", "player", s.role(
        *[F.col(c) for c in ("ho", "g", "i50", "cl", "d", "r50")]).alias("role"))


_P_HALF = "case when game_id % 17 = 0 then 0.5e0 + 4e-6 when game_id % 19 = 0 then 0.5e0 + 6e-6 else model_prob end"


@query("p19_winner_confidence", "market", f"""select game_id, case when abs(p - 0.5) <= 5.01e-6 then '' when p > 0.5 then home_team
  else away_team end as predicted_winner, {q('greatest(p, 1 - p)')} as confidence
  from (select *, {_P_HALF} as p from market)""")
def winner_confidence(t: Tables) -> DataFrame:
    g = F.col("game_id")
    p = F.when(g % 17 == 0, 0.5 + 4e-6).when(g % 19 == 0, 0.5 + 6e-6).otherwise(F.col("model_prob"))
    return rounded(t.market.select(
        "game_id", s.predicted_winner(p, F.col("home_team"), F.col("away_team")).alias("predicted_winner"),
        s.confidence(p).alias("confidence")))


@query("p20_probability_clip", "forecasts", f"""select game_id, {q('least(greatest(1.1 * model_prob - 0.05, 0.02), 0.98)')} as p
  from forecasts""")
def probability_clip(t: Tables) -> DataFrame:
    return rounded(t.forecasts.select("game_id", s.clip_probability(1.1 * F.col("model_prob") - 0.05).alias("p")))


# the side of the game whose edge lies in the band
define("bets", "market", """select * exclude (e), case when side = 'home' then e else -e end as edge,
    case when side = 'home' then model_prob else 1 - model_prob end as bet_prob,
    case when side = 'home' then iho else 1 - iho end as market_prob,
    case when side = 'home' then home_odds_open else away_odds_open end as odds,
    case when side = 'home' then home_team else away_team end as bet_team, side as bet_side
  from (select *, model_prob - iho as e, case when model_prob - iho >= 0.05 and model_prob - iho < 1 then 'home'
      when iho - model_prob >= 0.05 and iho - model_prob < 1 then 'away' end as side from market) where side is not null""")


def candidates(t: Tables) -> DataFrame:
    """All bets with an edge of 5% or more at opening prices."""
    return markets.candidate_bets(markets.add_moves(markets.add_implied(t.market)))


@query("p21_best_side", "bets", f"select game_id, bet_side, bet_team, {q('edge')} as edge, {q('odds')} as odds from bets where edge >= 0.15 and edge < 0.30")
def best_side(t: Tables) -> DataFrame:
    return rounded(markets.candidate_bets(t.market, 0.15, 0.30).select("game_id", "bet_side", "bet_team", "edge", "odds"))


@query("p22_price_role", "bets", "select game_id, case when odds < 2 then 'favorite' else 'underdog' end as role from bets")
def price_role(t: Tables) -> DataFrame:
    return candidates(t).select("game_id", s.price_role(F.col("odds")).alias("role"))


_BANDS = ", ".join(f"({lo}e0, {hi}e0, '{markets.band_label(lo, hi)}')" for lo, hi in markets.EDGE_BANDS)


@query("p23_edge_bands", "bets", f"select game_id, label as band from bets join (values {_BANDS}) b(lo, hi, label) on edge >= lo and edge < hi")
def edge_bands(t: Tables) -> DataFrame:
    return markets.explode_bands(candidates(t), "edge", markets.EDGE_BANDS).select("game_id", "band")


_FAV, _AGR = "odds < 2", "(alt_prob >= 0.5) = (bet_side = 'home')"
_MOV = "coalesce(case when bet_side = 'home' then odds_move > 0 else odds_move < 0 end, false)"


def _between(lo: float, hi: float) -> str:
    return f"edge >= {lo} and edge < {hi}"


FILTER_SQL = {
    "baseline": _between(.15, .30), "all": "true", "H1": f"{_between(.15, .30)} and {_FAV}",
    "H1b": f"{_between(.05, .30)} and {_FAV}", "H2a": _between(.05, .15), "H2b": _between(.10, .20),
    "H3": f"{_between(.10, .20)} and odds >= 1.5 and {_FAV}", "H4": f"{_between(.15, .30)} and {_AGR}",
    "H4b": f"{_between(.05, .30)} and {_AGR}", "H5": f"{_between(.15, .30)} and {_MOV}",
    "H5b": f"{_between(.05, .30)} and {_MOV}", "H1+H5": f"{_between(.15, .30)} and {_FAV} and {_MOV}",
    "H4+H5": f"{_between(.15, .30)} and {_AGR} and {_MOV}", "H1+H4": f"{_between(.15, .30)} and {_FAV} and {_AGR}",
    "H1+H4+H5": f"{_between(.15, .30)} and {_FAV} and {_AGR} and {_MOV}",
    "H6": f"{_between(.05, .30)} and {_FAV} and {_AGR} and {_MOV}", "H6b": f"{_between(.05, .30)} and {_FAV} and {_AGR}",
}
define("filtered", "bets", " union all ".join(
    f"select '{name}' as filter, * from bets where {cond}" for name, cond in FILTER_SQL.items()))


@query("p24_named_filters", "filtered", "select filter, game_id from filtered")
def named_filters(t: Tables) -> DataFrame:
    return markets.explode_filters(candidates(t)).select("filter", "game_id")


_NAMES = "['elo_diff', 'rest_diff', 'season_progress', 'win_rate_diff_5', 'avg_margin_diff_5', 'home_interstate']"
_NAME_LIST = ("elo_diff", "rest_diff", "season_progress", "win_rate_diff_5", "avg_margin_diff_5", "home_interstate")


@query("p25_change_key", "market", f"""
select game_id, sha1(game_id || '|' || home_team || '|' || away_team || '|' || printf('%.2f', round_even(model_prob * 20, 0) / 20)
  || '|' || array_to_string(list_sort(list_concat({_NAMES}[game_id % 6 + 1:], {_NAMES}[:game_id % 6])[1:5]), '|')) as cache_key
from market""")
def change_key(t: Tables) -> DataFrame:
    names, shift = F.array(*[F.lit(n) for n in _NAME_LIST]), (F.col("game_id") % 6).cast("int")
    turned = F.concat(F.slice(names, shift + 1, F.lit(6)), F.slice(names, F.lit(1), shift))
    return t.market.select("game_id", s.change_key(F.col("game_id"), F.col("home_team"), F.col("away_team"),
                                                   F.col("model_prob"), turned).alias("cache_key"))


@query("p26_label_lookup", "contests", """
with k as (select game_id, lower(home_team) || '_' || league as name from contests),
l as (select lower(n_name) || '_BUILDING' as name, 'Label ' || n_nationkey as label from nation where n_nationkey % 2 = 0)
select game_id, coalesce(label, replace(k.name, '_', ' ')) as label from k left join l on l.name = k.name""")
def label_lookup(t: Tables) -> DataFrame:
    labels = t.raw("nation").where("n_nationkey % 2 = 0").select(
        F.concat(F.lower("n_name"), F.lit("_BUILDING")).alias("name"),
        F.concat(F.lit("Label "), F.col("n_nationkey").cast("string")).alias("label"))
    named = t.contests.select("game_id", F.concat_ws("_", F.lower("home_team"), "league").alias("name"))
    return named.join(labels, "name", "left").select("game_id", s.label_or_name(F.col("label"), F.col("name")).alias("label"))


@query("p27_split_and_bet_id", "bets", """select game_id, trim(split_part(m, ' vs ', 1)) as home, trim(substr(m, strpos(m, ' vs ') + 4)) as away,
  strftime(date, '%Y-%m-%d') || '_' || home_team || '_' || away_team || '_' || bet_side as bet_id
from (select *, home_team || ' vs ' || away_team || ' vs old boys' as m from bets)""")
def split_and_bet_id(t: Tables) -> DataFrame:
    home, away = s.split_match(F.concat("home_team", F.lit(" vs "), "away_team", F.lit(" vs old boys")))
    return candidates(t).select("game_id", home.alias("home"), away.alias("away"), s.bet_key(
        F.col("date"), F.col("home_team"), F.col("away_team"), F.col("bet_side")).alias("bet_id"))


@query("p28_feature_report", "contests", "select game_id, home_score, away_score, 2 as n_missing from contests")
def feature_report(t: Tables) -> DataFrame:
    kept, missing = ingest.report_columns(t.contests, ["game_id", "home_score", "away_score", "humidity", "attendance"])
    return kept.withColumn("n_missing", F.lit(len(missing)))


_SORT_KEY = """case when n is null or n = '' then 999 when lower(n) like 'opening%' then 0
  when regexp_matches(n, '\\d') then cast(regexp_extract(n, '(\\d+)', 1) as int) when lower(n) like '%final%' then 900 else 500 end"""


@query("p30_round_sort_key", "contests", f"select game_id, {_SORT_KEY} as sort_key from (select game_id, {_ROUND_NAME} as n from contests)")
def round_sort_key(t: Tables) -> DataFrame:
    return t.contests.select("game_id", s.round_sort_key(_round_name()).alias("sort_key"))


@query("p31_abbreviated_name", "", """select p_partkey, case when len(w) >= 2 then w[1][1] || ' ' || array_to_string(w[2:], ' ') end as short
from (select p_partkey, string_split(trim(case when p_partkey % 4 = 0 then p_brand else p_name || ' ' || p_type end), ' ') as w from part)""")
def abbreviated_name(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    return t.raw("part").select("p_partkey", s.abbreviated(name).alias("short"))


@query("p32_points", "", f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, {q('floor(l_quantity / 10) * 6 + l_quantity % 10')} as points,
  {q('l_extendedprice')} as price from lineitem""")
def quarter_points(t: Tables) -> DataFrame:
    goals, behinds = F.floor(F.col("l_quantity") / 10), F.col("l_quantity") % 10
    return rounded(t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.points(
        goals, behinds).alias("points"), F.col("l_extendedprice").alias("price")))


@query("p33_meta_features", "market", f"""select game_id, {q('abs(model_prob - 0.5)')} as clf_confidence, {q('abs(m)')} as margin_abs,
  cast((model_prob >= 0.5 and m > 0) or (model_prob < 0.5 and m <= 0) as double) as clf_margin_agree
from (select *, (alt_prob - 0.5) * 60 as m from market)""")
def meta_features(t: Tables) -> DataFrame:
    p, m = F.col("model_prob"), (F.col("alt_prob") - 0.5) * 60
    return rounded(t.market.select("game_id", F.abs(p - 0.5).alias("clf_confidence"), F.abs(m).alias("margin_abs"),
                                   s.signs_agree(p, m).alias("clf_margin_agree")))


define("picks", "market tips", """select m.*, cast(model_prob >= 0.5 as double) as pick_model,
    case when home_odds_open is not null then cast(home_odds_open < away_odds_open as double) end as pick_market,
    cast(mh > 50 as double) as pick_tipster, case when home_score > away_score then 1 else 0 end as y, mh
  from market m join (select game_id, avg(hconfidence) as mh, avg(greatest(hconfidence, 100 - hconfidence)) as mc from tips group by 1) t on t.game_id = m.game_id
  where home_score is not null""")


def strategy_picks(t: Tables) -> DataFrame:
    from tallyline.operators.metrics import crowd
    rows = t.market.where("home_score is not null").join(crowd(t.tips), "game_id")
    rows = rows.withColumn("y", s.home_win(F.col("home_score"), F.col("away_score")))
    h, a = F.col("home_odds_open"), F.col("away_odds_open")
    rows = rows.select("*", (F.col("model_prob") >= 0.5).cast("double").alias("pick_model"),
                       F.when(h.isNotNull() & a.isNotNull(), (h < a).cast("double")).alias("pick_market"),
                       (F.col("mean_hconfidence") > 50).cast("double").alias("pick_tipster"))
    return rows.select("*", *[s.correct(F.col(f"pick_{n}"), F.col("y").cast("double")).alias(f"correct_{n}")
                              for n in ("model", "market", "tipster")])


@query("p34_strategy_picks", "picks", """select game_id, pick_model, pick_market, pick_tipster, cast(pick_model = y as double) as correct_model,
  cast(pick_market = y as double) as correct_market, cast(pick_tipster = y as double) as correct_tipster from picks""")
def strategy_picks_query(t: Tables) -> DataFrame:
    return strategy_picks(t).select("game_id", *[f"{k}_{n}" for k in ("pick", "correct")
                                                 for n in ("model", "market", "tipster")])


@query("p35_home_minus_away", "tg", f"""
with f as (select game_id, side, avg(case when done then sf end) over w as a, avg(case when done then sa end) over w as b from tg
  window w as (partition by league, team order by date, game_id rows between unbounded preceding and 1 preceding)),
w as (select game_id, {", ".join(f"max(case when side = '{x}' then {n} end) as {x}_{n}" for n in 'ab' for x in ('home', 'away'))} from f group by 1)
select game_id, {q('home_a')} as home_for, {q('away_a')} as away_for, {q('home_b')} as home_against, {q('away_b')} as away_against,
  {q('home_a - away_a')} as for_diff, {q('home_b - away_b')} as against_diff from w""")
def home_minus_away(t: Tables) -> DataFrame:
    from tallyline.operators.scan import running
    rows = running(history.team_games(t.games), history.TEAM, history.ORDER, {
        "n": ("count", F.when(F.col("done"), 1)), "f": ("sum", F.when(F.col("done"), F.col("sf"))),
        "a": ("sum", F.when(F.col("done"), F.col("sa")))})
    rows = rows.select("game_id", "side", F.try_divide(F.col("f").cast("double"), F.col("n").cast("double")).alias("for"),
                       F.try_divide(F.col("a").cast("double"), F.col("n").cast("double")).alias("against"))
    return rounded(history.by_game(rows, ["for", "against"], {"for_diff": "for", "against_diff": "against"}))


@query("p36_serving_features", "contests snapshots", f"""
with up as (select game_id, game_id % 150 as match_id from contests where home_score is null),
f as (select match_id, arg_min(home_odds, event_id) as h, arg_min(away_odds, event_id) as a from snapshots group by 1)
select game_id, case when h > 1 and a > 1 then {q('(1/h)/(1/h+1/a)')} end as implied_home_open,
  case when h > 1 and a > 1 then {q('1/h+1/a')} end as overround_open, {q('(h - a) * 5')} as home_line_close
from up left join f on f.match_id = up.match_id""")
def serving_features(t: Tables) -> DataFrame:
    upcoming = t.games.where("home_score is null").select("game_id", (F.col("game_id") % 150).alias("match_id"))
    quotes = t.snapshots.withColumn("home_line", (F.col("home_odds") - F.col("away_odds")) * 5)
    return rounded(markets.serving_prices(upcoming, quotes, ["match_id"], ["event_id"]).drop("match_id"))


@query("p37_upcoming_completed", "contests", """select game_id, home_score is null and home_team is not null and away_team is not null as upcoming,
  home_score is not null and away_score is not null as completed from contests""")
def upcoming_completed(t: Tables) -> DataFrame:
    known = F.col("home_team").isNotNull() & F.col("away_team").isNotNull()
    return t.contests.select("game_id", (F.col("home_score").isNull() & known).alias("upcoming"),
                             history.is_done().alias("completed"))


def optional_filter(df: DataFrame, **equals) -> DataFrame:
    """Keep rows equal to every given value; None leaves the column free."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


@query("p38_optional_filters", "contests", "select game_id, league, round from contests where league = 'BUILDING' and round = 7")
def optional_filters(t: Tables) -> DataFrame:
    return optional_filter(t.contests, league="BUILDING", round=7, year=None).select("game_id", "league", "round")
