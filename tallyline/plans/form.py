"""History features (W) with SQL written in another form: lists and correlated reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators import history, joins, ratings, rosters
from tallyline.plans.ctes import define, r6 as q
from tallyline.plans.registry import Tables, query, rounded

# each team row with the list of its done games before it
define("hist", "tg", """select t.*, list({'sf': sf, 'sa': sa, 'date': date, 'done': done}) over (
    partition by league, team order by date, game_id rows between unbounded preceding and 1 preceding) as all_before
  from tg t""")
define("past", "hist", """select * exclude (all_before),
    list_filter(coalesce(all_before, []), lambda x: x.done) as p from hist""")


def _sides(names: list[str]) -> str:
    return ", ".join(f"max(case when side = '{s}' then {n} end) as {s}_{n}" for n in names for s in ("home", "away"))


def _form_sql() -> str:
    cols = []
    for n in (5, 10):
        tail = f"p[-{n}:]"
        cols += [f"list_avg(list_transform({tail}, lambda x: case when x.sf > x.sa then 1e0 else 0e0 end)) as win_rate_{n}",
                 f"list_avg(list_transform({tail}, lambda x: x.sf - x.sa)) as avg_margin_{n}",
                 f"list_avg(list_transform({tail}, lambda x: x.sf)) as avg_score_for_{n}",
                 f"list_avg(list_transform({tail}, lambda x: x.sa)) as avg_score_against_{n}"]
    names = [f"{c}_{n}" for n in (5, 10) for c in ("win_rate", "avg_margin", "avg_score_for", "avg_score_against")]
    sides = ", ".join(f"{q(f'{s}_{n}')} as {s}_{n}" for n in names for s in ("home", "away"))
    diffs = ", ".join(f"{q(f'home_{n} - away_{n}')} as {d}" for n, d in [
        (f"{c}_{n}", f"{d}_{n}") for n in (5, 10) for c, d in (
            ("win_rate", "win_rate_diff"), ("avg_margin", "avg_margin_diff"),
            ("avg_score_for", "score_for_diff"), ("avg_score_against", "score_against_diff"))])
    return f"""with f as (select game_id, side, {', '.join(cols)} from past),
    w as (select game_id, {_sides(names)} from f group by game_id)
    select game_id, {sides}, {diffs} from w"""


def _numbered(t: Tables) -> DataFrame:
    return t.step("numbered", lambda: history.numbered(t.games), stored=True)


def _form(t: Tables) -> DataFrame:
    return t.step("form", lambda: history.rolling_form(_numbered(t)))


def _rest(t: Tables) -> DataFrame:
    return t.step("rest", lambda: history.rest_days(_numbered(t)))


def _elo(t: Tables) -> DataFrame:
    return t.step("elo", lambda: ratings.elo(t.games))


@query("w1_rolling_form", "past", _form_sql())
def rolling_form(t: Tables) -> DataFrame:
    df = _form(t)
    return rounded(df.drop("home_margin_volatility", "away_margin_volatility", "margin_volatility_diff_5"))


@query("w2_margin_volatility", "past", f"""
with f as (select game_id, side, case when len(p) >= 2 then list_stddev_samp(list_transform(p[-5:], lambda x: x.sf - x.sa)) end as v
  from past), w as (select game_id, {_sides(['v'])} from f group by game_id)
select game_id, {q('home_v')} as home_margin_volatility, {q('away_v')} as away_margin_volatility,
  {q('home_v - away_v')} as margin_volatility_diff_5 from w""")
def margin_volatility(t: Tables) -> DataFrame:
    return rounded(_form(t).select(
        "game_id", "home_margin_volatility", "away_margin_volatility", "margin_volatility_diff_5"))


@query("w3_form_streak", "tg", f"""
with done as (select league, team, date, game_id, sign(sf - sa) as o,
    row_number() over (partition by league, team order by date, game_id) as rn from tg where done),
runs as (select *, rn - row_number() over (partition by league, team, o order by rn) as grp from done),
streaks as (select league, team, rn, o * (row_number() over (partition by league, team, o, grp order by rn)) as streak
  from runs),
k as (select game_id, side, league, team, count(case when done then 1 end) over (
    partition by league, team order by date, game_id rows between unbounded preceding and 1 preceding) as k from tg),
f as (select k.game_id, k.side, s.streak as form_streak from k left join streaks s
    on s.league = k.league and s.team = k.team and s.rn = k.k),
w as (select game_id, {_sides(['form_streak'])} from f group by game_id)
select game_id, cast(home_form_streak as bigint) as home_form_streak, cast(away_form_streak as bigint) as away_form_streak,
  cast(home_form_streak - away_form_streak as bigint) as form_streak_diff from w""")
def form_streak(t: Tables) -> DataFrame:
    return history.form_streak(_numbered(t))


@query("w4_head_to_head", "contests", f"""
with p as (select *, least(home_team, away_team) as a, greatest(home_team, away_team) as b,
    case when home_score > away_score then home_team when away_score > home_score then away_team end as winner from contests),
h as (select *, list_filter(coalesce(list(winner) over (partition by league, a, b order by date, game_id
    rows between unbounded preceding and 1 preceding), []), lambda x: x is not null)[-10:] as won from p)
select game_id, {q("case when len(won) > 0 then len(list_filter(won, lambda x: x = home_team)) / len(won)::double end")}
  as h2h_home_win_rate, cast(len(won) as bigint) as h2h_meetings from h""")
def head_to_head(t: Tables) -> DataFrame:
    return rounded(history.head_to_head(t.games))


@query("w5_venue_record", "tg", f"""
with f as (select game_id, side, avg(case when done then case when side = 'home' then (case when sf > sa then 1e0 else 0e0 end)
      else 1e0 - (case when sa > sf then 1e0 else 0e0 end) end end) over (partition by league, team, venue
      order by date, game_id rows between unbounded preceding and 1 preceding) as r from tg),
w as (select game_id, {_sides(['r'])} from f group by game_id)
select game_id, {q('home_r')} as home_venue_win_rate, {q('away_r')} as away_venue_win_rate,
  {q('home_r - away_r')} as venue_win_rate_diff from w""")
def venue_record(t: Tables) -> DataFrame:
    return rounded(history.venue_record(t.games))


_REST = f"""with f as (select game_id, side, case when len(p) > 0 then least(date_diff('day', p[-1].date, date), 30) end as d from past),
w as (select game_id, {_sides(['d'])} from f group by game_id)"""


@query("w6_rest_days", "past", f"""{_REST}
select game_id, cast(home_d as bigint) as home_rest_days, cast(away_d as bigint) as away_rest_days,
  cast(home_d - away_d as bigint) as rest_diff from w""")
def rest_days(t: Tables) -> DataFrame:
    return _rest(t).select(
        "game_id", "home_rest_days", "away_rest_days", "rest_diff")


@query("w7_bye_flags", "past", f"""{_REST}
select game_id, home_had_bye, away_had_bye, home_had_bye - away_had_bye as bye_advantage from (select game_id,
  coalesce(cast(home_d > 11 and home_d <= 20 as int), 0) as home_had_bye,
  coalesce(cast(away_d > 11 and away_d <= 20 as int), 0) as away_had_bye from w)""")
def bye_flags(t: Tables) -> DataFrame:
    return _rest(t).select(
        "game_id", "home_had_bye", "away_had_bye", "bye_advantage")


STATS = ("d", "g", "ho", "i50", "cl", "r50")
define("team_stats", "player_stats", "select mid as game_id, team, " + ", ".join(
    f"coalesce(sum({c}), 0e0) as {c}" for c in STATS) + " from player_stats group by 1, 2")
define("tgs", "tg team_stats", "select t.*, " + ", ".join(f"s.{c}" for c in STATS)
       + " from tg t left join team_stats s on s.game_id = t.game_id and s.team = t.team")


def _stats(t: Tables) -> DataFrame:
    return t.step("team-stats", lambda: rosters.team_totals(t.player_stats, STATS).withColumnRenamed("mid", "game_id"))


def _rolling_stats_sql() -> str:
    lists = ", ".join(f"list_filter(coalesce(list({c}) over w, []), lambda x: x is not null)[-5:] as l_{c}" for c in STATS)
    avgs = ", ".join(f"list_avg(l_{c}) as {c}" for c in STATS)
    outs = ", ".join(f"{q(f'home_{c}')} as home_avg_{c}_5, {q(f'away_{c}')} as away_avg_{c}_5, "
                     f"{q(f'home_{c} - away_{c}')} as avg_{c}_diff_5" for c in STATS)
    return f"""with l as (select game_id, side, {lists} from tgs
      window w as (partition by league, team order by date, game_id rows between unbounded preceding and 1 preceding)),
    f as (select game_id, side, {avgs} from l), w as (select game_id, {_sides(list(STATS))} from f group by game_id)
    select game_id, {outs} from w"""


@query("w8_rolling_stats", "tgs", _rolling_stats_sql())
def rolling_stats(t: Tables) -> DataFrame:
    return rounded(history.rolling_stats(t.games, _stats(t), STATS))


@query("w9_rolling_ratios", "tgs", f"""
with l as (select game_id, side, list_filter(coalesce(list({{'g': g, 'e': i50, 'b': r50}}) over (partition by league, team
    order by date, game_id rows between unbounded preceding and 1 preceding), []), lambda x: x.g is not null)[-5:] as p from tgs),
f as (select game_id, side, list_avg(list_transform(p, lambda x: case when x.e > 0 then x.g / x.e end)) as a,
  list_avg(list_transform(p, lambda x: case when x.g + x.b > 0 then x.g / (x.g + x.b) end)) as b from l),
w as (select game_id, {_sides(['a', 'b'])} from f group by game_id)
select game_id, {q('home_a')} as home_i50_conversion, {q('away_a')} as away_i50_conversion,
  {q('home_b')} as home_kick_accuracy, {q('away_b')} as away_kick_accuracy,
  {q('home_a - away_a')} as i50_conversion_diff_5, {q('home_b - away_b')} as kick_accuracy_diff_5 from w""")
def rolling_ratios(t: Tables) -> DataFrame:
    return rounded(history.rolling_ratios(t.games, _stats(t), behinds="r50"))


# Sequential ratings: one step per game and league, state = list of ratings by team number.
# Unknown teams rate 1500, which mean reversion leaves in place, so one list serves all.
define("rated_games", "contests", """select c.*, h.n_nationkey + 1 as hi, a.n_nationkey + 1 as ai,
    row_number() over (partition by league order by date, game_id) as rn
  from contests c join nation h on h.n_name = home_team join nation a on a.n_name = away_team""")
ELO = """with recursive walk as (
  select league, cast(0 as bigint) as rn, cast(null as int) as season,
    list_transform(range((select max(n_nationkey) + 1 from nation)), lambda x: 1500e0) as r, cast(null as bigint) as game_id,
    cast(null as double) as h, cast(null as double) as a
  from (select distinct league from contests)
  union all
  select league, rn, year, case when move is null then r2 else list_transform(r2, lambda x, i:
      case when i = hi then x + move when i = ai then x - move else x end) end, game_id, r2[hi], r2[ai]
  from (select *, case when home_score is not null and away_score is not null then
        30e0 * ln(greatest(abs(home_score - away_score), 1) + 1) / ln(11e0)
        * ((case when home_score > away_score then 1e0 when home_score = away_score then 0.5e0 else 0e0 end)
           - 1e0 / (1e0 + power(10e0, (r2[ai] - r2[hi] - 30e0) / 400e0))) end as move
    from (select g.league, g.rn, g.year, g.game_id, g.hi, g.ai, g.home_score, g.away_score,
        case when w.season is distinct from g.year then list_transform(w.r, lambda x: x * 0.9e0 + 150e0) else w.r end as r2
      from walk w join rated_games g on g.league = w.league and g.rn = w.rn + 1))),
elo as (select game_id, h as home_elo, a as away_elo from walk where game_id is not null)"""


@query("w14_elo_ratings", "rated_games", f"""{ELO}
select game_id, {q('home_elo')} as home_elo, {q('away_elo')} as away_elo, {q('home_elo - away_elo')} as elo_diff,
  {q('1e0 / (1e0 + power(10e0, (away_elo - home_elo - 30e0) / 400e0))')} as elo_expected from elo""")
def elo_ratings(t: Tables) -> DataFrame:
    return rounded(_elo(t))


def _rated(t: Tables) -> DataFrame:
    rated = lambda: t.games.join(_elo(t).select(
        "game_id", F.col("home_elo").alias("home_rating"), F.col("away_elo").alias("away_rating")), "game_id")
    return t.step("rated", lambda: history.numbered(rated(), per_side=["rating"]), stored=True)


_RATED_ROWS = """, tr as (select t.*, case when side = 'home' then home_elo else away_elo end as rating,
    case when side = 'home' then away_elo else home_elo end as opp from tg t join elo using (game_id))"""


@query("w10_rating_velocity", "rated_games tg", f"""{ELO}{_RATED_ROWS},
f as (select game_id, side, rating - list_filter(coalesce(list(case when done then rating end) over (partition by league, team
    order by date, game_id rows between unbounded preceding and 1 preceding), []), lambda x: x is not null)[-5] as v from tr),
w as (select game_id, {_sides(['v'])} from f group by game_id)
select game_id, {q('home_v')} as home_elo_velocity, {q('away_v')} as away_elo_velocity,
  {q('home_v - away_v')} as elo_velocity_diff from w""")
def rating_velocity(t: Tables) -> DataFrame:
    return rounded(history.rating_velocity(_rated(t)))


@query("w11_schedule_strength", "rated_games tg", f"""{ELO}{_RATED_ROWS},
f as (select game_id, side, avg(opp) over (partition by league, team order by date, game_id
    rows between 5 preceding and 1 preceding) as v from tr), w as (select game_id, {_sides(['v'])} from f group by game_id)
select game_id, {q('home_v')} as home_sos_5, {q('away_v')} as away_sos_5, {q('home_v - away_v')} as sos_diff_5 from w""")
def schedule_strength(t: Tables) -> DataFrame:
    return rounded(history.schedule_strength(_rated(t)))


def _km(prefix: str) -> str:
    la, lo = f"{prefix}.lat", f"{prefix}.lon"
    a = (f"(power(sin(radians(v.lat - {la}) / 2), 2) + cos(radians({la})) * cos(radians(v.lat))"
         f" * power(sin(radians(v.lon - {lo}) / 2), 2))")
    return f"6371e0 * 2 * atan2(sqrt{a}, sqrt(1 - {a}))"


define("travel", "contests team_dim venue_dim", f"""select c.game_id, {_km('h')} as home_km, {_km('a')} as away_km,
    case when v.state is not null and h.state is distinct from v.state then 1 else 0 end as home_interstate,
    case when v.state is not null and a.state is distinct from v.state then 1 else 0 end as away_interstate
  from contests c left join team_dim h on h.team = c.home_team left join team_dim a on a.team = c.away_team
  left join venue_dim v on v.venue = c.venue""")


@query("w12_cumulative_travel", "tg travel", f"""
with f as (select t.game_id, t.side, sum(coalesce(case when side = 'home' then home_km else away_km end, 0e0)) over (
    partition by league, team order by date, t.game_id rows between 3 preceding and 1 preceding) as v
  from tg t join travel r on r.game_id = t.game_id), w as (select game_id, {_sides(['v'])} from f group by game_id)
select game_id, {q('home_v')} as home_cumulative_travel_3, {q('away_v')} as away_cumulative_travel_3,
  {q('home_v - away_v')} as cumulative_travel_diff_3 from w""")
def cumulative_travel(t: Tables) -> DataFrame:
    away = joins.attach_travel(t.games, t.team_dim, t.venue_dim)
    return rounded(history.cumulative_travel(history.numbered(away, per_side=["travel_km"])))


@query("w13_consecutive_away", "tg", f"""
with n as (select *, count(case when side = 'home' then 1 end) over (partition by league, team order by date, game_id
    rows between unbounded preceding and 1 preceding) as g from tg),
f as (select game_id, side, (select count(*) from n m where m.league = n.league and m.team = n.team and m.side = 'away'
    and m.g = n.g and (m.date, m.game_id) < (n.date, n.game_id)) as v from n),
w as (select game_id, {_sides(['v'])} from f group by game_id)
select game_id, home_v as home_consecutive_away, away_v as away_consecutive_away,
  home_v - away_v as consecutive_away_diff from w""")
def consecutive_away(t: Tables) -> DataFrame:
    return history.consecutive_away(_numbered(t))


@query("a4_season_progress", "contests", f"""
select game_id, {q('least(greatest(round / max(round) over (partition by league, year)::double, 0), 1)')} as season_progress
from contests""")
def season_progress(t: Tables) -> DataFrame:
    return rounded(history.season_progress(t.contests, ("league", "year")))


# -- player states and rosters -----------------------------------------------

PLAYER_STATS = ("d", "g", "ho", "i50", "cl", "r50")
define("listed", "player_stats contests", """select c.league, c.date, p.mid as game_id,
    case when p.team = c.home_team then 'home' else 'away' end as side, p.team, p.player,
    coalesce(d, 0) + 6e0 * coalesce(g, 0) + 1.5e0 * coalesce(ho, 0) + 2e0 * coalesce(i50, 0) + 2e0 * coalesce(cl, 0)
      + 1.5e0 * coalesce(r50, 0) as rating, coalesce(d, 0e0) as d, g, ho, i50, cl, r50,
    row_number() over (partition by c.league, p.team, p.player order by c.date, p.mid) as i
  from player_stats p join contests c on c.game_id = p.mid
  where p.mid in (select mid from player_stats group by mid having count(distinct team) = 2)""")
_VALUES = ("rating", *PLAYER_STATS)
# the average written out: weight 0.3 * 0.7^age, the first value without the 0.3
define("states", "listed", "select a.league, a.date, a.game_id, a.side, a.team, a.player, " + ", ".join(
    f"round(sum(case when b.i < a.i then b.{v} * (case when b.i = 1 then 1e0 else 0.3e0 end) * power(0.7e0, a.i - 1 - b.i) end)"
    f" * 1e10) / 1e10 as {v}_before, round(sum(b.{v} * (case when b.i = 1 then 1e0 else 0.3e0 end) * power(0.7e0, a.i - b.i))"
    f" * 1e10) / 1e10 as {v}_after" for v in _VALUES)
    + """ from listed a join listed b on b.league = a.league and b.team = a.team and b.player = a.player and b.i <= a.i
  group by a.league, a.date, a.game_id, a.side, a.team, a.player""")


def _states(t: Tables) -> DataFrame:
    return rosters.player_states(rosters.appearances(t.games, t.player_stats), PLAYER_STATS)


@query("w15_player_rating_ema", "states", f"""select game_id, team, player, {q('rating_before')} as rating_before,
  {q('rating_after')} as rating_after from states""")
def player_rating_ema(t: Tables) -> DataFrame:
    return rounded(_states(t).select("game_id", "team", "player", "rating_before", "rating_after"))


@query("w16_player_stat_ema", "states", "select game_id, team, player, " + ", ".join(
    f"{q(f'{c}_before')} as {c}_before" for c in PLAYER_STATS) + " from states")
def player_stat_ema(t: Tables) -> DataFrame:
    return rounded(_states(t).select("game_id", "team", "player", *[f"{c}_before" for c in PLAYER_STATS]))


def _role_sql(suffix: str) -> str:
    c = {x: f"coalesce({x}_{suffix}, 0)" for x in ("ho", "g", "i50", "cl", "d", "r50")}
    return (f"case when {c['ho']} >= 15 then 'ruck' when {c['g']} >= 1.5 and {c['i50']} >= 3 then 'forward' "
            f"when {c['cl']} >= 3 or {c['d']} >= 25 then 'midfielder' when {c['r50']} >= 3 then 'defender' "
            f"when {c['i50']} >= 3 then 'forward' else 'other' end")


define("team_seq", "states", """select distinct league, team, side, game_id, date,
    dense_rank() over (partition by league, team order by date, game_id) as rn from states""")
define("prev_game", "team_seq", """select n.*, b.game_id as prev_id from team_seq n left join team_seq b
    on b.league = n.league and b.team = n.team and b.rn = n.rn - 1""")
define("now_rows", "prev_game states", f"""select g.game_id, g.side, g.team, g.prev_id, s.player,
    coalesce(rating_before, 0) as rating, {_role_sql('before')} as role
  from prev_game g join states s on s.game_id = g.game_id and s.team = g.team""")
define("prev_rows", "prev_game states", f"""select g.game_id, g.side, g.team, s.player, coalesce(rating_after, 0) as rating,
    coalesce(ho_after, 0) as ho, {_role_sql('after')} as role
  from prev_game g join states s on s.game_id = g.prev_id and s.team = g.team""")
define("missing_rows", "now_rows prev_rows", """select p.* from prev_rows p where not exists (select 1 from now_rows n
    where n.game_id = p.game_id and n.team = p.team and n.player = p.player)""")
define("gained_rows", "now_rows prev_rows", """select n.* from now_rows n where n.prev_id is not null and not exists (
    select 1 from prev_rows p where n.game_id = p.game_id and n.team = p.team and n.player = p.player)""")
define("roster_sides", "prev_game now_rows prev_rows missing_rows gained_rows", """select g.game_id, g.side, g.prev_id is not null as has_prev,
    coalesce(m.n, 0) as outs, coalesce(i.n, 0) as ins, coalesce(p.n, 0) - coalesce(m.n, 0) as cont, coalesce(m.r, 0) as miss,
    coalesce(i.r, 0) - coalesce(m.r, 0) as net, coalesce(m.mid, 0) as m_mid, coalesce(m.fwd, 0) as m_fwd, coalesce(m.def, 0) as m_def,
    n.r as sel, coalesce(n.mid, 0) as s_mid, coalesce(n.fwd, 0) as s_fwd, case when l.ho >= 10 and l.gone then 1 else 0 end as ruck
  from prev_game g
  left join (select game_id, team, count(*) n, sum(rating) r, sum(rating) filter (role = 'midfielder') mid,
      sum(rating) filter (role = 'forward') fwd, sum(rating) filter (role = 'defender') def from missing_rows group by 1, 2) m
    on m.game_id = g.game_id and m.team = g.team
  left join (select game_id, team, count(*) n, sum(rating) r from gained_rows group by 1, 2) i on i.game_id = g.game_id and i.team = g.team
  left join (select game_id, team, count(*) n from prev_rows group by 1, 2) p on p.game_id = g.game_id and p.team = g.team
  left join (select game_id, team, sum(rating) r, sum(rating) filter (role = 'midfielder') mid,
      sum(rating) filter (role = 'forward') fwd from now_rows group by 1, 2) n on n.game_id = g.game_id and n.team = g.team
  left join (select p.game_id, p.team, p.ho, not exists (select 1 from now_rows x where x.game_id = p.game_id and x.team = p.team
        and x.player = p.player) as gone, row_number() over (partition by p.game_id, p.team order by p.ho desc, p.player) as rn
      from prev_rows p) l on l.game_id = g.game_id and l.team = g.team and l.rn = 1""")
define("roster_wide", "roster_sides", "select game_id, bool_and(has_prev) as has_both, " + ", ".join(
    f"max(case when side = '{s}' then {c} end) as {s[0]}_{c}" for s in ("home", "away")
    for c in ("outs", "ins", "cont", "miss", "net", "m_mid", "m_fwd", "m_def", "sel", "s_mid", "s_fwd", "ruck"))
    + " from roster_sides group by game_id")


def _roster(t: Tables) -> DataFrame:
    return t.step("roster", lambda: rosters.roster_features(_states(t), PLAYER_STATS))


@query("w17_roster_changes", "roster_wide", """select game_id, case when has_both then h_outs end::int as home_lineup_changes,
  case when has_both then a_outs end::int as away_lineup_changes, case when has_both then h_outs - a_outs end::int as lineup_changes_diff,
  case when has_both then h_cont - a_cont end::int as lineup_continuity_diff from roster_wide""")
def roster_changes(t: Tables) -> DataFrame:
    return _roster(t).select("game_id", "home_lineup_changes", "away_lineup_changes", "lineup_changes_diff",
                             "lineup_continuity_diff")


@query("w18_specialist_missing", "roster_wide", """select game_id, case when has_both then h_ruck end as home_ruck_missing,
  case when has_both then a_ruck end as away_ruck_missing from roster_wide""")
def specialist_missing(t: Tables) -> DataFrame:
    return _roster(t).select("game_id", "home_ruck_missing", "away_ruck_missing")


@query("w19_absence_quality", "roster_wide", "select game_id, " + ", ".join(
    f"case when has_both then {q(f'h_{c} - a_{c}')} end as {n}_diff" for c, n in (
        ("miss", "missing_rating"), ("net", "net_quality_change"), ("m_mid", "missing_mid_rating"),
        ("m_fwd", "missing_fwd_rating"), ("m_def", "missing_def_rating"))) + " from roster_wide")
def absence_quality(t: Tables) -> DataFrame:
    return rounded(_roster(t).select("game_id", "missing_rating_diff", "net_quality_change_diff",
                                     "missing_mid_rating_diff", "missing_fwd_rating_diff", "missing_def_rating_diff"))


@query("w20_selected_strength", "roster_wide", "select game_id, " + ", ".join(
    f"{q(f'h_{c} - a_{c}')} as selected_{n}_rating_diff" for c, n in (("sel", "total"), ("s_mid", "mid"), ("s_fwd", "fwd")))
    + " from roster_wide")
def selected_strength(t: Tables) -> DataFrame:
    return rounded(_roster(t).select("game_id", "selected_total_rating_diff", "selected_mid_rating_diff",
                                     "selected_fwd_rating_diff"))
