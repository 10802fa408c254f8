"""The derived tables of ``sources.fixtures`` as DuckDB SQL, for the checks."""

_CTE = {
    "contests": ("", """select o.o_orderkey as game_id, c.c_mktsegment as league, o.o_orderdate as date,
  cast(year(o.o_orderdate) as int) as year, cast(month(o.o_orderdate) as int) as round, o.o_orderpriority as venue,
  h.n_name as home_team, a.n_name as away_team,
  case when o.o_orderstatus <> 'P' then cast(floor(l.hs) as int) end as home_score,
  case when o.o_orderstatus <> 'P' then cast(floor(l.as_) as int) end as away_score
from orders o join (select l_orderkey, min(l_suppkey) sk,
    sum(case when l_linenumber % 2 = 1 then l_quantity else 0 end) hs,
    sum(case when l_linenumber % 2 = 0 then l_quantity else 0 end) as_
  from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey
  join customer c on c.c_custkey = o.o_custkey join nation h on h.n_nationkey = c.c_nationkey
  join supplier s on s.s_suppkey = l.sk join nation a on a.n_nationkey = s.s_nationkey
where h.n_name <> a.n_name"""),
    "player_stats": ("contests", """select l_orderkey as mid,
  case when l_linenumber % 2 = 1 then c.home_team else c.away_team end as team,
  concat('P', cast(l_partkey % 40 as varchar(10))) as player,
  sum(case when l_partkey % 11 <> 0 then l_quantity end) as d, sum(floor(l_quantity / 10e0)) as g,
  sum(cast(l_partkey % 25 as double)) as ho, sum(cast(l_suppkey % 9 as double)) as i50,
  sum(cast(l_partkey % 7 as double)) as cl, sum(cast(l_suppkey % 6 as double)) as r50
from lineitem join contests c on c.game_id = l_orderkey where c.home_score is not null
group by 1, 2, 3"""),
    "prices": ("contests", """select game_id, 1e0 / (po * 1.05e0) as home_odds_open,
  1e0 / ((1e0 - po) * 1.05e0) as away_odds_open,
  1e0 / ((po + mv) * 1.04e0) as home_odds_close, 1e0 / ((1e0 - po - mv) * 1.04e0) as away_odds_close,
  (0.5e0 - po) * 60e0 as home_line_close
from (select game_id, 0.1e0 + 0.8e0 * ((game_id * 7919) % 1000) / 1000e0 as po,
    (((game_id * 104729) % 101) - 50) / 1000e0 as mv from contests where game_id % 13 <> 0) p"""),
    "forecasts": ("contests", """select game_id, 0.05e0 + 0.9e0 * ((game_id * 15485863) % 997) / 997e0 as model_prob,
  0.1e0 + 0.8e0 * ((game_id * 32452843) % 991) / 991e0 as alt_prob from contests"""),
    "tips": ("contests", """select c.game_id, s.n_nationkey as source,
  20e0 + (c.game_id * 31 + s.n_nationkey * 17) % 61 as hconfidence
from contests c cross join nation s where s.n_nationkey < 5"""),
    "snapshots": ("", """select user_id as match_id, ts as fetched_at, event_id, 1.2e0 + value % 5e0 as home_odds,
  1.2e0 + (event_id % 37) / 10e0 as away_odds from events"""),
    "team_dim": ("", """select n_name as team, r_name as state, -40e0 + n_nationkey * 1.1e0 as lat,
  110e0 + n_nationkey * 1.7e0 as lon from nation join region on r_regionkey = n_regionkey"""),
    "venue_dim": ("contests", """select venue, -38e0 + rn * 2.3e0 as lat, 115e0 + rn * 6.1e0 as lon, r_name as state,
  case when rn = 1 then 1 else 0 end as roofed
from (select venue, row_number() over (order by venue) as rn from (select distinct venue from contests) v) w
join region on r_regionkey = rn - 1"""),
    "standings": ("contests", """select league, year, round, team, cast(pts as bigint) as pts,
  100e0 * pf / nullif(pa, 0) as percentage,
  cast(row_number() over (partition by league, year, round order by pts desc, team) as int) as rank
from (select league, year, round, team,
    sum(pts) over (partition by league, year, team order by round) as pts,
    sum(pf) over (partition by league, year, team order by round) as pf,
    sum(pa) over (partition by league, year, team order by round) as pa
  from (select league, year, round, team, sum(case when sf > sa then 4 when sf = sa then 2 else 0 end) as pts,
      sum(sf) as pf, sum(sa) as pa
    from (select league, year, round, home_team as team, home_score as sf, away_score as sa from contests
          where home_score is not null
          union all select league, year, round, away_team, away_score, home_score from contests
          where home_score is not null) tg
    where round % 5 <> 0 group by league, year, round, team) m) cum"""),
    "aliases": ("", """select upper(n_name) as alias, n_name as team from nation
union all select concat(n_name, ' FC') as alias, n_name from nation"""),
    # one row per team and game, ``done`` when both scores are known
    "tg": ("contests", """select game_id, league, date, year, round, venue, 'home' as side, home_team as team,
    away_team as opponent, home_score as sf, away_score as sa, home_score is not null and away_score is not null as done
  from contests
  union all select game_id, league, date, year, round, venue, 'away', away_team, home_team, away_score, home_score,
    home_score is not null and away_score is not null from contests"""),
}


def define(name: str, needs: str, sql: str) -> None:
    """Register a further derived table used by several checks."""
    _CTE[name] = (needs, sql)


def with_tables(needs: str, sql: str, recursive: bool = False, materialized: bool = True) -> str:
    """Prefix ``sql`` with the derived tables it names, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in _CTE[name][0].split():
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    head = ",\n".join(f"{n} as {'materialized ' if materialized else ''}({_CTE[n][1]})" for n in order)
    if not head:
        return sql.strip()
    sql = sql.strip()
    joiner = ",\n" if sql.lower().startswith("with ") else "\n"
    if joiner == ",\n":
        sql = sql[5:].lstrip()
        if sql.lower().startswith("recursive "):
            recursive, sql = True, sql[10:]
    return f"with {'recursive ' if recursive else ''}{head}{joiner}{sql}"


def r6(expr: str) -> str:
    """Six decimals, ties moved off the boundary, never a negative zero."""
    return f"(round(({expr}) + 1.2345e-9, 6) + 0e0)"
