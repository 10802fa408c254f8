"""Source, sink and page queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.plans.columns import candidates, price_ranges
from tallyline.plans.ctes import define, r6 as q
from tallyline.plans.registry import Tables, query, rounded
from tallyline.sources import ingest, pages
from tallyline.sources.tables import VersionedTable
from tallyline.staging import new_path

_ORDERS = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderstatus", T.StringType())])


@query("s1_typed_scan", "", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderstatus from orders")
def typed_scan(t: Tables) -> DataFrame:
    return ingest.scan(t.spark, f"{t.sf_dir}/orders.parquet", _ORDERS).select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus")


@query("s2_optional_scan", "", "select o_orderkey, o_custkey, o_orderstatus from orders")
def optional_scan(t: Tables) -> DataFrame:
    there = ingest.scan_optional(t.spark, f"{t.sf_dir}/orders.parquet", _ORDERS)
    missing = ingest.scan_optional(t.spark, f"{t.sf_dir}/no_such_table.parquet", _ORDERS)
    return there.unionByName(missing).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("s3_price_sheet", "contests prices price_ranges", f"""select strftime(c.date, '%Y-%m-%d') as day, case when home_team = 'NATION_3' then 'Third Nation' else home_team end as home_team, case when away_team = 'NATION_3' then 'Third Nation' else away_team end as away_team,
  {q('home_odds_open')} as home_odds_open, case when p.game_id % 10 <> 0 then {q('away_odds_open')} end as away_odds_open, {q('home_line_close')} as home_line_close,
  venue as venue_odds, round >= 11 as is_final_odds, {q('home_odds_min')} as home_odds_min, {q('home_odds_max')} as home_odds_max
from contests c join prices p on p.game_id = c.game_id join price_ranges r on r.game_id = c.game_id""")
def price_sheet(t: Tables) -> DataFrame:
    text = t.games.join(t.prices, "game_id").join(price_ranges(t), "game_id").select(
        F.date_format("date", "yyyy-MM-dd").alias("Date"), F.col("home_team").alias("Home Team"), F.col("away_team").alias("Away Team"),
        F.col("home_odds_open").cast("string").alias("Home Odds Open"),
        F.when(F.col("game_id") % 10 == 0, "n/a").otherwise(F.col("away_odds_open").cast("string")).alias("Away Odds Open"),
        F.col("home_line_close").cast("string").alias("Home Line Close"), F.lit("x").alias("Notes"),
        F.concat(F.lit(" "), "venue").alias("Venue"), F.when(F.col("round") >= 11, "Y").alias("Play Off Game?"),
        F.col("home_odds_min").cast("string").alias("Home Odds Min"), F.col("home_odds_max").cast("string").alias("Home Odds Max"))
    sheet = ingest.normalise_price_sheet(text, {"NATION_3": "Third Nation"})
    return rounded(sheet.select(F.date_format("date", "yyyy-MM-dd").alias("day"), "home_team", "away_team",
                                "home_odds_open", "away_odds_open", "home_line_close", "venue_odds", "is_final_odds", "home_odds_min", "home_odds_max"))


# two bookmakers per snapshot; the second knows no line for some, and names a stranger
define("quotes", "snapshots", """
  select match_id, event_id, 0 as book, 'h2h' as market, 'home' as side, home_odds as price, cast(null as double) as point from snapshots
  union all select match_id, event_id, 0, 'h2h', 'away', away_odds, null from snapshots
  union all select match_id, event_id, 1, 'h2h', 'home', home_odds + 0.05e0, null from snapshots
  union all select match_id, event_id, 1, 'spreads', 'home', 1.9e0, (event_id % 41 - 20) / 2e0 from snapshots where event_id % 7 <> 0
  union all select match_id, event_id, 1, 'spreads', 'away', 1.9e0, -(event_id % 41 - 20) / 2e0 from snapshots where event_id % 7 <> 0""")


def quote_payloads(t: Tables) -> DataFrame:
    """Every snapshot as a nested quote document."""
    def outcome(name: str, price, point=None):
        return F.struct(F.lit(name).alias("name"), price.cast("double").alias("price"),
                        (F.lit(None) if point is None else point).cast("double").alias("point"))

    e = F.col("event_id")
    line = F.when(e % 7 != 0, (e % 41 - 20) / 2.0)
    first = F.struct(F.array(F.struct(F.lit("h2h").alias("key"), F.array(
        outcome("H", F.col("home_odds")), outcome("A", F.col("away_odds"))).alias("outcomes"))).alias("markets"))
    second = F.struct(F.array(
        F.struct(F.lit("h2h").alias("key"), F.array(outcome("H", F.col("home_odds") + 0.05), outcome("X", F.lit(3.0))).alias("outcomes")),
        F.struct(F.lit("spreads").alias("key"), F.array(outcome("H", F.lit(1.9), line), outcome("A", F.lit(1.9), -line)).alias("outcomes"))
    ).alias("markets"))
    doc = F.struct(F.lit("H").alias("home_team"), F.lit("A").alias("away_team"), F.col("fetched_at").cast("string").alias("commence_time"),
                   F.array(first, second).alias("bookmakers"))
    return t.snapshots.select("match_id", "event_id", F.to_json(doc).alias("payload"))


def quotes(t: Tables) -> DataFrame:
    return ingest.flatten_quotes(quote_payloads(t), "payload", ["match_id", "event_id"])


@query("s4_flatten_quotes", "quotes", f"select match_id, event_id, book, market, side, {q('price')} as price, {q('point')} as point from quotes")
def flatten_quotes(t: Tables) -> DataFrame:
    return rounded(quotes(t))


@query("s5_page_headings", "", """select page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') as title,
  regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g') as heading from pages""")
def page_headings(t: Tables) -> DataFrame:
    return pages.headings(t.raw("pages"))


# score pages written from the games, with quarter scores that add up
_GB = "(game_id % {m} + {i}) || '.' || (game_id % {n} + {i})"


def _line_sql(team: str, final: str, m: int, n: int) -> str:
    quarters = " || '  ' || ".join(_GB.format(m=m, n=n, i=i) for i in (1, 2, 3, 4))
    return f"{team} || chr(160) || ' ' || {quarters} || chr(160) || {final}"


def _points_sql(m: int, n: int, i: int) -> str:
    return f"cast((game_id % {m} + {i}) * 6 + game_id % {n} + {i} as int)"


@query("s5_score_records", "contests", "select game_id as page_id, cast(year * 10 as int) as attendance, venue, home_team, "
       + ", ".join(f"{_points_sql(5, 7, i)} as home_q{i}" for i in (1, 2, 3, 4)) + ", home_score as home_final_score, away_team, "
       + ", ".join(f"{_points_sql(4, 9, i)} as away_q{i}" for i in (1, 2, 3, 4)) + ", away_score as away_final_score, "
       "strftime(date, '%a %d-%b-%Y') as date from contests where home_score is not null")
def score_records(t: Tables) -> DataFrame:
    """Page text is composed from the games and read back."""
    g = F.col("game_id")

    def line(team: str, final: str, m: int, n: int):
        quarters = [F.concat((g % m + i).cast("string"), F.lit("."), (g % n + i).cast("string")) for i in (1, 2, 3, 4)]
        return F.concat(F.col(team), F.lit("  "), F.concat_ws("  ", *quarters), F.lit(" "), F.col(final).cast("string"))

    text = F.concat_ws("\n", F.lit("Round 4"), line("home_team", "home_score", 5, 7), F.concat(F.lit("Att: "), F.format_number(F.col("year") * 10, 0)),
                       F.concat(F.lit("Venue: "), "venue"), F.date_format("date", "EEE dd-MMM-yyyy"), line("away_team", "away_score", 4, 9))
    return pages.match_records(t.contests.select(g.alias("page_id"), text.alias("text")))


@query("s6_link_ids", "", """
with x as (select page_id, unnest(hs) as h, generate_subscripts(hs, 1) - 1 as pos
  from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as hs from pages))
select page_id, regexp_extract(h, '/([a-z]+)$', 1) as link_id, cast(min(pos) as int) as first_pos from x
where regexp_extract(h, '/([a-z]+)$', 1) <> '' group by 1, 2""")
def link_ids(t: Tables) -> DataFrame:
    return pages.link_ids(t.raw("pages"), r"/([a-z]+)$")


@query("s7_item_rows", "", """
with x as (select page_id, unnest(i) as raw, generate_subscripts(i, 1) - 1 as pos from (select page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1, 's') as i from pages)),
y as (select page_id, cast(pos as int) as pos, trim(regexp_replace(raw, '<[^>]*>', '', 'g')) as item from x)
select page_id, pos, item from y where item <> '' and upper(item) not in ('TOTAL', 'TOTALS')""")
def item_rows(t: Tables) -> DataFrame:
    return pages.item_rows(t.raw("pages"))


@query("s7_table_rows", "player_stats", f"select mid as page_id, team, player, {q('g')} as g, {q('ho')} as ho from player_stats where player not in ('P7')")
def table_rows(t: Tables) -> DataFrame:
    """Statistic tables are composed from the player rows and read back; P7 plays the total row."""
    def cell(c):
        return F.concat(F.lit("<td>"), c, F.lit("</td>"))

    name = F.when(F.col("player") == "P7", "Totals").otherwise(F.concat("player", F.lit(" ↗")))
    row = F.concat(F.lit("<tr>"), cell(name), cell(F.col("g").cast("string")), cell(F.col("ho").cast("string")), F.lit("</tr>"))
    html = F.concat(F.lit("<table><tr><th>Player</th><th>G</th><th>HO</th></tr><tr><td>short row</td></tr>"), row, F.lit("</table>"))
    table = t.player_stats.select(F.struct("mid", "team").alias("page_id"), html.alias("html"))
    return rounded(pages.table_rows(table, ["Player", "G", "HO"]).select(
        F.col("page_id.mid").alias("page_id"), F.col("page_id.team").alias("team"), F.col("Player").alias("player"),
        F.col("G").try_cast("double").alias("g"), F.col("HO").try_cast("double").alias("ho")))


@query("s7_attributed_items", "", """
with x as (select page_id, unnest(i) as raw, generate_subscripts(i, 1) - 1 as pos from (select page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1, 's') as i from pages)),
y as (select page_id, cast(pos as int) as pos, trim(regexp_replace(raw, '<[^>]*>', '', 'g')) as item from x)
select page_id, pos, item from y where item <> '' and upper(item) not in ('TOTAL', 'TOTALS')""")
def attributed_items(t: Tables) -> DataFrame:
    """The given pages with attributes on every item, every second end tag left out, and tags in comments and scripts."""
    html = F.regexp_replace("html", "<li>", """<LI class='n' data-x="a > b" >""")
    html = F.when(F.col("page_id") % 2 == 0, F.regexp_replace(html, "</li>", "")).otherwise(html)
    html = F.regexp_replace(html, "</ul>", "<!-- <li>no item</li> --></ul><script>var s = '<ul><li>no item</li></ul>';</script>")
    return pages.item_rows(t.raw("pages").select("page_id", html.alias("html")))


@query("s7_nested_tables", "player_stats", f"""
select mid, cast(row_number() over (partition by mid order by team, player) as int) as n, team, player, {q('g')} as g, {q('ho')} as ho from player_stats where player not in ('P7')""")
def nested_tables(t: Tables) -> DataFrame:
    """One page per match: a table per side inside the cells of a layout table, attributes everywhere, end tags missing."""
    cells = [F.concat(F.lit("<a href='/p?x=1>2'>"), "player", F.lit(" ↗</a>")), F.concat(F.lit("<b>"), F.col("g").cast("string"), F.lit("</b>")), F.col("ho").cast("string")]
    cells[0] = F.when(F.col("player") == "P7", "Totals").otherwise(cells[0])
    row = F.concat(F.lit('<tr class="r" data-t="<td>">'), *[x for i, c in enumerate(cells) for x in (F.lit(f'<td width={i} align="right">'), c)])
    side = t.player_stats.groupBy("mid", "team").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<!--"), "player", F.lit("-->"), row))), "\n").alias("rows"))
    table = F.concat(F.lit("<td valign=top>"), "team", F.lit("<TABLE border=0><tr><th>Player<th>G<th>HO"), "rows", F.lit("</TABLE></td>"))
    page = side.groupBy("mid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("team", table.alias("x")))), lambda r: r["x"]), "").alias("x"))
    html = F.concat(F.lit("<table id='layout'><tr>"), "x", F.lit("</tr><tr><td colspan=2>Totals</table>"))
    rows = pages.titled_rows(page.select(F.col("mid").alias("page_id"), html.alias("html")), "Player")
    sides = page.select(F.col("mid").alias("page_id")).join(side.select(F.col("mid").alias("page_id"), "team"), "page_id")
    order = Window.partitionBy("page_id").orderBy("team")
    teams = sides.select("page_id", "team", F.row_number().over(order).alias("table"))  # table 0 is the layout
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("table", "pos")).alias("n")
    found = rows.join(teams, ["page_id", "table"]).select(F.col("page_id").alias("mid"), n, "team", *[F.col("values")[c].alias(c) for c in ("Player", "G", "HO")])
    return rounded(found.select("mid", "n", "team", F.col("Player").alias("player"), F.col("G").try_cast("double").alias("g"), F.col("HO").try_cast("double").alias("ho")))


@query("s5_score_tables", "contests", "select game_id // 64 as page_id, cast(year * 10 as int) as attendance, venue, home_team, "
       + ", ".join(f"{_points_sql(5, 7, i)} as home_q{i}" for i in (1, 2, 3, 4)) + ", home_score as home_final_score, away_team, "
       + ", ".join(f"{_points_sql(4, 9, i)} as away_q{i}" for i in (1, 2, 3, 4)) + ", away_score as away_final_score, "
       "strftime(date, '%a %d-%b-%Y') as date from contests where home_score is not null")
def score_tables(t: Tables) -> DataFrame:
    """Pages that list many matches, each a table with attributes."""
    g = F.col("game_id")

    def line(team: str, final: str, m: int, n: int, rest) -> Column:
        quarters = [F.concat((g % m + i).cast("string"), F.lit("."), (g % n + i).cast("string")) for i in (1, 2, 3, 4)]
        cells = [F.concat(F.lit("<b>"), F.col(team), F.lit("</b>")), F.concat_ws("&nbsp;".replace("&nbsp;", "\u00a0"), *quarters), F.col(final).cast("string"), rest]
        return F.concat(F.lit("<tr bgcolor='#eee'>"), *[x for c in cells for x in (F.lit('<td style="a>b">'), c, F.lit("</td>"))])

    when = F.concat(F.date_format("date", "EEE dd-MMM-yyyy"), F.lit(" Att: "), F.format_number(F.col("year") * 10, 0))
    table = F.concat(F.lit("<table class=m>"), line("home_team", "home_score", 5, 7, when), line("away_team", "away_score", 4, 9, F.lit("won")),
                     F.lit("<tr><td>Venue: "), "venue", F.lit("</table><br>"))
    done = t.contests.where("home_score is not null")
    page = done.groupBy(F.floor(g / 64).alias("page_id")).agg(F.array_join(F.sort_array(F.collect_list(table)), "").alias("html"))
    return pages.table_records(page).drop("table")


@query("s8_selection_rows", "contests player_stats", """
with p as (select c.year, c.round, s.team, s.player, cast(substr(s.player, 2) as int) % 5 as k from player_stats s join contests c on c.game_id = s.mid)
select distinct year, round, team, player, case when k = 4 then 'emergency' else 'selected' end as type from p""")
def selection_rows(t: Tables) -> DataFrame:
    kind = F.substring("player", 2, 9).cast("int") % 5
    rows = t.player_stats.groupBy("mid", "team").agg(
        F.collect_set(F.when(kind < 3, F.col("player"))).alias("positions"),
        F.collect_set(F.when((kind == 2) | (kind == 3), F.col("player"))).alias("interchange"),
        F.collect_set(F.when(kind == 4, F.col("player"))).alias("emergencies"))
    out = t.games.select(F.col("game_id").alias("mid"), "year", "round", "home_team", "away_team")
    for side in ("home", "away"):
        out = out.join(rows.select("mid", F.col("team").alias(f"{side}_team"), *[
            F.col(c).alias(f"{side}_{c}") for c in ("positions", "interchange", "emergencies")]), ["mid", f"{side}_team"], "left")
    return ingest.selections_long(out).distinct()


@query("s9_append_history", "snapshots", f"select match_id, event_id, {q('home_odds')} as home_odds from snapshots")
def append_history(t: Tables) -> DataFrame:
    """Two appends of disjoint halves make the whole history."""
    history = VersionedTable(t.spark, new_path(t.spark, "history"))
    for half in (0, 1):
        history.append(t.snapshots.where(F.col("event_id") % 2 == half).select("match_id", "event_id", "home_odds"))
    return rounded(history.read())


@query("s10_overwrite", "bets", f"select game_id, bet_side, {q('edge')} as edge from bets")
def overwrite(t: Tables) -> DataFrame:
    """An empty table keeps its schema; a second version replaces it, and a third is made from the second."""
    value_bets = VersionedTable(t.spark, new_path(t.spark, "value-bets"))
    bets = candidates(t).select("game_id", "bet_side", "edge")
    value_bets.overwrite(bets.where(F.lit(False)))
    value_bets.overwrite(value_bets.read().unionByName(bets))
    value_bets.overwrite(value_bets.read())
    return rounded(value_bets.read())
