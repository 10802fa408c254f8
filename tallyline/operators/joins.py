"""Joins and lookups between contest tables.

No broadcast hints: Spark broadcasts a side only when its measured size is below
``spark.sql.autoBroadcastJoinThreshold``; beyond it the same join is sort-merged
and skewed keys are split by adaptive execution.  Keep-first/keep-last picks are
``min_by``/``max_by`` aggregates, which combine before the shuffle, so a key with
very many rows never gathers in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import scalars as s
from tallyline.operators.history import ORDER
from tallyline.operators.scan import running
from tallyline.staging import stage


# -- one row per key ---------------------------------------------------------

def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return (df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
            .select(*keys, "__row.*").select(*df.columns))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


# -- names -------------------------------------------------------------------

def canonical_names(df: DataFrame, column: str, aliases: DataFrame, out: str, unknown: str = "null") -> DataFrame:
    """Trimmed name -> exact alias -> alias ignoring case -> error, or null to quarantine."""
    exact = aliases.groupBy(F.col("alias").alias("__exact")).agg(F.min("team").alias("__by_name"))
    folded = aliases.groupBy(F.lower("alias").alias("__folded")).agg(
        F.min_by("team", "alias").alias("__by_case"))
    name = F.trim(F.col(column))
    found = (df.join(exact, name == F.col("__exact"), "left")
             .join(folded, F.lower(name) == F.col("__folded"), "left"))
    team = F.coalesce("__by_name", "__by_case")
    if unknown == "error":
        team = F.coalesce(team, F.raise_error(F.concat(F.lit("unknown name: "), name)).cast("string"))
    return found.select(*df.columns, team.alias(out))


def resolve_alias(df: DataFrame, keys: Sequence[str], aliases: DataFrame, value: str, latest_by: str) -> DataFrame:
    """Replace ``value`` by the alias with the same keys, the latest one on a clash; else keep it."""
    latest = aliases.groupBy(*keys).agg(F.max_by("full_name", F.struct(latest_by, "full_name")).alias("__full"))
    return df.join(latest, list(keys), "left").select(
        *[c for c in df.columns if c != value], F.coalesce("__full", value).alias(value))


# -- enrichment --------------------------------------------------------------

def join_distinct(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on several keys against the distinct rows of the right side."""
    return left.join(right.distinct(), list(keys), "left")


def join_on_day(games: DataFrame, prices: DataFrame) -> DataFrame:
    """Left join on calendar day and both teams."""
    left = games.withColumn("__day", F.to_date("date"))
    right = prices.withColumn("__day", F.to_date("date")).drop("date")
    return left.join(right, ["__day", "home_team", "away_team"], "left").drop("__day")


def join_weather(games: DataFrame, weather: DataFrame, roofed: DataFrame) -> DataFrame:
    """Weather of (venue, day), one row each, with the derived flags; gusts and humidity where the table has them."""
    values = [c for c in ("temp_c", "rain_mm", "wind_kmh", "wind_gust_kmh", "humidity") if c in weather.columns]
    once = keep_first(weather.select("venue", "date_str", *values), ["venue", "date_str"], values)
    joined = (games.withColumn("date_str", s.day_key(F.col("date")))
              .join(once, ["venue", "date_str"], "left")
              .join(roofed.where("roofed = 1").select("venue", "roofed").distinct(), "venue", "left"))
    roof = F.coalesce("roofed", F.lit(0))
    return joined.drop("date_str").select(
        *[c for c in joined.columns if c not in ("date_str", "roofed")], roof.alias("is_roofed"),
        s.is_wet(F.col("rain_mm"), roof).alias("is_wet"), s.wind_strong(F.col("wind_kmh")).alias("wind_strong"))


def attach_travel(games: DataFrame, teams: DataFrame, venues: DataFrame) -> DataFrame:
    """Kilometres and interstate flags of both sides; unknown places give null and 0."""
    home = teams.select(F.col("team").alias("home_team"), F.col("state").alias("h_state"),
                        F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon"))
    away = teams.select(F.col("team").alias("away_team"), F.col("state").alias("a_state"),
                        F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    place = venues.select("venue", F.col("state").alias("v_state"), F.col("lat").alias("v_lat"),
                          F.col("lon").alias("v_lon"))
    joined = games.join(home, "home_team", "left").join(away, "away_team", "left").join(place, "venue", "left")

    def km(side: str) -> Column:
        return s.distance_km(F.col(f"{side}_lat"), F.col(f"{side}_lon"), F.col("v_lat"), F.col("v_lon"))

    return joined.select(
        *games.columns, km("h").alias("home_travel_km"), km("a").alias("away_travel_km"),
        (km("h") - km("a")).alias("travel_distance_diff"),
        s.interstate(F.col("h_state"), F.col("v_state")).alias("home_interstate"),
        s.interstate(F.col("a_state"), F.col("v_state")).alias("away_interstate")
    ).withColumn("interstate_diff", F.col("away_interstate") - F.col("home_interstate"))


def attach_home_ground(games: DataFrame, grounds: DataFrame) -> DataFrame:
    """1 when the venue is among the side's grounds (``team``, ``venues`` array)."""
    out = games
    for side in ("home", "away"):
        mine = grounds.select(F.col("team").alias(f"{side}_team"), F.col("venues").alias("__venues"))
        out = out.join(mine, f"{side}_team", "left").withColumn(
            f"{side}_at_home_ground",
            F.coalesce(F.array_contains("__venues", F.col("venue")).cast("int"), F.lit(0))).drop("__venues")
    return out


# -- ordinal pairing ---------------------------------------------------------

def pair_ids(games: DataFrame, team_stats: DataFrame, stats: Sequence[str], order: Sequence[str] = ORDER,
             goals: str | None = None) -> DataFrame:
    """Give the n-th game of a team pair and year the n-th statistics id of that pair and year.

    A year without ids of the pair borrows the pair's first year; every id is used
    once; ids without exactly two team rows are left out.
    """
    pair = F.concat_ws("|", F.least("a", "b"), F.greatest("a", "b"))
    ids = (team_stats.groupBy("mid").agg(F.min("team").alias("a"), F.max("team").alias("b"),
                                         F.count(F.lit(1)).alias("n"), F.min("year").alias("year"))
           .where("n = 2").select("mid", "year", pair.alias("pair")))
    ids = stage(ids, "ids")
    ids_n = running(ids, ["pair", "year"], ["mid"], {"nth": ("count", F.lit(1))})
    years = ids.groupBy("pair", "year").agg(F.min("mid").alias("first_mid"))
    first_year = years.groupBy("pair").agg(F.min_by("year", "first_mid").alias("first_year"))
    slim = games.select("game_id", *[c for c in order if c != "game_id"], "year", F.concat_ws(
        "|", F.least("home_team", "away_team"), F.greatest("home_team", "away_team")).alias("pair"))
    placed = (slim.join(years.select("pair", "year", F.lit(True).alias("own")), ["pair", "year"], "left")
              .join(first_year, "pair")
              .withColumn("source_year", F.when(F.col("own"), F.col("year")).otherwise(F.col("first_year"))))
    nth = running(stage(placed, "placed"), ["pair", "source_year"], list(order), {"nth": ("count", F.lit(1))})
    matched = nth.join(ids_n.withColumnRenamed("year", "source_year"), ["pair", "source_year", "nth"]).select(
        "game_id", "mid")
    out = games.join(matched, "game_id", "left")
    for side in ("home", "away"):
        mine = team_stats.select("mid", F.col("team").alias(f"{side}_team"),
                                 *[F.col(x).alias(f"{side}_{x}") for x in stats])
        out = out.join(mine, ["mid", f"{side}_team"], "left")
    if goals:
        out = out.withColumn("goal_mismatch", F.coalesce(
            (F.col(f"home_{goals}").cast("bigint") != F.col("home_goals").cast("bigint")).cast("int"), F.lit(0)))
    return out


# -- standings as of a round -------------------------------------------------

def standings_as_of(games: DataFrame, standings: DataFrame) -> DataFrame:
    """Rank and percentage of both sides after the latest published round before the game.

    The calendar is one per league and year: the last published round up to R-1,
    else the last one of the year before.  A team missing there gives nulls.
    Only distinct (league, year, round) rows go through the window.
    """
    season = ["league", "year"]
    published = standings.select(*season, "round").distinct()
    wanted = games.select(*season, F.coalesce("round", F.lit(0)).alias("round")).distinct()
    timeline = published.select(*season, F.col("round").alias("at"), F.col("round").alias("published"),
                                F.lit(None).cast("int").alias("round")).unionByName(
        wanted.select(*season, (F.col("round") - 1).alias("at"), F.lit(None).cast("int").alias("published"), "round"))
    upto = Window.partitionBy(*season).orderBy("at", F.desc("published")).rowsBetween(Window.unboundedPreceding, 0)
    in_season = timeline.select(*season, "round", F.last("published", ignorenulls=True).over(upto)
                                .alias("found")).where(F.col("round").isNotNull())
    final = published.groupBy(*season).agg(F.max("round").alias("final"))
    final = final.select("league", (F.col("year") + 1).alias("year"), "final")
    calendar = in_season.join(final, season, "left").select(
        *season, "round",
        F.when((F.col("round") > 1) & F.col("found").isNotNull(), F.col("year")).otherwise(F.col("year") - 1)
        .alias("at_year"),
        F.when((F.col("round") > 1) & F.col("found").isNotNull(), F.col("found")).otherwise(F.col("final"))
        .alias("at_round"))
    out = games.withColumn("__round", F.coalesce("round", F.lit(0))).join(
        calendar.withColumnRenamed("round", "__round"), [*season, "__round"], "left").drop("__round")
    for side in ("home", "away"):
        mine = standings.select("league", F.col("year").alias("at_year"), F.col("round").alias("at_round"),
                                F.col("team").alias(f"{side}_team"), F.col("rank").alias(f"{side}_ladder_rank"),
                                F.col("percentage").alias(f"{side}_percentage"))
        out = out.join(mine, ["league", "at_year", "at_round", f"{side}_team"], "left")
    return out


def ladder_features(df: DataFrame) -> DataFrame:
    """Differences and top-4 / top-8 flags; a missing rank stays missing."""
    home, away = F.col("home_ladder_rank"), F.col("away_ladder_rank")
    return df.select(
        "*", (away - home).alias("ladder_rank_diff"),
        (F.col("home_percentage") - F.col("away_percentage")).alias("percentage_diff"),
        *[s.top_flag(r, n).alias(f"{side}_top{n}") for n in (4, 8) for side, r in (("home", home), ("away", away))])


# -- rosters by lookup -------------------------------------------------------

def roster_of_game(games: DataFrame, by_id: DataFrame, selections: DataFrame) -> DataFrame:
    """Rosters of both sides: by id if complete, else by (year, round, teams), else by teams.

    ``by_id``: game_id, home_roster, away_roster.  ``selections``: year, round
    (null for undated), home_team, away_team, home_roster, away_roster.  Both
    sides must be there, otherwise both are null.
    """
    def both(home: str, away: str) -> Column:
        return (F.coalesce(F.size(home), F.lit(0)) > 0) & (F.coalesce(F.size(away), F.lit(0)) > 0)

    def renamed(df: DataFrame, tag: str) -> DataFrame:
        return df.withColumnRenamed("home_roster", f"h_{tag}").withColumnRenamed("away_roster", f"a_{tag}")

    dated = keep_last(selections.where("round is not null"), ["year", "round", "home_team", "away_team"],
                      ["home_roster"])
    undated = keep_last(selections.where("round is null").drop("year", "round"), ["home_team", "away_team"],
                        ["home_roster"])
    joined = (games.join(renamed(by_id, "id"), "game_id", "left")
              .join(renamed(dated, "sel"), ["year", "round", "home_team", "away_team"], "left")
              .join(renamed(undated, "any"), ["home_team", "away_team"], "left"))

    def first_complete(side: str) -> Column:
        return F.coalesce(*[F.when(both(f"h_{t}", f"a_{t}"), F.col(f"{side}_{t}")) for t in ("id", "sel", "any")])

    return joined.select(*games.columns, first_complete("h").alias("home_roster"),
                         first_complete("a").alias("away_roster"))


def projected_roster(upcoming: DataFrame, official: DataFrame, latest: DataFrame,
                     name: str = "roundname") -> DataFrame:
    """Rosters of the next round: the official one, else each team's latest known one.

    The next round is the earliest by date; other rounds are left out.
    """
    nearest = upcoming.where(F.col(name).isNotNull()).agg(
        F.min_by(name, F.struct("date", "game_id")).alias(name))
    games = upcoming.join(nearest, name, "left_semi")
    out = games.join(official, "game_id", "left")
    for side in ("home", "away"):
        out = out.join(latest.select(F.col("team").alias(f"{side}_team"), F.col("roster").alias(f"__{side}")),
                       f"{side}_team", "left")
    stated = F.col("home_roster").isNotNull() & F.col("away_roster").isNotNull()
    known = F.col("__home").isNotNull() & F.col("__away").isNotNull()
    return out.where(stated | known).select(
        *games.columns, F.when(stated, F.col("home_roster")).otherwise(F.col("__home")).alias("home_roster"),
        F.when(stated, F.col("away_roster")).otherwise(F.col("__away")).alias("away_roster"),
        (~stated).alias("projected"))


# -- results and snapshots ---------------------------------------------------

def with_latest_prediction(results: DataFrame, history: DataFrame) -> DataFrame:
    """Results with the newest prediction snapshot of each game."""
    return results.join(keep_last(history, ["game_id"], ["snapshot_date"]), "game_id", "left")


def explanation_lookup(requests: DataFrame, live: DataFrame, history: DataFrame) -> DataFrame:
    """Exact (game, date) from history, else the live one, else the newest in history."""
    exact = history.select("game_id", F.col("snapshot_date").alias("asked_date"), F.col("body").alias("__exact"))
    newest = history.groupBy("game_id").agg(F.max_by("body", "snapshot_date").alias("__newest"))
    now = live.select("game_id", F.col("body").alias("__live"))
    return (requests.join(exact, ["game_id", "asked_date"], "left").join(now, "game_id", "left")
            .join(newest, "game_id", "left")
            .select(*requests.columns, F.coalesce("__exact", "__live", "__newest").alias("body"),
                    F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__live").isNotNull(), "live")
                    .when(F.col("__newest").isNotNull(), "newest").alias("found")))


def common_sample(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(columns))


def round_list(past: DataFrame, upcoming: DataFrame, name: str = "roundname") -> DataFrame:
    """Distinct rounds, upcoming ones taking precedence, in display order."""
    up = upcoming.where(F.col(name) != "").select(name).distinct()
    old = past.where(F.col(name) != "").select(name).distinct().join(up, name, "left_anti")
    both = old.withColumn("kind", F.lit("past")).unionByName(up.withColumn("kind", F.lit("upcoming")))
    return both.withColumn("sort_key", s.round_sort_key(F.col(name))).orderBy("sort_key", name)


def next_round(upcoming: DataFrame, name: str = "roundname") -> DataFrame:
    """Games of the round that starts first."""
    first = (upcoming.where(F.col(name).isNotNull() & F.col("date").isNotNull())
             .groupBy(name).agg(F.min("date").alias("start"))
             .agg(F.min_by(name, F.struct("start", name)).alias(name)))
    return upcoming.join(first, name, "left_semi")


