"""Player ratings and roster change features.

``appearances`` (one row per listed player and team game) carry the state a
player had before the game and leaves after it.  A team's previous roster is
the one of its last done game with both rosters known, so the ratings of its
players as of now are simply the states left by that game: no as-of search.
Rosters are short lists by nature (one team's players in one game).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import scalars as s
from tallyline.operators.history import ORDER, TEAM, by_game, team_games
from tallyline.operators.scan import ema, last_n, running
from tallyline.staging import stage

ALPHA = 0.3
# fixed values: weights of the composite score
SCORE_WEIGHTS = {"d": 1.0, "g": 6.0, "m": 1.5, "t": 2.0, "ho": 1.5, "i50": 2.0, "cl": 2.0, "cg": 1.5, "r50": 1.5,
                 "ff": 1.0, "fa": -1.0}
ROLE_STATS = ("d", "g", "m", "t", "ho", "i50", "cl", "cg", "r50")
SPECIALIST_FLOOR = 10.0


def roster_sets(player_stats: DataFrame) -> DataFrame:
    return player_stats.groupBy("mid", "team").agg(F.array_sort(F.collect_set("player")).alias("roster"))


def latest_rosters(player_stats: DataFrame) -> DataFrame:
    """Players of the highest id of each team; the id is found first, so only its rows are gathered."""
    last = player_stats.groupBy("team").agg(F.max("mid").alias("mid"))
    return (player_stats.join(last, ["team", "mid"], "left_semi").groupBy("team")
            .agg(F.array_sort(F.collect_set("player")).alias("roster")))


def team_totals(player_stats: DataFrame, stats: Sequence[str], keys: Sequence[str] = ("mid", "team")) -> DataFrame:
    """Sums per team and game; all-missing sums to 0."""
    return player_stats.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in stats])


def appearances(games: DataFrame, player_stats: DataFrame) -> DataFrame:
    """Player rows of games in which both sides have a roster, with game order and ``done``."""
    sides = team_games(games).select("game_id", *(c for c in ("league", "date") if c in games.columns),
                                     "done", "side", "team")
    listed = player_stats.withColumnRenamed("mid", "game_id")
    complete = (listed.groupBy("game_id").agg(F.min("team").alias("a"), F.max("team").alias("b"))
                .where("a <> b").select("game_id"))
    return sides.join(listed, ["game_id", "team"]).join(complete, "game_id", "left_semi")


def player_states(rows: DataFrame, stats: Sequence[str] = ROLE_STATS, alpha: float = ALPHA) -> DataFrame:
    """Smoothed score and statistics per (player, team), before and after each appearance."""
    stats = [c for c in stats if c in rows.columns]
    weights = {c: w for c, w in SCORE_WEIGHTS.items() if c in rows.columns}
    scored = rows.select("*", s.weighted_score(weights).alias("score"))
    keys = (*TEAM, "player")
    counted = running(stage(scored, "appearances"), keys, ORDER, {"k": ("count", F.when(F.col("done"), 1))})
    values = {"rating": F.col("score"), **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in stats}}
    return ema(counted, keys, "k", F.col("done"), values, alpha)


def _state(suffix: str, stats: Sequence[str]) -> Column:
    def stat(name: str) -> Column:
        return F.col(f"{name}_{suffix}") if name in stats else F.lit(0.0)

    role = s.role(*[stat(x) for x in ("ho", "g", "i50", "cl", "d", "r50")])
    return F.struct(F.col("player").alias("player"), F.coalesce(f"rating_{suffix}", F.lit(0.0)).alias("rating"),
                    F.coalesce(stat("ho"), F.lit(0.0)).alias("ho"), role.alias("role"))


def _total(people: Column, role: str | None = None) -> Column:
    kept = people if role is None else F.filter(people, lambda p: p["role"] == role)
    return F.aggregate(kept, F.lit(0.0), lambda acc, p: acc + p["rating"])


def _without(people: Column, names: Column) -> Column:
    return F.filter(people, lambda p: ~F.array_contains(names, p["player"]))


def roster_features(states: DataFrame, stats: Sequence[str] = ROLE_STATS) -> DataFrame:
    """Changes, specialist missing, quality of absences and selected strength, per game."""
    stats = [c for c in stats if f"{c}_before" in states.columns]
    teams = states.groupBy("game_id", "league", "date", "done", "side", "team").agg(
        F.array_sort(F.collect_list(_state("before", stats))).alias("now"),
        F.array_sort(F.collect_list(F.when(F.col("done"), _state("after", stats)))).alias("left"))
    teams = running(stage(teams, "rosters"), TEAM, ORDER, {"k": ("count", F.when(F.col("done"), 1))})
    teams = last_n(teams, TEAM, "k", F.col("done"), 1, lambda frame: {
        "prev": F.last(F.when(F.col("done"), F.col("left")), ignorenulls=True).over(frame(1))})
    # each list is a column of its own, so it is built once for all sums over it
    named = teams.select("game_id", "side", "now", "prev",
                         *[F.transform(c, lambda p: p["player"]).alias(f"{c}_names") for c in ("now", "prev")])
    now, prev, now_names, prev_names = (F.col(c) for c in ("now", "prev", "now_names", "prev_names"))
    moved = named.select("*", _without(prev, now_names).alias("missing"), _without(now, prev_names).alias("gained"))
    missing, gained = F.col("missing"), F.col("gained")
    # highest hit-out average of the previous roster; the first name on a tie
    lead = F.aggregate(prev, F.struct(F.lit("").alias("player"), F.lit(0.0).alias("ho")), lambda best, p: F.when(
        p["ho"] > best["ho"], F.struct(p["player"].alias("player"), p["ho"].alias("ho"))).otherwise(best))
    one = moved.select(
        "game_id", "side",
        F.size(F.array_except(prev_names, now_names)).alias("lineup_changes"),
        F.size(F.array_except(now_names, prev_names)).alias("lineup_ins"),
        F.size(F.array_intersect(prev_names, now_names)).alias("lineup_continuity"),
        ((lead["ho"] >= SPECIALIST_FLOOR) & ~F.array_contains(now_names, lead["player"])).cast("int")
        .alias("ruck_missing"),
        _total(missing).alias("missing_rating"),
        (_total(gained) - _total(missing)).alias("net_quality_change"),
        *[_total(missing, role).alias(f"missing_{tag}_rating")
          for role, tag in (("midfielder", "mid"), ("forward", "fwd"), ("defender", "def"))],
        _total(now).alias("selected_total_rating"),
        *[_total(now, role).alias(f"selected_{tag}_rating")
          for role, tag in (("midfielder", "mid"), ("forward", "fwd"))],
        prev.isNotNull().cast("int").alias("has_prev"))
    names = [c for c in one.columns if c not in ("game_id", "side")]
    wide = by_game(one, names)
    both = (F.col("home_has_prev") == 1) & (F.col("away_has_prev") == 1)

    def diff(name: str, out: str | None = None, guarded: bool = True) -> Column:
        d = F.col(f"home_{name}") - F.col(f"away_{name}")
        return (F.when(both, d) if guarded else d).alias(out or f"{name}_diff")

    return wide.select(
        "game_id", *[F.when(both, F.col(f"{side}_{n}")).alias(f"{side}_{n}")
                     for n in ("lineup_changes", "ruck_missing") for side in ("home", "away")],
        *[diff(n) for n in ("lineup_changes", "lineup_continuity", "missing_rating", "net_quality_change",
                            "missing_mid_rating", "missing_fwd_rating", "missing_def_rating")],
        *[diff(n, guarded=False) for n in ("selected_total_rating", "selected_mid_rating", "selected_fwd_rating")])
