"""Leak-free history features: a row reads only rows before it in game order.

Game order is ``(date, game_id)``.  A game is *done* when both scores are known;
upcoming games read history and never write it.  Functions return one row per
game with ``home_*`` / ``away_*`` columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.operators.scan import last_n, running
from tallyline.staging import stage

ORDER = ("date", "game_id")
TEAM = ("league", "team")


def is_done() -> Column:
    return F.col("home_score").isNotNull() & F.col("away_score").isNotNull()


def team_games(games: DataFrame, per_side: Iterable[str] = ()) -> DataFrame:
    """Two rows per game, seen from each team; ``per_side`` names x for home_x/away_x pairs."""
    per_side = list(per_side)

    def view(side: str, other: str) -> Column:
        return F.struct(
            F.lit(side).alias("side"), F.col(f"{side}_team").alias("team"), F.col(f"{other}_team").alias("opponent"),
            F.col(f"{side}_score").alias("sf"), F.col(f"{other}_score").alias("sa"),
            *[c for x in per_side for c in (F.col(f"{side}_{x}").alias(x), F.col(f"{other}_{x}").alias(f"opponent_{x}"))])

    shared = [c for c in ("game_id", "league", "date", "year", "round", "venue") if c in games.columns]
    return (games.select(*shared, is_done().alias("done"),
                         F.explode(F.array(view("home", "away"), view("away", "home"))).alias("s"))
            .select(*shared, "done", "s.*"))


def by_game(team_rows: DataFrame, names: Sequence[str], diffs: dict[str, str] | None = None) -> DataFrame:
    """Put team rows back side by side; ``diffs`` maps output name -> column for home minus away."""
    wide = team_rows.groupBy("game_id").agg(*[
        F.max(F.when(F.col("side") == side, F.col(n))).alias(f"{side}_{n}")
        for n in names for side in ("home", "away")])
    return wide.select("*", *[(F.col(f"home_{n}") - F.col(f"away_{n}")).alias(out)
                              for out, n in (diffs or {}).items()])


def numbered(games: DataFrame, per_side: Iterable[str] = ()) -> DataFrame:
    """Team rows with ``k`` done games before, ``seq`` games before, and the last done date (stored)."""
    rows = team_games(games, per_side)
    return stage(running(rows, TEAM, ORDER, {
        "k": ("count", F.when(F.col("done"), 1)),
        "seq": ("count", F.lit(1)),
        "last_played": ("max", F.when(F.col("done"), F.col("date"))),
    }), "team-games")


def rolling_form(team_rows: DataFrame, windows: Sequence[int] = (5, 10), volatility: int = 5) -> DataFrame:
    """Win rate, margin, scores for and against over the last n done games; margin spread."""
    done = F.col("done")
    base = {
        "win_rate": F.when(done, (F.col("sf") > F.col("sa")).cast("double")),
        "avg_margin": F.when(done, (F.col("sf") - F.col("sa")).cast("double")),
        "avg_score_for": F.when(done, F.col("sf").cast("double")),
        "avg_score_against": F.when(done, F.col("sa").cast("double")),
    }

    def build(frame):
        out = {f"{name}_{n}": F.avg(value).over(frame(n)) for n in windows for name, value in base.items()}
        out["margin_volatility"] = F.stddev_samp(base["avg_margin"]).over(frame(volatility))
        return out

    rows = last_n(team_rows, TEAM, "k", done, max(*windows, volatility), build)
    names = [f"{name}_{n}" for n in windows for name in base] + ["margin_volatility"]
    short = {"win_rate": "win_rate_diff", "avg_margin": "avg_margin_diff",
             "avg_score_for": "score_for_diff", "avg_score_against": "score_against_diff"}
    diffs = {f"{short[name]}_{n}": f"{name}_{n}" for n in windows for name in base}
    diffs[f"margin_volatility_diff_{volatility}"] = "margin_volatility"
    return by_game(rows, names, diffs)


def form_streak(team_rows: DataFrame) -> DataFrame:
    """Signed run of equal results before the game; 0 after a draw, null without history."""
    margin = F.col("sf") - F.col("sa")
    rows = running(team_rows, TEAM, ORDER, {
        "last_win": ("max", F.when(margin > 0, F.col("k"))),
        "last_loss": ("max", F.when(margin < 0, F.col("k"))),
        "last_draw": ("max", F.when(margin == 0, F.col("k"))),
    })
    latest, none = F.col("k") - 1, F.lit(-1).cast("bigint")

    def run(stop_a: str, stop_b: str) -> Column:
        return latest - F.greatest(F.col(stop_a), F.col(stop_b), none)

    streak = (F.when(F.col("k") == 0, None)
              .when(F.col("last_win") == latest, run("last_loss", "last_draw"))
              .when(F.col("last_loss") == latest, -run("last_win", "last_draw"))
              .otherwise(0).cast("bigint"))
    return by_game(rows.withColumn("form_streak", streak), ["form_streak"], {"form_streak_diff": "form_streak"})


def head_to_head(games: DataFrame, meetings: int = 10) -> DataFrame:
    """Share of the last decided meetings won by the current home team, and their number."""
    home_first = F.col("home_team") < F.col("away_team")
    margin = F.col("home_score") - F.col("away_score")
    pairs = games.select(
        "game_id", "league", "date", home_first.alias("home_first"),
        F.concat_ws("|", F.least("home_team", "away_team"), F.greatest("home_team", "away_team")).alias("pair"),
        F.when(margin != 0, ((margin > 0) == home_first).cast("double")).alias("first_won"))
    decided = F.col("first_won").isNotNull()
    counted = running(pairs, ("league", "pair"), ORDER, {"k": ("count", F.when(decided, 1))})
    rows = last_n(counted, ("league", "pair"), "k", decided, meetings, lambda frame: {
        "rate": F.avg("first_won").over(frame(meetings)),
        "h2h_meetings": F.count("first_won").over(frame(meetings)),
    })
    return rows.select("game_id", F.when(F.col("home_first"), F.col("rate")).otherwise(1.0 - F.col("rate"))
                       .alias("h2h_home_win_rate"), "h2h_meetings")


def venue_record(games: DataFrame) -> DataFrame:
    """Win rate of each team at the venue so far.  A draw counts as a win of the away side."""
    rows = team_games(games).withColumn("venue", F.coalesce("venue", F.lit("")))
    home_win = (F.col("sf") > F.col("sa")).cast("int")
    won = F.when(F.col("side") == "home", home_win).otherwise(1 - (F.col("sa") > F.col("sf")).cast("int"))
    rows = running(rows, ("league", "team", "venue"), ORDER, {
        "wins": ("sum", F.when(F.col("done"), won)), "n": ("count", F.when(F.col("done"), 1))})
    rows = rows.withColumn("venue_win_rate", F.try_divide(F.col("wins").cast("double"), F.col("n").cast("double")))
    return by_game(rows, ["venue_win_rate"], {"venue_win_rate_diff": "venue_win_rate"})


def rest_days(team_rows: DataFrame, cap: int = 30, bye: tuple[int, int] = (11, 20)) -> DataFrame:
    """Whole days since the last done game (capped), bye flags and their differences."""
    elapsed = F.floor((F.unix_micros(F.col("date").cast("timestamp"))
                       - F.unix_micros(F.col("last_played").cast("timestamp"))) / F.lit(86_400_000_000))
    # a missing value stays missing: least() alone would return the cap
    days = F.when(F.col("last_played").isNotNull(), F.least(elapsed, F.lit(cap))).cast("bigint")
    wide = by_game(team_rows.withColumn("rest_days", days), ["rest_days"], {"rest_diff": "rest_days"})

    def had_bye(side: str) -> Column:
        d = F.col(f"{side}_rest_days")
        return F.coalesce(((d > bye[0]) & (d <= bye[1])).cast("int"), F.lit(0))

    return (wide.withColumn("home_had_bye", had_bye("home")).withColumn("away_had_bye", had_bye("away"))
            .withColumn("bye_advantage", F.col("home_had_bye") - F.col("away_had_bye")))


def rolling_stats(games: DataFrame, team_stats: DataFrame, stats: Sequence[str], n: int = 5) -> DataFrame:
    """Mean of each statistic over the team's last n games in which that statistic is known."""
    rows = team_games(games).select("game_id", "league", "date", "side", "team")
    rows = rows.join(team_stats.select("game_id", "team", *stats), ["game_id", "team"], "left")
    long = rows.select("game_id", "league", "date", "side", "team", F.explode(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in stats])).alias("v")
    ).select("game_id", "league", "date", "side", "team", "v.*")
    known = F.col("value").isNotNull()
    keys = ("league", "team", "stat")
    long = stage(running(stage(long, "team-stats"), keys, ORDER, {"k": ("count", F.when(known, 1))}), "counted")
    long = last_n(long, keys, "k", known, n, lambda frame: {"mean": F.avg("value").over(frame(n))})
    wide = long.groupBy("game_id").agg(*[
        F.max(F.when((F.col("side") == side) & (F.col("stat") == s), F.col("mean"))).alias(f"{side}_avg_{s}_{n}")
        for s in stats for side in ("home", "away")])
    return wide.select("*", *[(F.col(f"home_avg_{s}_{n}") - F.col(f"away_avg_{s}_{n}")).alias(f"avg_{s}_diff_{n}")
                              for s in stats])


def rolling_ratios(games: DataFrame, team_stats: DataFrame, n: int = 5, goals: str = "g", entries: str = "i50",
                   behinds: str = "b") -> DataFrame:
    """Goals per entry and per shot, averaged over the last n games with known goals."""
    rows = team_games(games).select("game_id", "league", "date", "side", "team")
    rows = rows.join(team_stats.select(
        "game_id", "team", F.col(goals).cast("double").alias("g"), F.col(entries).cast("double").alias("e"),
        F.col(behinds).cast("double").alias("b")), ["game_id", "team"], "left")
    known = F.col("g").isNotNull()
    shots = F.col("g") + F.col("b")
    rows = running(stage(rows, "team-ratios"), TEAM, ORDER, {"k": ("count", F.when(known, 1))})
    rows = last_n(rows, TEAM, "k", known, n, lambda frame: {
        "i50_conversion": F.avg(F.when(F.col("e") > 0, F.col("g") / F.col("e"))).over(frame(n)),
        "kick_accuracy": F.avg(F.when(shots > 0, F.col("g") / shots)).over(frame(n)),
    })
    return by_game(rows, ["i50_conversion", "kick_accuracy"],
                   {f"i50_conversion_diff_{n}": "i50_conversion", f"kick_accuracy_diff_{n}": "kick_accuracy"})


def rating_velocity(team_rows: DataFrame, n: int = 5, rating: str = "rating") -> DataFrame:
    """Pre-game rating minus the pre-game rating n done games ago."""
    done = F.col("done")

    def build(frame):
        # the frame starts at ordinal k-n, so its first valid value is exactly n done games back
        return {"then": F.when(F.col("k") >= n,
                               F.first(F.when(done, F.col(rating)), ignorenulls=True).over(frame(n)))}

    rows = last_n(team_rows, TEAM, "k", done, n, build)
    rows = rows.withColumn("elo_velocity", F.col(rating) - F.col("then"))
    return by_game(rows, ["elo_velocity"], {"elo_velocity_diff": "elo_velocity"})


def schedule_strength(team_rows: DataFrame, n: int = 5, opponent_rating: str = "opponent_rating") -> DataFrame:
    """Mean pre-game rating of the last n opponents, done or not."""
    rows = last_n(team_rows, TEAM, "seq", F.lit(True), n,
                  lambda frame: {f"sos_{n}": F.avg(opponent_rating).over(frame(n))})
    return by_game(rows, [f"sos_{n}"], {f"sos_diff_{n}": f"sos_{n}"})


def cumulative_travel(team_rows: DataFrame, n: int = 3, km: str = "travel_km") -> DataFrame:
    """Kilometres over the team's last n games; unknown trips count 0, no games gives null."""
    rows = last_n(team_rows, TEAM, "seq", F.lit(True), n, lambda frame: {
        f"cumulative_travel_{n}": F.sum(F.coalesce(F.col(km), F.lit(0.0))).over(frame(n))})
    return by_game(rows, [f"cumulative_travel_{n}"], {f"cumulative_travel_diff_{n}": f"cumulative_travel_{n}"})


def consecutive_away(team_rows: DataFrame) -> DataFrame:
    """Away games in a row before this one, played or not."""
    rows = running(team_rows, TEAM, ORDER, {"last_home": ("max", F.when(F.col("side") == "home", F.col("seq")))})
    rows = rows.withColumn("consecutive_away", F.col("seq") - 1 - F.coalesce("last_home", F.lit(-1).cast("bigint")))
    return by_game(rows, ["consecutive_away"], {"consecutive_away_diff": "consecutive_away"})


def season_progress(games: DataFrame, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Round over the last round of the season, in [0, 1].

    The season length is a small aggregate joined back, not a window over a whole season."""
    last = games.groupBy(*keys).agg(F.max("round").alias("__last"))
    share = F.try_divide(F.col("round").cast("double"), F.col("__last").cast("double"))
    # keep a missing round missing; greatest/least skip nulls
    return games.join(last, list(keys), "left").select(
        "game_id", F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
        .alias("season_progress"))
