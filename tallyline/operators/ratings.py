"""Paired-comparison ratings."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.operators.recurrence import chunked_recurrence

BASE = 1500.0
_YEAR = "\0year"  # state entry holding the season last seen


def elo(games: DataFrame, k: float = 30.0, home_advantage: float = 30.0, revert: float = 0.1,
        pool: str = "league", rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Pre-game ratings of both sides, their difference and the home expectation.

    Known ratings move 10% towards the base at each new season; the step size
    grows with the log of the margin; a draw counts half.
    """
    def step(key, rows: pd.DataFrame, state: dict):
        rating = dict(state)
        season = rating.pop(_YEAR, None)
        home_pre, away_pre = [], []
        for year, home, away, hs, as_ in zip(rows["year"], rows["home_team"], rows["away_team"],
                                             rows["home_score"], rows["away_score"]):
            if year != season:
                rating = {t: r * (1 - revert) + BASE * revert for t, r in rating.items()}
                season = year
            h, a = rating.get(home, BASE), rating.get(away, BASE)
            home_pre.append(h)
            away_pre.append(a)
            if hs != hs or as_ != as_:  # upcoming: reads only
                continue
            expected = 1.0 / (1.0 + 10.0 ** ((a - h - home_advantage) / 400.0))
            actual = 1.0 if hs > as_ else 0.5 if hs == as_ else 0.0
            move = k * math.log(max(abs(hs - as_), 1) + 1) / math.log(11) * (actual - expected)
            rating[home], rating[away] = h + move, a - move
        if season is not None:
            rating[_YEAR] = float(season)
        return pd.DataFrame({"game_id": rows["game_id"].to_numpy(), "home_elo": home_pre, "away_elo": away_pre}), rating

    schema = T.StructType([T.StructField("game_id", T.LongType()), T.StructField("home_elo", T.DoubleType()),
                           T.StructField("away_elo", T.DoubleType())])
    rows = games.select(pool, "game_id", F.col("date").cast("timestamp").alias("date"), "year", "home_team",
                        "away_team", F.col("home_score").cast("double").alias("home_score"),
                        F.col("away_score").cast("double").alias("away_score"))
    rated = chunked_recurrence(rows, [pool], ["date", "game_id"], step, schema, rows_per_chunk)
    gap = F.col("home_elo") - F.col("away_elo")
    return rated.select("*", gap.alias("elo_diff"),
                        (1.0 / (1.0 + F.pow(F.lit(10.0), (-gap - home_advantage) / 400.0))).alias("elo_expected"))
