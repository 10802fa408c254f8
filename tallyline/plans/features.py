"""One wide row per game: every pre-game feature group in one table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame

from tallyline.plans.registry import ORACLES, OVER_TABLES, Tables, query
from tallyline.staging import stage

#: Feature groups by query; each has one row per game, some only for games with a partner.
GROUPS = ("w1_rolling_form", "w2_margin_volatility", "w3_form_streak", "w4_head_to_head", "w5_venue_record", "w6_rest_days", "w7_bye_flags",
          "w8_rolling_stats", "w9_rolling_ratios", "w10_rating_velocity", "w11_schedule_strength", "w12_cumulative_travel",
          "w13_consecutive_away", "w14_elo_ratings", "w19_absence_quality", "w20_selected_strength", "a4_season_progress",
          "j6_ladder_features", "p11_price_move", "p16_weather_flags")
#: Groups submitted together, so that cores which one group's short jobs and last tasks leave idle work on another.
GROUPS_AT_ONCE = 4


def _prefix(name: str) -> str:
    return name.split("_")[0]


def _sql() -> str:
    """The groups' own SQL, side by side; a column is named after its group."""
    def part(name: str) -> str:
        return f"(select columns('(.*)') as '{_prefix(name)}_\\1' from ({ORACLES[name]}))"

    first, *others = GROUPS
    joins = " ".join(f"left join {part(n)} as {_prefix(n)} on {_prefix(n)}_game_id = w1_game_id" for n in others)
    extra = ", ".join(f"{_prefix(n)}_game_id" for n in others)
    return f"select * exclude ({extra}) from {part(first)} as w1 {joins}"


def feature_table(t: Tables) -> DataFrame:
    """All groups joined by game; what several groups read and each group is written once, so the join reads narrow tables."""
    t.keeps = True
    t.games  # stored before several groups ask for it

    def part(name: str) -> DataFrame:
        df = OVER_TABLES[name](t)
        return stage(df.select(*[df[c].alias("game_id" if c == "game_id" else f"{_prefix(name)}_{c}") for c in df.columns]), "group")

    with ThreadPoolExecutor(GROUPS_AT_ONCE) as pool:
        parts = list(pool.map(part, GROUPS))
    return reduce(lambda a, b: a.join(b, "game_id", "left"), parts).withColumnRenamed("game_id", "w1_game_id")


query("f1_feature_table", sql=_sql())(feature_table)
