"""Column expressions: probabilities, prices, flags, labels.

Every function takes and returns Columns; nulls propagate unless stated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
WILSON_Z = 1.96
MOVE_THRESHOLD = 0.005
CLIP = (0.02, 0.98)


def number(text: Column, type_name: str = "double") -> Column:
    """Bad text becomes null; so does NaN."""
    value = text.try_cast(type_name)
    return F.when(~F.isnan(value), value) if type_name in ("double", "float") else value


def round_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def day_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def home_win(home: Column, away: Column) -> Column:
    """1 if the home side scored more; a draw or a missing score gives 0."""
    return F.coalesce((home > away).cast("int"), F.lit(0))


def margin(home: Column, away: Column) -> Column:
    return home - away


def overround(home_odds: Column, away_odds: Column) -> Column:
    return F.try_divide(F.lit(1.0), home_odds) + F.try_divide(F.lit(1.0), away_odds)


def implied(home_odds: Column, away_odds: Column) -> Column:
    """Fair probability of the first side, the bookmaker's margin removed."""
    return F.try_divide(F.try_divide(F.lit(1.0), home_odds), overround(home_odds, away_odds))


def guarded_implied(home_odds: Column, away_odds: Column) -> Column:
    return F.when((home_odds > 1) & (away_odds > 1), implied(home_odds, away_odds))


def edge(model: Column, fair: Column) -> Column:
    return model - fair


def kelly(prob: Column, odds: Column, fraction: float = 0.25, cap: float | None = None) -> Column:
    net = odds - 1.0
    stake = F.try_divide(prob * net - (1.0 - prob), net) * fraction
    capped = F.greatest(F.lit(0.0), stake) if cap is None else F.least(F.greatest(F.lit(0.0), stake), F.lit(cap))
    return F.when(stake.isNotNull(), capped)


def expected_value(prob: Column, odds: Column) -> Column:
    return prob * (odds - 1.0) - (1.0 - prob)


def aligned(side: Column, move: Column) -> Column:
    """The market moved strictly towards the side; unknown counts as no."""
    return F.coalesce(F.when(side == "home", move > 0).otherwise(move < 0), F.lit(False))


def move_class(own_move: Column, threshold: float = MOVE_THRESHOLD) -> Column:
    return (F.when(own_move.isNull(), "UNKNOWN").when(own_move > threshold, "AGREE")
            .when(own_move < -threshold, "DISAGREE").otherwise("NEUTRAL"))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = (F.pow(F.sin(half_lat), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2))
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def interstate(team_state: Column, venue_state: Column) -> Column:
    """1 when the venue's state is known and not the team's."""
    return F.when(venue_state.isNotNull() & ~team_state.eqNullSafe(venue_state), 1).otherwise(0)


def is_wet(rain_mm: Column, roofed: Column) -> Column:
    rain = F.when(roofed == 1, 0.0).otherwise(rain_mm)
    return F.coalesce((rain > 1.0).cast("int"), F.lit(0))


def wind_strong(wind_kmh: Column) -> Column:
    return F.coalesce((wind_kmh > 25).cast("int"), F.lit(0))


def weighted_score(weights: dict[str, float]) -> Column:
    """Sum of weight times value; a missing value counts 0."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * weight
    return total


def role(ho: Column, g: Column, i50: Column, cl: Column, d: Column, r50: Column) -> Column:
    """First rule that holds, on smoothed averages; missing averages count 0."""
    ho, g, i50, cl, d, r50 = (F.coalesce(c, F.lit(0.0)) for c in (ho, g, i50, cl, d, r50))
    # fixed values: thresholds of the role rules
    return (F.when(ho >= 15, "ruck")
            .when((g >= 1.5) & (i50 >= 3), "forward")
            .when((cl >= 3) | (d >= 25), "midfielder")
            .when(r50 >= 3, "defender")
            .when(i50 >= 3, "forward")
            .otherwise("other"))


def clip_probability(p: Column, bounds: tuple[float, float] = CLIP) -> Column:
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(bounds[0])), F.lit(bounds[1])))


def predicted_winner(p: Column, home: Column, away: Column) -> Column:
    """Empty for a toss-up: |p - 0.5| within 1e-8 + 1e-5 * 0.5."""
    return (F.when(F.abs(p - 0.5) <= 1e-8 + 1e-5 * 0.5, "").when(p > 0.5, home).otherwise(away))


def confidence(p: Column) -> Column:
    return F.greatest(p, 1.0 - p)


def best_side(home_edge: Column, away_edge: Column, low: float, high: float) -> Column:
    """The side whose edge lies in [low, high), home first when its edge is not smaller."""
    return (F.when((home_edge >= low) & (home_edge < high) & (home_edge >= away_edge), "home")
            .when((away_edge >= low) & (away_edge < high), "away"))


def price_role(odds: Column) -> Column:
    return F.when(odds < 2.0, "favorite").otherwise("underdog")


def change_key(game_id: Column, home: Column, away: Column, p: Column, names: Column) -> Column:
    """Digest of what should renew a text: teams, probability to 5%, the five leading names."""
    bucket = F.format_string("%.2f", F.rint(p * 20) / 20)
    return F.sha1(F.concat_ws("|", game_id.cast("string"), home, away, bucket,
                              F.array_join(F.array_sort(F.slice(names, 1, 5)), "|")))


def label_or_name(label: Column, name: Column) -> Column:
    return F.coalesce(label, F.replace(name, F.lit("_"), F.lit(" ")))


def split_match(text: Column) -> tuple[Column, Column]:
    """'A vs B' -> (A, B); only the first ' vs ' separates."""
    parts = F.split(text, " vs ", 2)
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))


def bet_key(date: Column, home: Column, away: Column, side: Column) -> Column:
    return F.concat_ws("_", F.substring(date.cast("string"), 1, 10), home, away, side)


def round_sort_key(name: Column) -> Column:
    digits = F.regexp_extract(name, r"(\d+)", 1)
    return (F.when(name.isNull() | (name == ""), 999).when(F.lower(name).startswith("opening"), 0)
            .when(digits != "", digits.try_cast("int")).when(F.lower(name).contains("final"), 900).otherwise(500))


def abbreviated(full_name: Column) -> Column:
    """'First Last Name' -> 'F Last Name'; null for a single word."""
    parts = F.split(F.trim(full_name), r"\s+")
    return F.when(F.size(parts) >= 2, F.concat(
        F.substring(F.get(parts, F.lit(0)), 1, 1), F.lit(" "), F.array_join(F.slice(parts, 2, F.size(parts)), " ")))


def points(goals: Column, behinds: Column) -> Column:
    return goals * 6 + behinds


def top_flag(rank: Column, n: int) -> Column:
    return (rank <= n).cast("bigint")


def signs_agree(p: Column, predicted_margin: Column) -> Column:
    return (((p >= 0.5) & (predicted_margin > 0)) | ((p < 0.5) & (predicted_margin <= 0))).cast("double")


def correct(pick: Column, outcome: Column) -> Column:
    """1.0 / 0.0, null without a pick."""
    return (pick == outcome).cast("double")


def wilson(successes: Column, n: Column, empty: tuple[float, float] = (0.0, 1.0),
           z: float = WILSON_Z) -> tuple[Column, Column]:
    """Score interval of a proportion; ``empty`` is the answer for n = 0."""
    n = n.cast("double")
    share = F.try_divide(successes.cast("double"), n)
    denom = 1 + F.try_divide(F.lit(z * z), n)
    centre = (share + F.try_divide(F.lit(z * z), 2 * n)) / denom
    spread = z * F.sqrt(F.try_divide(share * (1 - share), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / denom
    low = F.when(n == 0, empty[0]).otherwise(F.greatest(F.lit(0.0), centre - spread))
    high = F.when(n == 0, empty[1]).otherwise(F.least(F.lit(1.0), centre + spread))
    return low, high
