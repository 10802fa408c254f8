"""Reading, writing and merging contest tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions import scalars as s
from tallyline.operators.joins import keep_first


def scan(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """Typed scan; CSV has a header and ISO dates."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def scan_optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Like ``scan``; a missing path is an empty table of the same schema."""
    if path_exists(spark, path):
        return scan(spark, path, schema, fmt)
    return spark.createDataFrame([], schema)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a plain folder; with no rows the schema is still written.

    The new rows are written aside first, so a failed job leaves the old folder and
    ``df`` may read it.  Readers that must never see the moment between the two take a
    ``tables.VersionedTable``.
    """
    aside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    spark = df.sparkSession
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, aside))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{aside} could not be moved to {path}")


# fixed values: sheet heading -> column
PRICE_SHEET = {
    "Home Odds": "home_odds_avg", "Away Odds": "away_odds_avg", "Bookmakers Surveyed": "bookmakers_surveyed",
    "Home Odds Open": "home_odds_open", "Home Odds Close": "home_odds_close",
    "Away Odds Open": "away_odds_open", "Away Odds Close": "away_odds_close",
    "Home Odds Min": "home_odds_min", "Home Odds Max": "home_odds_max",
    "Away Odds Min": "away_odds_min", "Away Odds Max": "away_odds_max",
    "Home Line Close": "home_line_close", "Away Line Close": "away_line_close",
    "Home Line Odds Close": "home_line_odds_close", "Away Line Odds Close": "away_line_odds_close",
}
PRICE_SHEET_TEXT = {"Venue": "venue_odds"}
PRICE_SHEET_FLAGS = {"Play Off Game?": "is_final_odds"}


def normalise_price_sheet(raw: DataFrame, team_names: dict[str, str] | None = None) -> DataFrame:
    """Headings to column names, unknown ones dropped, prices to numbers (bad cells null).

    The venue stays text without outer blanks; the finals cell is a flag, true for a Y.
    """
    def team(heading: str) -> Column:
        name = F.col(f"`{heading}`")
        for old, new in (team_names or {}).items():
            name = F.when(F.col(f"`{heading}`") == old, new).otherwise(name)
        return name

    date = F.col("Date").try_cast("timestamp")
    return raw.select(
        F.to_date(date).alias("date"), F.year(date).alias("year"),
        team("Home Team").alias("home_team"), team("Away Team").alias("away_team"),
        *[F.nullif(F.trim(F.col(f"`{old}`")), F.lit("")).alias(new) for old, new in PRICE_SHEET_TEXT.items() if old in raw.columns],
        *[s.number(F.col(f"`{old}`")).alias(new) for old, new in PRICE_SHEET.items() if old in raw.columns],
        *[F.coalesce(F.upper(F.trim(F.col(f"`{old}`"))).startswith("Y"), F.lit(False)).alias(new)
          for old, new in PRICE_SHEET_FLAGS.items() if old in raw.columns])


_OUTCOMES = "array<struct<name:string,price:double,point:double>>"
QUOTE_PAYLOAD = ("struct<home_team:string,away_team:string,commence_time:string,"
                 f"bookmakers:array<struct<markets:array<struct<key:string,outcomes:{_OUTCOMES}>>>>>")


def flatten_quotes(df: DataFrame, payload: str, keep: Sequence[str]) -> DataFrame:
    """Nested quote document -> one row per usable quote with its side.

    Outcomes of neither team are dropped, and spread quotes without point or price.
    """
    doc = df.select(*keep, F.from_json(payload, QUOTE_PAYLOAD).alias("d"))
    books = doc.select(*keep, F.col("d.home_team").alias("home_team"), F.col("d.away_team").alias("away_team"),
                       F.posexplode("d.bookmakers").alias("book", "b"))
    markets = books.select(*keep, "home_team", "away_team", "book", F.explode("b.markets").alias("m"))
    quotes = markets.select(*keep, "home_team", "away_team", "book", F.col("m.key").alias("market"),
                            F.explode("m.outcomes").alias("o"))
    side = (F.when(F.col("o.name") == F.col("home_team"), "home").when(F.col("o.name") == F.col("away_team"), "away"))
    spread_ok = F.col("o.point").isNotNull() & F.col("o.price").isNotNull()
    return (quotes.select(*keep, "book", "market", side.alias("side"), F.col("o.price").alias("price"),
                          F.col("o.point").alias("point"), spread_ok.alias("ok"))
            .where(F.col("side").isNotNull() & ((F.col("market") == "h2h") | ((F.col("market") == "spreads") & F.col("ok"))))
            .drop("ok"))


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace existing ones with the same keys."""
    kept = existing.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def add_new(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Existing rows plus unseen ones, the first of each key."""
    fresh = keep_first(incoming, [key], order).join(existing.select(key).distinct(), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def missing_keys(required: DataFrame, cached: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys still to be fetched."""
    return required.select(*keys).distinct().join(cached.select(*keys).distinct(), list(keys), "left_anti")


def first_source(rows: DataFrame, priority: str = "priority", per_key: Sequence[str] = ()) -> DataFrame:
    """Rows of the best non-empty source as a whole, or per key when keys are given."""
    best = rows.groupBy(*per_key).agg(F.min(priority).alias(priority))
    return rows.join(best, [*per_key, priority], "left_semi")


def selections_long(matches: DataFrame) -> DataFrame:
    """One row per listed player: position grid and interchange are selected, then emergencies.

    ``matches``: year, round and for each side team, positions, interchange, emergencies.
    """
    def side(p: str) -> list[Column]:
        chosen = F.array_union(F.coalesce(f"{p}_positions", F.array()), F.coalesce(f"{p}_interchange", F.array()))
        return [F.struct(F.col(f"{p}_team").alias("team"), F.lit("selected").alias("type"), chosen.alias("players")),
                F.struct(F.col(f"{p}_team").alias("team"), F.lit("emergency").alias("type"),
                         F.coalesce(f"{p}_emergencies", F.array()).alias("players"))]

    return (matches.select("year", "round", F.explode(F.array(*side("home"), *side("away"))).alias("s"))
            .select("year", "round", "s.team", "s.type", F.explode("s.players").alias("player")))


def report_columns(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist, and the names that do not."""
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have]), [c for c in wanted if c not in have]
