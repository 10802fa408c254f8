"""Contest tables derived from the given star-schema tables.

Each function is a pure DataFrame expression over Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("l_linenumber") % 2 == 1
    scores = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
              .agg(F.min("l_suppkey").alias("suppkey"),
                   F.sum(F.when(odd, F.col("l_quantity")).otherwise(0.0)).alias("hs"),
                   F.sum(F.when(~odd, F.col("l_quantity")).otherwise(0.0)).alias("aws")))
    nation = table(spark, sf_dir, "nation")
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("home_team"))
    away = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("away_team"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment",
                                                       "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suppkey"), "s_nationkey")
    played = F.col("o_orderstatus") != "P"
    return (table(spark, sf_dir, "orders")
            .join(scores, F.col("o_orderkey") == F.col("l_orderkey"))
            .join(customer, "o_custkey").join(home, "c_nationkey")
            .join(supplier, "suppkey").join(away, "s_nationkey")
            .where(F.col("home_team") != F.col("away_team"))
            .select(F.col("o_orderkey").alias("game_id"), F.col("c_mktsegment").alias("league"),
                    F.col("o_orderdate").alias("date"), F.year("o_orderdate").alias("year"),
                    F.month("o_orderdate").alias("round"), F.col("o_orderpriority").alias("venue"),
                    "home_team", "away_team",
                    F.when(played, F.floor("hs").cast("int")).alias("home_score"),
                    F.when(played, F.floor("aws").cast("int")).alias("away_score")))


def player_stats(spark: SparkSession, sf_dir: str, games: DataFrame | None = None) -> DataFrame:
    games = games if games is not None else contests(spark, sf_dir)
    done = games.where(F.col("home_score").isNotNull()).select(
        F.col("game_id").alias("l_orderkey"), "home_team", "away_team")
    part, supp, qty = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    return (table(spark, sf_dir, "lineitem").join(done, "l_orderkey")
            .groupBy(F.col("l_orderkey").alias("mid"),
                     F.when(F.col("l_linenumber") % 2 == 1, F.col("home_team"))
                     .otherwise(F.col("away_team")).alias("team"),
                     F.concat(F.lit("P"), (part % 40).cast("string")).alias("player"))
            .agg(F.sum(F.when(part % 11 != 0, qty)).alias("d"),
                 F.sum(F.floor(qty / 10.0)).alias("g"),
                 F.sum((part % 25).cast("double")).alias("ho"),
                 F.sum((supp % 9).cast("double")).alias("i50"),
                 F.sum((part % 7).cast("double")).alias("cl"),
                 F.sum((supp % 6).cast("double")).alias("r50")))


def prices(games: DataFrame) -> DataFrame:
    g = F.col("game_id")
    po, mv = F.col("po"), F.col("mv")
    return (games.where(g % 13 != 0)
            .select("game_id", (0.1 + 0.8 * ((g * 7919) % 1000) / 1000.0).alias("po"),
                    ((((g * 104729) % 101) - 50) / 1000.0).alias("mv"))
            .select("game_id", (1.0 / (po * 1.05)).alias("home_odds_open"),
                    (1.0 / ((1.0 - po) * 1.05)).alias("away_odds_open"),
                    (1.0 / ((po + mv) * 1.04)).alias("home_odds_close"),
                    (1.0 / ((1.0 - po - mv) * 1.04)).alias("away_odds_close"),
                    ((0.5 - po) * 60.0).alias("home_line_close")))


def forecasts(games: DataFrame) -> DataFrame:
    g = F.col("game_id")
    return games.select("game_id", (0.05 + 0.9 * ((g * 15485863) % 997) / 997.0).alias("model_prob"),
                        (0.1 + 0.8 * ((g * 32452843) % 991) / 991.0).alias("alt_prob"))


def tips(spark: SparkSession, sf_dir: str, games: DataFrame) -> DataFrame:
    """Five sources tip every game; the sources are the first five nations."""
    return games.select("game_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("source")).select(
        "game_id", "source", (20.0 + (F.col("game_id") * 31 + F.col("source") * 17) % 61).alias("hconfidence"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("match_id"), F.col("ts").alias("fetched_at"), "event_id",
        (1.2 + F.col("value") % 5.0).alias("home_odds"),
        (1.2 + (F.col("event_id") % 37) / 10.0).alias("away_odds"))


def team_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    return (table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_name").alias("team"), F.col("r_name").alias("state"),
                    (-40.0 + F.col("n_nationkey") * 1.1).alias("lat"),
                    (110.0 + F.col("n_nationkey") * 1.7).alias("lon")))


def venue_dim(spark: SparkSession, sf_dir: str, games: DataFrame) -> DataFrame:
    """One row per distinct venue; the numbering window sees only those."""
    ranked = games.select("venue").distinct().select(
        "venue", F.row_number().over(Window.orderBy("venue")).alias("rn"))
    region = table(spark, sf_dir, "region")
    return ranked.join(region, F.col("r_regionkey") == F.col("rn") - 1).select(
        "venue", (-38.0 + F.col("rn") * 2.3).alias("lat"), (115.0 + F.col("rn") * 6.1).alias("lon"),
        F.col("r_name").alias("state"), F.when(F.col("rn") == 1, 1).otherwise(0).alias("roofed"))


def standings(games: DataFrame) -> DataFrame:
    done = games.where(F.col("home_score").isNotNull() & (F.col("round") % 5 != 0))
    side = F.explode(F.array(
        F.struct(F.col("home_team").alias("team"), F.col("home_score").alias("sf"), F.col("away_score").alias("sa")),
        F.struct(F.col("away_team").alias("team"), F.col("away_score").alias("sf"), F.col("home_score").alias("sa"))))
    rows = done.select("league", "year", "round", side.alias("s")).select("league", "year", "round", "s.*")
    points = F.when(F.col("sf") > F.col("sa"), 4).when(F.col("sf") == F.col("sa"), 2).otherwise(0)
    monthly = rows.groupBy("league", "year", "round", "team").agg(
        F.sum(points).alias("pts"), F.sum("sf").alias("pf"), F.sum("sa").alias("pa"))
    season = Window.partitionBy("league", "year", "team").orderBy("round")
    total = monthly.select("league", "year", "round", "team", *[
        F.sum(c).over(season).alias(c) for c in ("pts", "pf", "pa")])
    ladder = Window.partitionBy("league", "year", "round").orderBy(F.desc("pts"), "team")
    return total.select("league", "year", "round", "team", "pts",
                        F.try_divide(F.col("pf") * 100.0, F.col("pa").cast("double")).alias("percentage"),
                        F.row_number().over(ladder).alias("rank"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    spelling = F.explode(F.array(F.upper(name), F.concat(name, F.lit(" FC"))))
    return table(spark, sf_dir, "nation").select(spelling.alias("alias"), name.alias("team"))
