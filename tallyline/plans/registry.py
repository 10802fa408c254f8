"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.plans.ctes import with_tables
from tallyline.sources import fixtures as fx
from tallyline.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The same queries over one query's derived tables, for compositions that share them.
OVER_TABLES: dict[str, Callable[["Tables"], DataFrame]] = {}


class Tables:
    """The derived tables of one query; ``games`` is stored because several branches scan it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.keeps = False
        self._steps: dict[str, DataFrame] = {}
        self._making: dict[str, threading.Lock] = {}  # by step, because compositions make several at once

    def step(self, name: str, make: Callable[[], DataFrame], stored: bool = False) -> DataFrame:
        """A step that several queries read, planned once; a composition that ``keeps`` its steps runs it only once, and stores it unless it is ``stored`` already."""
        with self._making.setdefault(name, threading.Lock()):
            if name not in self._steps:
                self._steps[name] = stage(make(), name) if self.keeps and not stored else make()
            return self._steps[name]

    def raw(self, name: str) -> DataFrame:
        return fx.table(self.spark, self.sf_dir, name)

    @cached_property
    def contests(self) -> DataFrame:
        return fx.contests(self.spark, self.sf_dir)

    @cached_property
    def games(self) -> DataFrame:
        return stage(self.contests, "games")

    @cached_property
    def prices(self) -> DataFrame:
        return fx.prices(self.games)

    @cached_property
    def forecasts(self) -> DataFrame:
        return fx.forecasts(self.games)

    @cached_property
    def market(self) -> DataFrame:
        """Games with their prices (some missing) and both forecasts."""
        return self.games.join(self.prices, "game_id", "left").join(self.forecasts, "game_id")

    @cached_property
    def tips(self) -> DataFrame:
        return fx.tips(self.spark, self.sf_dir, self.games)

    @cached_property
    def player_stats(self) -> DataFrame:
        return fx.player_stats(self.spark, self.sf_dir, self.games)

    @cached_property
    def standings(self) -> DataFrame:
        return fx.standings(self.games)

    @cached_property
    def snapshots(self) -> DataFrame:
        return fx.snapshots(self.spark, self.sf_dir)

    @cached_property
    def team_dim(self) -> DataFrame:
        return fx.team_dim(self.spark, self.sf_dir)

    @cached_property
    def venue_dim(self) -> DataFrame:
        return fx.venue_dim(self.spark, self.sf_dir, self.games)

    @cached_property
    def aliases(self) -> DataFrame:
        return fx.aliases(self.spark, self.sf_dir)


def query(name: str, needs: str = "", sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use the derived tables in ``needs``."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        OVER_TABLES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(needs, sql)
        return fn
    return register


def r6(column: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, ties moved off the boundary, never a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c + F.lit(1.2345e-9), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded."""
    return df.select(*[r6(F.col(n), digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])
