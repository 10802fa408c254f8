"""Price snapshots as streams: the incremental forms of the batch operators.

Results equal the batch operator over the same rows.  All state is bounded by the
watermark: windows, sessions and the dedupe by Spark's own eviction, the price
movement and the moving average by event-time timers, which drop a match when the
watermark passes its end.  Sinks are keyed tables, never memory tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyline.operators.markets import movement_columns
from tallyline.sources.tables import KeyedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def snapshot_stream(spark, sf_dir: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """Event files of a folder as a stream of price snapshots."""
    events = (spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
              .option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir))
    return events.select(F.col("user_id").alias("match_id"), F.col("ts").cast("timestamp").alias("fetched_at"), "event_id",
                         (1.2 + F.col("value") % 5.0).alias("home_odds"),
                         (1.2 + (F.col("event_id") % 37) / 10.0).alias("away_odds"))


def deduplicated(stream: DataFrame, keys: list[str], delay: str = "2 hours", time: str = "fetched_at") -> DataFrame:
    """Drop repeats of a key within the watermark; late rows are dropped with them."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, length: str = "1 day", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Price statistics per match and tumbling or sliding window."""
    span = F.window("fetched_at", length, slide) if slide else F.window("fetched_at", length)
    return _price_stats(stream.withWatermark("fetched_at", delay).groupBy(span.alias("w"), "match_id"))


def sessions(stream: DataFrame, gap: str = "6 hours", delay: str = "2 hours") -> DataFrame:
    """Price statistics per match and burst of snapshots; append mode gives each burst once, when it is closed.

    A burst is closed when the watermark passes its last snapshot by the gap.
    """
    span = F.session_window("fetched_at", gap)
    return _price_stats(stream.withWatermark("fetched_at", delay).groupBy(span.alias("w"), "match_id"))


def _price_stats(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("home_odds").alias("avg_home"),
                       F.max("home_odds").alias("best_home"), F.min("home_odds").alias("worst_home")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "match_id", "n", "avg_home", "best_home", "worst_home")


# -- state per match -----------------------------------------------------------

#: A match of unknown end is over when it had no price for so long (milliseconds of event time).
IDLE_MS = 30 * 24 * 3600 * 1000
#: Prices of a match that wait for the watermark: up to so many are one value with the average, more are kept by spans.
HELD = 4096
#: Length of such a span of event time.
SPAN_MS = 24 * 3600 * 1000

_END = "a_us long, a_tie long, a_home double, a_away double"
MOVEMENT_STATE = f"{_END}, {_END.replace('a_', 'b_')}, n long, until_ms long"
MOVEMENT_SCHEMA = f"match_id long, {_END}, {_END.replace('a_', 'b_')}, n long"
EMA_SCHEMA = "match_id long, n long, ema double"


def with_ends(stream: DataFrame, ends: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Add ``ends_at`` from a table of match ends and the watermark; prices after a match's end are dropped."""
    joined = stream.withWatermark("fetched_at", delay).join(ends, "match_id", "left")
    return joined.where(F.col("ends_at").isNull() | (F.col("fetched_at") <= F.col("ends_at")))


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


def _ended(stream: DataFrame) -> DataFrame:
    """A stream without match ends keeps a match until it has been silent for ``IDLE_MS``."""
    if "ends_at" in stream.columns:
        return stream
    return stream.withWatermark("fetched_at", "2 hours").withColumn("ends_at", F.lit(None).cast("timestamp"))


class _PerMatch(StatefulProcessor):
    """A match's state with one time until which it is kept; timers that it has outgrown do nothing."""

    def _until(self, rows: pd.DataFrame, us: np.ndarray) -> int:
        ends = rows["ends_at"].dropna()
        return int(_micros(ends)[0]) // 1000 + 1 if len(ends) else int(us.max()) // 1000 + IDLE_MS

    def close(self) -> None:
        pass


class PriceMovement(_PerMatch):
    """First and latest price of a match; a batch's rows are read as they come, a slice at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ends", MOVEMENT_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else None
        first, last, n, until = (held[:4], held[4:8], held[8], held[9]) if held else (None, None, 0, 0)
        for some in rows:
            us, ties = _micros(some["fetched_at"]), some["event_id"].to_numpy()
            order = np.lexsort((ties, us))
            row = lambda i: (int(us[i]), int(ties[i]), float(some["home_odds"].iloc[i]), float(some["away_odds"].iloc[i]))  # noqa: B023, E731
            low, high = row(order[0]), row(order[-1])
            first = low if first is None or low[:2] < first[:2] else first
            last = high if last is None or high[:2] > last[:2] else last
            n, until = n + len(some), max(until, self._until(some, us))
        if held is None or held[9] != until:
            self.handle.registerTimer(until)
        self.state.update((*first, *last, n, until))
        yield pd.DataFrame([(key[0], *first, *last, n)], columns=[f.split()[0] for f in MOVEMENT_SCHEMA.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[9] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())


def movement(stream: DataFrame) -> DataFrame:
    """First and latest price of each match (update mode), see ``with_ends``; a match's state goes when it is over."""
    ends = _ended(stream).select("match_id", "fetched_at", "ends_at", "event_id", "home_odds", "away_odds").groupBy("match_id").transformWithStateInPandas(
        statefulProcessor=PriceMovement(), outputStructType=T.StructType.fromDDL(MOVEMENT_SCHEMA), outputMode="Update", timeMode="EventTime")
    side = lambda p: F.struct(F.col(f"{p}_home").alias("home_odds"), F.col(f"{p}_away").alias("away_odds"))
    return movement_columns(ends.select("match_id", side("a").alias("a"), side("b").alias("b"), F.col("n").alias("n_snapshots"),
                                        F.timestamp_micros("a_us").alias("first_seen"), F.timestamp_micros("b_us").alias("last_seen")), ["match_id"])


class PriceEma(_PerMatch):
    """Moving average of the home price per match in event-time order, whatever order rows arrive in.

    Prices that the watermark has not passed wait beside the average in one value, so a
    batch reads and writes a match's state once. Where more than ``HELD`` wait they are
    put down by spans of event time, and at most one span of a match is in memory at a
    time. When the watermark has passed prices, no more can come before them: the next
    batch folds them into the average. What a batch gives out is the average over all
    prices so far, folded ones first.
    """

    def __init__(self, alpha: float = 0.3):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState(
            "folded", "n long, ema double, until_ms long, spread boolean, us array<long>, ties array<long>, prices array<double>")
        self.waiting = handle.getMapState("waiting", "span long, part long", "us array<long>, ties array<long>, prices array<double>")

    def _fold(self, rows: tuple[np.ndarray, ...], n: int, ema: float) -> tuple[int, float]:
        us, ties, prices = rows
        for price in prices[np.lexsort((ties, us))].tolist():
            ema = price if n == 0 else self.alpha * price + (1 - self.alpha) * ema
            n += 1
        return n, ema

    def _spread(self, rows: tuple[np.ndarray, ...], parts: dict[int, list[int]]) -> None:
        """Puts rows down by spans; ``parts`` are the ones that wait there."""
        spans = rows[0] // (1000 * SPAN_MS)
        for span in np.unique(spans).tolist():
            part = max(parts.get(span, [-1])) + 1
            self.waiting.updateValue((span, part), tuple(x[spans == span].tolist() for x in rows))
            parts.setdefault(span, []).append(part)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, ema, until, spread, *held = self.folded.get() or (0, 0.0, 0, False, [], [], [])
        kinds = (np.int64, np.int64, float)
        held, parts, before = tuple(np.asarray(x, k) for x, k in zip(held, kinds)), {}, until
        if spread:
            for span, part in self.waiting.keys():
                parts.setdefault(span, []).append(part)
        for some in rows:
            us = _micros(some["fetched_at"])
            until = max(until, self._until(some, us))
            held = tuple(np.append(x, y) for x, y in zip(held, (us, some["event_id"].to_numpy(np.int64), some["home_odds"].to_numpy(float))))
            if len(held[0]) > HELD:
                self._spread(held, parts)
                held = tuple(x[:0] for x in held)
        passed = 1000 * (timerValues.getCurrentWatermarkInMs() or 0)
        if parts and len(held[0]):
            self._spread(held, parts)
            held = tuple(x[:0] for x in held)
        if parts:
            kept, now = (n, ema), (n, ema)
            for span in sorted(parts):
                now = self._fold(tuple(np.concatenate([np.asarray(y, k) for y in x]) for x, k in zip(
                    zip(*(self.waiting.getValue((span, p)) for p in parts[span])), kinds)), *now)
                if (span + 1) * 1000 * SPAN_MS <= passed:
                    kept = now
                    for part in parts.pop(span):
                        self.waiting.removeKey((span, part))
        else:
            old = held[0] < passed
            kept = self._fold(tuple(x[old] for x in held), n, ema)
            held = tuple(x[~old] for x in held)
            now = self._fold(held, *kept)
        self.folded.update((*kept, until, bool(parts), *(x.tolist() for x in held)))
        if until != before:
            self.handle.registerTimer(until)
        yield pd.DataFrame({"match_id": [key[0]], "n": [now[0]], "ema": [now[1]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.folded.get()
        if state is not None and state[2] <= expiredTimerInfo.getExpiryTimeInMs():
            # over: what a batch gave out last was the whole average
            self.folded.clear()
            if state[3]:
                self.waiting.clear()
        return iter(())


def moving_average(stream: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Moving average of each match's home price (update mode), see ``with_ends``.

    Like ``movement`` it needs the RocksDB state store, which the sinks below set.
    """
    return _ended(stream).select("match_id", "fetched_at", "ends_at", "event_id", "home_odds").groupBy("match_id").transformWithStateInPandas(
        statefulProcessor=PriceEma(alpha), outputStructType=T.StructType.fromDDL(EMA_SCHEMA), outputMode="Update", timeMode="EventTime")


# -- sinks -------------------------------------------------------------------

def run_append(df: DataFrame, path: str, checkpoint: str) -> None:
    """Drain the stream into an append table."""
    (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which processors with timers need."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(store, before)


def _drain(df: DataFrame, table: KeyedTable, checkpoint: str, mode: str, take) -> DataFrame:
    def write(batch: DataFrame, batch_id: int) -> None:
        # the checkpoint names the writer, so a batch that is run again finds itself done
        take(KeyedTable(batch.sparkSession, table.root, table.schema, table.keys, table.rows_per_bucket), batch, checkpoint, batch_id)

    with rocksdb(df.sparkSession):
        query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()


def run_upsert(df: DataFrame, root: str, keys: list[str], checkpoint: str, mode: str = "update", rows_per_bucket: int = 1 << 20) -> DataFrame:
    """Drain the stream into a keyed table; rows of a batch replace those of their keys, in the buckets they fall into."""
    table = KeyedTable(df.sparkSession, root, df.schema, keys, rows_per_bucket)
    return _drain(df, table, checkpoint, mode, lambda t, batch, writer, batch_id: t.upsert(batch, (), writer, batch_id))


def run_ingest(df: DataFrame, root: str, key: str, order: list[str], checkpoint: str, rows_per_bucket: int = 1 << 20) -> DataFrame:
    """Drain the stream into a table that takes each key once, the first copy; a batch reads the keys of its buckets only."""
    table = KeyedTable(df.sparkSession, root, df.schema, [key], rows_per_bucket)
    return _drain(df, table, checkpoint, "append", lambda t, batch, writer, batch_id: t.add_new(batch, order, writer, batch_id))
