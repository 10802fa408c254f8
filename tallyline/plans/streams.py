"""Streaming queries (T): drained to the end, checked against the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.plans.betting import MOVEMENT_SQL, movement_text
from tallyline.plans.ctes import r6 as q
from tallyline.plans.registry import Tables, query, rounded
from tallyline.staging import new_path, stage
from tallyline.streaming import prices


def _until_ends(t: Tables) -> DataFrame:
    """Snapshots with the end of their match: the time of its last one."""
    ends = stage(t.snapshots.groupBy("match_id").agg(F.max(F.col("fetched_at").cast("timestamp")).alias("ends_at")), "ends")
    return prices.with_ends(prices.snapshot_stream(t.spark, t.sf_dir, t.raw("events").schema), ends)


@query("t1_deduplicated_snapshots", "snapshots", f"select match_id, event_id, {q('home_odds')} as home_odds, {q('away_odds')} as away_odds from snapshots")
def deduplicated_snapshots(t: Tables) -> DataFrame:
    """Every snapshot arrives twice and is kept once."""
    stream = prices.snapshot_stream(t.spark, t.sf_dir, t.raw("events").schema)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    path = new_path(t.spark, "t1")
    prices.run_append(prices.deduplicated(twice, ["event_id"]), f"{path}/rows", f"{path}/checkpoint")
    return rounded(t.spark.read.parquet(f"{path}/rows").select("match_id", "event_id", "home_odds", "away_odds"))


@query("t2_price_movement_stream", "snapshots", MOVEMENT_SQL)
def price_movement_stream(t: Tables) -> DataFrame:
    """A match is over with its last snapshot; its state goes when the watermark passes that."""
    path = new_path(t.spark, "t2")
    return movement_text(prices.run_upsert(prices.movement(_until_ends(t)), path, ["match_id"], f"{path}/checkpoint"))


_DAY = f"count(*) as n, {q('avg(home_odds)')} as avg_home, {q('max(home_odds)')} as best_home, {q('min(home_odds)')} as worst_home"


def _window_text(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")).drop("end"))


@query("t3_tumbling_windows", "snapshots", f"select strftime(date_trunc('day', fetched_at), '%Y-%m-%d %H:%M:%S') as start, match_id, {_DAY} from snapshots group by 1, 2")
def tumbling_windows(t: Tables) -> DataFrame:
    stream = prices.snapshot_stream(t.spark, t.sf_dir, t.raw("events").schema)
    path = new_path(t.spark, "t3")
    return _window_text(prices.run_upsert(prices.windowed(stream), path, ["start", "match_id"], f"{path}/checkpoint"))


@query("t3_sliding_windows", "snapshots", f"""
with w as (select *, date_trunc('day', fetched_at) + k * interval 12 hour as start from snapshots, range(-1, 2) r(k))
select strftime(start, '%Y-%m-%d %H:%M:%S') as start, match_id, {_DAY} from w where fetched_at >= start and fetched_at < start + interval 1 day group by 1, 2""")
def sliding_windows(t: Tables) -> DataFrame:
    stream = prices.snapshot_stream(t.spark, t.sf_dir, t.raw("events").schema)
    path = new_path(t.spark, "t3s")
    return _window_text(prices.run_upsert(prices.windowed(stream, "1 day", "12 hours"), path, ["start", "match_id"], f"{path}/checkpoint"))


@query("t3_session_windows", "snapshots", f"""
with g as (select *, case when fetched_at - lag(fetched_at) over (partition by match_id order by fetched_at, event_id) < interval 6 hour then 0 else 1 end as b from snapshots),
s as (select *, sum(b) over (partition by match_id order by fetched_at, event_id) as sid from g)
select strftime(min(fetched_at), '%Y-%m-%d %H:%M:%S') as start, match_id, {_DAY} from s group by match_id, sid
having max(fetched_at) + interval 6 hour <= (select max(fetched_at) - interval 2 hour from snapshots)""")
def session_windows(t: Tables) -> DataFrame:
    """Sessions that the watermark has closed, each once."""
    stream = prices.snapshot_stream(t.spark, t.sf_dir, t.raw("events").schema)
    path = new_path(t.spark, "t3w")
    prices.run_append(prices.sessions(stream), f"{path}/rows", f"{path}/checkpoint")
    return _window_text(t.spark.read.parquet(f"{path}/rows"))


@query("t4_stateful_ema", "snapshots", f"""
with o as (select match_id, home_odds, row_number() over (partition by match_id order by fetched_at, event_id) as i, count(*) over (partition by match_id) as n from snapshots)
select match_id, max(n) as n, {q('sum(home_odds * (case when i = 1 then 1e0 else 0.3e0 end) * power(0.7e0, n - i))')} as ema from o group by 1""")
def stateful_ema(t: Tables) -> DataFrame:
    path = new_path(t.spark, "t4")
    return rounded(prices.run_upsert(prices.moving_average(_until_ends(t)), path, ["match_id"], f"{path}/checkpoint"))


@query("t5_stream_ingest", "snapshots", f"select event_id, match_id, {q('home_odds')} as home_odds from snapshots")
def stream_ingest(t: Tables) -> DataFrame:
    """Each snapshot arrives twice; the table takes the first copy."""
    stream = prices.snapshot_stream(t.spark, t.sf_dir, t.raw("events").schema)
    twice = stream.select("event_id", "match_id", "home_odds", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    path = new_path(t.spark, "t5")
    return rounded(prices.run_ingest(twice, path, "event_id", ["copy"], f"{path}/checkpoint").drop("copy"))
