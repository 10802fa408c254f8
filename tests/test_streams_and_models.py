import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyline.learning import models as m
from tallyline.staging import new_path
from tallyline.streaming import prices

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture(scope="module")
def folder(spark):
    """Three event files, so that a stream takes three batches."""
    rnd = random.Random(6)
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=7 * i), rnd.randrange(4), "q", round(rnd.random() * 9, 2), "{}") for i in range(90)]
    path = new_path(spark, "events")
    for part in range(3):
        spark.createDataFrame(rows[part * 30:part * 30 + 30], EVENTS).coalesce(1).write.parquet(f"{path}/p{part}")
    files = f"{path}/all"
    for part in range(3):
        spark.read.parquet(f"{path}/p{part}").coalesce(1).write.mode("append").parquet(files)
    return rows, files


def stream(spark, files):
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(files)
    return events.select(F.col("user_id").alias("match_id"), F.col("ts").cast("timestamp").alias("fetched_at"), "event_id",
                         (1.2 + F.col("value") % 5.0).alias("home_odds"), (1.2 + (F.col("event_id") % 37) / 10.0).alias("away_odds"))


def test_stateful_average_over_batches(spark, folder):
    rows, files = folder
    path = new_path(spark, "ema")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, prices.ROCKSDB)
    out = prices.run_upsert(prices.moving_average(stream(spark, files)), path, ["match_id"], f"{path}/c")
    spark.conf.set(key, before)
    frame = pd.DataFrame(rows, columns=["e", "ts", "k", "t", "v", "p"]).assign(o=lambda d: 1.2 + d.v % 5)
    want = {k: g.o.ewm(alpha=0.3, adjust=False).mean().iloc[-1] for k, g in frame.groupby("k")}
    assert {r["match_id"]: r["ema"] for r in out.collect()} == pytest.approx(want)


def test_movement_and_ingest_over_batches(spark, folder):
    rows, files = folder
    path = new_path(spark, "move")
    out = prices.run_upsert(prices.movement(stream(spark, files)), f"{path}/a", ["match_id"], f"{path}/ca")
    assert {r["match_id"]: r["n_snapshots"] for r in out.collect()} == pd.Series([r[2] for r in rows]).value_counts().to_dict()
    twice = stream(spark, files).select("event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    kept = prices.run_ingest(twice, f"{path}/b", "event_id", ["copy"], f"{path}/cb")
    assert kept.count() == 90 and kept.where("copy = 2").count() == 0
    again = prices.run_ingest(twice, f"{path}/b", "event_id", ["copy"], f"{path}/cb2")
    assert again.count() == 90


def batches(spark, path, *groups):
    """One file per group of events ``(event id, hour, match, price)``, taken in order."""
    start = datetime(2024, 1, 1)
    for rows in groups:
        events = [(i, start + timedelta(hours=hour), key, "q", price, "{}") for i, hour, key, price in rows]
        spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("append").parquet(path)


def expiring(spark, path, ends):
    table = spark.createDataFrame([(k, datetime(2024, 1, 1) + timedelta(hours=h)) for k, h in ends.items()], "match_id bigint, ends_at timestamp")
    return prices.with_ends(stream(spark, path), table)


#: Prices come late within the watermark; match 1 ends at hour 5, match 2 at 60, match 3 has no known end.
LATE = ([(1, 0, 1, 1.0), (2, 3, 1, 2.0), (4, 2, 2, 4.0), (3, 1, 2, 3.0)], [(5, 4, 1, 5.0), (6, 2.5, 1, 0.5), (7, 9, 1, 9.0), (8, 10, 2, 1.5)],
        [(9, 30, 2, 2.5), (10, 29, 2, 0.7), (11, 31, 3, 1.1)], [(12, 59, 2, 3.3), (13, 62, 2, 8.0)], [(14, 100, 3, 1.9)], [(15, 101, 3, 2.9)])


def before_the_end(ends):
    """Prices of each match in event-time order, none after its end."""
    out = {}
    for i, hour, key, price in sorted((r for g in LATE for r in g), key=lambda r: (r[1], r[0])):
        if hour <= ends.get(key, 10 ** 6):
            out.setdefault(key, []).append((hour, i, 1.2 + price % 5))
    return out


def test_movement_and_average_with_late_rows_equal_the_batch_result(spark):
    path, ends = new_path(spark, "late"), {1: 5, 2: 60}
    batches(spark, f"{path}/events", *LATE)
    want = before_the_end(ends)
    out = prices.run_upsert(prices.moving_average(expiring(spark, f"{path}/events", ends)), f"{path}/a", ["match_id"], f"{path}/ca")
    average = {k: pd.Series([p for _, _, p in v]).ewm(alpha=0.3, adjust=False).mean().iloc[-1] for k, v in want.items()}
    assert {r["match_id"]: (r["n"], round(r["ema"], 9)) for r in out.collect()} == {k: (len(v), round(average[k], 9)) for k, v in want.items()}
    out = prices.run_upsert(prices.movement(expiring(spark, f"{path}/events", ends)), f"{path}/m", ["match_id"], f"{path}/cm")
    got = {r["match_id"]: (r["n_snapshots"], round(r["home_odds_open"], 9), round(r["home_odds_current"], 9)) for r in out.collect()}
    assert got == {k: (len(v), round(v[0][2], 9), round(v[-1][2], 9)) for k, v in want.items()}


@pytest.mark.parametrize("operator", [prices.movement, prices.moving_average])
def test_state_of_a_match_goes_when_it_is_over(spark, operator):
    """Twenty matches end one after another; what is held falls although rows go on."""
    path = new_path(spark, "expiry")
    hours, kept = [0, 20, 60, 100, 140], []
    batches(spark, f"{path}/events", *[[(100 * g + k, hour, k, 1.5) for k in range(20) if hour <= 10 + 6 * k] for g, hour in enumerate(hours)])
    df = operator(expiring(spark, f"{path}/events", {k: 10 + 6 * k for k in range(20)}))
    with prices.rocksdb(spark):
        query = (df.writeStream.foreachBatch(lambda batch, i: kept.append(batch.count())).outputMode("update")
                 .option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start())
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    removed = sum(p["stateOperators"][0]["numRowsRemoved"] for p in query.recentProgress if p["stateOperators"])
    assert held[-1] < max(held) / 2 and removed > 0, (held, removed)
    assert sum(kept) == sum(1 for h in hours for k in range(20) if h <= 10 + 6 * k)


def test_a_batch_of_an_ingest_reads_its_buckets_and_replays_do_nothing(spark):
    from tallyline.sources.tables import KeyedTable

    path = new_path(spark, "ingest")
    batches(spark, f"{path}/events", *[[(1000 * g + k, g, k, 1.0) for k in range(50)] for g in range(4)])
    source = stream(spark, f"{path}/events").select("event_id", "match_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    kept = prices.run_ingest(source, f"{path}/t", "event_id", ["copy"], f"{path}/c", rows_per_bucket=16)
    assert kept.count() == 200 and kept.where("copy = 2").count() == 0
    table = KeyedTable(spark, f"{path}/t", kept.schema, ["event_id"], 16)
    manifest = table.manifest()
    assert manifest["writers"] == {f"{path}/c": 3} and manifest["buckets"] >= 8
    again = spark.createDataFrame([(1, 1, 9)], kept.schema)
    table.add_new(again, ["copy"], f"{path}/c", 3)  # the last batch again, after a crash that came before its mark
    assert table.versions()[-1] == manifest["version"]
    table.add_new(again, ["copy"], f"{path}/c", 4)
    assert len(table.touched) <= KeyedTable.MOST_FOLDERS and table.read().count() == 200


def test_sessions_over_batches_out_of_order(spark):
    """A later batch moves a session's start; each closed session is given once, as the batch twin has it."""
    path, start = new_path(spark, "sessions"), datetime(2024, 1, 1)
    batches = [[(1, 0, 1), (2, 8, 1), (3, 1, 2)], [(4, 7, 1), (5, 9, 2)], [(6, 11, 1), (7, 30, 2)], [(8, 200, 3)]]
    for rows in batches:
        events = [(i, start + timedelta(hours=hour), key, "q", 1.0 + i, "{}") for i, hour, key in rows]
        spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/events")
    prices.run_append(prices.sessions(stream(spark, f"{path}/events")), f"{path}/rows", f"{path}/c")
    got = sorted((r["match_id"], (r["start"] - start).total_seconds() / 3600, r["n"]) for r in spark.read.parquet(f"{path}/rows").collect())
    assert got == [(1, 0.0, 1), (1, 7.0, 3), (2, 1.0, 1), (2, 9.0, 1), (2, 30.0, 1)]


def test_calibration_of_a_year_does_not_see_its_results(spark):
    rnd = random.Random(4)
    rows = [(k, 2000 + k % 3, round(rnd.random(), 3), int(rnd.random() < 0.5)) for k in range(300)]
    turned = [(k, y, p, 1 - won if y == 2002 else won) for k, y, p, won in rows]
    got = [{r["game_id"]: r["c"] for r in m.calibrate_forward(
        spark.createDataFrame(x, f"game_id long, year int, prob double, {m.LABEL} int"), "prob", "c").collect()} for x in (rows, turned)]
    assert got[0] == got[1] and {2000 + k % 3 for k in got[0]} == {2001, 2002}


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        x, z = rnd.random(), (rnd.random() if rnd.random() > 0.1 else None)
        rows.append((i, datetime(2018 + i // 100, 1, 1), 2018 + i // 100, x, z, int(rnd.random() < x), (x - 0.5) * 60 + rnd.random()))
    return spark.createDataFrame(rows, "game_id bigint, date timestamp, year int, x double, z double, home_win int, margin double")


def test_walk_forward_trains_on_the_past_only(table):
    seen = []

    def spy(train, features, seed):
        seen.append(train.agg(F.max("year"), F.min("year")).first())
        return m.classifier(train, features, seed, iterations=2, depth=2)

    oof = m.walk_forward(table, ["x", "z"], [2018, 2020, 2021], spy, seeds=(1,))
    assert sorted(tuple(r) for r in seen) == [(2019, 2018), (2020, 2018)]  # fits run side by side
    assert sorted(r["year"] for r in oof.select("year").distinct().collect()) == [2020, 2021] and oof.count() == 200


def test_isotonic_is_monotone_and_clipped(table):
    out = m.calibrate(m.fit_isotonic(table, "x"), table, "x", "c").orderBy("x").select("c").collect()
    c = [r["c"] for r in out]
    assert all(a <= b + 1e-12 for a, b in zip(c, c[1:])) and min(c) >= 0.02 and max(c) <= 0.98


def test_contributions_add_up_to_the_log_odds(table):
    rows = m.contributions(table, table, ["x", "z"], top=2)
    total = rows.groupBy("game_id").agg((F.sum("contribution") + F.first("base_value")).alias("t"), F.count(F.lit(1)).alias("n"))
    assert total.where("n <> 2").count() == 0
    order = table.join(total, "game_id").select(F.corr("x", "t")).first()[0]
    assert order > 0.8


class FakeState:
    """One state of a match, with the number of calls to it."""

    def __init__(self):
        self.map, self.calls = {}, 0

    def _do(self, what):
        self.calls += 1
        return what()

    def exists(self):
        return self._do(lambda: None in self.map)

    def get(self):
        return self._do(lambda: self.map.get(None))

    def update(self, value):
        self._do(lambda: self.map.update({None: value}))

    def clear(self):
        self._do(self.map.clear)

    def keys(self):
        return self._do(lambda: list(self.map))

    def getValue(self, key):
        return self._do(lambda: self.map[key])

    def updateValue(self, key, value):
        self._do(lambda: self.map.update({key: value}))

    def removeKey(self, key):
        self._do(lambda: self.map.pop(key))


class FakeHandle:
    def __init__(self):
        self.states, self.timers = [], []

    def getValueState(self, *_):
        self.states.append(FakeState())
        return self.states[-1]

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)


class Watermark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


@pytest.mark.parametrize("many", [300, 3 * 4096 + 5])
def test_average_of_a_match_takes_few_state_calls_and_folds_any_number_of_prices(many):
    rng = np.random.default_rng(many)
    start, hour = datetime(2024, 1, 1), 3600.0
    rows = pd.DataFrame({"fetched_at": [start + timedelta(seconds=float(x)) for x in rng.uniform(0, 30 * 24 * hour, many)],
                         "event_id": rng.permutation(many), "home_odds": rng.uniform(1, 5, many)}).assign(ends_at=pd.NaT)
    rows["day"] = rows["fetched_at"].dt.day // 8
    handle, ema = FakeHandle(), prices.PriceEma()
    ema.init(handle)
    for day, batch in sorted(rows.groupby("day"), key=lambda x: x[0]):
        slices = [batch.iloc[i:i + 1000] for i in range(0, len(batch), 1000)]
        passed = (batch["fetched_at"].min().to_pydatetime() - datetime(1970, 1, 1)) / timedelta(milliseconds=1)
        out = next(iter(ema.handleInputRows((1,), iter(slices), Watermark(int(passed) - 1))))
    want = rows.sort_values(["fetched_at", "event_id"])["home_odds"].ewm(alpha=0.3, adjust=False).mean().iloc[-1]
    assert out["n"][0] == many and out["ema"][0] == pytest.approx(want)
    batches = rows["day"].nunique()
    if many < prices.HELD:
        assert sum(s.calls for s in handle.states) + len(handle.timers) <= 3 * batches
    waiting = sum(len(v[-1]) for s in handle.states for v in s.map.values())
    assert waiting < many  # the watermark has passed the batches before the last
    list(ema.handleExpiredTimer((1,), None, Watermark(max(handle.timers))))
    assert not any(s.map for s in handle.states)
