import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plain import GAME_SCHEMA, elo, ledger, make_games, team_features
from tallyline.operators import history, markets, ratings, scan
from tallyline.operators.scan import ema, last_n, running


def near(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-7)


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(3)
    # key "hot" holds most rows; several rows share a day; a fifth has no value
    rows = [(i, "hot" if rnd.random() < 0.7 else f"k{i % 4}", rnd.randrange(40), rnd.random() * 10 if rnd.random() > 0.2 else None)
            for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, key string, day int, v double").withColumn(
        "date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")))
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        by_key.setdefault(r[1], []).append(r)
    return df, by_key


@pytest.mark.parametrize("piece", [1 << 20, 17])
def test_running_matches_plain_prefixes(series, monkeypatch, piece):
    """One piece and many, cut inside days, give the same answer."""
    monkeypatch.setattr(scan, "PIECE", piece)
    df, by_key = series
    got = {r["id"]: r for r in running(df, ["key"], ["date", "id"], {
        "n": ("count", F.col("v")), "s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")),
        "prev": ("last", F.col("v"))}).collect()}
    assert len(got) == 400
    for rows in by_key.values():
        for i, r in enumerate(rows):
            past = [x[3] for x in rows[:i] if x[3] is not None]
            g = got[r[0]]
            assert g["n"] == len(past)
            assert near(g["s"], sum(past) if past else None)
            assert near(g["hi"], max(past, default=None)) and near(g["lo"], min(past, default=None))
            assert near(g["prev"], past[-1] if past else None)


@pytest.mark.parametrize("block", [3, 7, 1 << 20])
def test_last_n_is_exact_for_any_block_size(series, block):
    df, by_key = series
    counted = running(df, ["key"], ["date", "id"], {"k": ("count", F.col("v"))})
    got = {r["id"]: r["m"] for r in last_n(counted, ["key"], "k", F.col("v").isNotNull(), 3, lambda frame: {
        "m": F.avg("v").over(frame(3))}, block=block).collect()}
    assert len(got) == 400
    for rows in by_key.values():
        for i, r in enumerate(rows):
            past = [x[3] for x in rows[:i] if x[3] is not None][-3:]
            assert near(got[r[0]], sum(past) / len(past) if past else None)


@pytest.mark.parametrize("alpha", [0.3, 0.6])
def test_ema_matches_pandas(series, alpha):
    df, by_key = series
    counted = running(df, ["key"], ["date", "id"], {"k": ("count", F.col("v"))})
    got = {r["id"]: r for r in ema(counted, ["key"], "k", F.col("v").isNotNull(), {"v": F.col("v")}, alpha).collect()}
    for rows in by_key.values():
        known = [x for x in rows if x[3] is not None]
        after = dict(zip([x[0] for x in known], pd.Series([x[3] for x in known]).ewm(alpha=alpha, adjust=False).mean()))
        state = None
        for r in rows:
            assert near(got[r[0]]["v_before"], state)
            if r[0] in after:
                state = after[r[0]]
                assert near(got[r[0]]["v_after"], state)
            else:
                assert got[r[0]]["v_after"] is None


def test_pieces_are_bounded_on_one_key_and_one_day(spark, monkeypatch):
    monkeypatch.setattr(scan, "PIECE", 100)
    df = spark.range(2000).selectExpr("'a' as key", "date'2024-01-01' as date", "id")
    sizes = [r["count"] for r in scan.in_pieces(df, ["key", "date", "id"]).groupBy("__piece").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 300
    got = running(df, ["key"], ["date", "id"], {"n": ("count", F.lit(1))}).where("n != id").count()
    assert got == 0


def test_crowds_of_rows_that_are_not_valid_are_split(spark, monkeypatch):
    """A block with many upcoming rows: each part sees the last valid rows."""
    monkeypatch.setattr(scan, "PIECE", 50)
    df = spark.range(600).selectExpr("'a' as key", "date'2024-01-01' as date", "id", "case when id < 9 then double(id) end as v")
    counted = running(df, ["key"], ["date", "id"], {"k": ("count", F.col("v"))})
    got = {r["id"]: r["m"] for r in last_n(counted, ["key"], "k", F.col("v").isNotNull(), 3, lambda frame: {
        "m": F.avg("v").over(frame(3))}).collect()}
    assert len(got) == 600 and all(got[k] == 7.0 for k in range(9, 600)) and got[0] is None and got[2] == 0.5


@pytest.fixture(scope="module")
def games(spark):
    rows = make_games()
    return rows, spark.createDataFrame(rows, GAME_SCHEMA)


def test_team_history_matches_a_chronological_pass(games):
    rows, df = games
    numbered = history.numbered(df)
    form = {r["game_id"]: r for r in history.rolling_form(numbered).collect()}
    streak = {r["game_id"]: r for r in history.form_streak(numbered).collect()}
    rest = {r["game_id"]: r for r in history.rest_days(numbered).collect()}
    away = {r["game_id"]: r for r in history.consecutive_away(numbered).collect()}
    for (game, side), want in team_features(rows).items():
        assert near(form[game][f"{side}_win_rate_5"], want["win_rate_5"])
        assert near(form[game][f"{side}_avg_margin_5"], want["avg_margin_5"])
        assert near(form[game][f"{side}_margin_volatility"], want["volatility"])
        assert streak[game][f"{side}_form_streak"] == want["streak"]
        assert rest[game][f"{side}_rest_days"] == want["rest"]
        assert away[game][f"{side}_consecutive_away"] == want["away_run"]


def test_no_leakage_from_later_games(spark, games):
    """Cutting the table after a game changes no feature of that game."""
    rows, df = games
    cut = sorted(rows, key=lambda r: (r[2], r[0]))[:150]
    part = spark.createDataFrame(cut, GAME_SCHEMA)
    ids = {r[0] for r in cut}

    def features(table):
        numbered = history.numbered(table)
        parts = [history.rolling_form(numbered), history.form_streak(numbered), history.rest_days(numbered),
                 history.consecutive_away(numbered), history.head_to_head(table), history.venue_record(table), ratings.elo(table)]
        return [{r["game_id"]: tuple(None if v is None else round(float(v), 8) for v in r) for r in p.collect()
                 if r["game_id"] in ids} for p in parts]

    assert features(df) == features(part)


@pytest.mark.parametrize("rows_per_chunk", [1_000_000, 25])
def test_elo_in_chunks_equals_the_sequential_fold(games, rows_per_chunk):
    rows, df = games
    got = {r["game_id"]: r for r in ratings.elo(df, rows_per_chunk=rows_per_chunk).collect()}
    want = elo(rows)
    assert len(got) == len(want)
    for game, (h, a) in want.items():
        assert abs(got[game]["home_elo"] - h) < 1e-6 and abs(got[game]["away_elo"] - a) < 1e-6


def test_elo_conserves_the_total(games):
    rows, df = games
    last = {}
    for r in ratings.elo(df).join(df, "game_id").orderBy("date", "game_id").collect():
        last[r["league"], r["home_team"]] = r["home_elo"]
    assert all(1000 < v < 2000 for v in last.values())


@pytest.mark.parametrize("rows_per_chunk", [1_000_000, 20])
def test_ledger_skips_small_stakes_in_order(spark, rows_per_chunk):
    rnd = random.Random(9)
    rows = [("s" if rnd.random() < 0.8 else "t", i, i // 3, rnd.choice([0.0005, 0.01, 0.1]), 1.5 + rnd.random(), rnd.random() < 0.5)
            for i in range(150)]
    df = spark.createDataFrame(rows, "key string, game_id bigint, day int, bet_fraction double, odds double, won boolean").withColumn(
        "date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).cast("timestamp"))
    got = {(r["key"], r["game_id"]): (r["bet_amount"], r["bankroll"]) for r in markets.ledger(
        df, ["key"], rows_per_chunk=rows_per_chunk).collect()}
    want = ledger([(r[0], (r[2], r[1]), r[1], r[3], r[4], r[5]) for r in rows])
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9)


def test_empty_tables(spark):
    none = spark.createDataFrame([], GAME_SCHEMA)
    assert history.rolling_form(history.numbered(none)).count() == 0
    assert ratings.elo(none).count() == 0


def test_season_change_reverts_an_idle_team(spark):
    rows = [(1, "L", pd.Timestamp("2020-12-30").to_pydatetime(), 2020, 12, "V", "A", "B", 20, 10),
            (2, "L", pd.Timestamp("2021-01-05").to_pydatetime(), 2021, 1, "V", "C", "D", 5, 9),
            (3, "L", pd.Timestamp("2021-01-06").to_pydatetime(), 2021, 1, "V", "A", "B", None, None)]
    got = {r["game_id"]: r for r in ratings.elo(spark.createDataFrame(rows, GAME_SCHEMA)).collect()}
    want = elo(rows)
    assert abs(got[3]["home_elo"] - want[3][0]) < 1e-9 and want[3][0] > 1500


def test_recurrence_that_never_forgets_runs_each_chunk_a_few_times(spark):
    """A balance depends on all of its past; the rows processed stay linear in the table."""
    from pyspark.sql import types as T

    from tallyline.operators.recurrence import chunked_recurrence

    seen = spark.sparkContext.accumulator(0)

    def step(key, rows, state):
        seen.add(len(rows))
        balance, out = state.get("balance", 100.0), []
        for gain in rows["gain"]:
            balance = max(1.0, balance * gain)
            out.append(balance)
        return pd.DataFrame({"key": key[0], "id": rows["id"].tolist(), "balance": out}), {"balance": balance}

    rnd = random.Random(6)
    rows = [("a" if i % 5 else "b", i, 0.8 + 0.45 * rnd.random()) for i in range(300)]
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("id", T.LongType()), T.StructField("balance", T.DoubleType())])
    got = {r["id"]: r["balance"] for r in chunked_recurrence(
        spark.createDataFrame(rows, "key string, id bigint, gain double"), ["key"], ["id"], step, schema, rows_per_chunk=30).collect()}
    balance = {"a": 100.0, "b": 100.0}
    for key, i, gain in rows:
        balance[key] = max(1.0, balance[key] * gain)
        assert got[i] == pytest.approx(balance[key])
    assert seen.value <= 4 * len(rows)


def test_recurrence_hands_a_chunk_to_its_step_in_pieces(spark):
    """A worker never holds a whole chunk, and pieces carry the state; rows without order value come last."""
    from pyspark.sql import types as T

    from tallyline.operators.recurrence import chunked_recurrence

    largest = spark.sparkContext.accumulator(0)

    def step(key, rows, state):
        if len(rows) > 50:
            largest.add(1)
        total, out = state.get("total", 0.0), []
        for x in rows["x"]:
            total = 0.5 * total + x
            out.append(total)
        return pd.DataFrame({"id": rows["id"].to_numpy(), "total": out}), {"total": total}

    rows = [("ab"[i % 2], i if i < 398 else None, i, float(i % 7)) for i in range(400)]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("total", T.DoubleType())])
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "50")
    try:
        got = {r["id"]: r["total"] for r in chunked_recurrence(
            spark.createDataFrame(rows, "key string, at int, id bigint, x double"), ["key"], ["at", "id"], step, schema).collect()}
    finally:
        spark.conf.set(size, before)
    want, total = {}, {"a": 0.0, "b": 0.0}
    for key, _, i, x in rows:
        total[key] = 0.5 * total[key] + x
        want[i] = total[key]
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert largest.value == 0
