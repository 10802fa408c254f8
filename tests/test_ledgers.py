"""Bankroll maps, the ledger over chunks, and bootstrap replicates held as arrays."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators import markets, resample, scaling
from tests.plain import ledger


def bets(n, seed, shares=(0.0, 0.0002, 0.0009, 0.002, 0.03, 0.2, 1.0)):
    rnd = random.Random(seed)
    return [(rnd.choice(shares), rnd.choice([-1.0, 0.3, 0.8, 2.5])) for _ in range(n)]


def sequential(money, rows, minimum):
    for share, gain in rows:
        if money * share >= minimum:
            money += money * share * gain
    return money


@pytest.mark.parametrize("n,shares", [(1, (0.01,)), (2, (0.001, 0.1)), (37, (0.0, 0.0007, 0.004, 0.05)), (500, (0.0004, 0.001, 0.02, 0.2)), (64, (0.0,)), (40, (0.3, 1.0))])
def test_a_map_is_the_fold_of_its_bets_for_any_bankroll(n, shares):
    rows = bets(n, n, shares)
    m = scaling.bets_map(*zip(*rows), 1.0)
    assert m[0][0] == 0 and np.all(np.diff(m[0]) >= 0)
    for money in [0.0, 0.5, 1.0, 3.7, 20, 49.99, 333.3, 999.0, 1000.0, 1234.5, 5e4, 1e9]:
        assert scaling.applied(m, money) == pytest.approx(sequential(money, rows, 1.0), rel=1e-9)


def test_maps_compose_in_any_grouping():
    rows = bets(300, 8, (0.0005, 0.003, 0.02, 0.1))
    parts = [scaling.bets_map(*zip(*rows[i:i + 60]), 2.0) for i in range(0, 300, 60)]
    left = parts[0]
    for p in parts[1:]:
        left = scaling.compose(left, p)
    right = scaling.compose(parts[0], scaling.compose(parts[1], scaling.compose(parts[2], scaling.compose(parts[3], parts[4]))))
    whole = scaling.bets_map(*zip(*rows), 2.0)
    for money in np.geomspace(1, 1e6, 200):
        want = scaling.applied(whole, money)
        assert scaling.applied(left, money) == pytest.approx(want, rel=1e-9)
        assert scaling.applied(right, money) == pytest.approx(want, rel=1e-9)


def test_empty_and_odd_shares():
    m = scaling.bets_map([0.0, float("nan"), -0.2], [1.0, 1.0, 1.0], 1.0)
    assert scaling.applied(m, 77.0) == 77.0


@pytest.mark.parametrize("rows_per_chunk", [1 << 18, 40, 7])
def test_ledger_over_many_chunks_equals_one_walk(spark, rows_per_chunk):
    """One key holds most rows; bankrolls fall under the breaks of small shares and rise again."""
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice("ab"), i, i // 4, rnd.choice([0.0005, 0.0009, 0.0015, 0.01, 0.15]), 1.2 + 2 * rnd.random(), rnd.random() < 0.55)
            for i in range(900)]
    df = (spark.createDataFrame(rows, "key string, game_id bigint, day int, bet_fraction double, odds double, won boolean")
          .withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day"))).repartition(5))
    got = {(r["key"], r["game_id"]): (r["bet_amount"], r["bankroll"], r["odds"]) for r in markets.ledger(
        df, ["key"], rows_per_chunk=rows_per_chunk, carry=["odds", "won"]).collect()}
    want = ledger([(r[0], (r[2], r[1]), r[1], r[3], r[4], r[5]) for r in rows])
    assert got.keys() == want.keys() and 0 < len(want) < len(rows)
    odds = {(r[0], r[1]): r[4] for r in rows}
    for k, (amount, money) in want.items():
        assert got[k] == pytest.approx((amount, money, odds[k]), rel=1e-9)


def test_chunks_add_no_jobs(spark):
    """The number of Spark jobs does not grow with the chunks of a key."""
    rows = [("k", i, 0.01, 1.9, i % 3 > 0) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, game_id bigint, bet_fraction double, odds double, won boolean").withColumn("date", F.current_date())

    def jobs(rows_per_chunk):
        name = f"chunks of {rows_per_chunk}"
        spark.sparkContext.setJobGroup(name, name)
        assert markets.ledger(df, ["key"], rows_per_chunk=rows_per_chunk).count() == 400
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    assert jobs(4) <= jobs(200) + 2


def test_ledger_of_nothing(spark):
    none = spark.createDataFrame([], "key string, game_id bigint, date date, bet_fraction double, odds double, won boolean")
    assert markets.ledger(none, ["key"]).count() == 0


def test_draws_are_poisson_and_agree_with_sql():
    ids = np.array([0, 1, 77, 2 ** 40 + 5, 10 ** 15])
    times = resample.draws(ids, 5000)
    assert abs(times.mean() - 1) < 0.03 and abs(times.var() - 1) < 0.06
    assert len(resample.poisson_limits()) >= 12  # the tail goes on as far as 32 bits tell counts apart
    steps, count = resample.draws_sql("xor(g, g >> 32)", "rep")
    sql = "select g, rep from (select unnest([0, 1, 77, 1099511627781, 1000000000000000]::ubigint[]) as g), range(300) r(rep)"
    for name, value in steps:
        sql = f"select *, {value} as {name} from ({sql})"
    rows = duckdb.sql(f"select g, rep, {count} as n from ({sql}) order by g, rep").fetchall()
    assert [n for _, _, n in rows] == [int(x) for row in times[:, :300] for x in row]


@pytest.mark.parametrize("partitions", [1, 6])
def test_replicate_sums_against_one_array(spark, partitions):
    draw = np.random.default_rng(7)
    rows = [("big" if k % 3 else f"g{k}", k, float(draw.normal()), None if k % 97 == 0 else float(draw.random())) for k in range(900)]
    df = spark.createDataFrame(rows, "key string, id long, a double, b double").repartition(partitions)
    got = {r["key"]: np.frombuffer(r["sums"]).reshape(2, 70) for r in resample.replicate_sums(df, ["key"], "id", ["a", "b"], 70).collect()}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        times = resample.draws(np.array([r[1] for r in mine]), 70).astype(float)
        want = np.array([[r[2] for r in mine], [r[3] or 0.0 for r in mine]]) @ times
        assert np.allclose(got[key], want)
    assert len(got) == len({r[0] for r in rows})  # and groups beyond HELD are sent on in turns
    ci = {r["key"]: (r["lo"], r["hi"]) for r in resample.ratio_interval(df, ["key"], "id", "a", "b", 70, 0.9, 1.0, ("lo", "hi")).collect()}
    below = got["big"][1] > 0
    assert ci["big"] == pytest.approx(tuple(np.percentile(got["big"][0][below] / got["big"][1][below], [5, 95])))
