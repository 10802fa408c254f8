"""Boosted fits over a shared binned table, and the isotonic fit by ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.learning import boosting as b
from tallyline.learning import isotonic, passes

SCHEMA = "game_id long, year int, x double, z double, noise double, home_win int, margin double"


def rows(n=1500, seed=3):
    rnd, out = random.Random(seed), []
    for i in range(n):
        x, z = rnd.random(), rnd.random() if rnd.random() > 0.2 else None
        p = 0.1 + 0.8 * (x > 0.5) if z is None else 0.9 if (x > 0.5) != (z > 0.5) else 0.1
        out.append((i, 2000 + i * 6 // n, x, z, rnd.random(), int(rnd.random() < p), 40 * x - 20 + (10 if z is None else 0) + rnd.gauss(0, 2)))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def predictions(df, label="home_win", spec=b.Spec(), seeds=(1, 2), features=("x", "z", "noise")):
    out = b.walk(df, list(features), list(range(2000, 2006)), label, spec, seeds, "pred")
    return {(r["game_id"], r["seed"]): (r["pred"], r["trees"]) for r in out.collect()}


def test_trees_learn_an_interaction_and_stop_early(table):
    got = predictions(table)
    truth = {r[0]: r[5] for r in rows()}
    years = {r[0]: r[1] for r in rows()}
    assert len(got) == 2 * sum(y > 2000 for y in years.values())
    late = {k: v for k, v in got.items() if years[k[0]] >= 2003}
    loss = np.mean([-np.log(p if truth[i] else 1 - p) for (i, _), (p, _) in late.items()])
    assert loss < 0.45  # the best possible is about 0.33, a constant has 0.69
    stopped = {v[1] for k, v in got.items() if years[k[0]] >= 2002}
    assert max(stopped) < b.Spec().trees and min(stopped) > 5
    assert {v[1] for k, v in got.items() if years[k[0]] == 2001} == {b.Spec().without_stop}


def test_reruns_agree_and_seeds_differ(table):
    one, two = predictions(table, seeds=(1, 2)), predictions(table.repartition(5), seeds=(1,))
    assert all(two[k] == one[k] for k in two)
    assert any(one[i, 1][0] != one[i, 2][0] for i, _ in one)


def test_a_fold_sees_only_earlier_years(spark, table):
    turned = spark.createDataFrame([(*r[:5], 1 - r[5] if r[1] >= 2004 else r[5], r[6]) for r in rows()], SCHEMA)
    one, two = predictions(table, seeds=(1,)), predictions(turned, seeds=(1,))
    years = {r[0]: r[1] for r in rows()}
    assert all(one[k] == two[k] for k in one if years[k[0]] <= 2004) and any(one[k] != two[k] for k in one if years[k[0]] == 2005)


@pytest.mark.parametrize("loss", ["squared", "absolute", "huber"])
def test_margins(table, loss):
    got = predictions(table, "margin", b.Spec(loss=loss), (1,))
    truth = {r[0]: r for r in rows()}
    late = [abs(p - truth[i][6]) for (i, _), (p, _) in got.items() if truth[i][1] >= 2002]
    assert np.mean(late) < 3.0  # the noise alone has 1.6


def test_the_bound_on_learnt_rows_leaves_every_row_scored(table, monkeypatch):
    monkeypatch.setattr(b, "FIT_ROWS", 300)
    assert len(predictions(table, seeds=(1,))) == sum(r[1] > 2000 for r in rows())


def test_fits_receive_no_rows_beyond_the_bound(table, monkeypatch):
    """Rows are picked before they are dealt to the fits, whose memory does not grow with the table."""
    everything = b.Binned(table, ["x", "z"], ["home_win"])
    width = lambda df, part: sum(len(r[part]) for r in df.select(part).collect())
    assert width(everything.picked(), "bins") == 2 * len(rows()) and width(everything.picked(), "labels") == 8 * len(rows())
    monkeypatch.setattr(b, "FIT_ROWS", 100)
    assert 100 < width(everything.picked(), "bins") < 400
    monkeypatch.setattr(b, "FIT_ROWS", 0)
    task = {"label": "home_win", "fold": 2005, "seed": 1, "spec": b.Spec()}
    assert everything.fits([task])[0]["trees"] == []


def by_passes(binned, tasks, monkeypatch):
    """Models that passes over the blocks grow, with scores stored on the way, and those of a task each."""
    in_tasks = binned.fits(tasks)
    monkeypatch.setattr(b, "TASK_ROWS", 100)
    monkeypatch.setattr(passes, "KEPT", 2)
    return binned.fits(tasks), in_tasks


@pytest.mark.parametrize("loss, label", [("logistic", "home_win"), ("squared", "margin"), ("absolute", "margin"), ("huber", "margin")])
def test_passes_over_all_rows_grow_the_trees_of_one_task(table, monkeypatch, loss, label):
    monkeypatch.setattr(b, "BLOCK", 100)
    some = table.withColumn("margin", F.when(F.col("game_id") % 7 > 0, F.col("margin")))
    binned = b.Binned(some, ["x", "z", "noise"], ["home_win", "margin"])
    tasks = [{"label": label, "fold": f, "seed": 1, "spec": b.Spec(loss=loss, trees=4, without_stop=3, sample=1.0, depth=d)}
             for f, d in ((2000, 3), (2001, 2), (2002, 3), (2005, 3), (2006, 1))]
    got, want = by_passes(binned, tasks, monkeypatch)
    assert [len(m["trees"]) for m in got] == [len(m["trees"]) for m in want] and len(got[3]["trees"]) == 4
    for mine, theirs in zip(got, want):
        assert mine["base"] == pytest.approx(theirs["base"], abs=1e-5)
        for (f, high, value), (g, cut, leaf) in zip(mine["trees"], theirs["trees"]):
            assert (f, high) == (g, cut) and value == pytest.approx(leaf, abs=1e-5)


def test_passes_stop_early_and_reruns_agree(table, monkeypatch):
    tasks = [{"label": "home_win", "fold": 2004, "seed": seed, "spec": b.Spec(rate=0.5, depth=2, patience=3)} for seed in (1, 2)]
    got, want = by_passes(b.Binned(table, ["x", "z", "noise"], ["home_win"]), tasks, monkeypatch)
    assert all(0 < len(m["trees"]) < 40 for m in got) and got[0]["trees"] != got[1]["trees"]
    monkeypatch.setattr(passes, "KEPT", 50)
    assert b.Binned(table.repartition(5), ["x", "z", "noise"], ["home_win"]).fits(tasks) == got
    assert all(abs(len(m["trees"]) - len(w["trees"])) < 20 for m, w in zip(got, want))


def test_fits_learn_from_every_row(spark):
    """One late row in 300,000 moves the mean; a bound on learnt rows loses it or its weight."""
    df = spark.range(300_000).selectExpr("id as game_id", "cast(2000 + id % 2 as int) as year", "1d as x", "if(id = 77776, 3e6, 0) as margin")
    model = b.Binned(df, ["x"], ["margin"]).fits([{"label": "margin", "fold": 2001, "seed": 1, "spec": b.Spec(loss="squared", without_stop=1)}])[0]
    assert model["base"] == pytest.approx(20.0)


def test_rows_without_label_are_scored_and_empty_tables_are_empty(spark, table):
    binned = b.Binned(table.withColumn("home_win", F.when(F.col("year") < 2005, F.col("home_win"))), ["x", "z"], ["home_win"])
    models = binned.fits([{"label": "home_win", "fold": 2005, "seed": 1, "spec": b.Spec()}])
    assert binned.scores(models).count() == sum(r[1] == 2005 for r in rows())
    assert sum(b.importances(models[0], ["x", "z"]).values()) > 10
    none = spark.createDataFrame([], SCHEMA)
    assert b.walk(none, ["x"], [2001], "home_win", b.Spec(), (1,), "p").count() == 0


def test_halving_keeps_the_better_half(table):
    seen = []

    def loss(oof):
        seen.append(oof.count())
        joined = oof.join(table.select("game_id", "home_win"), "game_id")
        return joined.agg(F.avg((F.col("value") - F.col("home_win")) ** 2)).first()[0]

    found = b.halving(table, {"good": ["x", "z"], "bad": ["noise"]}, [b.Spec(depth=2), b.Spec(depth=1)], [2003, 2004], (1, 2), "home_win", loss)
    assert len(found) == 4 and found[0][0] == "good" and found[0][3] == 2 and [f[3] for f in found] == [2, 2, 1, 1] and len(seen) == 6


def exact(points):
    """max over starts of the least mean over ends, for each point."""
    xs = sorted({x for x, _ in points})
    s = [sum(y for x, y in points if x == v) for v in xs]
    n = [sum(1 for x, _ in points if x == v) for v in xs]
    return {v: max(min(sum(s[j:k + 1]) / sum(n[j:k + 1]) for k in range(i, len(xs))) for j in range(i + 1)) for i, v in enumerate(xs)}


@pytest.mark.parametrize("fan", [100_000, 7])
def test_isotonic_by_ranges_equals_the_exact_fit(spark, monkeypatch, fan):
    monkeypatch.setattr(isotonic, "FAN", fan)
    rnd = random.Random(2)
    points = [(x, float(rnd.random() < x ** 2)) for x in (rnd.randrange(60) / 60 for _ in range(400))]
    df = spark.createDataFrame([*points, (None, 1.0), (0.5, None)], "p double, y double").repartition(4)
    model = isotonic.fit(df, "p", "y")
    want = exact(points)
    got = {r["p"]: r["c"] for r in df.where("p is not null").select("p", model(F.col("p")).alias("c")).collect()}
    assert got == pytest.approx(want) and model.blocks < len(want) / 2
    outside = df.sparkSession.createDataFrame([(-3.0,), (9.0,), (None,)], "p double").select(model(F.col("p")).alias("c")).collect()
    assert [r["c"] for r in outside] == [pytest.approx(want[min(want)]), pytest.approx(want[max(want)]), None]
    assert isotonic.fit(df.where("false"), "p", "y").blocks == 0
