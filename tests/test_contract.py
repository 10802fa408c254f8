import threading
from types import SimpleNamespace

import duckdb
import pytest

import __spark_entry__ as contract
from tallyline.plans.registry import ORACLES, QUERIES
from tools import check

ROWS_ONLY = {"m2_feature_matrix", "m3_classifier_early_stop", "m4_margin_regressor", "m5_walk_forward", "m6_seed_ensemble",
             "m8_grid_search", "m9_feature_ablation", "m10_stacking", "m11_two_stage_margin",
             "m12_conditioned_margin", "m13_loss_comparison", "m14_market_variants", "m15_feature_importance", "m16_contributions",
             "m17_score_upcoming", "m18_model_comparison", "m19_backfill_scores", "m20_walk_forward_betting"}


def test_every_query_has_sql_unless_it_trains_a_model():
    """Of the library's own queries; the pipeline operators have a subpackage and tests of their own."""
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", ["w1_rolling_form", "w14_elo_ratings", "w19_absence_quality", "j4_ordinal_pairing", "a3_quote_consensus",
                                  "w21_staking_ledger", "p25_change_key", "s6_link_ids", "t2_price_movement_stream",
                                  "s7_nested_tables", "s11_keyed_upsert", "t4_stateful_ema", "m7_isotonic_calibration"])
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = contract.queries()[name](spark, small)
    cur = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(columns, cur.fetchall())


def test_history_splits_a_key_and_prunes_the_scan(spark, small):
    """The team window is partitioned by (team, block) and reads only the columns it needs."""
    df = contract.queries()["w2_margin_volatility"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "__block" in plan and "ReadSchema" in plan and "venue" not in plan.split("ReadSchema", 1)[1].split("\n")[0]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_feature_table_makes_shared_steps_once(spark, monkeypatch):
    from tallyline.operators import history, ratings
    from tallyline.plans import features
    from tallyline.plans.registry import Tables

    made = []
    for module, name in ((history, "rolling_form"), (history, "rest_days"), (ratings, "elo")):
        def counted(*args, _own=getattr(module, name), _name=name, **kwargs):
            made.append(_name)
            return _own(*args, **kwargs)
        monkeypatch.setattr(module, name, counted)
    monkeypatch.setattr(features, "GROUPS", ("w1_rolling_form", "w2_margin_volatility", "w6_rest_days", "w7_bye_flags", "w10_rating_velocity",
                                             "w11_schedule_strength", "w14_elo_ratings"))
    table = features.feature_table(Tables(spark, "/root/testdata/sf0.001"))
    assert sorted(made) == ["elo", "rest_days", "rolling_form"]
    assert {"w1_game_id", "w2_margin_volatility_diff_5", "w7_bye_advantage", "w14_elo_expected"} <= set(table.columns)


def test_feature_groups_are_made_side_by_side_and_share_steps(spark, monkeypatch):
    """Two groups that wait for each other, and a step that both read and only one makes."""
    from tallyline.plans import features
    from tallyline.plans.registry import Tables

    meet, made = threading.Barrier(2, timeout=60), []

    def group(name):
        def run(t):
            meet.wait()
            rows = t.step("shared", lambda: made.append(name) or spark.range(3).withColumnRenamed("id", "game_id"))
            return rows.selectExpr("game_id", f"game_id * 2 as {name}")
        return run

    monkeypatch.setattr(features, "GROUPS", ("w1_one", "w2_two"))
    monkeypatch.setattr(features, "OVER_TABLES", {"w1_one": group("a"), "w2_two": group("b")})
    t = Tables(spark, "")
    t.games = SimpleNamespace()
    rows = features.feature_table(t).collect()
    assert sorted(tuple(r) for r in rows) == [(0, 0, 0), (1, 2, 2), (2, 4, 4)] and len(made) == 1
