import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyline.functions import scalars as s
from tallyline.operators import joins, markets, metrics
from tallyline.sources import dimensions, ingest, pages
from tallyline.staging import new_path


def one(df):
    return df.first().asDict()


def values(spark, **cols):
    return one(spark.range(1).select(*[c.alias(n) for n, c in cols.items()]))


def test_scalar_edges(spark):
    lit = F.lit
    got = values(
        spark, kelly_even=s.kelly(lit(0.9), lit(1.0)), no_edge=s.kelly(lit(0.2), lit(2.0)), capped=s.kelly(lit(0.99), lit(5.0), 0.25, 0.1),
        guarded=s.guarded_implied(lit(1.0), lit(2.0)), draw=s.home_win(lit(5), lit(5)), unplayed=s.home_win(lit(None).cast("int"), lit(5)),
        flat=s.move_class(lit(0.005)), up=s.move_class(lit(0.0051)), none=s.move_class(lit(None).cast("double")),
        aligned=s.aligned(lit("home"), lit(0.0)), wet=s.is_wet(lit(5.0), lit(1)), dry=s.is_wet(lit(None).cast("double"), lit(0)),
        unknown_venue=s.interstate(lit("A"), lit(None).cast("string")), toss=s.predicted_winner(lit(0.500004), lit("H"), lit("A")),
        single=s.abbreviated(lit("Pele")), many=s.abbreviated(lit("Jan van der Berg")), r0=s.round_sort_key(lit("Opening Round")),
        r9=s.round_sort_key(lit("Grand Final")), r5=s.round_sort_key(lit("Bye")), rn=s.round_sort_key(lit("")),
        clip0=s.clip_probability(lit(0.0)), clip1=s.clip_probability(lit(1.0)), bad=s.number(lit("n/a")), nan=s.number(lit("NaN")))
    assert got["kelly_even"] is None and got["no_edge"] == 0.0 and got["capped"] == pytest.approx(0.1)
    assert got["guarded"] is None and got["draw"] == 0 and got["unplayed"] == 0
    assert (got["flat"], got["up"], got["none"]) == ("NEUTRAL", "AGREE", "UNKNOWN")
    assert got["aligned"] is False and got["wet"] == 0 and got["dry"] == 0 and got["unknown_venue"] == 0
    assert got["toss"] == "" and got["single"] is None and got["many"] == "J van der Berg"
    assert (got["r0"], got["r9"], got["r5"], got["rn"]) == (0, 900, 500, 999)
    assert (got["clip0"], got["clip1"]) == (0.02, 0.98) and got["bad"] is None and got["nan"] is None


def test_edges_are_antisymmetric(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(rnd.random(), 1.05 + rnd.random() * 4, 1.05 + rnd.random() * 4) for _ in range(200)], "p double, h double, a double")
    fair_h, fair_a = s.implied(F.col("h"), F.col("a")), s.implied(F.col("a"), F.col("h"))
    gap = df.select(F.max(F.abs((F.col("p") - fair_h) + (1 - F.col("p") - fair_a))).alias("g")).first()["g"]
    assert gap < 1e-12


def test_wilson_of_nothing(spark):
    low, high = s.wilson(F.lit(0), F.lit(0))
    low2, high2 = s.wilson(F.lit(0), F.lit(0), empty=(0.0, 0.0))
    assert list(values(spark, a=low, b=high, c=low2, d=high2).values()) == [0.0, 1.0, 0.0, 0.0]


def test_names_case_trim_and_error(spark):
    aliases = spark.createDataFrame([("Cats", "Geelong"), ("CATS FC", "Geelong")], "alias string, team string")
    df = spark.createDataFrame([(" Cats ",), ("cats fc",), ("Dogs",)], "n string")
    assert [r["t"] for r in joins.canonical_names(df, "n", aliases, "t").orderBy("n").collect()] == ["Geelong", None, "Geelong"]
    with pytest.raises(Exception, match="unknown name"):
        joins.canonical_names(df, "n", aliases, "t", unknown="error").collect()


def test_pairing_uses_each_id_once_and_borrows_the_first_year(spark):
    games = spark.createDataFrame([
        (1, datetime(2020, 1, 1), 2020, "A", "B"), (2, datetime(2020, 2, 1), 2020, "B", "A"), (3, datetime(2020, 3, 1), 2020, "A", "B"),
        (4, datetime(2021, 1, 1), 2021, "A", "B"), (5, datetime(2021, 1, 1), 2021, "C", "D")],
        "game_id bigint, date timestamp, year int, home_team string, away_team string")
    stats = spark.createDataFrame(
        [(mid, t, 2020, float(mid)) for mid in (10, 11, 12, 13) for t in ("A", "B")] + [(14, "C", 2021, 1.0)],
        "mid bigint, team string, year int, g double")
    got = {r["game_id"]: r["mid"] for r in joins.pair_ids(games, stats, ["g"]).collect()}
    # 2021 has no ids of A|B and takes the next unused one of 2020; id 14 has one team row only
    assert got == {1: 10, 2: 11, 3: 12, 4: 13, 5: None}


def test_standings_step_back_and_missing_team(spark):
    table = spark.createDataFrame([("L", 2020, 3, "A", 1, 120.0), ("L", 2020, 3, "B", 2, 90.0), ("L", 2021, 2, "A", 4, 99.0)],
                                  "league string, year int, round int, team string, rank int, percentage double")
    games = spark.createDataFrame([(1, "L", 2021, 1, "A", "B"), (2, "L", 2021, 6, "A", "B"), (3, "L", 2019, 4, "A", "B"), (4, "L", 2021, 2, "A", "B")],
                                  "game_id bigint, league string, year int, round int, home_team string, away_team string")
    got = {r["game_id"]: (r["home_ladder_rank"], r["away_ladder_rank"]) for r in joins.standings_as_of(games, table).collect()}
    assert got == {1: (1, 2), 2: (4, None), 3: (None, None), 4: (1, 2)}


def test_roster_needs_both_sides(spark):
    games = spark.createDataFrame([(1, 2020, 1, "A", "B"), (2, 2020, 1, "C", "D")], "game_id bigint, year int, round int, home_team string, away_team string")
    by_id = spark.createDataFrame([(1, ["x"], None), (2, ["u"], ["v"])], "game_id bigint, home_roster array<string>, away_roster array<string>")
    sel = spark.createDataFrame([(2020, 1, "A", "B", ["p"], []), (None, None, "A", "B", ["h"], ["i"])],
                                "year int, round int, home_team string, away_team string, home_roster array<string>, away_roster array<string>")
    got = {r["game_id"]: (r["home_roster"], r["away_roster"]) for r in joins.roster_of_game(games, by_id, sel).collect()}
    assert got == {1: (["h"], ["i"]), 2: (["u"], ["v"])}


def test_settlement_draw_is_void_and_last_result_wins(spark):
    bets = spark.createDataFrame([("A", "B", "A", 10.0, 3.0, "pending", None), ("C", "D", "D", 5.0, 2.0, "pending", None),
                                  ("C", "D", "C", 5.0, 2.0, "won", 5.0), ("E", "F", "E", 1.0, 2.0, "pending", None)],
                                 "home_team string, away_team string, bet_team string, bet_amount double, odds double, status string, profit_loss double")
    results = spark.createDataFrame([(1, datetime(2020, 1, 1), "A", "B", 0, 9), (2, datetime(2020, 2, 1), "A", "B", 9, 0), (3, datetime(2020, 1, 1), "C", "D", 4, 4)],
                                    "game_id bigint, date timestamp, home_team string, away_team string, home_score int, away_score int")
    got = sorted((r["bet_team"], r["status"], r["profit_loss"]) for r in markets.settle(bets, results).collect() if r["status"] != "pending")
    assert got == [("A", "won", 20.0), ("C", "won", 5.0), ("D", "void", 0.0)]


def test_bands_overlap_and_bootstrap_covers_roi(spark):
    df = spark.createDataFrame([(i, "k", 0.05 + (i % 30) / 100, 100.0, 60.0 if i % 2 else -40.0) for i in range(400)],
                               "game_id bigint, key string, edge double, bet_amount double, profit double")
    labels = {r["band"] for r in markets.explode_bands(df.where("game_id = 12"), "edge", markets.EDGE_BANDS).collect()}
    assert labels == {"0.15-0.20", "0.05-0.30", "0.15-0.30", "0.15-1.00", "0.10-1.00"}
    ci = one(markets.bootstrap_roi(df, ["key"], reps=400))
    assert ci["roi_ci_low"] < 10.0 < ci["roi_ci_high"] and ci["roi_ci_high"] - ci["roi_ci_low"] < 15


def test_drawdown_counts_the_start(spark):
    df = spark.createDataFrame([("k", datetime(2020, 1, d), d, b) for d, b in ((1, 800.0), (2, 900.0), (3, 450.0))],
                               "key string, date timestamp, game_id bigint, bankroll double")
    assert one(markets.max_drawdown(df, ["key"], ["date", "game_id"]))["max_drawdown"] == pytest.approx(0.55)


def test_auc_with_ties_and_metrics_at_the_edges(spark):
    rnd = random.Random(4)
    rows = [("g", round(rnd.random(), 1), int(rnd.random() < 0.5)) for _ in range(120)] + [("g", 0.0, 0), ("g", 1.0, 1)]
    df = spark.createDataFrame(rows, "key string, p double, y int")
    pos, neg = [p for _, p, y in rows if y], [p for _, p, y in rows if not y]
    brute = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert one(metrics.auc(df, "p", "y", ["key"]))["auc"] == pytest.approx(brute)
    perfect = spark.createDataFrame([(0.0, 0), (1.0, 1), (0.5, 1)], "p double, y int")
    got = one(metrics.classification(perfect, "p", "y"))
    assert got["accuracy"] == 1.0 and got["log_loss"] == pytest.approx(-math.log(0.5) / 3, abs=1e-5)
    bins = metrics.reliability(perfect, "p", "y", [0.0, 0.5, 1.0]).orderBy("bin").collect()
    assert [r["n"] for r in bins] == [1, 2]


def test_guardrail_levels(spark):
    df = spark.createDataFrame([(0.5, 0.98, 1.0), (0.5, 0.98, None), (0.505, 0.1, None)], "home_win_prob double, analytical_home_prob double, home_line double")
    got = {r["check"]: r["level"] for r in metrics.guardrails(df).collect()}
    assert got["constant_output:home_win_prob"] == "fail" and got["clamp_saturation:analytical_home_prob"] == "warn"
    assert got["line_coverage"] == "warn" and got["model_disagreement"] == "warn"
    assert one(metrics.overall_level(metrics.guardrails(df)))["level"] == "fail"


def test_score_page_and_table(spark):
    text = ("Round 1\nSydney  3.3  4.3  7.10 12.14  86Thu 07-Mar-2024 7:30 PM Att: 40,012 Venue: Ground One\n"
            "Old Boys  1.1  2.2  3.3  4.4  28\n")
    got = one(pages.match_records(spark.createDataFrame([(1, text), (2, "no scores")], "page_id int, text string")))
    assert got["home_team"] == "Sydney" and got["home_q4"] == 12 * 6 + 14 and got["home_final_score"] == 86
    assert got["away_team"] == "Old Boys" and got["away_final_score"] == 28 and got["attendance"] == 40012
    html = ("<table><tr><th>Player</th><th>K</th></tr><tr><td><a>Al One</a> ↗</td><td>3</td></tr>"
            "<tr><td>x</td></tr><tr><td></td><td>9</td></tr><tr><td>Totals</td><td>3</td></tr></table>")
    rows = pages.table_rows(spark.createDataFrame([(1, html)], "page_id int, html string"), ["Player", "K"]).collect()
    assert [(r["Player"], r["K"]) for r in rows] == [("Al One", "3")]


def test_quotes_drop_strangers_and_half_lines(spark):
    doc = ('{"home_team":"H","away_team":"A","bookmakers":[{"markets":[{"key":"h2h","outcomes":[{"name":"H","price":1.5},'
           '{"name":"A","price":2.5},{"name":"Z","price":9}]},{"key":"spreads","outcomes":[{"name":"H","price":1.9,"point":-3.5},'
           '{"name":"A","price":1.9}]}]}]}')
    rows = ingest.flatten_quotes(spark.createDataFrame([(1, doc)], "id int, p string"), "p", ["id"])
    assert sorted((r["market"], r["side"]) for r in rows.collect()) == [("h2h", "away"), ("h2h", "home"), ("spreads", "home")]
    got = one(markets.quote_consensus(rows, ["id"]))
    assert got["home_line"] == -3.5 and got["away_line"] is None and got["home_odds"] == 1.5


def test_sinks(spark):
    path = new_path(spark, "sink")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    assert ingest.scan_optional(spark, path, df.schema).count() == 0
    ingest.overwrite(df.where("false"), path)
    assert spark.read.parquet(path).schema.names == ["id", "v"]
    ingest.append(df, path)
    ingest.append(df, path)
    assert ingest.scan(spark, path, df.schema).count() == 4
    up = ingest.upsert(df, spark.createDataFrame([(2, "new"), (3, "c")], "id bigint, v string"), ["id"])
    assert sorted(map(tuple, up.collect())) == [(1, "a"), (2, "new"), (3, "c")]
    more = ingest.add_new(df, spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "id bigint, v string"), "id", ["v"])
    assert sorted(map(tuple, more.collect())) == [(1, "a"), (2, "b"), (3, "y")]


def test_league_dimensions(spark):
    games = spark.createDataFrame([(1, "M.C.G.", "sydney swans", "Carlton"), (2, "Nowhere", "GWS", "West Coast")],
                                  "game_id int, venue string, raw string, away_team string")
    named = joins.canonical_names(games, "raw", dimensions.names(spark), "home_team")
    out = joins.attach_home_ground(joins.attach_travel(named, dimensions.teams(spark), dimensions.venues(spark)), dimensions.teams(spark))
    got = {r["game_id"]: r for r in out.collect()}
    assert got[1]["home_team"] == "Sydney" and got[1]["home_interstate"] == 1 and got[1]["away_at_home_ground"] == 1
    assert 700 < got[1]["home_travel_km"] < 730 and got[1]["away_interstate"] == 0
    assert got[2]["home_travel_km"] is None and got[2]["home_interstate"] == 0 and got[2]["home_at_home_ground"] == 0
