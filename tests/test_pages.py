"""The tag scanner: attributes, nesting, missing end tags, and text that only looks like tags."""

import re

from pyspark.sql import functions as F

from tallyline.sources import pages


def page(spark, *htmls):
    return spark.createDataFrame([(k, h) for k, h in enumerate(htmls)], "page_id int, html string").withColumn("table", F.lit("x"))


def tables(df):
    return sorted((r["page_id"], r["table"], r["pos"], r["cells"]) for r in pages.page_tables(df).collect())


def items(df):
    return sorted(((r["page_id"], r["pos"], r["item"]) for r in pages.item_rows(df).collect()), key=repr)


def test_tokens_cover_a_page(spark):
    html = """<!DOCTYPE html><p a='>' b="<x>">one<br/>two < three<!-- <td> --><script>if (a<b) "</p>"</script><STYLE>p>q{}</style><?x y?></P>"""
    assert "".join(re.findall(pages.TOKEN.replace('\\"', '"'), html)) == html
    got = [(r["tag"], r["closes"], r["text"]) for r in pages.tokens(page(spark, html), ["p", "td"]).orderBy("at").collect()]
    assert got == [("p", False, None), ("", False, "one"), ("", False, "two "), ("", False, "<"), ("", False, " three"), ("p", True, None)]


def test_items_with_attributes_nesting_and_missing_ends(spark):
    df = page(spark, "<ul class=a><li id='1'>one<li>two <b>bold</b><ol><li x='>'>in</li></ol> rest</li></ul><li>loose</li>",
              "<UL><LI>↗ up</LI><li> </li><li>Totals</li><li>last", None, "", "no tags", "</ul><li>a</ul><ul><li>b</ul>")
    assert items(df) == [(0, 0, "one"), (0, 1, "two bold rest"), (0, 2, "in"), (0, 3, "loose"), (1, 0, "up"), (1, 3, "last"), (5, 0, "a"), (5, 1, "b")]


def test_nested_tables_belong_to_themselves(spark):
    df = page(spark, "<table id=o><tr><td>left<table><tr class='x'><th>P</th><th>G</th></tr><tr><td>a<td>1<tr><td>b</td><td>2</td></table> tail</td><td>right</td></tr></table>"
                     "<table><tr><td>z</td></tr></table>", "<tr><td>no table</td></tr>", "<table><tr></tr><td>no row</td></table>")
    assert tables(df) == [(0, 0, 0, ["left tail", "right"]), (0, 1, 1, ["P", "G"]), (0, 1, 2, ["a", "1"]), (0, 1, 3, ["b", "2"]), (0, 2, 4, ["z"]), (1, 0, 0, ["no table"])]


def test_rows_by_titles(spark):
    head = "<table><tr><td>Player</td><td>G</td><td>G</td></tr>"
    df = page(spark, head + "<tr><td>Ann ↙</td><td>1</td><td>2</td></tr><tr><td>short</td></tr><tr><td>TOTAL</td><td>1</td><td>2</td></tr><tr><td></td><td>1</td><td>2</td></tr></table>",
              "<table><tr><td>Team</td></tr><tr><td>Ann</td></tr></table>")
    assert [(r["page_id"], r["table"], r["pos"], r["values"]) for r in pages.titled_rows(df, "Player").collect()] == [(0, 0, 1, {"Player": "Ann", "G": "2"})]
    assert [tuple(r) for r in pages.table_rows(df, ["Player", "A", "B"]).collect()] == [(0, 1, "Ann", "1", "2")]


def test_pages_of_one_id_do_not_mix(spark):
    df = spark.createDataFrame([(1, "<ul><li>a"), (1, "<li>b</li><li>c</li>"), (None, "<li>d</li>")], "page_id int, html string")
    assert items(df) == sorted([(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (None, 0, "d")], key=repr)


def test_score_tables(spark):
    line = "<tr a='b'><td><b>{}</b></td><td>1.1 2.2 3.3 4.4</td><td>28</td></tr>"
    df = page(spark, f"<table>{line.format('Home side')}{line.format('Away')}<tr><td>Venue: Oval</td></tr></table><table>{line.format('One')}</table>")
    got = [r.asDict() for r in pages.table_records(df).collect()]
    assert len(got) == 1 and (got[0]["home_team"], got[0]["away_q2"], got[0]["venue"], got[0]["table"]) == ("Home side", 14, "Oval", 0)


def test_a_long_page_and_one_shuffle(spark):
    html = "<table class='big'>" + "".join(f"<tr><td w={k}>p{k}<td>{k}" for k in range(20_000)) + "</table>"
    df = pages.page_tables(page(spark, html))
    assert df.count() == 20_000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_tokens_stay_in_their_task(spark, monkeypatch):
    """The shuffle moves whole pages, not their tokens, and a task takes a few pages at a time."""
    monkeypatch.setattr(pages, "AT_ONCE", 5)
    html = ["</table></ul><tr><td>x<td>y</tr>late<td>z", None, "<table><tr><td> a <table><tr><td>in</table> b<tr><td></table>", "", "<ul><li>q<ul><li>r</ul>s"]
    df = page(spark, *html)
    assert tables(df) == [(0, 0, 0, ["x", "y"]), (2, 0, 0, ["a  b"]), (2, 0, 2, [""]), (2, 1, 1, ["in"])]
    assert items(df) == [(4, 0, "qs"), (4, 1, "r")]
    plan = pages.page_tables(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "Window" not in plan, plan
