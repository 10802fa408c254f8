import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import fill_middle, filter_audit, mtree

SCHEMA = "doc_id long, text string, source string, part string, A int, good string, frames int, score int"


def documents(spark, rows):
    """Rows ``(doc_id, text, source)`` with columns that carry the operators' own names."""
    return spark.createDataFrame([(i, t, s, "x", 1, "x", 1, 1) for i, t, s in rows], SCHEMA)


# -- filter audit --------------------------------------------------------------

def plain_fails(rows):
    """Failing filters of every row, by the definitions."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any((u or "") == t and j is not None and j < i for j, u, _ in rows) else set()
        out.append(fails)
    return out


def plain_audit(rows, labels):
    fails, out = plain_fails(rows), {}
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    for part in {s or "" for _, _, s in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return out


def audited(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in rows}
    assert len(got) == len(rows)
    return got


def test_filter_audit_against_all_orders_one_by_one(spark):
    draw = random.Random(5)
    long_text = " ".join(f"word{k}" for k in range(250))
    pool = ["", None, " \n\t", "two words", "SHOUTING ALL THE WAY", "costs 5 $ & more", "same same " * 150, long_text, long_text + " |",
            "Ärger Ünder", long_text.upper(), "same same " * 150 + "#"]
    rows = [(k, draw.choice(pool), draw.choice(["s", "t", None, ""])) for k in range(300)]
    rows += [(None, long_text, "s"), (None, long_text, "s"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (-4, long_text, "t")]
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for k in range(0, 400, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x")).withColumn("n", F.lit(3))
    got = audited(filter_audit.filter_audit(documents(spark, rows).repartition(3), told))
    assert got == plain_audit(rows, labels)
    assert len(got) == 3 * 120 * 5


def test_filter_audit_of_nothing_and_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(documents(spark, []), labels).count() == 0
    got = audited(filter_audit.filter_audit(documents(spark, [(1, "x", "s"), (2, "x", None)]), labels))
    assert got == plain_audit([(1, "x", "s"), (2, "x", None)], [])


def test_very_long_and_marked_texts_have_the_right_marks(spark):
    rows = [(1, "word " * 600_000, "s"), (2, "word " * 600_000, "t"), (3, "ÄÖ" * 9 + "A" * 1, "s"), (4, "x" * 49 + "A", "s"), (5, "x" * 48 + "A", "s")]
    marks = filter_audit.document_marks(documents(spark, rows))
    got = {r["doc_id"]: {x for x in "ABCDE" if r[x]} for r in marks.collect()}
    assert got == {r[0]: f for r, f in zip(rows, plain_fails(rows))}


def test_audit_takes_other_filters_and_measures(spark):
    rows = spark.createDataFrame([("a", True, None, 3), ("a", True, True, 4), ("b", False, False, 9)], "p string, x boolean, y boolean, bytes int")
    got = filter_audit.audit(rows, {"x": F.col("x"), "y": F.col("y")}, F.col("p"), {"bytes": F.col("bytes")})
    assert {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["bytes_lost"], r["shapley"])
            for r in got.collect()} == {
        ("a", "xy", 1): (0, 2, 0, 1, 7, 3), ("a", "xy", 2): (0, 0, 1, 0, 0, 1), ("a", "yx", 1): (1, 1, 0, 0, 4, 1), ("a", "yx", 2): (0, 1, 1, 1, 3, 3),
        ("b", "xy", 1): (1, 0, 0, 0, 0, 0), ("b", "xy", 2): (1, 0, 0, 0, 0, 0), ("b", "yx", 1): (1, 0, 0, 0, 0, 0), ("b", "yx", 2): (1, 0, 0, 0, 0, 0)}
    with pytest.raises(ValueError):
        filter_audit.audit(rows, {c: F.lit(True) for c in "abcdefgh"}, F.col("p"))


def test_removal_steps_are_the_least_position_of_a_failing_filter():
    fails = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 1], [1, 1, 1]], bool)
    orders = np.array(list(permutations(range(3))))
    steps, _ = filter_audit.removal_steps(fails, orders)
    for p, f in enumerate(fails):
        for o, order in enumerate(orders):
            assert steps[p, o] == min([np.inf] + [k for k, x in enumerate(order, 1) if f[x]])


# -- fill in the middle ---------------------------------------------------------

def plain_middle(doc_id, text, unit="line", seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def middle_rows():
    draw = random.Random(9)
    texts = ["", None, "\n", "\n\n\n", "one line", "two\nlines", "ends\n", "<P>", "a <S> b\nc", "<M", "<", "<P", "<\nS>\nP>", "ÄÖÜ\n漢字\n🎈 line\n",
             "x" * 1000, "漢" * 400, ("🎈" * 30 + "\n") * 30, "a\r\nb\r\n", "tail <", "<<P\n<<S\n<<M\n"]
    texts += ["".join(draw.choice(["ab", "\n", "é", "<", "S>", "🎈", " ", "P"]) for _ in range(draw.randrange(1, 400))) for _ in range(300)]
    rows = [(k * 3 - 20, t, "s") for k, t in enumerate(texts)]
    return rows + [(None, "a\nb\nc\nd", "s"), (None, "a\nb\nc\nd", "s"), (10, "same id\nother text", "s"), (10, "same id\nother text", "s"), (2 ** 62, "x\ny", "s")]


@pytest.mark.parametrize("unit,frame,seed,rate,spm_rate", [("line", 16, 7, 100, 50), ("line", 1 << 16, 7, 100, 50), ("character", 5, 3, 60, 20), ("line", 4, 1, 100, 100)])
def test_fill_in_middle_against_strings(spark, unit, frame, seed, rate, spm_rate):
    rows = middle_rows()
    stored = fill_middle.store(documents(spark, rows).repartition(3), unit=unit, frame=frame)
    made = fill_middle.fill_in_middle(stored, unit, seed, rate, spm_rate)
    want = sorted(((i, *plain_middle(i, t, unit, seed, rate, spm_rate)) for i, t, _ in rows), key=repr)
    got = sorted((tuple(r) for r in fill_middle.texts(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_text").collect()), key=repr)
    assert got == want
    back = sorted(((r["doc_id"], r["original_text"]) for r in fill_middle.originals(made).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t, _ in rows), key=repr)
    assert {w[2] for w in want} >= ({"plain", "spm"} if spm_rate == 100 else {"plain", "spm", "psm"})


def test_middle_digests_and_long_texts(spark):
    long_text = "".join(f"line {k} of a very long text 漢字\n" for k in range(120_000))
    rows = [(5, long_text, "s"), (6, "z" * 5_000_000, "s"), (7, None, "s")]
    got = {r["doc_id"]: r for r in fill_middle.fill_in_middle_digests(documents(spark, rows)).collect()}
    for i, text, _ in rows:
        n, form, p, m, output = plain_middle(i, text)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert tuple(got[i][c] for c in ("n", "form", "prefix_chars", "middle_chars")) == (n, form, p, m)
        assert (got[i]["output_sha256"], got[i]["restored_sha256"]) == (sha(output), sha(text or ""))
    assert fill_middle.fill_in_middle_digests(documents(spark, [])).count() == 0


def test_a_cut_opens_one_frame():
    text = "".join(f"{k}\n" for k in range(5000)).encode()
    frames = [{"ends": p.count(b"\n"), "chars": len(p), "size": len(p), "data": fill_middle._shrink(p)} for p in fill_middle.pieces(text, 512)]
    held = fill_middle.Frames(frames, "line")
    out = fill_middle.transformed(5, 5000, False, held, 7, 100, 50)
    assert len(frames) > 40 and held.opened <= 2
    assert len(set(out[3]) & {f["data"] for f in frames}) >= len(frames) - 2  # whole frames are handed on as they are


# -- exact top products ----------------------------------------------------------

def plain_top(rows, every, k, scale=256):
    points = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, v in points:
        if q % every == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in points if i != q and len(w) == len(v)]
            out[q] = [(r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return {q: v for q, v in out.items() if v}


def searched(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("page_rows", [None, 64])
def test_top_products_against_brute_force(spark, monkeypatch, page_rows):
    """Clusters, a common vector with thousands of copies, other lengths, odd rows; one tree or many."""
    if page_rows:
        monkeypatch.setattr(mtree, "TREE_BYTES", page_rows * 64)
        monkeypatch.setattr(mtree, "QUERIES", 7)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(9, 8)) * 2
    rows = [(k, (centres[k % 9] + draw.normal(size=8) * 0.2).tolist()) for k in range(900)]
    rows += [(k, [0.5, -0.25, 1.0, 2.0, 0.0, 0.0, 1.5, -1.0]) for k in range(900, 1700)]  # copies: ranks go to the smallest ids
    rows += [(k, draw.normal(size=3).tolist()) for k in range(1700, 1760)] + [(1800, [1.0, 2.0, 3.0, 4.0]), (1850, []), (1851, [])]
    rows += [(None, [1.0] * 8), (1900, None), (1950, [1.0] * 7 + [None]), (2000, [float("nan")] * 8), (2050, [float("inf")] + [0.0] * 7),
             (-50, [0.0] * 8), (2100, [1e-3] * 8), (3, rows[3][1]), (3, rows[3][1]), (2150, [1e3, -1e3] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("rank", "score", "cluster", "dims", "vector", "x"):
        df = df.withColumn(c, F.lit("x"))
    assert searched(mtree.top_products(df.repartition(3))) == plain_top(rows, 50, 5)


def test_top_products_of_few_rows_and_long_components(spark):
    schema = "vec_id long, embedding array<double>"
    assert mtree.top_products(spark.createDataFrame([], schema)).count() == 0
    few = [(0, [1.0, 2.0]), (1, [3.0, -4.0]), (2, [3.0, -4.0])]
    assert searched(mtree.top_products(spark.createDataFrame(few, schema))) == plain_top(few, 50, 5)
    assert mtree.top_products(spark.createDataFrame(few[:1], schema)).count() == 0
    # squares beyond 2^53 need 64-bit integers; beyond 2^62 a vector takes no part
    draw = np.random.default_rng(1)
    large = [(k, (draw.normal(size=4) * 1e6).tolist()) for k in range(300)]
    got = searched(mtree.top_products(spark.createDataFrame(large + [(400, [1e18] * 4)], schema)))
    assert got == plain_top(large, 50, 5)


def test_stored_bounds_avoid_computations():
    draw = np.random.default_rng(2)
    points = np.concatenate([draw.normal(size=(200, 16)) * 3 + c for c in draw.normal(size=(30, 16)) * 90]).astype(np.int64)
    ids = draw.permutation(len(points)).astype(np.int64)
    pages = mtree.bulk_load(ids, points)
    leaves = [p for p in pages if p["ids"] is not None]
    assert sorted(np.concatenate([np.frombuffer(p["ids"], np.int64) for p in leaves])) == list(range(len(points)))
    for p in leaves:  # covering radius, parent distance and longest vector hold for what lies below
        x, pivot = np.frombuffer(p["x"], np.int64).reshape(-1, 16), np.frombuffer(p["pivot"], np.int64)
        gap = np.sqrt(((x - pivot).astype(float) ** 2).sum(axis=1))
        assert np.allclose(gap, np.frombuffer(p["gaps"])) and gap.max() <= p["radius"] + 1e-9
        above = np.frombuffer(pages[p["parent"]]["pivot"], np.int64)
        assert np.isclose(p["to_parent"], np.sqrt(((pivot - above).astype(float) ** 2).sum()))
    tree = mtree.Tree(pages, 16)
    for k in range(0, 60):
        want = sorted((-int(points[j] @ points[k]), int(ids[j])) for j in range(len(points)) if j != k)[:5]
        assert sorted((-s, i) for s, i in tree.best(int(ids[k]), points[k], 5)) == want
    assert tree.computed < 0.2 * 60 * len(points)
