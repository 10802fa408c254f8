import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyline.llm import katz, language_id, mixing, near_dup, neighbours, packing, passages, pii, token_counts, vector_dup
from tallyline.llm.graph import components
from tallyline.llm.queries import vocabulary
from tests.llm import plain_llm as plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["component_id", "kept", "n_shingles", "size", "taken", "copies", "score", "lang_pred", "all_spans", "part", "held", "mark"]


@pytest.fixture(scope="module")
def prose(spark, small):
    """The given small table, whole, as Python rows."""
    return [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()]


@pytest.fixture(scope="module")
def messy(spark, prose):
    """Nulls everywhere, blank and very long texts, repeated rows, and columns named like the operators' own."""
    long_text = " ".join(f"w{k % 977} und die" for k in range(30_000))
    odd = [(900001, None, None, None, None), (900002, "", "en", "s", 0), (900003, " \n\t ", "en", None, 3), (None, "a null id", "en", "s", 9),
           (None, "a null id", "en", "s", 9), (900004, long_text, "de", "s", None), (900005, long_text + " more", "de", "s", None),
           (900006, "1234 5678 +-*/ 77", None, "s", 1), (900007, "same text of six words here", "en", "t", 1),
           (900007, "same text of six words here", "en", "t", 1), (-5, "same text of six words here", "en", "t", 1)]
    df = spark.createDataFrame(prose[:60] + odd, SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components_of_chains_stars_and_cycles(spark):
    random.seed(3)
    chain = [(k, k + 1) for k in range(1, 60)]
    star = [(100, 100 + k) for k in range(1, 300)]
    edges = chain + star + [(500, 501), (501, 502), (502, 500), (7, 7), (900, 899)]
    random.shuffle(edges)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, **{k: 100 for k in range(100, 400)}, 500: 500, 501: 500, 502: 500, 900: 899, 899: 899}


def test_super_minhash_estimates_jaccard():
    draw = np.random.default_rng(0)
    shared, a, b = (draw.integers(0, 1 << 63, n).astype(np.uint64) for n in (300, 100, 100))
    one, two = np.concatenate([shared, a]), np.concatenate([shared, b])
    both = near_dup.super_minhash(np.concatenate([one, two, one[:3]]), np.repeat([0, 1, 2], [400, 400, 3]), 3)
    assert abs((both[0] == both[1]).mean() - 300 / 500) < 0.12
    alone = near_dup.super_minhash(one[:3], np.zeros(3, int), 1)
    assert (alone[0] == both[2]).all() and len(set(both[2].tolist())) == near_dup.SLOTS


def test_near_duplicates_match_brute_force(messy):
    rows = messy.select("doc_id", "text").collect()
    got = near_dup.near_duplicates(messy).collect()
    assert len(got) == len(rows)
    want = plain.near_duplicates({r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}.items())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_near_duplicates_find_links_between_members_that_miss_the_bucket_leader(spark):
    """A drifting chain: neighbours are similar, ends are not, and no single leader reaches all."""
    random.seed(5)
    base = [f"v{k}" for k in range(400)]
    rows = [(k, " ".join(base[9 * k: 9 * k + 150])) for k in range(25)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain.near_duplicates(rows)


def test_token_counts_equal_the_library(spark, messy):
    from tokenizers import Tokenizer

    random.seed(1)
    rows = [(k, "".join(random.choice("aabbcde'’ \n\té1._-Σ中💩ﬀ́") for _ in range(150))) for k in range(150)]
    rows += [(1001, "<|endoftext|>Hi<|startoftext|> aaaaaaaaa we'LL İstanbul x　y \x1c a\x85b"), (1002, None), (1003, "")]
    rows += [(r["doc_id"], r["text"]) for r in messy.collect() if r["doc_id"] and r["doc_id"] not in (900007,)]
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("word_bpe_49k.json")).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["n_bytes"]) for r in got} == {
        i: (len(library.encode(t or "", add_special_tokens=False).ids), len((t or "").encode())) for i, t in rows}
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


def test_language_is_found_on_held_out_rows(spark, prose):
    got = language_id.identify(spark.createDataFrame(prose, SCHEMA)).collect()
    lang = {r[0]: r[2] for r in prose}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_messy_rows(messy):
    got = {r["doc_id"]: r for r in language_id.identify(messy).collect()}
    assert [got[k]["lang_pred"] for k in (900001, 900002, 900003, 900006)] == ["und"] * 4 and got[900001]["score"] == 0


def test_cross_parsing_counts_phrases():
    random.seed(2)
    train, text = ("".join(random.choice("abc ") for _ in range(400)) for _ in range(2))
    samples = [language_id.letters([t])[0] for t in (train, "ab" * 50)]
    symbols, offsets = language_id.letters([text + "ddé", "", "b"])
    got = language_id.phrase_counts(symbols, offsets, [language_id.Automaton(s) for s in samples])
    for k, sample in enumerate(samples):
        for t, (low, high) in enumerate(zip(offsets[:-1], offsets[1:])):
            want = 0
            for b in range(low, high, language_id.BLOCK):
                block, i = symbols[b: min(high, b + language_id.BLOCK)].tobytes(), 0
                while i < len(block):
                    j = i + 1
                    while j <= len(block) and block[i:j] in sample.tobytes():
                        j += 1
                    want, i = want + 1, max(i + 1, j - 1)
            assert got[t, k] == want


def test_letters_are_their_utf8_bytes():
    texts = ["Ab 12c", "", "ÄÖß.", "漢字かな", "🎈한글 ЖΩ", "  "]
    symbols, offsets = language_id.letters(texts)
    assert [symbols[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])] == [
        b"ab\0c", b"", "äöß".encode() + b"\0", "漢字かな".encode(), b"\0" + "한글".encode() + b"\0" + "жω".encode(), b"\0"]


def test_languages_of_eight_scripts(spark):
    """Each language is random words over an alphabet of its own; Chinese, Japanese and Korean letters are many."""
    rnd = random.Random(7)
    blocks = {"la": (0x61, 26), "el": (0x3B1, 25), "ru": (0x430, 32), "ar": (0x627, 20), "he": (0x5D0, 27), "hi": (0x915, 37), "th": (0xE01, 46),
              "zh": (0x4E00, 2000), "ja": (0x3042, 80), "ko": (0xAC00, 2000), "zt": (0x6000, 2000)}
    rows = []
    for k, (lang, (low, n)) in enumerate(blocks.items()):
        words = ["".join(chr(low + rnd.randrange(n)) for _ in range(rnd.randrange(1, 6))) for _ in range(300)]
        words = [w for w in words if w.isalpha()]
        rows += [(1000 * k + i, " ".join(rnd.choices(words, k=40)), lang) for i in range(60)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {i: name for i, _, name in rows}
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_training_rows_share_evenly():
    texts = [np.full(n, k + 1, np.uint8) for k, n in enumerate((10, 3, 50_000, 700, 900))]
    got = language_id.even_shares(texts, 1000)
    assert 990 <= len(got) <= 1000 and [int((got == k + 1).sum()) for k in (0, 1)] == [10, 3]
    assert len({int((got == k + 1).sum()) for k in (2, 3, 4)}) == 1
    assert len(language_id.even_shares(texts[:2], 1000)) == 15 and len(language_id.even_shares([], 9)) == 0


def test_mix_keeps_targets_and_reruns_agree(spark, prose):
    docs = spark.createDataFrame(prose, SCHEMA)
    got = mixing.mix(docs).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    longest = max(r["size"] for r in got)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for k, s in enumerate(sorted(size)):
        assert target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= longest
    free = [(target[s] / (5, 2, 1)[k % 3]) for k, s in enumerate(sorted(size)) if target[s] < 2 * size[s] - 1e-6]
    assert max(free) == pytest.approx(min(free))
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mix_of_many_leaves_is_exact_to_a_document(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = [(k, " ".join(["w"] * (1 + k % 9)), None, "ab"[k % 7 == 0], None) for k in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 9
    assert len(got) == 500


def test_pivotal_keeps_sums_and_expectations():
    size, chance = np.array([9.0, 5, 4, 3, 2, 1, 1]), np.array([0.3, 0.5, 0.2, 0.9, 0.4, 0.6, 0.7])
    runs = []
    for seed in range(3000):
        out, open_ = mixing.pivotal(chance, size, np.random.default_rng(seed))
        assert (out * size).sum() == pytest.approx((chance * size).sum())
        assert sum(0 < x < 1 for x in out) == (open_ >= 0)
        runs.append(out)
    assert np.abs(np.mean(runs, axis=0) - chance).max() < 0.03


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(40, 16))
    rows = [(k, [float(x) for x in base[k % 40] + 0.02 * draw.normal(size=16)], k % 3) for k in range(600)]
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] + [1.0] * 15, 1), (5003, [None] + [1.0] * 15, 1),
             (5004, rows[0][1], None), (5005, rows[0][1], 0), (5006, [2.0 * x for x in rows[0][1]], 0), (5007, [float("inf")] + [1.0] * 15, 1), (5008, [], 1)]
    return rows


def usable(rows):
    return [(i, np.array(v, float), s) for i, v, s in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]


def test_vector_duplicates_match_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").withColumn("near", F.lit(1)).withColumn("kept", F.lit("x"))
    got = {r["vec_id"]: r for r in vector_dup.vector_duplicates(df).collect()}
    assert len(got) == len(vectors)
    good = [r for r in usable(vectors) if r[2] is not None]
    unit = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    linked = (unit @ unit.T >= 0.98) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good])[None, :])
    np.fill_diagonal(linked, False)
    n = {r[0]: int(k) for r, k in zip(good, linked.sum(axis=1))}
    found, wanted = sum(got[i]["n_links"] for i in n), sum(n.values())
    assert found >= 0.95 * wanted and all(got[i]["n_links"] <= n[i] for i in n)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (5000, 5001, 5002, 5003, 5004, 5007, 5008))
    assert got[5005]["component_id"] == 0 and got[5006]["component_id"] == 0 and not got[5006]["kept"]


def test_hilbert_curve_visits_every_cell_in_steps_of_one():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = neighbours.hilbert(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_reach_recall_with_exact_scores(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit(1))
    got = neighbours.neighbours(df).collect()
    good = usable(vectors)
    ids = np.array([r[0] for r in good])
    rows = np.stack([r[1] for r in good])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = rows @ rows[q]
        scores[q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == ids[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        assert all(abs(m[2] - rows[q] @ rows[ids.tolist().index(m[1])]) < 1e-9 for m in mine)
        hits, total = hits + len({m[1] for m in mine} & set(best.tolist())), total + 20
    assert hits >= 0.9 * total


def test_personal_data_base_spans(spark, messy):
    rows = [(-1, "a@b.c_d@e.f x@y @z.q a@b. é+1 (523) 555-1055 💩 1.2.3.4.5 256.1.1.1 001.002.003.0255 4111 1111 1111 1111 4111-1111-1111-1111-2 5"),
            (-2, None), (-3, ""), (-4, "1 2 3 " * 2000 + "x@y.z"), (-15, "a" * 30000 + " +1" + "(5)" * 4 + "+44 20 7946 0958."), (-6, "@" * 2000 + "a.b@c.d@e.f.g")]
    rows += [(r["doc_id"], r["text"]) for r in messy.where("doc_id between 0 and 900003").collect()]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = plain.base_spans(text) if i != -15 else plain.base_spans(" " * 30000 + text[30000:])
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want)
        assert set(want) <= set(filter(None, got[i]["spans"].split(",")))
        assert [got[i][f"n_{k}"] for k in plain.PATTERNS] == [sum(s.startswith(k) for s in want) for k in plain.PATTERNS]


def test_personal_data_learns_from_every_candidate(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(
        F.lit("write to me"), F.col("id").cast("string"), F.lit(" at host dot org"))).otherwise(F.lit("call +44 20 7946 0958")).alias("text"))
    got = {(r["kind"], r["label"]): r["n"] for r in pii.candidates(docs).groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()}
    assert got["email", 0.0] == 3000 and got["phone", 1.0] == 12000  # the loose match has no plus sign


def test_redaction_leaves_no_base_span_and_keeps_columns(messy):
    got = pii.redact(messy)
    assert got.columns == messy.columns
    rows = got.collect()
    assert len(rows) == messy.count() and not any(plain.base_spans(r["text"]) for r in rows)
    assert sum(r["text"] is None for r in rows) == 1


def test_katz_matches_plain_python(spark, messy, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in messy.where("doc_id is null or doc_id not in (900004, 900005)").collect()]
    monkeypatch.setattr(katz, "CHUNK", 40_000)
    from tallyline.staging import stage

    got = katz.score(stage(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want, totals = plain.katz(rows, katz.good_turing)
    assert totals == pytest.approx([1.0] * len(totals))
    order = {}
    for (i, _), w in zip(rows, want):
        order.setdefault(i, []).append(w)
    for r in got:
        best = min(order[r["doc_id"]], key=lambda w: abs(w[4] - r["score"]))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == best[:3]
        assert (r["base_score"], r["score"]) == pytest.approx(best[3:], rel=1e-9)
    assert len(got) == len(rows)


def test_katz_of_chunks_with_equal_texts(spark):
    long_text = " ".join(("v%d" % (k % 50)) * 20 for k in range(150_000))
    assert len(long_text) > katz.CHUNK
    rows = [(1, long_text), (2, long_text), *[(k, "same text of six words here") for k in range(3, 9)], (9, None), (10, "")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in katz.score(docs).collect()}
    want, _ = plain.katz(rows, katz.good_turing)
    assert len(got) == len(rows)
    for (i, _), w in zip(rows, want):
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == w[:3]
        assert (got[i]["base_score"], got[i]["score"]) == pytest.approx(w[3:], rel=1e-9)


def test_repeated_passages(spark):
    random.seed(8)

    def text(n):
        return [f"{random.choice('abcdefgh')}{random.randrange(9999)}" for _ in range(n)]

    shared, short = text(70), text(30)
    edited = list(shared)
    for k in (20, 41, 60):
        edited[k] = "changed"
    rows = [(1, text(200) + shared + text(100)), (2, text(20) + shared), (3, edited + text(300)), (4, text(90) + short), (5, short + text(80)),
            (6, text(400)), (7, text(5)), (8, ["x"] * 3000), (9, text(60) + edited)]
    docs = [(i, " ".join(w), "x") for i, w in rows] + [(10, None, "x"), (11, "", "x"), (None, " ".join(shared), "x")]
    got = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string, repeated string")).collect()}
    assert set(got) == {1, 2, 3, 9}
    assert (got[1]["start_word"], got[1]["end_word"], got[1]["repeated"], got[1]["first_id"]) == (200, 270, False, 1)
    assert (got[2]["start_word"], got[2]["end_word"], got[2]["repeated"], got[2]["first_id"]) == (20, 90, True, 1)
    assert got[3]["repeated"] and got[3]["n_words"] == 70


def test_passages_made_of_frequent_lines_are_linked(spark):
    random.seed(12)

    def text(n):
        return [f"w{random.randrange(10 ** 9)}" for _ in range(n)]

    rows, want = [], {}
    for trial in range(12):
        base = 1000 * (trial + 1)
        one, two, own = text(45 if trial % 2 else 40), text(45), text(20)
        shared = one + (two if trial % 2 else own)
        for k in range(4):  # smaller and larger ids hold each frequent part, never the whole
            rows += [(base + k, text(30) + one + text(30)), (base + 10 + k, text(30) + two + text(30)),
                     (base + 900 + k, text(30) + one + text(30)), (base + 910 + k, text(30) + two + text(30))]
        for k in (500, 600):
            rows.append((base + k, text(50) + shared + text(50)))
            want[base + k] = (50, 50 + len(shared), base + 500)
    docs = [(i, " ".join(w)) for i, w in rows]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["start_word"], r["end_word"], r["first_id"]) for r in got} == want


def test_edited_passages_made_of_frequent_lines_are_linked(spark):
    random.seed(15)

    def text(n):
        return [f"x{random.randrange(10 ** 9)}" for _ in range(n)]

    rows, want = [], {}
    for trial in range(6):
        base, lines = 1000 * (trial + 1), [text(20) for _ in range(3)]
        for k, line in enumerate(lines):  # smaller and larger ids hold each line, never two of them
            rows += [(base + 10 * k + m + far, text(30) + line + text(30)) for m in range(4) for far in (0, 900)]
        for k in (500, 600, 700):  # nor do they agree between the lines
            rows.append((base + k, text(50) + lines[0] + text(2) + lines[1] + text(2) + lines[2] + text(50)))
            want[base + k] = (50, 114, base + 500)
        rows += [(base + 800 + k, text(50) + lines[0] + ["same"] + lines[1] + ["same"] + lines[2] + text(50)) for k in range(3)]  # copies
        want |= {base + 800 + k: (50, 112, base + 500) for k in range(3)}
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["start_word"], r["end_word"], r["first_id"]) for r in got} == want


def test_texts_of_several_pairs_are_cut_into_seeds_once(monkeypatch):
    draw, cut, real = np.random.default_rng(5), [], passages.seeds
    hub = draw.integers(0, 1 << 32, 300, dtype=np.uint32)
    texts = {0: hub, **{i: np.concatenate([hub[20 * i: 20 * i + 80], draw.integers(0, 1 << 32, 40, dtype=np.uint32), hub[:9 * i]]) for i in range(1, 8)}}
    pairs = [(i, j) for j in range(8) for i in range(j)]
    batch = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]),
                                        *[pa.array([texts[p[k]].tobytes() for p in pairs], pa.binary()) for k in (0, 1)]],
                                       ["doc_id", "other_id", "words", "other_words"])
    monkeypatch.setattr(passages, "seeds", lambda words, *rest: cut.append(len(words)) or real(words, *rest))
    together = pa.Table.from_batches(passages._aligned(50, 0.75)(iter([batch])))
    assert len(cut) == len(texts)
    alone = pa.concat_tables([pa.Table.from_batches(passages._aligned(50, 0.75)(iter([batch.slice(i, 1)]))) for i in range(len(pairs))])
    assert together.num_rows >= 7 and together.to_pylist() == alone.to_pylist()


def test_few_texts_are_known_at_once():
    words = {i: np.arange(i, i + 60, dtype=np.uint32) for i in range(6)}
    known = passages._Known(most=2 * len(passages._ordered(words[0])[0]) + 20)
    for i in (0, 1, 2, 0, 3, 4, 0, 5):
        assert all((a == b).all() for a, b in zip(known(i, words[i]), passages._ordered(words[i])))
        assert known.size == sum(len(t[0]) for t in known.texts.values()) and (known.size <= known.most or len(known.texts) == 1)


def test_edited_passages_are_found(spark):
    random.seed(14)

    def text(n):
        return [f"u{random.randrange(10 ** 9)}" for _ in range(n)]

    rows, want = [], {"short": set(), "long": set()}
    for k in range(60):
        size, name = (51, "short") if k % 2 else (100, "long")
        one = text(size)
        two = list(one)
        for at in random.sample(range(1, size - 1), size // 7):
            two[at] = text(1)[0]
        rows += [(2 * k, " ".join(text(70) + one + text(80))), (2 * k + 1, " ".join(text(40) + two + text(90)))]
        want[name].add(2 * k + 1)
    got = {r["doc_id"] for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["repeated"]}
    assert len(got & want["long"]) == len(want["long"])
    assert len(got & want["short"]) >= 0.8 * len(want["short"])


def test_every_occurrence_of_a_passage_has_a_row(spark):
    random.seed(13)

    def text(n):
        return [f"v{random.randrange(10 ** 9)}" for _ in range(n)]

    shared, header = text(80), text(60)
    often = [w for _ in range(20) for w in header + text(90)]
    docs = [(1, text(30) + shared + text(40) + shared + text(30)), (2, text(10) + shared), (3, text(25) + shared[20:60] + text(200) + shared),
            (4, often), (5, [w for _ in range(9) for w in text(91) + header]), (6, ["x"] * 3000), (7, ["x"] * 2000)]
    rows = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    assert sorted(got[1]) == [(30, 110), (150, 230)] and got[2] == [(10, 90)] and got[3] == [(265, 345)]
    assert sorted(got[4]) == [(150 * k, 150 * k + 60) for k in range(20)] and sorted(got[5]) == [(151 * k + 91, 151 * k + 151) for k in range(9)]
    assert got[6] == [(0, 3000)] and got[7] == [(0, 2000)]


def test_chains_with_a_fenwick_tree_match_quadratic_search():
    random.seed(9)
    for _ in range(30):
        n = random.randrange(2, 60)
        a, b = (np.array([random.randrange(300) for _ in range(n)]) for _ in range(2))
        order = sorted(range(n), key=lambda k: (a[k], b[k]))
        best = {}
        for k in order:
            best[k] = passages.WORDS
            for j in order:
                if j in best and a[j] < a[k] and b[j] < b[k] and j != k:
                    top = max((best[m] + passages.GAP * (a[m] + b[m]), m) for m in best if a[m] < a[k] and b[m] < b[k] and m != k)[1]
                    gain = best[top] - passages.GAP * (a[k] + b[k] - a[top] - b[top]) + min(passages.WORDS, a[k] - a[top], b[k] - b[top])
                    if max(a[k] - a[top], b[k] - b[top]) <= passages.LONGEST_GAP:
                        best[k] = max(best[k], gain)
                    break
        found = passages.chains(a, b)
        assert sorted(k for c in found for k in c.tolist()) == list(range(n))
        for c in found:
            assert (np.diff(a[c]) > 0).all() and (np.diff(b[c]) > 0).all()


def test_chains_look_at_all_predecessors_within_the_gap():
    random.seed(10)
    for _ in range(40):
        n = random.randrange(2, 80)
        a, b = (np.array([random.randrange(400) for _ in range(n)]) for _ in range(2))
        order = sorted(range(n), key=lambda k: (a[k], b[k]))
        best, follows = {}, {}
        for k in order:
            near = [(best[j] + passages.GAP * (a[j] + b[j]), order.index(j)) for j in best
                    if 0 < a[k] - a[j] <= passages.LONGEST_GAP and 0 < b[k] - b[j] <= passages.LONGEST_GAP]
            best[k] = passages.WORDS
            if near:
                top, j = max(near)
                j = order[j]
                gain = top - passages.GAP * (a[k] + b[k]) + min(passages.WORDS, a[k] - a[j], b[k] - b[j])
                if gain > passages.WORDS:
                    best[k], follows[k] = gain, j
        got = passages.chains(a, b)
        links = {(int(x), int(y)) for c in got for x, y in zip(c, c[1:])}
        assert links <= {(j, k) for k, j in follows.items()} and {k for c in got for k in c.tolist()[1:]} <= set(follows)
        top = max(best.values())
        assert best[int(got[0][-1])] == pytest.approx(top)
        chain, k = [], int(got[0][-1])
        while k is not None:
            chain.append(k)
            k = follows.get(k)
        assert got[0].tolist() == chain[::-1]


def test_a_second_passage_behind_a_longer_first_one_is_chained():
    first = np.arange(0, 1000, 7)
    second = np.arange(3000, 3300, 7)
    a, b = np.concatenate([first, second]), np.concatenate([first, second + 11])
    assert sorted(len(c) for c in passages.chains(a, b)) == sorted([len(first), len(second)])
    near = np.arange(1060, 1160, 7)
    a, b = np.concatenate([first, near]), np.concatenate([first, near + 1])
    assert sorted(len(c) for c in passages.chains(a, b)) == sorted([len(first), len(near)])


def test_packing_keeps_every_id_once(spark, messy):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = [(r["doc_id"], r["text"]) for r in messy.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    rows += [(1_000_001, " lead  double \n\n end "), (1_000_002, "a<|endoftext|>b")]
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("byte_bpe_50k.json")).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        part = ids[r["doc_id"]][r["start"]: r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[i])
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_shortest_pack_first_places_all():
    random.seed(4)
    histogram = {k: random.randrange(1, 50) for k in random.sample(range(1, 101), 60)}
    rows = packing.place(histogram, 100)
    for length, n in histogram.items():
        ranks = sorted((rank, take) for size, rank, take, _, _ in rows if size == length)
        assert sum(t for _, t in ranks) == n and all(x[0] + x[1] == y[0] for x, y in zip(ranks, ranks[1:]))
    filled = Counter()
    for length, _, take, first, offset in sorted(rows, key=lambda r: r[4]):
        for s in range(first, first + take):
            assert filled[s] == offset
            filled[s] += length
    assert max(filled.values()) <= 100 and sum(filled.values()) / (100 * len(filled)) > 0.95


def test_empty_tables(spark):
    docs = empty(spark)
    vocab = vocabulary("byte_bpe_50k.json")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (near_dup.near_duplicates(docs), token_counts.token_counts(docs, vocabulary("word_bpe_49k.json")), language_id.identify(docs),
               mixing.mix(docs), vector_dup.vector_duplicates(vectors), pii.personal_data(docs), katz.score(docs), neighbours.neighbours(vectors),
               passages.repeated_passages(docs), packing.pack(docs, vocab)):
        assert df.count() == 0


def test_pipeline_stages_on_messy_rows(spark, messy):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    from tallyline.staging import stage

    kept = docs
    for name, step in corpus_pipeline.STAGES:
        before, kept = kept, stage(step(spark, kept, ""), name)
        if name != "packing":
            assert kept.columns == docs.columns
        if name == "language":
            assert {900001, 900002, 900003, 900006}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() == docs.count() - 4
        if name == "near_duplicates":
            rows = {r["doc_id"]: r["text"] for r in before.collect() if r["doc_id"] is not None}
            want = sorted(i for i, (_, c) in plain.near_duplicates(rows.items()).items() if i == c)
            assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == want
        if name == "personal_data":
            assert kept.count() == before.count() and not any(plain.base_spans(r["text"]) for r in kept.collect())
            assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())
        if name == "mixing":
            times = Counter((r["doc_id"], r["text"]) for r in kept.collect())
            there = Counter((r["doc_id"], r["text"]) for r in before.collect())
            assert all(n <= 2 * there[k] for k, n in times.items())
    assert kept.agg(F.sum("length")).first()[0] > 0
