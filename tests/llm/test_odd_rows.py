"""Repeated rows, clashing column names, few candidates and empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyline.llm import katz, language_id, mixing, neighbours, packing, token_counts
from tallyline.llm.queries import vocabulary
from tallyline.staging import stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["n_tokens", "n_bytes", "over_limit", "start", "length", "sequence_id", "offset", "ids_crc32", "doc_tokens", "rank", "part", "before", "inside",
         "size", "source_size", "target", "taken", "copies", "score", "base_score", "held_out", "n_known", "train_tokens", "chunk", "lang_pred", "found", "mark", "n"]


@pytest.fixture(scope="module")
def repeated(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")]).limit(40).collect()]
    rows += [rows[0]] * 30 + [rows[1]] * 5 + [(None, "no id", None, None, None)] * 4 + [(900, None, None, None, None)] * 3 + [(901, "", "en", "s", 0)]
    return rows


@pytest.fixture(scope="module")
def clashing(spark, repeated):
    df = spark.createDataFrame(repeated, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in NAMES}).repartition(3)


def plain(spark, repeated):
    return spark.createDataFrame(repeated, SCHEMA)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_names_and_repeats_change_nothing(spark, repeated, clashing):
    vocab = vocabulary("word_bpe_49k.json")
    for run in (lambda d: token_counts.token_counts(d, vocab), language_id.identify,
                lambda d: katz.score(d).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6), F.round("score", 6))):
        got, want = rows_of(run(clashing)), rows_of(run(plain(spark, repeated)))
        assert got == want and sum(got.values()) == len(repeated)
        one = [k for k in got if k[0] == repeated[0][0]]
        assert len(one) == 1 and got[one[0]] == 31  # equal rows, equal results


def test_every_repeat_is_packed(spark, repeated, clashing):
    got = packing.pack(clashing, vocabulary("byte_bpe_50k.json")).collect()
    tokens = {}
    for r in got:
        tokens.setdefault(r["doc_id"], [0, r["doc_tokens"]])[0] += r["length"]
    times = Counter(r[0] for r in repeated)
    assert all(total == times[i] * each for i, (total, each) in tokens.items()) and tokens.keys() == times.keys()
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_a_mix_takes_repeats_of_a_row_one_by_one(clashing, repeated):
    got = mixing.mix(clashing).collect()
    assert len(got) == len(repeated) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)


def test_few_neighbours_and_repeated_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.9, 0.1], 2), (3, [0.9, 0.1], None), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("x"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.neighbours(df).collect())
    assert got == [(0, 1, 2), (0, 2, 3), (0, 3, 1)]
    assert neighbours.neighbours(df.where("vec_id = 0")).count() == 0


def test_an_empty_table_goes_through_the_pipeline(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, ""), name)
        assert docs.count() == 0
    assert "sequence_id" in docs.columns


def test_the_pipeline_keeps_columns_it_does_not_know(spark, clashing):
    docs = clashing
    for name, step in corpus_pipeline.STAGES[:4]:
        docs = stage(step(spark, docs, ""), name)
        assert docs.columns == clashing.columns
    assert docs.where("mark = 'x'").count() == docs.count() > 0
