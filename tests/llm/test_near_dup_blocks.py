import random

import numpy as np
import pytest

from tallyline.llm import near_dup
from tests.llm import plain_llm as plain


def test_shared_counts_against_sets():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 62, 300).astype(np.int64)
    sets = [np.unique(np.concatenate([draw.choice(base, 60, replace=False), draw.integers(0, 1 << 62, k % 7).astype(np.int64)])) for k in range(90)]
    sets += [np.unique(draw.integers(0, 400, 25).astype(np.int64)) for _ in range(40)] + [base[:0], np.sort(base), np.sort(base)]
    got = near_dup.shared_counts(sets)
    for i in range(len(sets)):
        for j in range(len(sets)):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def near_copies(n, edits, words=200, seed=5):
    """Texts that each change a few random words of one text."""
    rnd = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for at in rnd.sample(range(words), edits):
            text[at] = f"x{rnd.randrange(10 ** 9)}"
        rows.append((i, " ".join(text)))
    return rows


def columns(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.fixture
def stages(monkeypatch):
    sizes, write = {}, near_dup.stage

    def counted(df, name="stage"):
        out = write(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(near_dup, "stage", counted)
    return sizes


def test_pairs_of_a_group_just_under_the_threshold_never_become_rows(spark, stages):
    per_row = []
    for n in (400, 1600):
        stages.clear()
        assert near_dup.near_duplicates(columns(spark, near_copies(n, 4))).count() == n
        per_row.append((stages["star"] + stages["joined"] + stages["crowd-parts"]) / n)
    assert per_row[1] < 1.5 * per_row[0] and stages["joined"] < stages["crowd-parts"]


@pytest.mark.parametrize("block", [1024, 8])
def test_components_of_a_mixed_group_against_all_pairs(spark, monkeypatch, block):
    """Copies around the threshold, one component that fills blocks, stragglers that link late, negative ids."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = near_copies(60, 6, seed=1) + [(100 + i, t) for i, t in near_copies(60, 2, seed=2)] + [(-1 - i, t) for i, t in near_copies(25, 5, seed=3)]
    rows += [(300 + i, t + " tail of its own") for i, t in near_copies(30, 5, seed=4)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(columns(spark, rows)).collect()}
    assert got == plain.near_duplicates(rows)
    assert len({c for _, c in got.values()}) > 1
