"""Sets that are alike: all pairs, and few candidates on the way."""

import random

import pytest

from namefold.operators import primitives as P
from namefold.plans.adapters import docs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sides(spark, *rows):
    return [spark.createDataFrame(x, "cid string, set array<string>") for x in rows]


@pytest.mark.parametrize(("least", "min_overlap"), [(0.7, 2), (0.6, 3), (1.0, 2)])
def test_all_pairs_of_short_and_long_sets(spark, monkeypatch, least, min_overlap):
    monkeypatch.setattr(P, "PART", 3000)  # candidates are counted in several parts
    r = random.Random(5)
    base = [r.sample(range(18), n) for n in range(1, 17) for _ in range(3)]
    near = [[t for t in x if r.random() > 0.1] + [99] * (r.random() > 0.7) for x in base for _ in range(2)]
    rows = [[(f"{side}{k}", [f"t{t}" for t in x]) for k, x in enumerate(base + near)] for side in "ab"]
    got = {(x["a"], x["b"], round(x["confidence"], 9)) for x in P.jaccard(*sides(spark, *rows), least, min_overlap, 0.6, 0.32, 0.92).collect()}
    want = set()
    for a, x in rows[0]:
        for b, y in rows[1]:
            n, every = len(set(x) & set(y)), len(set(x) | set(y))
            if n >= min_overlap and n / every >= least:
                want.add((a, b, 0.92 if least >= 1 else round(0.6 + 0.32 * (n / every - least) / (1 - least), 9)))
    assert got == want and want


def test_short_sets_of_frequent_tokens_do_not_meet_by_a_token(spark, monkeypatch):
    monkeypatch.delattr(P, "met_by_rare_tokens")
    rows = [[(f"{side}{k}", ["all", "every", f"t{k}"]) for k in range(30)] for side in "ab"]
    assert P.jaccard(*sides(spark, *rows), 0.7, 2, 0.6, 0.32, 0.92).count() == 30


def test_copies_are_no_candidates(spark, monkeypatch):
    """Thirty equal sets on each side are one candidate, and all their pairs are found."""
    seen, settled = [], P.settled
    monkeypatch.setattr(P, "settled", lambda df: seen.append(settled(df)) or seen[-1])
    rows = [[(f"{side}{k}", [f"t{t}" for t in range(40)]) for k in range(30)] for side in "ab"]
    assert P.jaccard(*sides(spark, *rows), 0.7, 3, 0.6, 0.32, 0.92).count() == 900
    assert [x.count() for x in seen if x.columns[:2] == ["a", "b"]] == [1, 1]


def test_a_frequent_token_brings_no_candidates_that_cannot_be_alike(spark, monkeypatch):
    """Sets that share one token of twelve meet at it, but have too few tokens left there."""
    seen, settled = [], P.settled
    monkeypatch.setattr(P, "settled", lambda df: seen.append(settled(df)) or seen[-1])
    rows = [[(f"{side}{k}", ["all", *(f"{k}.{t}" for t in range(11))]) for k in range(20)] for side in "ab"]
    assert P.jaccard(*sides(spark, *rows), 0.7, 3, 0.6, 0.32, 0.92).count() == 20
    assert [x.count() for x in seen if x.columns[:2] == ["a", "b"]] == [20, 20]


def test_documents_are_not_kept(spark):
    a, b = docs(spark, SF)
    assert "InMemoryTableScan" not in plan(a.strings) and "InMemoryTableScan" not in plan(b.classes)
