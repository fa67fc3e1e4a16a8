"""Matchers whose sets have no limit: groups beyond former limits, held to a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from namefold.operators import primitives as P
from namefold.operators import structure
from namefold.operators.project import Project
from namefold.plans.adapters import as_records

MAPPING = "a string, b string"


def build(spark, rows, columns):
    return Project(as_records(spark.createDataFrame(rows, columns)))


@pytest.mark.parametrize("size", [3, 130, 260])
def test_folders_of_any_size_are_scored_whole(spark, monkeypatch, size):
    monkeypatch.setattr(P, "FOLDER", 100)  # the folder is dealt over several tasks
    r = random.Random(size)
    content = [([f"text{r.randrange(40)}" for _ in range(r.randrange(5))] + ["abc"], [f"Lp/P{r.randrange(9)};" for _ in range(r.randrange(4))], r.choice([["enum"], ["final", "abstract"], []]), r.randrange(3), r.randrange(3), r.choice(["", "Lq/Q;", "known"])) for _ in range(size)]

    def rows(side):
        named = lambda s: f"LX/{side}known;" if s == "known" else s
        out = [(f"LX/{side}{k};", f"dir{side}", s if side == "a" or k % 3 else s[1:], c, m, nm, nf, named(sup)) for k, (s, c, m, nm, nf, sup) in enumerate(content)]
        return [*out, (f"LX/{side}known;", f"dir{side}", ["known"], [], [], 1, 1, "")]

    a, b = (build(spark, rows(side), "id string, bucket string, strings array<string>, calls array<string>, mods array<string>, nm int, nf int, super string") for side in "ab")
    mapping = spark.createDataFrame([("LX/aknown;", "LX/bknown;")], MAPPING)
    pairs = spark.createDataFrame([(f"LX/a{i};", f"LX/b{j};") for i in range(size) for j in range(size)], MAPPING)
    want = P.best_scores(P.content_score(pairs, a, b, mapping), 0.6, 0.02).select("a", "b", (0.6 + F.col("lead")).alias("confidence")).collect()
    assert want and sorted(structure.bucket_best(0.6, 0.02)(a, b, mapping).collect()) == sorted(want)


def plain_division(a, b, mapping, min_mapped, skip_empty):
    """(a, cand, k) by sets; a and b are lists of names by class."""
    image = dict(mapping)
    reach = {}
    for cand, to in b.items():
        for y in set(to) & set(b):
            reach.setdefault(y, set()).add(cand)
    out = {}
    for x, to in a.items():
        near = {image[y] for y in set(to) & set(a) if y in image}
        filled = [reach[y] for y in near if y in reach]
        if x in image or len(near) < min_mapped or not filled or not skip_empty and len(filled) < len(near):
            continue
        cands = set.intersection(*filled) - set(image.values())
        if cands:
            out[x] = (cands, len(near))
    return out


@pytest.mark.parametrize(("most", "skip_empty", "seed"), [(1, True, 1), (5, False, 2), (2, True, 3)])
def test_division_has_no_limit_of_what_an_image_reaches(spark, monkeypatch, most, skip_empty, seed):
    """Every hub is referred to by more classes than the former limit of 500, and is dealt over parts and tasks."""
    monkeypatch.setattr(P, "LINKS", 2000)
    monkeypatch.setattr(P, "MET", 300)
    r = random.Random(seed)
    hubs, rare = [f"h{k}" for k in range(12)], [f"r{k}" for k in range(40)]
    made = [r.sample(hubs, r.choice([1, 8, 9, 9])) + r.sample(rare, r.choice([0, 0, 0, 1])) for _ in range(1200)]
    name = lambda side, x: f"LX/{side}{x};"
    sides = {side: {name(side, k): [name(side, t) for t in to] + ["Lnone/N;"] for k, to in enumerate(made)} | {name(side, t): [] for t in hubs + rare + ["gone"]} for side in "ab"}
    sides["a"][name("a", 7)] = [name("a", "h1"), name("a", "h2"), name("a", "gone")]  # no class refers to the image of the last
    mapping = [(name("a", t), name("b", t)) for t in [*hubs, *rare[:30], "gone", 3, 4, 5]]
    a, b = (build(spark, [(x, to) for x, to in sides[side].items()], "id string, calls array<string>") for side in "ab")
    got = {}
    for row in P.division_few(a, b, spark.createDataFrame(mapping, MAPPING), 2, most, skip_empty).collect():
        cands, _ = got.setdefault(row["a"], (set(), row["k"]))
        cands.add(row["cand"])
    want = {x: found for x, found in plain_division(sides["a"], sides["b"], mapping, 2, skip_empty).items() if len(found[0]) <= most}
    large = [x for x in want if not any("r" in y for y in sides["a"][x])]
    reach = [sum(x in to for to in made) for x in hubs]
    assert large and got == want and min(reach) > 500
