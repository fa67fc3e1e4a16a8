import random

import numpy as np
import pytest

from namefold.operators.commit import State, commit
from namefold.operators.members import assignment
from namefold.operators.project import Project
from namefold.plans.adapters import as_records


def sequential(pairs, found, margin=0.1):
    """The loop that the rounds stand for: candidates by falling confidence, ties by name."""
    a2b = {a: [b, c, lock] for a, b, c, lock in pairs}
    b2a = {v[0]: a for a, v in a2b.items()}
    for a, b, conf in sorted(found, key=lambda x: (-x[2], x[0], x[1])):
        mine = a2b.get(a)
        if mine and mine[0] == b:
            mine[1] = max(mine[1], conf)
            continue
        if (mine and mine[2]) or (b in b2a and a2b[b2a[b]][2]):
            continue
        against = max([mine[1] if mine else 0.0, a2b[b2a[b]][1] if b in b2a else 0.0])
        if conf < against + margin:
            continue
        if b in b2a:
            del a2b[b2a[b]]
        if mine and a in a2b:
            del b2a[mine[0]]
        a2b[a] = [b, conf, False]
        b2a[b] = a
    return {(a, v[0], round(v[1], 9)) for a, v in a2b.items()}


def projects(spark):
    ids = spark.range(8).selectExpr("concat('LX/', cast(id as string), ';') as id")
    return Project(as_records(ids)), Project(as_records(ids))


@pytest.mark.parametrize("seed", range(6))
def test_rounds_equal_the_loop(spark, seed):
    r = random.Random(seed)
    name = lambda k: f"LX/{k};"
    ends = r.sample(range(8), 8)
    pairs = [(name(k), name(ends[k]), round(r.choice([0.3, 0.5, 0.7]), 2), r.random() < 0.2) for k in range(4)]
    found = list({(x, y): (name(x), name(y), round(r.uniform(0.05, 1), 2)) for x, y in ((r.randrange(8), r.randrange(8)) for _ in range(30))}.values())
    empty = State.empty(spark)
    old = spark.createDataFrame([(a, b, c, k, ["x"]) for a, b, c, k in pairs], empty.mapping.schema)
    rows = spark.createDataFrame([(a, b, c, "m", 3) for a, b, c in found], "a string, b string, confidence double, matcher_id string, tier int")
    state, fates = commit(State(old, empty.negatives), rows, *projects(spark))
    assert {(x["a"], x["b"], round(x["confidence"], 9)) for x in state.mapping.collect()} == sequential(pairs, found)
    assert fates.count() == len(found)


def test_guard_negatives_and_locks(spark):
    ids = lambda *x: Project(as_records(spark.createDataFrame([(i,) for i in x], "id string")))
    a, b = ids("Lp/A;", "Lp/B;", "LX/1;", "LX/2;"), ids("Lp/A;", "Lp/C;", "LX/8;", "LX/9;")
    rows = [("Lp/A;", "Lp/C;"), ("Lp/A;", "LX/8;"), ("LX/1;", "Lp/A;"), ("Lp/B;", "LX/8;"), ("LX/2;", "LX/9;"), ("Lp/A;", "Lp/A;")]
    df = spark.createDataFrame([(x, y, 0.9, "m", 2) for x, y in rows], "a string, b string, confidence double, matcher_id string, tier int")
    negatives = spark.createDataFrame([("LX/2;", "LX/9;")], "a string, b string")
    state, fates = commit(State(State.empty(spark).mapping, negatives), df, a, b)
    fate = {(r["a"], r["b"]): r["outcome"] for r in fates.collect()}
    assert fate == {rows[0]: "cross-ns", rows[1]: "cross-ns", rows[2]: "cross-ns", rows[3]: "added", rows[4]: "negative", rows[5]: "added"}
    first = df.where("a = 'Lp/A;' and b = 'Lp/A;'").selectExpr("a", "b", "1.0D confidence", "'t' matcher_id", "1 tier")
    state, _ = commit(state, first, a, b)
    locked = {r["a"]: (r["locked"], r["matchers"]) for r in state.mapping.collect()}
    assert locked["Lp/A;"] == (True, ["m", "t"]) and locked["Lp/B;"] == (False, ["m"])


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 3), (4, 4), (6, 6)):
        for _ in range(20):
            cost = rng.integers(0, 9, (n, m)).astype(float)
            got = assignment(cost)
            k = min(n, m)
            small = cost if n <= m else cost.T
            best = min(sum(small[i, p[i]] for i in range(k)) for p in permutations(range(max(n, m)), k))
            assert len(got) == k and len({i for i, _ in got}) == len({j for _, j in got}) == k
            assert sum(cost[i, j] for i, j in got) == best


def test_work_folders_are_shared_and_released(spark):
    from pathlib import Path

    from namefold.plans import storage

    path = storage.work_dir(spark)
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert storage.stored(spark.range(3)).count() == 3
    Path(path).mkdir(parents=True)
    storage.release(spark)
    assert not Path(path).exists()
