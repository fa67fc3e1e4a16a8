"""Commit of candidates to a one-to-one mapping.

The loop over candidates by falling confidence, with incumbents, a displacement margin and locks, equals one
greedy matching over the union of candidates and incumbents, where an incumbent stands at its confidence plus
the margin (a locked one above all) behind candidates of the same key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namefold.operators.project import Project
from namefold.plans.storage import stored
from namefold.schema import MAPPING, PAIR

MARGIN = 0.1
LOCK_KEY = 1e9
#: Rows that one task matches in order, at most: some 100 MB.
ONE_TASK = 500_000


@dataclass
class State:
    """The mapping so far and the pairs that must not come back."""

    mapping: DataFrame
    negatives: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> State:
        return cls(spark.createDataFrame([], MAPPING), spark.createDataFrame([], PAIR))


def admissible(candidates: DataFrame, a: Project, b: Project, negatives: DataFrame) -> DataFrame:
    """Candidates with their outcome so far: cross-ns, negative, or null for those that compete.

    Two unobfuscated names pair only with themselves; an unobfuscated name pairs with an obfuscated one only if
    the other side does not know it. Revoked pairs come back in tier 1 alone.
    """
    known_a = a.classes.where(~a.obfuscated("cid")).select(F.col("cid").alias("b"), F.lit(True).alias("b_known"))
    known_b = b.classes.where(~b.obfuscated("cid")).select(F.col("cid").alias("a"), F.lit(True).alias("a_known"))
    obf_a, obf_b = a.obfuscated("a"), b.obfuscated("b")
    rows = candidates.join(known_b, "a", "left").join(known_a, "b", "left").join(negatives.withColumn("neg", F.lit(True)), ["a", "b"], "left")
    cross = F.when(~obf_a & ~obf_b, F.col("a") != F.col("b")).when(~obf_a, F.col("a_known").isNotNull()).when(~obf_b, F.col("b_known").isNotNull()).otherwise(False)
    outcome = F.when(cross, "cross-ns").when(F.col("neg").isNotNull() & (F.col("tier") != 1), "negative")
    return rows.select(*candidates.columns, outcome.alias("outcome"))


def _one_by_one(rows: DataFrame, order: list) -> DataFrame:
    """The greedy matching of rows that fit one task."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used_a: set[str] = set()
        used_b: set[str] = set()
        for batch in batches:
            kept = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                free = a not in used_a and b not in used_b
                if free:
                    used_a.add(a)
                    used_b.add(b)
                kept.append(free)
            yield batch[np.array(kept, dtype=bool)]

    found = rows.repartition(1).sortWithinPartitions(*order).select("a", "b").mapInPandas(scan, "a string, b string")
    return rows.join(stored(found), ["a", "b"], "left_semi")


def greedy_matching(rows: DataFrame, order: list) -> DataFrame:
    """The one-to-one greedy matching of distinct (a, b, ...) rows in a total order.

    Rounds accept every row that is first for both its ends, until at most ONE_TASK rows are left, which one task takes in
    order. A chain in which each row waits for the one before it settles a row a round at each end of it, so
    only such a chain of more than ONE_TASK rows takes many rounds.
    """
    first = lambda end: F.row_number().over(Window.partitionBy(end).orderBy(*order)) == 1
    accepted, left = None, stored(rows)
    while left.count() > ONE_TASK:
        marked = stored(left.withColumn("_taken", first("a") & first("b")))
        taken = marked.where("_taken").drop("_taken")
        accepted = taken if accepted is None else accepted.unionByName(taken)
        left = marked.where("not _taken").drop("_taken").join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti")
        left = stored(left.select(*rows.columns))
    rest = _one_by_one(left, order)
    return rest if accepted is None else accepted.unionByName(rest)


def commit(state: State, candidates: DataFrame, a: Project, b: Project, margin: float = MARGIN, provenance: str = "reference") -> tuple[State, DataFrame]:
    """The state after a matcher's candidates, and the outcome of each: (a, b, confidence, matcher_id, outcome).

    A pair that is proposed again keeps the greater confidence; the matcher is noted only if it raised it, or
    always with ``provenance='all'``. Outcomes are judged against the state after the commit.
    """
    old = state.mapping
    judged = stored(admissible(candidates, a, b, state.negatives))
    usable = judged.where("outcome is null")
    best = usable.groupBy("a", "b").agg(F.max_by(F.struct("matcher_id", "tier"), "confidence").alias("by"), F.max("confidence").alias("confidence"))
    before = old.select("a", "b", F.col("confidence").alias("was"), F.col("locked").alias("was_locked"), "matchers")
    rows = best.join(before, ["a", "b"], "full")
    # Without an opponent a new candidate has to reach the margin.
    rows = rows.where(F.col("was").isNotNull() | (F.col("confidence") >= margin))
    held = F.when(F.col("was_locked"), LOCK_KEY).when(F.col("was").isNotNull(), F.col("was") + margin)
    key = F.greatest(F.coalesce(held, F.lit(-1.0)), F.coalesce("confidence", F.lit(-1.0)))
    rows = rows.withColumn("key", key).withColumn("old", (F.coalesce(held, F.lit(-1.0)) > F.coalesce("confidence", F.lit(-1.0))).cast("int"))
    won = greedy_matching(rows, [F.desc("key"), "old", "a", "b"])
    raised = F.col("confidence").isNotNull() & (F.col("was").isNull() | (F.col("confidence") > F.col("was")))
    named = raised if provenance == "reference" else F.col("confidence").isNotNull()
    matchers = F.coalesce("matchers", F.array().cast("array<string>"))
    after = stored(won.select(
        "a", "b", F.greatest("confidence", "was").alias("confidence"),
        (F.coalesce("was_locked", F.lit(False)) | F.coalesce(F.col("by.tier") == 1, F.lit(False))).alias("locked"),
        F.when(named & ~F.array_contains(matchers, F.col("by.matcher_id")), F.concat(matchers, F.array("by.matcher_id"))).otherwise(matchers).alias("matchers"),
    ))
    return State(after, state.negatives), outcomes(judged, old, after)


def outcomes(judged: DataFrame, old: DataFrame, after: DataFrame) -> DataFrame:
    """Per candidate: added, updated, displaced, rejected, locked-blocked, negative or cross-ns."""
    pair = lambda df, n: df.select("a", "b", F.lit(True).alias(n))
    ends = lambda df, end, n: df.select(end, F.lit(True).alias(n))
    locked = old.where("locked")
    rows = judged.join(pair(old, "was"), ["a", "b"], "left").join(pair(after, "now"), ["a", "b"], "left")
    rows = rows.join(ends(locked, "a", "la"), "a", "left").join(ends(locked, "b", "lb"), "b", "left")
    rows = rows.join(ends(old, "a", "oa"), "a", "left").join(ends(old, "b", "ob"), "b", "left")
    fate = F.when(F.col("outcome").isNotNull(), F.col("outcome")).when(F.col("was") & F.col("now"), "updated").when(F.col("now") & (F.col("oa") | F.col("ob")), "displaced").when(F.col("now"), "added").when(F.col("la") | F.col("lb"), "locked-blocked").otherwise("rejected")
    return rows.select("a", "b", "confidence", "matcher_id", fate.alias("outcome"))


def churn(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: pairs added, removed and changed (an a with another b), and the mean confidence change of the rest."""
    x = old.select("a", F.col("b").alias("b0"), F.col("confidence").alias("c0"))
    y = new.select("a", F.col("b").alias("b1"), F.col("confidence").alias("c1"))
    both = x.join(y, "a", "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return both.agg(
        n(F.col("b0").isNull()).alias("added"), n(F.col("b1").isNull()).alias("removed"), n(F.coalesce(F.col("b0") != F.col("b1"), F.lit(False))).alias("changed"),
        F.coalesce(F.avg(F.when(F.col("b0") == F.col("b1"), F.abs(F.col("c1") - F.col("c0")))), F.lit(0.0)).alias("mean_change"), F.count("b1").alias("size"),
    )
