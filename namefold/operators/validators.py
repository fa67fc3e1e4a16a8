"""Scores of committed pairs from 1 (veto) to 10, their aggregate, and the cleanups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namefold.functions import refs
from namefold.operators.commit import State
from namefold.operators.primitives import kinds_differ
from namefold.operators.project import Project
from namefold.plans.storage import settled, stored

VETO, NEUTRAL, DECISIVE = 1, 5, 10
LOCK_AT = 0.85


def steps(value: Column, *limits: tuple[float, int], below: int) -> Column:
    """The score of the first limit that ``value`` reaches."""
    out = None
    for at, score in limits:
        out = F.when(value >= at, score) if out is None else out.when(value >= at, score)
    return out.otherwise(below)


def _sides(pairs: DataFrame, a: Project, b: Project, *columns: str) -> DataFrame:
    side = lambda p, k: p.classes.select(F.col("cid").alias(k), F.struct(*columns).alias(f"r{k}"))
    return pairs.select("a", "b").join(side(a, "a"), "a", "left").join(side(b, "b"), "b", "left")


def shape(pairs: DataFrame, a: Project, b: Project, mapping: DataFrame) -> DataFrame:
    rows = _sides(pairs, a, b, "mods", "nf", "nm")
    gap = lambda c: F.abs(F.col(f"ra.{c}") - F.col(f"rb.{c}")) / F.greatest(F.lit(1), F.col(f"ra.{c}"), F.col(f"rb.{c}"))
    d = F.greatest(gap("nf"), gap("nm"))
    value = F.when(F.col("ra").isNull() | F.col("rb").isNull(), VETO).when(kinds_differ(F.col("ra.mods"), F.col("rb.mods")), VETO).when(d > 0.75, 2).when(d > 0.5, 3).when(d > 0.25, 6).when(d > 0.1, 8).otherwise(DECISIVE)
    return rows.select("a", "b", value.alias("value"), F.lit(False).alias("provisional"))


def _signature_hits(pairs: DataFrame, a: Project, b: Project, mapping: DataFrame) -> DataFrame:
    """(a, b, n, hits, n_obf, n_open) of pairs whose a has signatures, over its methods in order."""
    rows = pairs.select("a", "b").join(a.classes.select(F.col("cid").alias("a"), F.explode("sigs").alias("sig")), "a")
    rows = rows.join(refs.substituted(rows.select("sig"), mapping, a.prefix), "sig")
    there = b.classes.select(F.col("cid").alias("b"), F.explode(F.array_distinct("sigs")).alias("keep"), F.lit(1).alias("hit"))
    rows = rows.join(there, ["b", "keep"], "left")
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.count("hit").alias("hits"), F.sum("n_obf").alias("n_obf"), F.sum("n_open").alias("n_open"))


def signature_refs(pairs: DataFrame, a: Project, b: Project, mapping: DataFrame, resolved: float = 0.5) -> DataFrame:
    rows = _sides(pairs, a, b, "sigs").join(_signature_hits(pairs, a, b, mapping), ["a", "b"], "left")
    empty = F.col("ra").isNull() | F.col("rb").isNull() | (F.size("ra.sigs") == 0) | (F.size("rb.sigs") == 0)
    rate = F.col("hits") / F.col("n")
    graded = F.when(rate <= 0, 2).otherwise(steps(rate, (0.95, DECISIVE), (0.8, 8), (0.5, 6), (0.25, 4), below=3))
    open_refs = (F.col("n_obf") > 0) & ((F.col("n_obf") - F.col("n_open")) < F.col("n_obf") * resolved)
    return rows.select("a", "b", F.when(empty, NEUTRAL).otherwise(graded).alias("value"), (~empty & open_refs).alias("provisional"))


def neighbour_hits(pairs: DataFrame, a: Project, b: Project, mapping: DataFrame, reverse: bool = False) -> DataFrame:
    """(a, b, n, hits): mapped neighbours of a, and those whose image is a neighbour of b."""
    here, there = ("dst", "src") if reverse else ("src", "dst")
    near = pairs.select("a", "b").join(a.links.select(F.col(here).alias("a"), F.col(there).alias("x")), "a")
    near = near.join(mapping.select(F.col("a").alias("x"), F.col("b").alias("y")), "x")
    found = b.links.select(F.col(here).alias("b"), F.col(there).alias("y"), F.lit(1).alias("hit"))
    return near.join(found, ["b", "y"], "left").groupBy("a", "b").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))


def neighbour_consistency(pairs: DataFrame, a: Project, b: Project, mapping: DataFrame, least: int = 3) -> DataFrame:
    rows = pairs.select("a", "b").join(neighbour_hits(pairs, a, b, mapping), ["a", "b"], "left")
    value = F.when(F.col("n").isNull(), NEUTRAL).otherwise(steps(F.col("hits") / F.col("n"), (0.9, DECISIVE), (0.7, 8), (0.4, 6), (0.2, 3), below=2))
    return rows.select("a", "b", value.alias("value"), (F.coalesce("n", F.lit(0)) < least).alias("provisional"))


def method_pair_count(pairs: DataFrame, a: Project, b: Project, mapping: DataFrame, methods: int = 2, enough: int = 2) -> DataFrame:
    rows = _sides(pairs, a, b, "methods").select("a", "b", F.col("ra").isNull().alias("no_a"), F.col("rb").isNull().alias("no_b"), F.size("ra.methods").alias("na"), F.size("rb.methods").alias("nb"))
    rows = rows.join(_signature_hits(pairs, a, b, mapping), ["a", "b"], "left")
    few = F.col("no_a") | F.col("no_b") | (F.col("na") < methods) | (F.col("nb") < methods)
    rate = F.col("hits") / F.col("n")
    graded = F.when(rate >= 0.8, DECISIVE).when(rate >= 0.5, 8).when(rate >= 0.25, 6).when(F.col("hits") >= enough, NEUTRAL).when(F.col("hits") == 0, 2).otherwise(4)
    return rows.select("a", "b", F.when(few, NEUTRAL).otherwise(graded).alias("value"), (~few & (F.col("n_open") > 0) & (F.col("hits") < enough)).alias("provisional"))


def merge_asymmetry(pairs: DataFrame, a: Project, b: Project, mapping: DataFrame) -> DataFrame:
    flag = lambda p, k: p.merges.select(F.col("cid").alias(k), F.lit(True).alias(f"m{k}"))
    rows = pairs.select("a", "b").join(flag(a, "a"), "a", "left").join(flag(b, "b"), "b", "left")
    return rows.select("a", "b", F.when(F.col("ma").isNull() != F.col("mb").isNull(), VETO).otherwise(NEUTRAL).alias("value"), F.lit(False).alias("provisional"))


VALIDATORS = {
    "shape": shape,
    "signature_refs": signature_refs,
    "neighbour_consistency": neighbour_consistency,
    "method_pair_count": method_pair_count,
    "lambda_merge_asymmetry": merge_asymmetry,
}


def scores(pairs: DataFrame, a: Project, b: Project, mapping: DataFrame, validators: dict | None = None) -> DataFrame:
    """(a, b, validator, value, provisional) of every pair by every validator; over large tables one after another, so
    that disk holds the shuffle files of one."""
    out = None
    for name, validator in (VALIDATORS if validators is None else validators).items():
        rows = validator(pairs, a, b, mapping)
        rows = (rows if a.keep else settled(rows)).withColumn("validator", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.select("a", "b", "validator", "value", "provisional")


def aggregate(scored: DataFrame) -> DataFrame:
    """(a, b, score, provisional): 0 after a veto, else the mean mapped from 1..10 to 0..1."""
    rows = scored.groupBy("a", "b").agg(F.min("value").alias("least"), F.avg("value").alias("mean"), F.max("provisional").alias("open"))
    return rows.select("a", "b", F.when(F.col("least") <= VETO, 0.0).otherwise((F.col("mean") - 1) / 9).alias("score"), (F.col("open") & (F.col("least") > VETO)).alias("provisional"))


def revoke(state: State, gone: DataFrame) -> State:
    gone = stored(gone.select("a", "b"))
    return State(stored(state.mapping.join(gone, ["a", "b"], "left_anti")), stored(state.negatives.unionByName(gone).distinct()))


def validate(state: State, a: Project, b: Project, validators: dict | None = None) -> tuple[State, DataFrame]:
    """One pass against the mapping as it stands: vetoes revoke unlocked pairs, sure agreement raises and locks."""
    scored = stored(scores(state.mapping, a, b, state.mapping, validators))
    rows = state.mapping.join(aggregate(scored), ["a", "b"])
    gone = rows.where("score <= 0 and not provisional and not locked")
    higher = ~F.col("provisional") & (F.col("score") > F.col("confidence"))
    kept = rows.join(gone.select("a", "b"), ["a", "b"], "left_anti").select(
        "a", "b", F.when(higher, F.col("score")).otherwise(F.col("confidence")).alias("confidence"), (F.col("locked") | (higher & (F.col("score") >= LOCK_AT))).alias("locked"), "matchers"
    )
    gone = stored(gone.select("a", "b"))
    after = State(stored(kept), stored(state.negatives.unionByName(gone).distinct()))
    stats = scored.groupBy("validator").agg(F.count("*").alias("scored"), F.sum(F.col("provisional").cast("long")).alias("provisional"), F.sum((F.col("value") <= VETO).cast("long")).alias("veto"))
    return after, stats


def unsupported(state: State, a: Project, b: Project, reverse_saves: bool, least: int = 2) -> DataFrame:
    """Unlocked pairs with mapped neighbours but no hit among them; ``reverse_saves`` keeps those that referring classes confirm."""
    pairs = state.mapping.where("not locked").select("a", "b")
    bad = neighbour_hits(pairs, a, b, state.mapping).where((F.col("n") >= least) & (F.col("hits") == 0)).select("a", "b")
    if reverse_saves:
        back = neighbour_hits(bad, a, b, state.mapping, reverse=True).where((F.col("n") >= least) & (F.col("hits") > 0))
        bad = bad.join(back.select("a", "b"), ["a", "b"], "left_anti")
    return bad


def cleanup(state: State, a: Project, b: Project, reverse_saves: bool) -> State:
    return revoke(state, unsupported(state, a, b, reverse_saves))
