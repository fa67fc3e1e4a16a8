"""Measures of a mapping without outside labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.operators.project import Project
from namefold.operators.validators import neighbour_hits

#: Weights of precision, neighbour consistency, recall, coverage of a, and agreement of matchers.
WEIGHTS = (0.30, 0.25, 0.15, 0.20, 0.10)


def _share(part: F.Column, whole: F.Column, empty: float) -> F.Column:
    return F.when(whole > 0, part / whole).otherwise(empty)


def one_to_one(mapping: DataFrame) -> DataFrame:
    """One row: the share of pairs whose b belongs to no other a."""
    counts = mapping.groupBy("b").agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("pairs"), F.count("*").alias("images")).select(F.coalesce(F.col("images") / F.col("pairs"), F.lit(1.0)).alias("one_to_one_ratio"))


def agreement(mapping: DataFrame) -> DataFrame:
    """Histogram of the number of matchers per pair."""
    return mapping.groupBy(F.size("matchers").alias("matchers")).agg(F.count("*").alias("pairs"))


def anchors(mapping: DataFrame, a: Project, b: Project) -> DataFrame:
    """One row: unobfuscated classes in both, those recovered, precision and recall."""
    both = a.classes.where(~a.obfuscated("cid")).select(F.col("cid").alias("a")).join(b.classes.select(F.col("cid").alias("a")), "a", "left_semi").select("a", F.lit(1).alias("both"))
    rows = mapping.where(~a.obfuscated("a")).select("a", "b", F.lit(1).alias("mapped")).join(both, "a", "full")
    same = F.col("a") == F.col("b")
    out = rows.agg(F.count("both").alias("stable_total"), F.count(F.when(same & F.col("both").isNotNull(), 1)).alias("recovered"), F.count("mapped").alias("mapped"), F.count(F.when(same, 1)).alias("same"))
    return out.select("stable_total", "recovered", _share(F.col("same"), F.col("mapped"), 1.0).alias("precision"), _share(F.col("recovered"), F.col("stable_total"), 1.0).alias("recall"))


def neighbour_consistency(mapping: DataFrame, a: Project, b: Project) -> DataFrame:
    """One row: the mean share of mapped neighbours whose image is a neighbour, over pairs with any."""
    hits = neighbour_hits(mapping, a, b, mapping)
    return hits.agg(F.coalesce(F.avg(F.col("hits") / F.col("n")), F.lit(0.0)).alias("neighbour_consistency"))


def coverage(mapping: DataFrame, a: Project, b: Project) -> DataFrame:
    """One row: mapped shares of all and of obfuscated classes on both sides."""
    def side(p: Project, k: str) -> DataFrame:
        rows = p.classes.select(F.col("cid").alias(k), p.obfuscated("cid").cast("int").alias("o")).join(mapping.select(k, F.lit(1).alias("m")), k, "left")
        return rows.agg(F.count("*").alias(f"{k}_total"), F.count("m").alias(f"{k}_matched"), F.coalesce(F.sum("o"), F.lit(0)).alias(f"{k}_obf_total"), F.count(F.when((F.col("o") == 1) & F.col("m").isNotNull(), 1)).alias(f"{k}_obf_matched"))

    both = side(a, "a").withColumn("_", F.lit(0)).join(side(b, "b").withColumn("_", F.lit(0)), "_").drop("_")
    shares = [_share(F.col(f"{k}_{o}matched"), F.col(f"{k}_{o}total"), 0.0).alias(f"{k}{'_obfuscated' if o else ''}") for k in "ab" for o in ("", "obf_")]
    return both.select(*shares, F.col("a_obf_matched").alias("a_obfuscated_matched"), F.col("a_obf_total").alias("a_obfuscated_total"), F.lit(1).alias("_")).drop("_")


def ambiguity(outcomes: DataFrame) -> DataFrame:
    """One row: rejected candidates by all candidates."""
    return outcomes.agg(F.coalesce(F.avg((F.col("outcome") == "rejected").cast("double")), F.lit(0.0)).alias("ambiguity_rate"))


def evaluate(mapping: DataFrame, a: Project, b: Project, matcher_stats: dict[str, dict[str, int]] | None = None) -> dict:
    """The whole report; every part is one aggregate row, but for the short histogram."""
    cover, anchor = coverage(mapping, a, b).first().asDict(), anchors(mapping, a, b).first().asDict()
    histogram = {r["matchers"]: r["pairs"] for r in agreement(mapping).collect()}
    pairs = sum(histogram.values())
    mean = sum(k * n for k, n in histogram.items()) / max(1, pairs)
    near = neighbour_consistency(mapping, a, b).first()[0]
    stats = (matcher_stats or {}).values()
    proposed = sum(s.get("proposed", 0) for s in stats)
    parts = (anchor["precision"], near, anchor["recall"], cover["a"], min(mean / 5, 1.0))
    return {
        "coverage": cover,
        "one_to_one_ratio": one_to_one(mapping).first()[0] if pairs else 1.0,
        "anchor_recovery": anchor,
        "neighbour_consistency": near,
        "multi_matcher_agreement": {"histogram": histogram, "mean_matchers_per_pair": mean},
        "ambiguity_rate": sum(s.get("rejected", 0) for s in stats) / proposed if proposed else 0.0,
        "overall_score": sum(w * x for w, x in zip(WEIGHTS, parts, strict=True)),
    }


def long_range(mapping: DataFrame, a: Project, b: Project, min_strings: int = 2, length: int = 6, correct: float = 0.5, wrong: float = 0.2) -> DataFrame:
    """Per matcher: pairs of readable a by the overlap of their strings, and the precision that it suggests."""
    known = b.classes.where(~b.obfuscated("cid")).select(F.col("cid").alias("a"))
    strings = lambda p, k: p.classes.select(F.col("cid").alias(k), F.array_distinct(F.filter("strings", lambda s: F.length(s) >= length)).alias(f"s{k}"))
    rows = mapping.where(~a.obfuscated("a")).join(known, "a", "left_anti").join(strings(a, "a"), "a").where(F.size("sa") >= min_strings).join(strings(b, "b"), "b", "left")
    overlap = F.size(F.array_intersect("sa", "sb")) / F.size("sa")
    label = F.when(F.col("sb").isNull() | (F.size("sb") == 0), "unknown").when(overlap >= correct, "correct").when(overlap < wrong, "wrong").otherwise("maybe")
    rows = rows.select(F.explode("matchers").alias("matcher_id"), label.alias("label"))
    n = lambda x: F.count(F.when(F.col("label") == x, 1))
    out = rows.groupBy("matcher_id").agg(F.count("*").alias("n"), *(n(x).alias(x) for x in ("correct", "maybe", "wrong", "unknown")))
    return out.withColumn("precision_estimate", F.col("correct") / F.greatest(F.lit(1), F.col("correct") + F.col("wrong")))
