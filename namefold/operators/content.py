"""Matchers of tiers 1 and 2: what two classes have in common whatever their names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namefold.functions import refs
from namefold.operators import primitives as P
from namefold.operators.project import Project

#: References that any two classes may share, so that sharing them says nothing.
TRIVIAL_REFS = (
    "Ljava/lang/Object;", "Ljava/lang/String;", "Ljava/lang/Integer;",
    "Ljava/lang/Long;", "Ljava/lang/Boolean;", "Ljava/lang/Float;",
    "Ljava/lang/Double;", "Ljava/lang/Math;", "Ljava/lang/System;",
    "Ljava/lang/Number;", "Ljava/lang/Class;", "Ljava/lang/Enum;",
    "Ljava/lang/Throwable;", "Ljava/lang/Exception;",
    "Ljava/lang/RuntimeException;", "Ljava/lang/IllegalStateException;",
    "Ljava/lang/IllegalArgumentException;",
    "Ljava/lang/CharSequence;", "Ljava/lang/StringBuilder;",
    "Ljava/util/List;", "Ljava/util/Map;", "Ljava/util/Set;",
    "Ljava/util/Iterator;", "Ljava/util/Collection;",
    "Ljava/util/ArrayList;", "Ljava/util/HashMap;",
    "Ljava/util/AbstractCollection;", "Ljava/util/AbstractMap;",
    "Lkotlin/jvm/functions/Function0;",
    "Lkotlin/jvm/functions/Function1;",
    "Lkotlin/jvm/functions/Function2;",
    "Lkotlin/Unit;", "Lkotlin/Pair;",
    "Lkotlinx/coroutines/CoroutineScope;",
    "Lredex/$StoreFenceHelper;",
)
OBJECT = "Ljava/lang/Object;"


@dataclass(frozen=True)
class Matcher:
    """A configured matcher: propose(a, b) in tiers 1 and 2, propose(a, b, mapping) in tier 3 gives (a, b, confidence)."""

    id: str
    tier: int
    propose: Callable[..., DataFrame] = field(compare=False)

    def candidates(self, a: Project, b: Project, mapping: DataFrame | None = None) -> DataFrame:
        found = self.propose(a, b) if self.tier < 3 else self.propose(a, b, mapping)
        if not getattr(self.propose, "single", False):
            found = found.groupBy("a", "b").agg(F.max("confidence").alias("confidence"))
        return found.select("a", "b", "confidence").withColumns({"matcher_id": F.lit(self.id), "tier": F.lit(self.tier)})


def keyed(p: Project, key: Column, when: Column | None = None) -> DataFrame:
    """(cid, key), null where ``when`` does not hold."""
    return p.classes.select("cid", (key if when is None else F.when(when, key)).alias("key"))


def fingerprint(key: Callable[[Project], DataFrame], base: float, spec: str = "none", ceiling: float = 0.95) -> Callable[[Project, Project], DataFrame]:
    return P.single(lambda a, b: P.fingerprint_pairs(key(a), key(b), base, ceiling, spec))


def string_set(least: int, count: int, chars: int = 0) -> Callable[[Project], DataFrame]:
    """Set of the strings of at least ``least`` characters, if there are ``count`` with ``chars`` in all."""

    def key(p: Project) -> DataFrame:
        found = p.classes.select("cid", "mods", "super", *P.COUNTS, refs.sorted_set(refs.long_strings(F.col("strings"), least)).alias("key"))
        total = F.aggregate("key", F.lit(0), lambda n, s: n + F.length(s))
        return found.select("cid", "mods", "super", *P.COUNTS, F.when((F.size("key") >= count) & (total >= chars), F.col("key")).alias("key"))

    return key


def bucketed(key: Callable[[Project], DataFrame], confidence: float) -> Callable[[Project, Project], DataFrame]:
    return P.single(lambda a, b: P.resolve_buckets(a.prefix, key(a), key(b), confidence))


def same_name(a: Project, b: Project) -> DataFrame:
    both = a.classes.where(~a.obfuscated("cid")).select("cid").join(b.classes.select("cid"), "cid", "left_semi")
    return both.select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(1.0).alias("confidence"))


def native_key(p: Project) -> DataFrame:
    return keyed(p, refs.sorted_set(F.col("native_syms")), F.size("native_syms") > 0)


def dotted_key(p: Project) -> DataFrame:
    names = refs.dotted_names(F.col("strings"))
    return keyed(p, names, F.size(names) > 0)


def unique_string(least: int) -> Callable[[Project, Project], DataFrame]:
    def propose(a: Project, b: Project) -> DataFrame:
        one = lambda p, k: P.unique_tokens(p.strings.where(F.length("s") >= least)).withColumnRenamed("cid", k)
        return one(a, "a").join(one(b, "b"), "s").select("a", "b", F.lit(0.95).alias("confidence"))

    return propose


def long_unique_string(a: Project, b: Project, least: int = 20, alone: float = 0.55) -> DataFrame:
    """A unique long string counts in full only beside a shared reference that is not trivial."""
    pairs = unique_string(least)(a, b)
    telling = lambda p, k: p.classes.select(F.col("cid").alias(k), F.array_except(p.stable_refs(), F.array(*map(F.lit, TRIVIAL_REFS))).alias(f"r_{k}"))
    pairs = pairs.join(telling(a, "a"), "a").join(telling(b, "b"), "b")
    return pairs.select("a", "b", F.when(F.arrays_overlap("r_a", "r_b"), F.col("confidence")).otherwise(alone).alias("confidence"))


def strings_and_refs_key(p: Project) -> DataFrame:
    strings, found = refs.sorted_set(refs.long_strings(F.col("strings"), 4)), refs.sorted_set(p.stable_refs())
    return keyed(p, F.struct(strings.alias("s"), found.alias("r")), (F.size(strings) > 0) | (F.size(found) >= 3))


def refs_key(p: Project) -> DataFrame:
    found = F.array_sort(p.stable_refs())
    return keyed(p, found, F.size(found) >= 4)


def target_key(column: str, least: int) -> Callable[[Project], DataFrame]:
    def key(p: Project) -> DataFrame:
        found = refs.sorted_set(F.filter(column, lambda x: ~p.obfuscated(x["cls"])))
        return keyed(p, found, F.size(found) >= least)

    return key


def typed_access_key(least: int) -> Callable[[Project], DataFrame]:
    def key(p: Project) -> DataFrame:
        every = F.flatten(F.transform("methods", lambda m: F.coalesce(m["facc_typed"], F.array().cast("array<struct<cls:string,name:string>>"))))
        found = refs.sorted_set(F.filter(every, lambda x: ~p.obfuscated(x["cls"])))
        return keyed(p, found, F.size(found) >= least)

    return key


def enum_key(p: Project) -> DataFrame:
    names = refs.name_like(F.col("strings"))
    return keyed(p, names, F.array_contains("mods", "enum") & (F.size(names) >= 2))


def enum_jaccard(least: float = 0.7, min_overlap: int = 2) -> Callable[[Project, Project], DataFrame]:
    """Sets smaller than the least overlap are no sets."""
    def names(p: Project) -> DataFrame:
        return p.classes.where(F.array_contains("mods", "enum")).select("cid", refs.name_like(F.col("strings")).alias("set"))

    return P.single(lambda a, b: P.jaccard(names(a), names(b), least, min_overlap, 0.6, 0.32, 0.92))


def body_hashes() -> Column:
    return F.filter(F.transform("methods", lambda m: m["bha"]), lambda x: x.isNotNull() & (x != ""))


def body_key(least: int) -> Callable[[Project], DataFrame]:
    def key(p: Project) -> DataFrame:
        hashes = F.array_sort(body_hashes())
        return keyed(p, F.struct(hashes.alias("h"), "nm", "nf", "nn", "mods"), F.size(hashes) >= least)

    return key


def body_jaccard(min_methods: int, least: float) -> Callable[[Project, Project], DataFrame]:
    def hashes(p: Project) -> DataFrame:
        return p.classes.select("cid", F.array_distinct(body_hashes()).alias("set"))

    return P.single(lambda a, b: P.jaccard(hashes(a), hashes(b), least, min_methods, 0.65, 0.27, 0.92))


def source_key(p: Project) -> DataFrame:
    files = refs.source_files(F.col("strings"))
    return keyed(p, F.struct(files.alias("f"), F.coalesce("super", F.lit("")).alias("s"), "nm", "nf", "mods"), F.size(files) >= 1)


def string_jaccard(least: float = 0.7, min_overlap: int = 3) -> Callable[[Project, Project], DataFrame]:
    def strings(p: Project) -> DataFrame:
        return p.classes.select("cid", F.array_distinct(refs.long_strings(F.col("strings"), 4)).alias("set"))

    return P.single(lambda a, b: P.jaccard(strings(a), strings(b), least, min_overlap, 0.6, 0.32, 0.92))


def contained_strings(min_strings: int = 3, ratio: float = 0.8, b_to_a: float = 2.0) -> Callable[[Project, Project], DataFrame]:
    """Most strings of a are in a b with many more strings: b may have taken a in."""

    def propose(a: Project, b: Project) -> DataFrame:
        tokens = lambda p: p.strings.where(F.length("s") >= 8)
        need = F.greatest(F.lit(min_strings), (ratio * F.col("n")).cast("int"))
        met = P.overlaps(tokens(a), tokens(b), need).where((F.col("na") >= min_strings) & (F.col("nb") >= b_to_a * F.col("na")))
        met = met.where(F.col("n") >= F.greatest(F.lit(min_strings), (ratio * F.col("na")).cast("int")))
        share = F.col("n") / F.col("na")
        return met.select("a", "b", F.least(0.65 + 0.15 * (share - ratio) / (1 - ratio + 1e-9), F.lit(0.85)).alias("confidence"))

    return propose


def line_key(p: Project) -> DataFrame:
    found = refs.sorted_set(F.col("line_refs"))
    return keyed(p, found, F.size(found) >= 4)


def shape_key(p: Project) -> DataFrame:
    impls = F.array_sort(F.filter("impls", lambda x: ~p.obfuscated(x)))
    return keyed(p, F.struct("super", impls.alias("i"), "nf", "nm", "ns", "nn", "mods"), F.col("super").isNotNull() & ~p.obfuscated("super") & (F.col("super") != OBJECT))


@P.single
def corroborating_shape(a: Project, b: Project) -> DataFrame:
    return P.fingerprint_pairs(shape_key(a), shape_key(b), 0.55, spec="both").withColumn("confidence", F.greatest("confidence", F.lit(0.3)))


def annotation_key(p: Project) -> DataFrame:
    values = refs.sorted_set(F.col("annotation_values"))
    return keyed(p, values, F.size(values) >= 2)


def metadata_key(p: Project) -> DataFrame:
    return keyed(p, F.array_sort("kotlin_meta"), F.size("kotlin_meta") > 0)


def method_call_set(min_targets: int = 2, min_votes: int = 2) -> Callable[[Project, Project], DataFrame]:
    """Methods with equal calls, parameter length, branches and name, where one class of B has such a method."""

    def keys(p: Project) -> DataFrame:
        calls = refs.sorted_set(F.filter("calls", lambda x: ~p.obfuscated(x["cls"])))
        params = F.length(F.regexp_extract("sig", r"\(([^)]*)\)", 1))
        return p.methods.where(F.size(calls) >= min_targets).select("cid", F.struct(calls.alias("c"), params.alias("p"), "br", "name").alias("key"))

    def propose(a: Project, b: Project) -> DataFrame:
        only = keys(b).distinct().groupBy("key").agg(F.count("*").alias("n"), F.min("cid").alias("b")).where("n = 1")
        votes = keys(a).join(only, "key").groupBy(F.col("cid").alias("a"), "b").agg(F.count("*").alias("v"))
        return P.top_votes(votes, min_votes, 1).select("a", "b", P.capped(0.7, 0.05, "v", 0.92).alias("confidence"))

    return propose


def content_matchers() -> list[Matcher]:
    """The matchers of tiers 1 and 2 that run by default, in their order."""
    return [
        Matcher("fqn_stable", 1, same_name),
        Matcher("native_syms", 1, fingerprint(native_key, 0.95)),
        Matcher("identical_strings", 1, bucketed(string_set(4, 3, 30), 0.97)),
        Matcher("deobf_fqn", 1, fingerprint(dotted_key, 0.95, "b", 0.97)),
        Matcher("long_unique_string", 2, long_unique_string),
        Matcher("unique_string", 2, unique_string(6)),
        Matcher("string_pair", 2, bucketed(string_set(8, 2), 0.85)),
        Matcher("stringset_hash", 2, bucketed(string_set(4, 2), 0.65)),
        Matcher("strings_plus_refs", 2, fingerprint(strings_and_refs_key, 0.8)),
        Matcher("stable_refs_ms", 2, fingerprint(refs_key, 0.7)),
        Matcher("call_targets_ms", 2, fingerprint(target_key("call_targets", 4), 0.9, "both")),
        Matcher("field_targets_ms", 2, fingerprint(target_key("field_targets", 3), 0.85, "both")),
        Matcher("field_access_by_type_ms", 2, fingerprint(typed_access_key(3), 0.85, "both")),
        Matcher("enum_value_names", 2, fingerprint(enum_key, 0.95, "both", 0.97)),
        Matcher("enum_values_jaccard", 2, enum_jaccard()),
        Matcher("anon_body_ms", 2, fingerprint(body_key(2), 0.93, "b")),
        Matcher("anon_body_jac_m5_j85", 2, body_jaccard(5, 0.85)),
        Matcher("anon_body_jac_m3_j95", 2, body_jaccard(3, 0.95)),
        Matcher("source_file_fp", 2, fingerprint(source_key, 0.92, "both")),
        Matcher("jaccard_strings_j7_o3", 2, string_jaccard()),
        Matcher("contained_strings", 2, contained_strings()),
        Matcher("line_refs_ms", 2, fingerprint(line_key, 0.92, "both")),
    ]


def optional_content_matchers() -> list[Matcher]:
    """Matchers of tier 2 that are off by default."""
    return [
        Matcher("corroborating_shape", 2, corroborating_shape),
        Matcher("annotation_values", 2, fingerprint(annotation_key, 0.93, "both")),
        Matcher("kotlin_debug_metadata", 2, fingerprint(metadata_key, 0.97, "b", 0.97)),
        Matcher("per_method_callset", 2, method_call_set()),
    ]
