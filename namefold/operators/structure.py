"""Matchers of tier 3: what the mapping so far says about the classes that it lacks."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namefold.functions import refs
from namefold.operators import members
from namefold.operators import primitives as P
from namefold.operators.content import OBJECT, Matcher
from namefold.operators.project import EDGE_WEIGHTS, Project
from namefold.plans.storage import settled

Proposal = Callable[[Project, Project, DataFrame], DataFrame]


def open_a(df: DataFrame, mapping: DataFrame, column: str = "a") -> DataFrame:
    """Rows whose ``column`` is not mapped yet."""
    return df.join(mapping.select(F.col("a").alias(column)), column, "left_anti")


def open_b(df: DataFrame, mapping: DataFrame, column: str = "b") -> DataFrame:
    """Rows whose ``column`` is no image yet."""
    return df.join(mapping.select(F.col("b").alias(column)), column, "left_anti")


def open_classes(p: Project, mapping: DataFrame, side: str) -> DataFrame:
    """Records of obfuscated classes without a partner."""
    return (open_a if side == "a" else open_b)(p.classes.where(p.obfuscated("cid")), mapping, "cid")


def images(edges: DataFrame, mapping: DataFrame, end: str, other: str) -> DataFrame:
    """(a, image, n_mapped): the images of the classes at ``other`` of the edges of unmapped a at ``end``."""
    rows = open_a(edges.select(F.col(end).alias("a"), F.col(other).alias("x")).distinct(), mapping)
    rows = rows.join(mapping.select(F.col("a").alias("x"), F.col("b").alias("image")), "x").select("a", "image")
    return rows.join(rows.groupBy("a").agg(F.count("*").alias("n_mapped")), "a")


def _only(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """The candidates of those a that have exactly one unmatched candidate."""
    left = open_b(found, mapping, "cand")
    return left.withColumn("n", F.count("*").over(Window.partitionBy("a"))).where("n = 1")


def lock_step(min_mapped: int, reverse: bool = False, cap: int = 500) -> Proposal:
    """The one unmatched class that meets every image of the mapped neighbours (reverse: of those that refer here, of
    which one has to refer to at most ``cap`` classes)."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        if reverse:
            reach = b.links.select(F.col("src").alias("image"), F.col("dst").alias("cand"))
            found = _only(P.division(images(a.links, mapping, "dst", "src"), reach, min_mapped, cap), mapping)
        else:
            found = P.division_few(a, b, mapping, min_mapped, 1, skip_empty=True)
        return found.select("a", F.col("cand").alias("b"), P.capped(0.85, 0.02, "k", 0.97).alias("confidence"))

    return propose


def disambiguating_lock_step(min_mapped: int = 3, most: int = 5, least: float = 0.6, margin: float = 0.1) -> Proposal:
    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        found = P.division_few(a, b, mapping, min_mapped, most, skip_empty=False)
        few = found.withColumn("n", F.count("*").over(Window.partitionBy("a"))).where("n >= 2")
        best = P.best_scores(P.content_score(few.select("a", F.col("cand").alias("b")), a, b, mapping), least, margin)
        return best.select("a", "b", (0.65 + F.col("lead") * 0.5).alias("confidence"))

    return propose


def extended_by(min_mapped: int) -> Proposal:
    """The one super of all images of mapped subclasses."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        near = images(a.edges.where("kind = 'extends'"), mapping, "dst", "src").where(F.col("n_mapped") >= min_mapped)
        supers = b.classes.where("super is not null and super <> ''").select(F.col("cid").alias("image"), "super")
        one = near.join(supers, "image").groupBy("a").agg(F.min("super").alias("b"), F.max("super").alias("_m"), F.max("n_mapped").alias("k")).where("b = _m")
        return open_b(one, mapping).select("a", "b", P.capped(0.85, 0.03, "k", 0.97).alias("confidence"))

    return propose


def implemented_by(min_mapped: int) -> Proposal:
    """The one unmatched interface that all images of mapped implementors name."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        near = images(a.edges.where("kind = 'implements'"), mapping, "dst", "src").join(b.classes.select(F.col("cid").alias("image")), "image", "left_semi")
        near = near.select("a", "image", "n_mapped")
        reach = b.classes.select(F.col("cid").alias("image"), F.explode(F.array_distinct("impls")).alias("cand"))
        found = _only(P.division(near, reach, min_mapped, None, skip_empty=False), mapping)
        return found.select("a", F.col("cand").alias("b"), P.capped(0.85, 0.02, "k", 0.97).alias("confidence"))

    return propose


#: Votes that are counted at a time.
VOTES = 50_000_000


def neighbour_vote(min_votes: int, margin: int, rise: float, most: float, weights: dict[str, int] | None = None, cap: int = 200) -> Proposal:
    """Classes of B that refer to the images of what a refers to; images that too many refer to have no vote."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        ea, eb = (a.edges, b.edges) if weights else (a.links.withColumn("kind", F.lit("any")), b.links.withColumn("kind", F.lit("any")))
        table = F.create_map(*(F.lit(x) for kv in (weights or {"any": 1}).items() for x in kv))
        small = eb.groupBy("dst", "kind").count().where(F.col("count") <= cap).select("dst", "kind")
        to = eb.join(small, ["dst", "kind"]).select(F.col("dst").alias("y"), "kind", F.col("src").alias("b"))
        voters = open_a(ea.select(F.col("src").alias("a"), F.col("dst").alias("x"), "kind"), mapping)
        voters = voters.join(mapping.select(F.col("a").alias("x"), F.col("b").alias("y")), "x").select("a", "y", "kind")
        # All candidates of an a are counted in its part, so only its best is kept of them before the next part.
        voters = settled(voters)
        near = settled(to.groupBy("y", "kind").agg(F.collect_list("b").alias("bs")))
        met = voters.join(near.select("y", "kind", F.size("bs").alias("n")), ["y", "kind"])
        parts = 1 + (met.agg(F.sum("n")).first()[0] or 0) // VOTES

        def top(i: int) -> DataFrame:
            # Whole lists go to their a, and become rows where that is counted.
            some = voters.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == i).join(near, ["y", "kind"])
            rows = some.select("a", "kind", "bs").repartition("a").select("a", "kind", F.explode("bs").alias("b"))
            return P.top_votes(rows.groupBy("a", "b").agg(F.sum(table[F.col("kind")]).alias("v")), min_votes, margin)

        best = functools.reduce(DataFrame.unionByName, (settled(top(i)) for i in range(parts)))
        return best.select("a", "b", P.capped(0.55, rise, "lead", most).alias("confidence"))

    return propose


def position_vote(elements: Callable[[Project], DataFrame], base: float, rise: float, most: float, min_votes: int, margin: int = 1, equal_length: bool = True) -> Proposal:
    """Votes of equal places in lists of matched pairs; ``elements`` gives (cid, refs) per project."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        # Whole lists meet, and only the places of pairs become rows.
        met = mapping.select("a", "b").join(elements(a).select(F.col("cid").alias("a"), F.col("refs").alias("x")), "a").join(elements(b).select(F.col("cid").alias("b"), F.col("refs").alias("y")), "b")
        if equal_length:
            met = met.where(F.size("x") == F.size("y"))
        votes = met.select(F.inline(F.arrays_zip(F.col("x").alias("a"), F.col("y").alias("b")))).withColumn("w", F.lit(1))
        return vote_unmapped(votes, a, mapping, base, rise, most, min_votes, margin)

    return P.single(propose)


def vote_unmapped(votes: DataFrame, p: Project, mapping: DataFrame, base: float, rise: float, most: float, min_votes: int, margin: int) -> DataFrame:
    """Votes (a, b, w) between obfuscated classes that have no partner yet."""
    usable = votes.where(p.obfuscated("a") & p.obfuscated("b"))
    # Summed before the mapping is asked: pairs are fewer than votes.
    total = open_b(open_a(usable.groupBy("a", "b").agg(F.sum("w").alias("v")), mapping), mapping)
    return P.top_votes(total, min_votes, margin).select("a", "b", P.capped(base, rise, "lead", most).alias("confidence"))


def _list(column: str, strip: bool = False) -> Callable[[Project], DataFrame]:
    def elements(p: Project) -> DataFrame:
        return p.classes.select("cid", (F.transform(column, lambda x: F.regexp_replace(x, r"^\[+", "")) if strip else F.col(column)).alias("refs"))

    return elements


def _super(p: Project) -> DataFrame:
    return p.classes.where("super is not null").select("cid", F.array("super").alias("refs"))


def _summed(count: Callable[[DataFrame], DataFrame], parts: Iterator[DataFrame]) -> DataFrame:
    """The counts of all parts, one part after the other."""
    return functools.reduce(DataFrame.unionByName, (settled(count(part)) for part in parts))


def body_sequence_vote(min_votes: int, margin: int = 1) -> Proposal:
    """Votes of equal places in the obfuscated references of paired methods' bodies of equal length."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        def votes(met: DataFrame) -> DataFrame:
            met = met.where((F.size("x") == F.size("y")) & (F.size("x") > 0))
            rows = met.select(F.inline(F.arrays_zip(F.col("x").alias("a"), F.col("y").alias("b"))))
            return rows.where(a.obfuscated("a") & a.obfuscated("b")).groupBy("a", "b").agg(F.count("*").alias("w"))

        votes = _summed(votes, members.paired_by_signature(a, b, mapping, body_hash=True, field="body_lx"))
        return vote_unmapped(votes, a, mapping, 0.72, 0.02, 0.92, min_votes, margin)

    return propose


def call_position_vote(min_votes: int, margin: int = 1) -> Proposal:
    """Votes of equal places in call lists of equal length, where the names or the substituted signatures agree."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        # Equal calls are counted first. Of calls with other names, only one that substitution changes can vote.
        def calls(met: DataFrame) -> DataFrame:
            met = met.where((F.size("x") == F.size("y")) & (F.size("x") > 0))
            rows = met.select(F.inline(F.arrays_zip(F.col("x").alias("x"), F.col("y").alias("y"))))
            rows = rows.select(F.col("x.cls").alias("a"), F.col("x.name").alias("sig"), F.col("y.cls").alias("b"), F.col("y.name").alias("sig_b")).where(a.obfuscated("a") & a.obfuscated("b") & F.col("sig").isNotNull() & F.col("sig_b").isNotNull())
            other = F.substring_index("sig", "(", 1) != F.substring_index("sig_b", "(", 1)
            rows = rows.where(~other | F.col("sig").contains(a.prefix)).select("a", "b", *(F.when(other, F.col(c)).alias(c) for c in ("sig", "sig_b")))
            return rows.groupBy("a", "b", "sig", "sig_b").agg(F.count("*").alias("w"))

        rows = _summed(calls, members.paired_by_signature(a, b, mapping, body_hash=False, field="calls_full"))
        subs = refs.substituted(rows.where("sig is not null").select("sig"), mapping, a.prefix).select("sig", "keep")
        votes = rows.where("sig is null").select("a", "b", "w").unionByName(rows.join(subs, "sig").where("keep = sig_b").select("a", "b", "w"))
        return vote_unmapped(votes, a, mapping, 0.74, 0.03, 0.93, min_votes, margin)

    return propose


def method_walk(min_votes: int = 2, margin: int = 1) -> Proposal:
    """Votes of the signatures and calls of paired methods: equal places, lone callees, unique and aligned signatures."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        calls = lambda m: F.transform(F.filter(F.col(f"{m}.calls_full"), lambda c: c["cls"].startswith(a.prefix)), lambda c, i: F.struct(i.alias("pos"), c["cls"].alias("cls"), c["name"].alias("sig")))
        met = members.paired_methods(a, b, mapping, least=0.5, most=10_000, body=0.0)
        # What follows asks the pairs several times, so what it needs of them is stored.
        met = settled(met.select("a", "b", "ia", "ib", F.col("ma.sig").alias("sa"), F.col("mb.sig").alias("sb"), calls("ma").alias("ca"), calls("mb").alias("cb")))
        own = lambda c: refs.positions(F.col(c), a.prefix)
        signs = met.select(own("sa").alias("x"), own("sb").alias("y")).where((F.size("x") == F.size("y")) & (F.size("x") <= 6))
        signs = signs.select(F.inline(F.arrays_zip("x", "y"))).where("x.pos = y.pos").select(F.col("x.ref").alias("a"), F.col("y.ref").alias("b"), F.lit(1).alias("w"))
        key = ["a", "b", "ia", "ib"]
        xs = open_a(met.select(*key, F.inline("ca")), mapping, "cls")
        ys = open_b(met.select(*key, F.inline("cb")), mapping, "cls")
        gather = lambda df, n: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "cls", "sig"))).alias(n))
        both = settled(gather(xs, "xs").join(gather(ys, "ys"), key).select("xs", "ys"))
        lone = (F.size("xs") == 1) & (F.size("ys") == 1)
        single = both.where(lone).select(F.col("xs")[0]["cls"].alias("a"), F.col("ys")[0]["cls"].alias("b"), F.lit(2).alias("w"))
        many = both.where(~lone)
        once = lambda c: F.filter(c, lambda x: F.size(F.filter(c, lambda y: y["sig"] == x["sig"])) == 1)
        u = many.select(F.explode(once("xs")).alias("x"), once("ys").alias("us")).select("x", F.explode("us").alias("y")).where("x.sig = y.sig")
        aligned = many.where(F.size("xs") == F.size("ys")).select(F.inline(F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y")))).where("x.sig = y.sig")
        more = u.unionByName(aligned).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.lit(1).alias("w"))
        return vote_unmapped(signs.unionByName(single).unionByName(more), a, mapping, 0.65, 0.04, 0.92, min_votes, margin)

    return propose


def _mapped_super(pairs: str = "s") -> Column:
    """Image of the super; null for none, for Object and for one without an image."""
    s = F.get(F.col(pairs), F.lit(0))
    return F.when((s["ref"] != OBJECT) & (s["ref"] != ""), s["to"])


def _super_array() -> Column:
    return F.filter(F.array("super"), lambda x: x.isNotNull())


def _kept_super(pairs: str = "s") -> Column:
    s = F.get(F.col(pairs), F.lit(0))
    return F.coalesce(s["to"], s["ref"])


def _whole(pairs: str) -> Column:
    """Whether every reference has an image."""
    return ~F.exists(pairs, lambda x: x["to"].isNull())


def field_types(min_fields: int, ordered: bool, base: float) -> Proposal:
    """Equal field types after substitution, with super, method count and modifiers."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        arrange = (lambda x: x) if ordered else F.array_sort
        rows = open_classes(a, mapping, "a").where(F.size("field_types") >= min_fields)
        bare = F.transform("field_types", lambda t: F.regexp_replace(t, r"^\[+", ""))
        sub = refs.resolved(rows, ["cid"], mapping, a.prefix, t=bare, s=_super_array())
        rows = rows.join(sub, "cid").where(~F.exists("t", lambda x: x["ref"].startswith(a.prefix) & x["ref"].endswith(";") & x["to"].isNull()))
        types = F.zip_with("field_types", refs.kept(F.col("t")), lambda t, k: F.concat(F.regexp_extract(t, r"^\[*", 0), k))
        ka = rows.select("cid", F.struct(arrange(types).alias("t"), _kept_super().alias("s"), "nm", "mods").alias("key")).where("key.s is not null")
        kb = open_classes(b, mapping, "b").where(F.size("field_types") >= min_fields).select("cid", F.struct(arrange(F.col("field_types")).alias("t"), F.coalesce("super", F.lit("")).alias("s"), "nm", "mods").alias("key"))
        return P.fingerprint_pairs(ka, kb, base, spec="b")

    return propose


def mapped_neighbours(least: int, ratio: float) -> Proposal:
    """Equal sets of references after substitution, with super, interfaces, counts and modifiers."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        every = F.array_distinct(F.concat("calls", "facc", "trefs"))
        rows = open_classes(a, mapping, "a").where(F.size(every) >= least)
        sub = refs.resolved(rows, ["cid"], mapping, a.prefix, r=every, s=_super_array(), i=F.col("impls"))
        rows = rows.join(sub, "cid")
        to = F.filter(F.transform("r", lambda x: x["to"]), lambda x: x.isNotNull())
        distinct = refs.sorted_set(to)
        rows = rows.where((F.size(to) / F.size("r") >= ratio) & (F.size(distinct) >= least))
        impls = F.when(_whole("i"), F.array_sort(refs.kept(F.col("i")))).otherwise(F.array().cast("array<string>"))
        ka = rows.select("cid", F.struct(distinct.alias("r"), _kept_super().alias("s"), impls.alias("i"), "nm", "nf", "nn", "mods").alias("key")).where("key.s is not null")
        kb = open_classes(b, mapping, "b").where(F.size(every) >= least)
        kb = kb.select("cid", F.struct(F.array_sort(every).alias("r"), F.coalesce("super", F.lit("")).alias("s"), F.array_sort("impls").alias("i"), "nm", "nf", "nn", "mods").alias("key"))
        return P.fingerprint_pairs(ka, kb, 0.85, spec="b")

    return propose


def _near(p: Project, reverse: bool) -> DataFrame:
    here, there = ("dst", "src") if reverse else ("src", "dst")
    return p.links.groupBy(F.col(here).alias("cid")).agg(F.array_sort(F.collect_list(there)).alias("near"))


def reverse_neighbours(least: int, ratio: float) -> Proposal:
    """Equal sets of referring classes after substitution, with counts and modifiers."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        rows = open_classes(a, mapping, "a").join(_near(a, True), "cid").where(F.size("near") >= least)
        rows = rows.join(refs.resolved(rows, ["cid"], mapping, a.prefix, r=F.col("near")), "cid")
        to = F.filter(F.transform("r", lambda x: x["to"]), lambda x: x.isNotNull())
        ka = rows.where(F.size(to) / F.size("r") >= ratio).select("cid", F.struct(F.array_sort(to).alias("r"), "nm", "nf", "mods").alias("key"))
        kb = open_classes(b, mapping, "b").join(_near(b, True), "cid").where(F.size("near") >= least).select("cid", F.struct(F.col("near").alias("r"), "nm", "nf", "mods").alias("key"))
        return P.fingerprint_pairs(ka, kb, 0.83, spec="b")

    return propose


def symmetric_neighbours(least: int, ratio: float, sort: bool = False) -> Proposal:
    """Equal neighbours in both directions after substitution. Substituted names keep the order of the names before,
    unless ``sort``, so that without it only renamings that keep the order are found."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        empty = F.array().cast("array<string>")

        def both(p: Project, side: str) -> DataFrame:
            rows = open_classes(p, mapping, side).join(_near(p, False).withColumnRenamed("near", "f"), "cid", "left").join(_near(p, True).withColumnRenamed("near", "v"), "cid", "left")
            return rows.withColumn("f", F.coalesce("f", empty)).withColumn("v", F.coalesce("v", empty)).where(F.size("f") + F.size("v") >= least)

        rows = both(a, "a")
        rows = rows.join(refs.resolved(rows, ["cid"], mapping, a.prefix, xf=F.col("f"), xv=F.col("v")), "cid")
        there = lambda c: F.filter(F.transform(c, lambda x: x["to"]), lambda x: x.isNotNull())
        arrange = F.array_sort if sort else (lambda x: x)
        to = F.concat(arrange(there("xf")), arrange(there("xv")))
        ka = rows.where(F.size(to) / (F.size("f") + F.size("v")) >= ratio).select("cid", F.struct(to.alias("r"), F.size(there("xf")).alias("k"), "nm", "nf", "mods").alias("key"))
        kb = both(b, "b").select("cid", F.struct(F.concat("f", "v").alias("r"), F.size("f").alias("k"), "nm", "nf", "mods").alias("key"))
        return P.fingerprint_pairs(ka, kb, 0.85, spec="b")

    return propose


def sub_signatures(p: Project, mapping: DataFrame) -> DataFrame:
    """(cid, sigs, keep, marked, open): a class's sorted signatures, before and after substitution."""
    rows = p.classes.select("cid", F.posexplode("sigs").alias("pos", "sig"))
    rows = rows.join(refs.substituted(rows.select("sig"), mapping, p.prefix), "sig")
    every = lambda c: F.array_sort(F.collect_list(c))
    return rows.groupBy("cid").agg(every("sig").alias("sigs"), every("keep").alias("keep"), every("marked").alias("marked"), F.sum("n_open").alias("open"))


def signature_fingerprint(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
    """Equal signatures after substitution, where it changed any and left no more open than there are signatures."""
    rows = a.classes.where("nm >= 2").select("cid").join(sub_signatures(a, mapping), "cid")
    ka = rows.where((F.col("marked") != F.col("sigs")) & (F.col("open") <= F.size("marked"))).select("cid", F.col("marked").alias("key"))
    kb = b.classes.where((F.size("sigs") > 0) & (F.col("nm") >= 2)).select("cid", F.array_sort("sigs").alias("key"))
    return P.fingerprint_pairs(ka, kb, 0.7)


def call_targets(least: int = 6) -> Proposal:
    """Equal call targets after substitution; targets without an image are left out."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        sub = refs.resolved(a.classes, ["cid"], mapping, a.prefix, c=F.transform("call_targets", lambda x: x["cls"]))
        rows = a.classes.select("cid", "call_targets").join(sub, "cid")
        named = F.zip_with("call_targets", "c", lambda t, c: F.struct(c["to"].alias("cls"), t["name"].alias("name")))
        key = refs.sorted_set(F.filter(named, lambda x: x["cls"].isNotNull()))
        ka = rows.select("cid", F.when(F.size(key) >= least, key).alias("key"))
        kb_key = refs.sorted_set(F.col("call_targets"))
        kb = b.classes.select("cid", F.when(F.size(kb_key) >= least, kb_key).alias("key"))
        return P.fingerprint_pairs(ka, kb, 0.85, spec="b")

    return propose


def method_call_sets(least: int = 2) -> Proposal:
    """Equal multisets of methods, each as its substituted signature, calls, accesses, branches and literal count."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        def key(p: Project, images: DataFrame) -> DataFrame:
            cls = lambda c: F.transform(c, lambda x: x["cls"])
            rows = p.methods.join(refs.resolved(p.methods, ["cid", "midx"], images, p.prefix, c=cls("calls"), f=cls("facc")), ["cid", "midx"])
            rows = rows.join(refs.substituted(rows.select("sig"), images, p.prefix).select("sig", "keep"), "sig")
            named = lambda c, to: refs.sorted_set(F.zip_with(c, refs.kept(F.col(to)), lambda x, k: F.struct(k.alias("cls"), x["name"].alias("name"))))
            one = F.struct("keep", named("calls", "c").alias("c"), named("facc", "f").alias("f"), "br", F.size("strs").alias("n"))
            return rows.groupBy("cid").agg(F.array_sort(F.collect_list(one)).alias("key")).where(F.size("key") >= least)

        return P.fingerprint_pairs(key(a, mapping), key(b, mapping.limit(0)), 0.9, spec="b")

    return propose


def siblings(kind: str) -> Proposal:
    """The one class of B with the same (mapped) super, interfaces and shape.

    ``exact``: equal counts, unmapped interfaces as one mark. ``loose``: all interfaces mapped, counts within one,
    unmatched in B. ``interfaces``: without the super, all of at least one interface mapped.
    """

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        rows = a.classes.join(refs.resolved(a.classes, ["cid"], mapping, a.prefix, s=_super_array(), i=F.col("impls")), "cid")
        marked = F.array_sort(F.transform("i", lambda x: F.coalesce(x["to"], F.lit("?"))))
        rows = rows.select(F.col("cid").alias("a"), F.when(F.lit(kind == "interfaces"), "").otherwise(_mapped_super()).alias("s"), F.when(F.lit(kind == "exact") | _whole("i"), marked).alias("i"), "mods", *("nm", "nf", "ns", "nn")).where("s is not null and i is not null")
        there = b.classes.select(F.col("cid").alias("b"), F.when(F.lit(kind == "interfaces"), "").otherwise(F.col("super")).alias("s"), F.array_sort("impls").alias("i"), "mods", "nm", "nf", "ns", "nn")
        there = there.where("s is not null" if kind == "interfaces" else f"s is not null and s <> '' and s <> '{OBJECT}'")
        if kind == "interfaces":
            rows, there = rows.where(F.size("i") > 0), there.where(F.size("i") > 0)
        key = ["s", "i", "mods", "nm", "nf", "nn", "ns"]
        if kind == "loose":
            key.remove("ns")
            there = open_b(there, mapping)
            around = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(f).alias("f")) for m in (-1, 0, 1) for f in (-1, 0, 1)))
            rows = rows.withColumn("d", F.explode(around)).withColumn("nm", F.col("nm") + F.col("d.m")).withColumn("nf", F.col("nf") + F.col("d.f"))
        # Siblings are counted per shape, so however many a super has, no pairs of them are made.
        shapes = there.groupBy(*key).agg(F.count("*").alias("n"), F.min("b").alias("b"))
        one = rows.select("a", *key).join(shapes, key).groupBy("a").agg(F.sum("n").alias("n"), F.min("b").alias("b")).where("n = 1")
        return one.select("a", "b", F.lit(0.62 if kind == "loose" else 0.7).alias("confidence"))

    return propose


def sibling_signatures(least: int = 4) -> Proposal:
    """The one unmatched class of B with the same super, substituted signatures and modifiers."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        rows = open_classes(a, mapping, "a").where(F.size("sigs") >= least).select("cid", "super", "mods")
        rows = rows.join(refs.resolved(rows, ["cid"], mapping, a.prefix, s=_super_array()), "cid").join(sub_signatures(a, mapping).select("cid", "keep"), "cid")
        rows = rows.select(F.col("cid").alias("a"), _mapped_super().alias("s"), F.col("keep").alias("g"), "mods").where("s is not null")
        there = open_classes(b, mapping, "b").where((F.size("sigs") >= least) & F.col("super").isNotNull() & ~F.col("super").isin("", OBJECT))
        there = there.select(F.col("cid").alias("b"), F.col("super").alias("s"), F.array_sort("sigs").alias("g"), "mods")
        one = rows.join(there, ["s", "g", "mods"]).groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1")
        return one.select("a", "b", F.lit(0.85).alias("confidence"))

    return propose


def _ratio_vote(tokens_a: DataFrame, tokens_b: DataFrame, total: DataFrame, min_votes: int, ratio: float, most: float) -> DataFrame:
    """Votes of tokens (cid, k, token): each k of a counts once for each b that has its token."""
    total = total.where(F.col("total") >= min_votes)
    met = tokens_a.select(F.col("cid").alias("a"), "k", "token").join(tokens_b.select(F.col("cid").alias("b"), "token").distinct(), "token")
    top = P.top_votes(met.groupBy("a", "b").agg(F.count("*").alias("v")), min_votes, 1)
    top = top.join(total, "a").where(F.col("v") / F.col("total") >= ratio)
    return top.select("a", "b", P.capped(0.7, 0.05, "lead", most).alias("confidence"))


def body_hash_vote(min_votes: int = 3, ratio: float = 0.5) -> Proposal:
    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        rows = lambda p: p.methods.where("bha <> ''").select("cid", F.col("midx").alias("k"), F.col("bha").alias("token"))
        left = open_a(rows(a), mapping, "cid")
        return _ratio_vote(left, open_b(rows(b), mapping, "cid"), left.groupBy(F.col("cid").alias("a")).agg(F.count("*").alias("total")), min_votes, ratio, 0.93)

    return propose


def signature_vote(min_votes: int = 4, ratio: float = 0.7) -> Proposal:
    """Only signatures without an open reference vote; all count for the ratio."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        left = open_a(a.methods.where("sig <> ''").select("cid", F.col("midx").alias("k"), "sig"), mapping, "cid")
        total = left.groupBy(F.col("cid").alias("a")).agg(F.count("*").alias("total"))
        left = left.join(refs.substituted(left.select("sig"), mapping, a.prefix), "sig").where("n_open = 0").select("cid", "k", F.col("keep").alias("token"))
        right = open_b(b.methods.where("sig <> ''").select("cid", F.col("sig").alias("token")), mapping, "cid")
        return _ratio_vote(left, right, total, min_votes, ratio, 0.92)

    return propose


def best_effort(least: float, margin: float, most: int = 50) -> Proposal:
    """The best content score among two to ``most`` unmatched classes that share a string or a stable reference.

    References seed the classes whose strings find fewer than ``most``: the first five in the order of calls,
    accesses and types. Strings all count; one that more than ``most`` unmatched classes hold rules its class out
    before any pairs are made.
    """

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        long = lambda p, k: p.strings.where(F.length("s") >= 6).withColumnRenamed("cid", k)
        rows = open_a(a.classes.select(F.col("cid").alias("a"), F.slice(F.filter(F.concat("calls", "facc", "trefs"), lambda x: ~x.startswith(a.prefix)), 1, 5).alias("refs")), mapping)
        there = long(b, "b").join(mapping.select("b", F.lit(True).alias("_m")), "b", "left")
        there = there.select("b", "s", (F.col("_m").isNull() & b.obfuscated("b")).alias("open"))
        holders = there.groupBy("s").agg(F.count("*").alias("every"), F.sum(F.col("open").cast("int")).alias("free"))
        here = open_a(long(a, "a"), mapping).join(holders, "s")
        of = here.groupBy("a").agg(F.max("every").alias("every"), F.max("free").alias("free"))
        ruled_out, many = of.where(F.col("free") > most).select("a"), of.where(F.col("every") >= most).select("a")
        usable = there.join(holders, "s").where((F.col("every") < most) | (F.col("open") & (F.col("free") <= most))).select("s", "b", "open")
        pairs = here.select("a", "s").join(ruled_out, "a", "left_anti").join(usable, "s").select("a", "b", "open").distinct()
        few = rows.join(ruled_out, "a", "left_anti").join(many, "a", "left_anti")
        few = few.join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a", "left").where(f"n is null or n < {most}")
        by_ref = few.select("a", F.explode("refs").alias("dst")).join(b.links, "dst").select("a", F.col("src").alias("b"))
        found = open_b(pairs.where("open").select("a", "b").unionByName(by_ref).distinct().where(b.obfuscated("b")), mapping)
        found = found.withColumn("n", F.count("*").over(Window.partitionBy("a"))).where(F.col("n").between(2, most))
        best = P.best_scores(P.content_score(found, a, b, mapping), least, margin)
        return best.select("a", "b", (0.6 + F.col("lead")).alias("confidence"))

    return propose


def bucket_best(least: float = 0.75, margin: float = 0.18) -> Proposal:
    """The best content score of all open classes in the folder that the class's folder most often maps to."""

    def propose(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
        folder = lambda p, k: p.classes.select(F.col("cid").alias(k), F.coalesce("bucket", F.lit("")).alias(f"f_{k}"))
        seen = mapping.select("a", "b").join(folder(a, "a"), "a").join(folder(b, "b"), "b").groupBy("f_a", "f_b").count()
        top = seen.withColumn("r", F.row_number().over(Window.partitionBy("f_a").orderBy(F.desc("count"), "f_b"))).where("r = 1 and f_b <> ''").select("f_a", F.col("f_b").alias("folder"))
        # Whole contents are shuffled for one side at a time.
        top = settled(top)
        rows = open_a(P.contents(a, "a", "bucket").where(a.obfuscated("a")), mapping).withColumn("f_a", F.coalesce("bucket", F.lit(""))).join(top, "f_a")
        rows = settled(P.with_super(rows, a, mapping).select("a", "folder", "r_a", "_super"))
        there = settled(open_b(P.contents(b, "b", "bucket").where(b.obfuscated("b")), mapping).select("b", F.coalesce("bucket", F.lit("")).alias("folder"), "r_b"))
        best = P.best_of_folders(rows, there, least, margin)
        return best.select("a", "b", (0.6 + F.col("lead")).alias("confidence"))

    return propose


def structure_matchers() -> list[Matcher]:
    """The matchers of tier 3 that run by default, in their order."""
    t = lambda name, proposal: Matcher(name, 3, proposal)
    out = [t(f"lockstep_n{n}", lock_step(n)) for n in (4, 3, 2, 1)]
    out += [
        t("disambig_lockstep_n3", disambiguating_lock_step(3)),
        t("field_type_seq_sub", field_types(2, True, 0.85)),
        t("field_type_ms_sub", field_types(3, False, 0.82)),
        t("mapped_nb_fp_n3_r7", mapped_neighbours(3, 0.7)),
        t("mapped_nb_fp_n2_r5", mapped_neighbours(2, 0.5)),
        t("sym_nb_fp_n4_r6", symmetric_neighbours(4, 0.6)),
        t("method_walk", method_walk()),
    ]
    out += [t(f"field_position_lx_vote_n{n}", position_vote(_list("field_types", strip=True), 0.7, 0.05, 0.93, n)) for n in (2, 1)]
    out += [t(f"impls_position_lx_vote_n{n}", position_vote(_list("impls"), 0.7, 0.05, 0.93, n)) for n in (2, 1)]
    out += [t(f"super_lx_vote_n{n}", position_vote(_super, 0.75, 0.04, 0.95, n)) for n in (2, 1)]
    out += [t(f"anns_position_lx_vote_n{n}", position_vote(_list("anns"), 0.7, 0.05, 0.93, n)) for n in (2, 1)]
    out += [t(f"body_lx_seq_vote_n{n}", body_sequence_vote(n)) for n in (2, 1)]
    out += [t(f"calls_full_position_vote_n{n}", call_position_vote(n)) for n in (2, 1)]
    out += [t(f"reverse_lockstep_n{n}", lock_step(n, reverse=True)) for n in (4, 3, 2, 1)]
    out += [t(f"extended_by_lockstep_n{n}", extended_by(n)) for n in (2, 1)]
    out += [t(f"implemented_by_lockstep_n{n}", implemented_by(n)) for n in (3, 2, 1)]
    out += [t("method_callset_sub", method_call_sets())]
    out += [t(f"neighbour_vote_w_n{n}", neighbour_vote(n, 1 if n <= 1 else 2, 0.02, 0.92, EDGE_WEIGHTS)) for n in (4, 2, 1)]
    out += [
        t("sig_substituted", signature_fingerprint),
        t("call_targets_sub", call_targets()),
        t("sibling_super", siblings("exact")),
        t("sibling_super_loose", siblings("loose")),
        t("sibling_sub_sigs", sibling_signatures()),
        t("bha_method_vote", body_hash_vote()),
        t("method_sig_sub_vote", signature_vote()),
        t("best_effort_s75_m20", best_effort(0.75, 0.2)),
    ]
    return out


def optional_structure_matchers() -> list[Matcher]:
    """Matchers of tier 3 that are off by default."""
    return [
        Matcher("neighbour_vote", 3, neighbour_vote(4, 2, 0.03, 0.9)),
        Matcher("rev_nb_fp_n4_r6", 3, reverse_neighbours(4, 0.6)),
        Matcher("sibling_impls", 3, siblings("interfaces")),
        Matcher("bucket_disambig", 3, bucket_best()),
    ]
