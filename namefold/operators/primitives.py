"""Relational building blocks of the matchers."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b
from itertools import combinations, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namefold.operators.project import Project
from namefold.plans.storage import settled, stored


def specificity(base: float, na: Column, nb: Column, ceiling: float = 0.95) -> Column:
    """Confidence of a bucket with na and nb classes: falls with its size, to 0.4 at the least."""
    return F.when(na * nb <= 1, F.lit(min(base, ceiling))).otherwise(F.greatest(base / F.sqrt(na * nb), F.lit(0.4)))


def single(propose: Callable) -> Callable:
    """Mark a proposal that gives no pair twice, so that its pairs need not be grouped."""
    propose.single = True
    return propose


def digest(key: Column) -> Column:
    """16 bytes that stand for a key of any type; of its text and of its bytes, which differ where a text is no UTF-8."""
    text = F.concat_ws("|", F.to_json(F.struct(key.alias("key"))), F.xxhash64(key).cast("string"))
    # Spark moves no filter below an id of the row; below this, a filter for null would make every key once more.
    return F.when(key.isNotNull() & (F.monotonically_increasing_id() >= 0), F.substring(F.unhex(F.sha2(text, 256)), 1, 16))


def fingerprint_pairs(a: DataFrame, b: DataFrame, base: float, ceiling: float = 0.95, spec: str = "none") -> DataFrame:
    """All pairs of (cid, key) rows with equal keys; a null key meets none.

    ``spec``: 'none' gives every pair the confidence ``base``; 'both' and 'b' lower it by the bucket's size
    on both sides or on the B side alone. Keys meet by their digests; a side is dealt by them once, for its sizes and for the pairs.
    """
    def side(rows: DataFrame, name: str, sized: bool) -> DataFrame:
        keys = rows.select(F.col("cid").alias(name), digest(F.col("key")).alias("key")).where("key is not null")
        return keys.withColumn(f"n{name}", F.count("*").over(Window.partitionBy("key")) if sized else F.lit(1))

    pairs = side(a, "a", spec == "both").join(side(b, "b", spec in ("both", "b")), "key")
    conf = F.lit(base) if spec == "none" else specificity(base, F.col("na"), F.col("nb"), ceiling)
    return pairs.select("a", "b", conf.alias("confidence"))


#: Modifiers that make a class of another kind.
KINDS = ("interface", "enum", "annotation")
#: Member counts of a class.
COUNTS = ("nf", "nm", "ns", "nn")


def kinds_differ(x: Column, y: Column) -> Column:
    """Whether two sets of modifiers differ in what kind of class they make."""
    same = F.lit(True)
    for kind in KINDS:
        same = same & (F.array_contains(x, kind) == F.array_contains(y, kind))
    return ~same


def resolve_buckets(prefix: str, a: DataFrame, b: DataFrame, confidence: float) -> DataFrame:
    """Within each bucket of equal keys, the one-to-one assignment that is greedy by (distance, a, b).

    Rows have the key beside the class's modifiers, counts and super. The distance is the difference of member counts,
    less eight for an equal unobfuscated super; classes of different kinds never pair. The classes of a bucket meet in
    one task, by their shapes: the distance depends on these alone, so no list of pairs is made. Buckets of one side
    alone go before.
    """
    def side(rows: DataFrame, at: int) -> DataFrame:
        kind = sum((F.array_contains("mods", k).cast("int") * (1 << n) for n, k in enumerate(KINDS)), F.lit(0))
        named = F.when((F.col("super") != "") & ~F.col("super").startswith(prefix), F.col("super")).otherwise("")
        rows = rows.select(digest(F.col("key")).alias("bucket"), F.lit(at).alias("side"), "cid", kind.alias("kind"), *COUNTS, F.coalesce(named, F.lit("")).alias("sup"))
        return rows.where("bucket is not null and kind is not null")

    # The window deals the rows by their bucket and sorts them, once for all that follows.
    by = Window.partitionBy("bucket")
    both = side(a, 0).unionByName(side(b, 1)).withColumn("lo", F.min("side").over(by)).withColumn("hi", F.max("side").over(by))
    rows = both.where("lo < hi").select("bucket", "side", "cid", "kind", *COUNTS, "sup")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["bucket", "side", "cid", "kind", *COUNTS, "sup"]
        every = (row for batch in batches for row in batch[columns].itertuples(index=False, name=None))
        found: list[tuple[str, str]] = []
        for _, bucket in groupby(every, key=lambda row: row[0]):
            found += assigned([row[1:] for row in bucket])
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        yield pd.DataFrame(found, columns=["a", "b"])

    return rows.mapInPandas(run, "a string, b string").withColumn("confidence", F.lit(confidence))


def assigned(bucket: list[tuple]) -> list[tuple[str, str]]:
    """Pairs of a bucket's rows (side, cid, kind, four counts, super), greedy by (distance, a, b)."""
    ours: dict[tuple, list[str]] = {}
    theirs: dict[tuple, deque[str]] = {}
    for side, cid, *shape in sorted(bucket):
        (ours if side == 0 else theirs).setdefault(tuple(shape), [] if side == 0 else deque()).append(cid)
    levels: dict[int, dict[tuple, list[tuple]]] = {}
    for x in ours:
        for y in theirs:
            if x[0] == y[0]:
                gap = sum(abs(int(p) - int(q)) for p, q in zip(x[1:5], y[1:5], strict=True)) - (8 if x[5] == y[5] != "" else 0)
                levels.setdefault(gap, {}).setdefault(x, []).append(y)
    pairs = []
    for gap in sorted(levels):
        taken: set[str] = set()
        for cid, x in sorted((cid, x) for x in levels[gap] for cid in ours[x]):
            free = [theirs[y] for y in levels[gap][x] if theirs[y]]
            if free:
                pairs.append((cid, min(free, key=lambda q: q[0]).popleft()))
                taken.add(cid)
        for x in levels[gap]:
            ours[x] = [cid for cid in ours[x] if cid not in taken]
    return pairs


def unique_tokens(tokens: DataFrame) -> DataFrame:
    """(s, cid) of tokens that exactly one class has."""
    return tokens.groupBy("s").agg(F.count("*").alias("n"), F.min("cid").alias("cid")).where("n = 1").select("s", "cid")


def overlaps(a: DataFrame, b: DataFrame, need_a: Column, need_b: Column | None = None) -> DataFrame:
    """(a, b, n, na, nb): shared tokens and set sizes of pairs of distinct (cid, s) rows.

    ``need_a`` tells, from the set's size ``n``, the least overlap that matters for a set of side a, ``need_b``
    likewise for side b. A pair with such an overlap shares one of the n - need + 1 rarest tokens of each set,
    so only those tokens meet, and candidates are then counted in full. Without ``need_b`` the B sets are whole.
    """
    rarity = a.select("s").unionByName(b.select("s")).groupBy("s").agg(F.count("*").alias("f"))

    def prefix(tokens: DataFrame, need: Column | None, name: str) -> tuple[DataFrame, DataFrame]:
        sets = tokens.join(rarity, "s").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("xs"))
        sets = sets.select(F.col("cid").alias(name), F.transform("xs", lambda x: x["s"]).alias(f"s{name}"), F.size("xs").alias("n"))
        kept = F.col(f"s{name}") if need is None else F.slice(f"s{name}", F.lit(1), F.greatest(F.lit(0), F.col("n") - need.cast("int") + 1))
        return sets.select(name, f"s{name}", F.col("n").alias(f"n{name}")), sets.select(name, F.explode(kept).alias("s"))

    (sets_a, few_a), (sets_b, few_b) = prefix(a, need_a, "a"), prefix(b, need_b, "b")
    met = few_a.join(few_b, "s").select("a", "b").distinct().join(sets_a, "a").join(sets_b, "b")
    return met.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n"), "na", "nb")


#: Sets of so many tokens at most meet by the subsets that they may share.
SMALL = 10
#: Tokens that are sent to the pairs at a time.
PART = 15_000_000


def jaccard(a: DataFrame, b: DataFrame, least: float, min_overlap: int, base: float, rise: float, flat: float) -> DataFrame:
    """Pairs of (cid, set) rows with a Jaccard coefficient of at least ``least``; the confidence rises from ``base`` by ``rise``.

    Sets have no repeated tokens; those below ``min_overlap`` are no sets. One of each class of equal sets is compared, and
    only the ids of the others follow. Two sets of at most ``SMALL`` tokens meet where their intersection is equal, others
    by the rarest of the tokens that both sides have. The sets are stored, since both ways ask them several times.
    """
    def side(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        sets = rows.select(F.col("cid").alias("id"), F.sort_array("set").alias("set")).where(F.size("set") >= min_overlap)
        sets = settled(sets.withColumn("key", digest(F.col("set"))))
        one = settled(sets.groupBy("key").agg(F.min("id").alias(name)))
        distinct = sets.join(one.select(F.col(name).alias("id")), "id", "left_semi").select(F.col("id").alias(name), "set", F.size("set").alias(f"n{name}"))
        return settled(distinct), sets.select("key", "id").join(one, "key").select(name, "id")

    (a, every_a), (b, every_b) = side(a, "a"), side(b, "b")
    met = met_by_subsets(a, b, least, min_overlap)
    if not a.where(F.col("na") > SMALL).isEmpty() or not b.where(F.col("nb") > SMALL).isEmpty():
        # A set that is alike one of more than SMALL tokens has more than least * SMALL.
        big_a, big_b = (rows.where(F.col(f"n{name}") >= least * (SMALL + 1) - 1e-9) for rows, name in ((a, "a"), (b, "b")))
        met = met.unionByName(met_by_rare_tokens(big_a, big_b, least, min_overlap))
    j = F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))
    conf = F.lit(flat) if least >= 1 else base + rise * (F.col("j") - least) / (1 - least)
    found = met.where(F.col("n") >= min_overlap).withColumn("j", j).where(F.col("j") >= least).select("a", "b", conf.alias("confidence"))
    found = found.join(every_a, "a").select(F.col("id").alias("to"), "b", "confidence").join(every_b, "b")
    return found.select(F.col("to").alias("a"), F.col("id").alias("b"), "confidence")


def met_by_subsets(a: DataFrame, b: DataFrame, least: float, min_overlap: int) -> DataFrame:
    """(a, b, n, na, nb) of the pairs of sets of at most ``SMALL`` tokens that reach ``least``.

    Each set names the subsets that may be its intersection with a set of each size, by 16 bytes. Of the sets that name
    one subset those pairs count whose other tokens, by 8 bytes each, differ, so each pair is found once.
    """
    def alike(n: int, own: int, other: int) -> bool:
        return n >= min_overlap and n / (own + other - n) >= least

    #: By a set's size: how many of its tokens are shared with a set of what size.
    shares = {own: [(n, other) for other in range(1, SMALL + 1) for n in range(1, min(own, other) + 1) if alike(n, own, other)] for own in range(1, SMALL + 1)}

    def named(rows: DataFrame, own: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cids, keys, sizes, rests = [], [], [], []
                for cid, tokens in zip(batch.column(own).to_pylist(), batch.column("set").to_pylist(), strict=True):
                    names = [blake2b(t.encode(), digest_size=8).digest() for t in tokens]
                    for n, others in groupby(sorted(shares[len(names)]), key=lambda x: x[0]):
                        others = [o for _, o in others]
                        for held in combinations(range(len(names)), n):
                            key = blake2b("".join(f"{len(tokens[k])}:{tokens[k]}" for k in held).encode(), digest_size=16).digest()
                            rest = [int.from_bytes(names[k], "little", signed=True) for k in range(len(names)) if k not in held]
                            for o in others:
                                cids.append(cid)
                                keys.append(key)
                                sizes.append(n << 16 | (len(names) << 8 | o if own == "a" else o << 8 | len(names)))
                                rests.append(rest)
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.string()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(rests, pa.list_(pa.int64()))], [own, "key", "sizes", f"r{own}"])

        return rows.where(F.col(f"n{own}") <= SMALL).select(own, "set").mapInArrow(run, f"{own} string, key binary, sizes int, r{own} array<long>")

    met = named(a, "a").join(named(b, "b"), ["key", "sizes"]).where(~F.arrays_overlap("ra", "rb"))
    part = lambda by: F.shiftright("sizes", by).bitwiseAND(F.lit(255))
    return met.select("a", "b", part(16).alias("n"), part(8).alias("na"), part(0).alias("nb"))


def met_by_rare_tokens(a: DataFrame, b: DataFrame, least: float, min_overlap: int) -> DataFrame:
    """(a, b, n, na, nb) of the pairs that reach ``least`` and have a set of more than ``SMALL`` tokens, and of some more.

    Tokens of one side alone meet none. Of the others, a set's ``k - need + 1`` rarest are enough, for ``k`` of them and
    ``need`` that it shares with any set alike. A pair alike meets at its rarest common token, where both sets have as many
    tokens left as they share.
    """
    tokens = {name: rows.select(name, f"n{name}", F.explode("set").alias("s")) for name, rows in (("a", a), ("b", b))}
    counts = [rows.groupBy("s").agg(F.count("*").alias(f"f{name}")) for name, rows in tokens.items()]
    shared = settled(counts[0].join(counts[1], "s").select("s", (F.col("fa") + F.col("fb")).alias("f")))
    need = lambda n, part: F.greatest(F.lit(min_overlap), F.ceil(part * n - 1e-9))

    def rarest(name: str) -> DataFrame:
        own = tokens[name].join(shared, "s").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("xs"), F.first(f"n{name}").alias(f"n{name}"))
        few = F.size("xs") - need(F.col(f"n{name}"), least).cast("int") + 1
        own = own.where(few > 0).select(name, f"n{name}", F.size("xs").alias("k"), F.posexplode(F.slice("xs", F.lit(1), few)).alias("at", "x"))
        return own.select(name, f"n{name}", (F.col("k") - F.col("at")).alias(f"left_{name}"), F.col("x.s").alias("s"))

    fit = (F.least("left_a", "left_b") >= need(F.col("na") + F.col("nb"), least / (1 + least))) & (F.greatest("na", "nb") > SMALL)
    pairs = settled(rarest("a").join(rarest("b"), "s").where(fit).select("a", "b", "na").distinct())
    n = 1 + (pairs.agg(F.sum("na")).first()[0] or 0) // PART

    def counted(i: int) -> DataFrame:
        met = pairs.select("a", "b").where(F.pmod(F.xxhash64("a", "b"), F.lit(n)) == i).join(a.withColumnRenamed("set", "sa"), "a").join(b.withColumnRenamed("set", "sb"), "b")
        return met.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n"), "na", "nb")

    return reduce(DataFrame.unionByName, (settled(counted(i)) for i in range(n)))


def top_votes(votes: DataFrame, min_votes: int, margin: int) -> DataFrame:
    """Per a the b with the most votes, if they reach ``min_votes`` and lead the second by ``margin``: (a, b, v, lead)."""
    by = Window.partitionBy("a").orderBy(F.desc("v"), "b")
    ranked = votes.withColumn("rank", F.row_number().over(by)).withColumn("second", F.coalesce(F.lead("v", 1).over(by), F.lit(0)))
    return ranked.where((F.col("rank") == 1) & (F.col("v") >= min_votes)).withColumn("lead", F.col("v") - F.col("second")).where(F.col("lead") >= margin).select("a", "b", "v", "lead")


def capped(base: float, rise: float, column: str, most: float) -> Column:
    return F.least(base + rise * F.col(column), F.lit(most))


#: Sets, smallest first, that narrow the candidates of a division one after another.
NARROW = 3


def division(images: DataFrame, reach: DataFrame, min_mapped: int, cap: int | None, skip_empty: bool = True) -> DataFrame:
    """Relational division: (a, cand, k) for every candidate that all images of ``a`` reach.

    ``images`` is distinct (a, image, n_mapped) and ``reach`` distinct (image, cand). With ``cap``, an a
    needs an image that reaches between one and ``cap`` candidates. Images that reach none do not count when
    ``skip_empty``, else they leave no candidate.
    """
    size = reach.groupBy("image").agg(F.count("*").alias("size"))
    wide = images.where(F.col("n_mapped") >= min_mapped).join(size, "image", "left")
    need = wide.groupBy("a").agg(F.count("size").alias("filled"), F.count("*").alias("every"), F.max("n_mapped").alias("k"), F.min("size").alias("least"))
    need = need.where("filled > 0") if skip_empty else need.where("filled = every")
    if cap is not None:
        need = need.where(F.col("least") <= cap)
    # The smallest set seeds the candidates, the next two narrow them, and each other set then has to hold what is left.
    ranked = wide.where("size is not null").join(need.select("a"), "a", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("size", "image"))).select("a", "image", "r")
    left = ranked.where("r = 1").select("a", "image").join(reach, "image").select("a", "cand")
    for r in range(2, NARROW + 1):
        left = left.join(ranked.where(F.col("r") == r).select("a", "image"), "a", "left").join(reach.withColumn("hit", F.lit(1)), ["image", "cand"], "left")
        left = left.where("image is null or hit = 1").select("a", "cand")
    held = left.join(ranked.where(F.col("r") > NARROW).select("a", "image"), "a").join(reach, ["image", "cand"])
    full = held.groupBy("a", "cand").agg(F.count("*").alias("n"))
    found = left.join(need, "a").join(full, ["a", "cand"], "left")
    return found.where(F.coalesce("n", F.lit(0)) == F.greatest(F.col("filled") - NARROW, F.lit(0))).select("a", "cand", "k")


#: References that are dealt at a time, and classes of B that meet in one task for one image.
LINKS, MET = 25_000_000, 20_000


def division_few(a: Project, b: Project, mapping: DataFrame, min_mapped: int, most: int, skip_empty: bool) -> DataFrame:
    """(a, cand, k): all open classes of B that refer to the images of all of the k mapped classes that an open a refers to.

    Only those a have rows for which there are at most ``most``. At least ``min_mapped`` have to be mapped. Images that no
    class refers to do not count when ``skip_empty``, else they leave no candidate. Classes meet at the image of ``a`` that
    the fewest open classes refer to, as lists of numbers, so however many these are, no pairs of them are made; an image
    of more than ``MET`` is dealt over tasks. References are dealt in parts, and each part's results are stored.
    """
    keep = stored if a.keep else settled

    def lists(p: Project) -> tuple[DataFrame, int]:
        rows = keep(p.targets())
        return rows, 1 + (rows.agg(F.sum(F.size("to"))).first()[0] or 0) // LINKS

    def in_parts(n: int, by: str, part: Callable[[Column], DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, (keep(part(F.pmod(F.xxhash64(by), F.lit(n)) == i)) for i in range(n)))

    (la, na), (lb, nb) = lists(a), lists(b)
    images = keep(mapping.select(F.col("b").alias("image")).distinct().join(lb.select(F.col("cid").alias("image")), "image", "left_semi").withColumn("id", F.monotonically_increasing_id()))
    taken = mapping.select(F.col("b").alias("cid"), F.lit(False).alias("open")).distinct()

    def reached(some: Column) -> DataFrame:
        rows = lb.where(some).select("cid", F.explode("to").alias("image")).join(images, "image").groupBy("cid").agg(F.collect_list("id").alias("ids"))
        return rows.join(taken, "cid", "left").select("cid", "ids", F.coalesce("open", F.lit(True)).alias("open"))

    lb = in_parts(nb, "cid", reached)
    size = lb.select(F.explode("ids").alias("id"), F.col("open").cast("int").alias("open")).groupBy("id").agg(F.sum("open").alias("free"))
    known = mapping.select(F.col("a").alias("x"), F.col("b").alias("image")).join(la.select(F.col("cid").alias("x")), "x", "left_semi")
    known = keep(known.join(images, "image", "left").join(size, "id", "left").select("x", "image", F.when(F.col("free").isNotNull(), F.struct("free", "id")).alias("at")))

    def asking(some: Column) -> DataFrame:
        rows = la.where(some).select(F.col("cid").alias("a"), F.explode("to").alias("x")).join(known, "x")
        rows = rows.groupBy("a").agg(F.size(F.collect_set("image")).cast("long").alias("k"), F.array_sort(F.collect_set("at")).alias("at"))
        rows = rows.where((F.col("k") >= min_mapped) & ((F.size("at") > 0) if skip_empty else (F.size("at") == F.col("k"))))
        # One image alone leaves all its open classes.
        rows = rows.withColumn("free", F.col("at")[0]["free"]).where((F.col("free") > 0) & ((F.size("at") > 1) | (F.col("free") <= most)))
        return rows.join(mapping.select("a"), "a", "left_anti").select("a", "k", F.transform("at", lambda x: x["id"]).alias("ids"), F.col("at")[0]["id"].alias("seed"))

    la = in_parts(na, "cid", asking)
    dealt = keep(size.where(F.col("free") > MET).select(F.col("id").alias("seed"), F.ceil(F.col("free") / MET).cast("int").alias("parts")))

    def met(some: Column) -> DataFrame:
        parts = F.coalesce("parts", F.lit(1))
        mine = la.where(some).join(F.broadcast(dealt), "seed", "left").select("seed", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("side"), F.col("a").alias("cid"), "k", "ids")
        theirs = lb.where("open").select("cid", "ids", F.explode("ids").alias("seed")).where(some).join(F.broadcast(dealt), "seed", "left")
        theirs = theirs.select("seed", F.pmod(F.xxhash64("cid"), parts).cast("int").alias("part"), F.lit(1).alias("side"), "cid", F.lit(0).cast("long").alias("k"), "ids")
        rows = mine.unionByName(theirs).repartition("seed", "part").sortWithinPartitions("seed", "part", "side")
        return rows.mapInArrow(lambda batches: _few_of_each(batches, most), "a string, cand string, k long")

    found = in_parts(nb, "seed", met)
    # Of an image that is dealt, each task has told at most one more than ``most``.
    return found.withColumn("n", F.count("*").over(Window.partitionBy("a"))).where(F.col("n") <= most).drop("n")


def _few_of_each(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(a, cand, k) of groups of rows (seed, part, side, cid, k, ids): the classes of side 1 that have all ids of one of
    side 0; of an a with more than ``most``, only one more than those."""
    for table in whole_groups(batches, ("seed", "part"), 50_000):
        side = table["side"].to_numpy()
        seed, part = table["seed"].to_numpy(), table["part"].to_numpy()
        group = np.concatenate([[0], np.cumsum((seed[1:] != seed[:-1]) | (part[1:] != part[:-1]))])
        asked = np.zeros(group[-1] + 1, dtype=bool)
        asked[group[side == 0]] = True
        table, side, group = table.filter(pa.array(asked[group])), side[asked[group]], group[asked[group]]
        if not len(side):
            continue
        ids = table["ids"].combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        sizes = np.diff(ids.offsets.to_numpy())
        row = np.repeat(np.arange(len(side)), sizes)
        names, code = np.unique(ids.flatten().to_numpy(), return_inverse=True)
        key = group[row] * len(names) + code
        theirs = side[row] == 1
        # The references of B by group and image, and of each the class.
        full = np.sort(key[theirs] * len(side) + row[theirs])
        start = np.searchsorted(full, key[~theirs] * len(side))
        held = np.searchsorted(full, (key[~theirs] + 1) * len(side)) - start
        mine = np.flatnonzero(side == 0)
        ends = np.concatenate([[0], np.cumsum(sizes[mine])])
        n_ids, keys = sizes[mine], key[~theirs]
        rarest = np.lexsort((held, np.repeat(np.arange(len(mine)), n_ids)))[ends[:-1]]  # of each a, where the fewest are
        count = held[rarest]
        # A group whose images all are large is told in slices of a million pairs.
        cuts = np.searchsorted(np.cumsum(count), np.arange(0, count.sum(), 1_000_000), side="left").tolist()
        cuts = sorted({0, *cuts, len(mine)})
        for lo, hi in zip(cuts, cuts[1:]):
            n = count[lo:hi]
            who = np.repeat(np.arange(lo, hi), n)
            at = np.repeat(start[rarest[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cand = full[at] % len(side)
            for j in range(int(n_ids[lo:hi].max(initial=0))):
                if not len(who):
                    break
                more = j < n_ids[who]
                want = keys[np.minimum(ends[who] + j, len(keys) - 1)] * len(side) + cand
                place = np.minimum(np.searchsorted(full, want), len(full) - 1)
                ok = ~more | (full[place] == want)
                who, cand = who[ok], cand[ok]
            order = np.arange(len(who)) - np.searchsorted(who, who)  # ``who`` is sorted
            who, cand = who[order <= most], cand[order <= most]
            if len(who):
                cids, k = table["cid"].combine_chunks(), table["k"].combine_chunks()
                yield pa.RecordBatch.from_arrays([cids.take(pa.array(mine[who])), cids.take(pa.array(cand)), k.take(pa.array(mine[who]))], ["a", "cand", "k"])


def contents(p: Project, name: str, *more: str) -> DataFrame:
    """(name, ``more``, r_name): what content scores compare of each class."""
    strings = F.array_distinct(F.filter("strings", lambda s: F.length(s) >= 4))
    return p.classes.select(F.col("cid").alias(name), *more, F.struct("mods", "nm", "nf", strings.alias("strs"), p.body_refs().alias("refs"), F.coalesce("super", F.lit("")).alias("super")).alias(f"r_{name}"))


def with_super(left: DataFrame, a: Project, mapping: DataFrame) -> DataFrame:
    """Contents of side a and, as ``_super``, the image of the super, or itself where it has none or keeps its name."""
    images = mapping.select(F.col("a").alias("_s"), F.col("b").alias("_to"))
    left = left.join(images, F.col("r_a.super") == F.col("_s"), "left")
    return left.withColumn("_super", F.when(a.obfuscated("r_a.super"), F.coalesce("_to", "r_a.super")).otherwise(F.col("r_a.super"))).drop("_s", "_to")


#: Modifiers that count in a content score.
SCORED = ("interface", "enum", "annotation", "abstract", "final")


def content_score(pairs: DataFrame, a: Project, b: Project, mapping: DataFrame) -> DataFrame:
    """(a, b, score) of pairs (a, b): agreement of shape, strings, stable references and super, from 0 to 1."""
    left = with_super(contents(a, "a"), a, mapping)
    rows = pairs.select("a", "b").distinct().join(left, "a").join(contents(b, "b"), "b")
    flag = lambda kind: F.when(F.array_contains("r_a.mods", kind) == F.array_contains("r_b.mods", kind), 0.5).otherwise(0.0)
    score = sum((flag(k) for k in SCORED), F.lit(0.0))
    score = score + (F.col("r_a.nm") == F.col("r_b.nm")).cast("double") + (F.col("r_a.nf") == F.col("r_b.nf")).cast("double")
    weight = F.lit(2.5 + 1 + 1 + 1.5)
    for what, w in (("strs", 3.0), ("refs", 2.0)):
        union = F.size(F.array_union(f"r_a.{what}", f"r_b.{what}"))
        both = F.size(F.array_intersect(f"r_a.{what}", f"r_b.{what}"))
        score = score + F.when(union > 0, w * both / union).otherwise(0.0)
        weight = weight + F.when(union > 0, w).otherwise(0.0)
    score = score + F.when(F.col("_super") == F.col("r_b.super"), 1.5).otherwise(0.0)
    return rows.select("a", "b", (score / weight).alias("score"))


def best_scores(scored: DataFrame, least: float, margin: float) -> DataFrame:
    """Per a the best of at least two scored b, if it reaches ``least`` and leads by ``margin``: (a, b, score, lead)."""
    by = Window.partitionBy("a").orderBy(F.desc("score"), F.desc("b"))
    ranked = scored.withColumn("rank", F.row_number().over(by)).withColumn("lead", F.col("score") - F.lead("score", 1).over(by))
    return ranked.where((F.col("rank") == 1) & F.col("lead").isNotNull() & (F.col("score") >= least) & (F.col("lead") >= margin)).select("a", "b", "score", "lead")


#: Classes of A that meet a folder's classes of B in one task.
FOLDER = 5000


def best_of_folders(a: DataFrame, b: DataFrame, least: float, margin: float) -> DataFrame:
    """``best_scores`` of the ``content_score`` of all pairs of one folder, without a row for each pair: (a, b, lead).

    ``a`` is (a, folder, r_a, _super) and ``b`` is (b, folder, r_b). A folder's classes of A are dealt over tasks, each of
    which has all of its classes of B and scores one class of A against them at a time.
    """
    parts = a.groupBy("folder").agg(F.ceil(F.count("*") / FOLDER).cast("int").alias("parts"))

    def side(rows: DataFrame, name: str, part: Column, sup: Column) -> DataFrame:
        r = F.col(f"r_{name}")
        # A flag that is not known equals none.
        flags = F.array(*(F.coalesce(F.array_contains(r["mods"], k).cast("int"), F.lit(2 if name == "a" else 3)) for k in SCORED))
        return rows.join(parts, "folder").select("folder", part.alias("part"), F.lit(int(name == "b")).alias("side"), F.col(name).alias("cid"), F.concat(flags, F.array(r["nm"], r["nf"])).alias("shape"), r["strs"].alias("strs"), r["refs"].alias("refs"), sup.alias("super"))

    mine = side(a, "a", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"), F.col("_super"))
    theirs = side(b, "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), F.col("r_b.super"))
    rows = mine.unionByName(theirs).repartition("folder", "part").sortWithinPartitions("folder", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ("folder", "part")):
            found = best_of_folder(group, least, margin)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.float64()), strict=True)], ["a", "b", "lead"])

    return rows.mapInArrow(run, "a string, b string, lead double")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 1) -> Iterator[pa.Table]:
    """The runs of rows with equal ``keys``, as many together as have ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        change = np.zeros(last, dtype=bool)
        for key in keys:
            change |= pc.not_equal(batch.column(key).slice(1), batch.column(key).slice(0, last)).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for at, end in zip(starts, starts[1:]):
            piece = batch.slice(at, end - at)
            if n >= rows and any(held[-1].column(key)[-1] != piece.column(key)[0] for key in keys):
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(piece)
            n += piece.num_rows
    if held:
        yield pa.Table.from_batches(held)


def best_of_folder(group: pa.Table, least: float, margin: float) -> list[tuple[str, str, float]]:
    """(a, b, lead) of one folder's rows, those of A first; sums in the order of ``content_score``."""
    n = int((group["side"].to_numpy() == 0).sum())
    m = group.num_rows - n
    if not n or m < 2:
        return []
    cids = group["cid"].to_pylist()
    shape = np.array(group["shape"].to_pylist(), dtype=np.int64)
    sup = group["super"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)

    def postings(column: str) -> tuple:
        """Each class's tokens, their number, and the classes of B that have each token."""
        lists = group[column].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(n + m), np.diff(ends))
        there = codes[ends[n]:]
        order = np.argsort(there, kind="stable")
        return codes, ends, owner[ends[n]:][order] - n, np.searchsorted(there[order], np.arange(int(codes.max(initial=-1)) + 2))

    tokens = [(postings("strs"), 3.0), (postings("refs"), 2.0)]
    bases: dict[tuple, np.ndarray] = {}
    found = []
    for i in range(n):
        key = tuple(shape[i])
        if key not in bases:
            base = np.zeros(m)
            for k in range(shape.shape[1]):
                base = base + np.where(shape[n:, k] == shape[i, k], 0.5 if k < len(SCORED) else 1.0, 0.0)
            bases[key] = base
        score, weight = bases[key], np.full(m, 2.5 + 1 + 1 + 1.5)
        for (codes, ends, owners, starts), w in tokens:
            mine = codes[ends[i]:ends[i + 1]]
            both = np.bincount(np.concatenate([owners[starts[c]:starts[c + 1]] for c in mine]), minlength=m) if len(mine) else np.zeros(m, dtype=np.int64)
            union = len(mine) + np.diff(ends[n:]) - both
            score = score + np.where(union > 0, w * both / np.maximum(union, 1), 0.0)
            weight = weight + np.where(union > 0, w, 0.0)
        score = (score + np.where(sup[n:] == sup[i], 1.5, 0.0)) / weight
        best = np.flatnonzero(score == score.max())
        if score[best[0]] < least:
            continue
        b = max(best.tolist(), key=lambda j: cids[n + j])
        lead = float(score[b] - (score[b] if len(best) > 1 else np.delete(score, b).max()))
        if lead >= margin:
            found.append((cids[i], cids[n + b], lead))
    return found
