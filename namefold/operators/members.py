"""Methods and fields of matched classes, paired."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namefold.functions import refs
from namefold.operators.project import Project
from namefold.plans.storage import settled, stored


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of the least total cost (shortest augmenting paths with potentials)."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, col, least = start, -1, 0.0
        while True:
            step = least + c[row] - u[row] - v
            better = ~done & (step < reach)
            reach[better], via[better] = step[better], col
            col = int(np.argmin(np.where(done, np.inf, reach)))
            least = reach[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        u[start] += least
        inner = done.copy()
        inner[col] = False
        u[row_of[inner]] += least - reach[inner]
        v[inner] -= least - reach[inner]
        while col >= 0:
            before = via[col]
            row_of[col] = start if before < 0 else row_of[before]
            col = before
    return [(int(j), int(r)) if turned else (int(r), int(j)) for j, r in enumerate(row_of) if r >= 0]


def _methods(p: Project, side: str) -> DataFrame:
    fields = [c for c in p.methods.columns if c not in ("cid", "midx")]
    return p.methods.select(F.col("cid").alias(side), F.col("midx").alias(f"i{side}"), F.struct(*fields).alias(f"m{side}"))


def _lists(p: Project, side: str, field: str) -> DataFrame:
    """(side, x<side>): a class's methods in order, with no more than their signature, body hash and ``field``."""
    return p.classes.where(F.size("methods") > 0).select(F.col("cid").alias(side), F.transform("methods", lambda m: F.struct(m["sig"].alias("sig"), m["bha"].alias("bha"), m[field].alias(field))).alias(f"x{side}"))


def _rest(hits: Column, sigs: Column) -> Column:
    """(ia, ib) of the methods of ``xa`` that no signature took and those of ``xb``, in order within a body hash."""
    some = lambda x: F.coalesce(x["bha"] != "", F.lit(False))
    rest_a = F.filter(F.transform("xa", lambda x, i: F.struct(i.alias("ia"), x["bha"].alias("bha"), some(x).alias("some"))), lambda x: x["some"] & F.get(hits, x["ia"]).isNull())
    taken = lambda x: F.coalesce(F.array_contains(hits, x["sig"]) & (x["ib"] == F.size("xb") - F.array_position(sigs, x["sig"])), F.lit(False))
    rest_b = F.filter(F.transform("xb", lambda x, i: F.struct(i.alias("ib"), x["bha"].alias("bha"), x["sig"].alias("sig"), some(x).alias("some"))), lambda x: x["some"] & ~taken(x))
    before = lambda x, i: F.size(F.filter(F.slice(rest_a, F.lit(1), i), lambda y: y["bha"] == x["bha"]))
    return F.transform(rest_a, lambda x, i: F.struct(x["ia"].alias("ia"), F.get(F.filter(rest_b, lambda y: y["bha"] == x["bha"]), before(x, i))["ib"].alias("ib")))


#: Pairs of classes that meet at a time.
PART = 1_000_000


def paired_by_signature(a: Project, b: Project, mapping: DataFrame, body_hash: bool, field: str) -> Iterator[DataFrame]:
    """Parts of (a, b, ia, ib, x, y): each method of a meets the last one of b with its substituted signature, else with its own,
    else (``body_hash``) in order those with its body hash that no signature took. x and y are their values of ``field``.

    Whole lists of methods meet, so a class moves once to its pair and once to its partner; what is shuffled for the
    first is off the disk before the second. A part has the pairs of some b, about ``PART`` of them; who sums a part up
    before the next one keeps the disk's load to one part's.
    """
    met = found = settled(mapping.select("a", "b").join(_lists(a, "a", field), "a"))
    # Signatures without an obfuscated reference stay as they are; the others bring what replaces them to their class.
    named = met.select("a", F.explode(F.array_distinct(F.filter(F.transform("xa", lambda x: x["sig"]), lambda s: s.contains(a.prefix)))).alias("sig")).distinct()
    if named.isEmpty():
        met = met.withColumn("images", F.lit(None).cast("map<string,string>"))
    else:
        images = named.join(refs.substituted(named.select("sig"), mapping, a.prefix).select("sig", "keep"), "sig").groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("sig", "keep"))).alias("images"))
        met = met.join(images, "a", "left")
    n = 1 + found.count() // PART
    for i in range(n):
        some = lambda df: df.where(F.pmod(F.xxhash64("b"), F.lit(n)) == i)  # noqa: E731, B023
        yield _met(some(met).join(some(_lists(b, "b", field)), "b"), body_hash, field)


def _met(met: DataFrame, body_hash: bool, field: str) -> DataFrame:
    """(a, b, ia, ib, x, y) of rows (a, b, xa, images, xb)."""
    met = met.withColumn("sigs", F.reverse(F.transform("xb", lambda x: x["sig"])))
    keep = lambda x: F.coalesce(F.get(F.map_values("images"), F.array_position(F.map_keys("images"), x["sig"]).cast("int") - 1), x["sig"])
    among = lambda s: F.coalesce(F.array_contains("sigs", s), F.lit(False))
    met = met.withColumn("hits", F.transform("xa", lambda x: F.when(among(keep(x)), keep(x)).when(among(x["sig"]), x["sig"])))
    if body_hash:
        lost = F.exists(F.arrays_zip(F.col("xa").alias("x"), F.col("hits").alias("h")), lambda z: z["h"].isNull() & F.coalesce(z["x"]["bha"] != "", F.lit(False)))
        met = met.withColumn("rest", F.when(lost, _rest(F.col("hits"), F.col("sigs"))))
    rows = met.select("a", "b", "xb", "sigs", *(["rest"] if body_hash else []), F.posexplode(F.arrays_zip(F.col("xa").alias("m"), F.col("hits").alias("hit"))).alias("ia", "z"))
    at = F.when(F.col("z.hit").isNotNull(), F.size("xb") - F.array_position("sigs", F.col("z.hit")).cast("int"))
    if body_hash:
        at = F.coalesce(at, F.get(F.filter("rest", lambda r: r["ia"] == F.col("ia")), F.lit(0))["ib"])
    rows = rows.withColumn("ib", at).where("ib is not null")
    return rows.select("a", "b", "ia", "ib", F.col(f"z.m.{field}").alias("x"), F.get("xb", F.col("ib"))[field].alias("y"))


def _share(x: Column, y: Column) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def similarity(body: float) -> Column:
    """Of methods ma and mb: calls, accesses and branches, and ``body`` for an equal body hash."""
    gap = F.abs(F.col("ma.br") - F.col("mb.br")) / F.greatest(F.lit(1), F.col("ma.br"), F.col("mb.br"))
    same = F.when((F.col("ma.bha") == F.col("mb.bha")) & (F.col("ma.bha") != ""), body).otherwise(0.0)
    return 0.5 * _share(F.col("ma.calls"), F.col("mb.calls")) + 0.3 * _share(F.col("ma.facc"), F.col("mb.facc")) + 0.2 * (1 - gap) + same


def paired_methods(a: Project, b: Project, mapping: DataFrame, least: float, most: int, body: float, greedy: bool = True) -> DataFrame:
    """(a, b, ia, ib, ma, mb, sim): methods of equal substituted signature in order of appearance, then the
    assignment of the greatest similarity over the rest, from ``least`` on.

    Where more than ``most`` pairs are possible each method takes the best one left (``greedy``), or none.
    """
    # Signatures and places alone decide what is exact, so only they are sorted and stored; the methods themselves come to their places.
    signed = lambda p, side: p.methods.select(F.col("cid").alias(side), F.col("midx").alias(f"i{side}"), "sig")
    kth = lambda side: F.row_number().over(Window.partitionBy(side, "keep").orderBy(f"i{side}"))
    left = stored(mapping.select("a", "b").join(signed(a, "a"), "a"))
    left = left.join(refs.substituted(left.select("sig"), mapping, a.prefix).select("sig", "keep"), "sig")
    left = settled(left.select("a", "b", "ia", "keep", kth("a").alias("k")))
    right = mapping.select("b").join(signed(b, "b"), "b").withColumnRenamed("sig", "keep")
    right = settled(right.select("b", "ib", "keep", kth("b").alias("k")))
    found = exact = settled(left.join(right, ["b", "keep", "k"]).select("a", "b", "ia", "ib", F.lit(1.0).alias("sim")))
    rest_a = stored(left.select("a", "b", "ia").join(exact.select("a", "ia"), ["a", "ia"], "left_anti"))
    rest_b = stored(right.select("b", "ib").join(exact.select("b", "ib"), ["b", "ib"], "left_anti"))

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.unique(group["ia"]), np.unique(group["ib"])
        sim = np.zeros((len(rows), len(cols)))
        sim[np.searchsorted(rows, group["ia"]), np.searchsorted(cols, group["ib"])] = group["sim"]
        if sim.size > most:
            chosen, free = [], np.ones(len(cols), dtype=bool)
            for i in range(len(rows) if greedy else 0):
                best = np.where(free, sim[i], -1.0)
                j = int(np.argmax(best))
                if best[j] > 0:
                    chosen.append((i, j))
                    free[j] = best[j] < least
        else:
            chosen = assignment(1.0 - sim)
        kept = [(i, j) for i, j in chosen if sim[i, j] >= least - 1e-12]
        return pd.DataFrame({"a": group["a"].iloc[0], "b": group["b"].iloc[0], "ia": [int(rows[i]) for i, _ in kept], "ib": [int(cols[j]) for _, j in kept], "sim": [float(sim[i, j]) for i, j in kept]})

    if not rest_a.isEmpty() and not rest_b.isEmpty():
        open_pairs = rest_a.join(_methods(a, "a"), ["a", "ia"]).join(rest_b.join(_methods(b, "b"), ["b", "ib"]), "b").select("a", "b", "ia", "ib", similarity(body).alias("sim"))
        found = found.unionByName(stored(open_pairs.groupBy("a", "b").applyInPandas(assign, "a string, b string, ia int, ib int, sim double")))
    return found.join(_methods(a, "a"), ["a", "ia"]).join(_methods(b, "b"), ["b", "ib"]).select("a", "b", "ia", "ib", "ma", "mb", "sim")


def method_mapping(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
    """(a_class, b_class, a, b, sim), the similarity rounded half to even at two digits."""
    rows = paired_methods(a, b, mapping, least=0.3, most=20_000, body=0.1, greedy=False)
    return rows.select(F.col("a").alias("a_class"), F.col("b").alias("b_class"), F.col("ma.sig").alias("a"), F.col("mb.sig").alias("b"), F.bround("sim", 2).alias("sim"))


def field_mapping(a: Project, b: Project, mapping: DataFrame) -> DataFrame:
    """(a_class, b_class, a_idx, b_idx, a_type, b_type): fields of equal substituted type, the same place first."""
    left = mapping.select("a", "b").join(a.classes.select(F.col("cid").alias("a"), F.posexplode("field_types").alias("i", "sig")), "a")
    left = left.join(refs.substituted(left.select("sig"), mapping, a.prefix).select("sig", "keep"), "sig")
    left = left.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("i", "sig", "keep"))).alias("x"))
    rows = left.join(b.classes.select(F.col("cid").alias("b"), F.col("field_types").alias("y")), "b").select("a", "b", F.transform("x", lambda t: t["sig"]).alias("own"), F.transform("x", lambda t: t["keep"]).alias("keep"), "y")

    def pair(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                places: dict[str, deque[int]] = {}
                for j, t in enumerate(row.y):
                    places.setdefault(t, deque()).append(j)
                free = np.ones(len(row.y), dtype=bool)
                for i, t in enumerate(row.keep):
                    left = places.get(t, ())
                    while left and not free[left[0]]:
                        left.popleft()
                    if left:
                        j = i if i < len(free) and free[i] and row.y[i] == t else left[0]
                        free[j] = False
                        out.append((row.a, row.b, i, j, row.own[i], row.y[j]))
            yield pd.DataFrame(out, columns=["a_class", "b_class", "a_idx", "b_idx", "a_type", "b_type"])

    return rows.mapInPandas(pair, "a_class string, b_class string, a_idx int, b_idx int, a_type string, b_type string")
