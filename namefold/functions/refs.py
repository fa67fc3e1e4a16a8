"""Column functions over class names, signatures and string literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every capital L opens a reference up to the next semicolon; without one it runs to the end.
SIGNATURE_TOKENS = r"(L[^;]*;|L[^;]*$|[^L]+)"
#: The same with one token for each character that takes a position.
POSITION_TOKENS = r"(L[^;]*;|L[^;]*$|[^(\[])"
#: Top-level packages whose dotted names are kept in literals, and source file endings.
DOTTED_NAME = r"\b((?:com|org|net|io|androidx|kotlin|java|javax)\.[a-zA-Z][\w.$]*[\w$])(?=\s*\()"
SOURCE_FILE = r"^(.*\.(?:kt|java|scala))$"


def tokens(signature: Column) -> Column:
    return F.regexp_extract_all(signature, F.lit(SIGNATURE_TOKENS), F.lit(1))


def references(signature: Column, prefix: str) -> Column:
    """Closed references of a signature that begin with ``prefix``, in order."""
    return F.filter(tokens(signature), lambda t: t.startswith(prefix) & t.endswith(";"))


def positions(signature: Column, prefix: str) -> Column:
    """(pos, ref) of the obfuscated references; an unclosed reference ends the walk and brackets take no place."""
    all_tokens = F.regexp_extract_all(signature, F.lit(POSITION_TOKENS), F.lit(1))
    placed = F.transform(all_tokens, lambda t, i: F.struct(i.alias("pos"), t.alias("ref")))
    return F.filter(placed, lambda x: x["ref"].startswith(prefix) & x["ref"].endswith(";"))


def sorted_set(array: Column) -> Column:
    return F.sort_array(F.array_distinct(array))


def long_strings(array: Column, least: int) -> Column:
    return F.filter(array, lambda s: F.length(s) >= least)


def dotted_names(strings: Column) -> Column:
    """Distinct dotted class names before a bracket in any literal, sorted."""
    found = F.transform(strings, lambda s: F.regexp_extract_all(s, F.lit("(?U)" + DOTTED_NAME), F.lit(1)))
    return sorted_set(F.flatten(found))


def source_files(strings: Column) -> Column:
    """Distinct source files in the last bracket of any literal, without the line number, sorted."""
    inner = F.transform(strings, lambda s: F.regexp_replace(F.regexp_extract(s, r"(?s)^.*\(([^)]*)\)", 1), r":\d+$", ""))
    return sorted_set(F.filter(inner, lambda x: x.rlike(SOURCE_FILE)))


def name_like(strings: Column) -> Column:
    """Distinct strings that may name an enum constant, sorted."""
    return sorted_set(F.filter(strings, lambda s: (F.length(s) >= 2) & ~s.rlike("[ /\\\\.%\"\\n\\t,:?]")))


def resolved(df: DataFrame, keys: list[str], mapping: DataFrame, prefix: str, **arrays: Column) -> DataFrame:
    """``keys`` and, for each named array of references, an array of (ref, to) in its order.

    ``to`` is the image of an obfuscated reference, null if it has none, and the reference itself if it is
    not obfuscated. The mapping meets the exploded references in one join, which broadcasts it when small.
    """
    def tagged(name: str, array: Column) -> Column:
        return F.transform(array, lambda x, i: F.struct(F.lit(name).alias("kind"), i.alias("pos"), x.alias("ref")))

    def untagged(name: str) -> Column:
        return F.transform(F.filter("_all", lambda x: x["kind"] == name), lambda x: F.struct(x["ref"].alias("ref"), x["to"].alias("to"))).alias(name)

    items = [tagged(name, array) for name, array in arrays.items()]
    items = [F.coalesce(x, F.array().cast("array<struct<kind:string,pos:int,ref:string>>")) for x in items]
    rows = df.select(*keys, F.explode_outer(F.concat(*items)).alias("_x")).select(*keys, "_x.kind", "_x.pos", "_x.ref")
    images = mapping.select(F.col("a").alias("ref"), F.col("b").alias("_b"))
    rows = rows.join(images, "ref", "left").withColumn("to", F.when(F.col("ref").startswith(prefix), F.col("_b")).otherwise(F.col("ref")))
    back = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("kind", "pos", "ref", "to"))).alias("_all"))
    made = [untagged(name) for name in arrays]
    return back.select(*keys, *made)


def kept(pairs: Column) -> Column:
    """Images where there are any, else the references as they are."""
    return F.transform(pairs, lambda x: F.coalesce(x["to"], x["ref"]))


def substituted(signatures: DataFrame, mapping: DataFrame, prefix: str) -> DataFrame:
    """Of distinct signatures (sig): ``keep`` with unresolved references as they are, ``marked`` with them as the
    unknown reference, and how many obfuscated and unresolved ones there are."""
    parts = resolved(signatures.select("sig").distinct(), ["sig"], mapping, prefix, t=tokens(F.col("sig")))
    unknown = F.lit(f"{prefix}?;")
    closed = lambda x: x["ref"].startswith(prefix) & x["ref"].endswith(";")
    return parts.select(
        "sig",
        F.array_join(kept(F.col("t")), "").alias("keep"),
        F.array_join(F.transform("t", lambda x: F.when(closed(x) & x["to"].isNull(), unknown).otherwise(F.coalesce(x["to"], x["ref"]))), "").alias("marked"),
        F.size(F.filter("t", closed)).alias("n_obf"),
        F.size(F.filter("t", lambda x: closed(x) & x["to"].isNull())).alias("n_open"),
    )
