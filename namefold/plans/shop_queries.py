"""Content matchers over the orders as unobfuscated classes of two builds, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namefold.operators import content, structure
from namefold.operators.content import Matcher
from namefold.plans.adapters import shop
from namefold.plans.registry import TOP, Query, register, rounded

_SHOP = """WITH l AS (
        SELECT o_orderkey AS k, any_value(o_custkey) AS c, any_value(o_orderpriority) AS pr,
               list({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'f': l_returnflag} ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS xs
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
    base0 AS (
        SELECT 0 AS side, 'LX/a' || k || ';' AS cid, k, c, pr, xs FROM l
        UNION ALL SELECT 1, 'LX/b' || k || ';', k, c, pr, CASE WHEN k % 5 = 0 THEN xs[2:] ELSE xs END FROM l),
    base AS (
        SELECT *, k % 3 = 0 AS enum, len(xs) AS nm, list_sort(list_distinct(list_concat(
            list_transform(xs, lambda x: 'com.shop.P' || (x.p % 500) || ' (P' || (x.p % 500) || '.kt:' || x.n || ')'),
            list_transform(xs, lambda x: 'NAME' || (x.s % 60) || 'x' || (x.n % 2))))) AS ss
        FROM base0)"""


def _set(element: str) -> str:
    """Sorted distinct values of an expression over a line x."""
    return f"list_sort(list_distinct(list_transform(xs, lambda x: {element})))"


def _text(*parts: str) -> str:
    return " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)


def _bucket_sql(key: str, when: str, base: float, spec: str, ceiling: float = 0.95) -> str:
    na = {"both": "p.n", "b": "1"}.get(spec)
    conf = str(base) if na is None else f"round(CASE WHEN {na} * q.n <= 1 THEN {min(base, ceiling)} ELSE greatest({base} / sqrt({na} * q.n), 0.4) END, 6)"
    return _SHOP + f""",
    k AS (SELECT side, cid, {key} AS key FROM base WHERE {when}),
    z AS (SELECT side, key, count(*) AS n FROM k GROUP BY ALL)
    SELECT x.cid AS a, y.cid AS b, {conf} AS confidence
    FROM k x JOIN k y ON x.key = y.key AND x.side = 0 AND y.side = 1 JOIN z p ON p.key = x.key AND p.side = 0 JOIN z q ON q.key = x.key AND q.side = 1"""


_ALL = {m.id: m for m in content.content_matchers() + content.optional_content_matchers()}


def _on_shop(matcher: Matcher, flat: bool = False) -> Query:
    return lambda spark, sf_dir: rounded(matcher.candidates(*shop(spark, sf_dir, flat)))


#: Classes that share a string also share a call here, so each pair counts in full.
register("long_unique_string", _on_shop(_ALL["long_unique_string"]), _SHOP + """,
    t AS (SELECT side, cid, unnest(ss) AS s FROM base),
    u AS (SELECT side, s, min(cid) AS cid FROM t WHERE length(s) >= 20 GROUP BY side, s HAVING count(*) = 1)
    SELECT DISTINCT x.cid AS a, y.cid AS b, 0.95 AS confidence FROM u x JOIN u y ON x.s = y.s AND x.side = 0 AND y.side = 1""")
_PARTS, _SUPPLIERS = _set("x.p % 500"), _set("x.s % 13")
_REFS = _text("c", _PARTS, _SUPPLIERS, "left(pr, 1)")
for _name, _sql in {
    "native_syms": _bucket_sql(_text(_PARTS), "k % 2 = 0 AND nm > 0", 0.95, "none"),
    "deobf_fqn": _bucket_sql(_text(_PARTS), "nm > 0", 0.95, "b", 0.97),
    "strings_plus_refs": _bucket_sql(_text("ss", _REFS), "true", 0.8, "none"),
    "stable_refs_ms": _bucket_sql(_REFS, "nm > 0", 0.7, "none"),
    "call_targets_ms": _bucket_sql(_text(_set(_text("x.p % 500", "x.n"))), f"len({_set(_text('x.p % 500', 'x.n'))}) >= 4", 0.9, "both"),
    "field_targets_ms": _bucket_sql(_text(_set(_text("x.s % 13", "x.n % 3"))), f"len({_set(_text('x.s % 13', 'x.n % 3'))}) >= 3", 0.85, "both"),
    "field_access_by_type_ms": _bucket_sql(_text(_set(_text("x.s % 13", "x.f"))), f"len({_set(_text('x.s % 13', 'x.f'))}) >= 3", 0.85, "both"),
    "enum_value_names": _bucket_sql(_text(_set(_text("x.s % 60", "x.n % 2"))), f"enum AND len({_set(_text('x.s % 60', 'x.n % 2'))}) >= 2", 0.95, "both", 0.97),
    "source_file_fp": _bucket_sql(_text(_PARTS, "c", "nm", "enum"), "nm > 0", 0.92, "both"),
    "line_refs_ms": _bucket_sql(_text(_set(_text("x.p % 500", "x.n"))), f"len({_set(_text('x.p % 500', 'x.n'))}) >= 4", 0.92, "both"),
    "corroborating_shape": _bucket_sql(_text("c", "nm", "enum"), "true", 0.55, "both"),
    "annotation_values": _bucket_sql(_text(_PARTS), f"len({_PARTS}) >= 2", 0.93, "both"),
    "kotlin_debug_metadata": _bucket_sql(_text("c", "pr"), "k % 4 = 1", 0.97, "b", 0.97),
}.items():
    register(_name, _on_shop(_ALL[_name]), _sql)


def _assigned_sql(least: int, count: int, chars: int, conf: float) -> str:
    """Within a bucket classes of one kind are at distance -8 with an equal super and at 0 without."""
    pick = f"list_filter(ss, lambda t: length(t) >= {least})"
    return _SHOP + f""",
    k AS (SELECT side, cid, {pick} AS key, enum AS kind, c % 50 AS sup FROM base WHERE len({pick}) >= {count} AND list_sum(list_transform({pick}, lambda t: length(t))) >= {chars}),
    r1 AS (SELECT *, row_number() OVER (PARTITION BY side, key, kind, sup ORDER BY cid) AS r FROM k),
    m1 AS (SELECT x.cid AS a, y.cid AS b FROM r1 x JOIN r1 y ON x.key = y.key AND x.kind = y.kind AND x.sup = y.sup AND x.r = y.r WHERE x.side = 0 AND y.side = 1),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY side, key, kind ORDER BY cid) AS r FROM k WHERE cid NOT IN (SELECT a FROM m1) AND cid NOT IN (SELECT b FROM m1)),
    m2 AS (SELECT x.cid AS a, y.cid AS b FROM r2 x JOIN r2 y ON x.key = y.key AND x.kind = y.kind AND x.r = y.r WHERE x.side = 0 AND y.side = 1)
    SELECT a, b, {conf} AS confidence FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2)"""


register("identical_strings", _on_shop(_ALL["identical_strings"], flat=True), _assigned_sql(4, 3, 30, 0.97))
register("string_pair", _on_shop(_ALL["string_pair"], flat=True), _assigned_sql(8, 2, 0, 0.85))
register("stringset_hash", _on_shop(_ALL["stringset_hash"], flat=True), _assigned_sql(4, 2, 0, 0.65))
register("enum_values_jaccard", _on_shop(_ALL["enum_values_jaccard"]), _SHOP + f""",
    t AS (SELECT side, cid, unnest({_set(_text('x.s % 60', 'x.n % 2'))}) AS s FROM base WHERE enum),
    big AS (SELECT cid, count(*) AS n FROM t GROUP BY cid HAVING count(*) >= 2),
    o AS (SELECT x.cid AS a, y.cid AS b, count(*) AS n FROM t x JOIN t y ON x.s = y.s AND x.side = 0 AND y.side = 1 GROUP BY ALL)
    SELECT a, b, round(0.6 + 0.32 * (o.n / (x.n + y.n - o.n) - 0.7) / (1 - 0.7), 6) AS confidence
    FROM o JOIN big x ON x.cid = a JOIN big y ON y.cid = b WHERE o.n >= 2 AND o.n / (x.n + y.n - o.n) >= 0.7""")
register("per_method_callset", _on_shop(_ALL["per_method_callset"]), _SHOP + f""",
    t AS (SELECT side, cid, unnest(list_transform(xs, lambda x: {_text('x.p % 500', 'x.s % 13', 'x.n', 'x.p % 3', 'x.s % 4')})) AS key FROM base),
    lone AS (SELECT key, min(cid) AS b FROM (SELECT DISTINCT cid, key FROM t WHERE side = 1) GROUP BY key HAVING count(*) = 1),
    votes AS (SELECT cid AS a, b, count(*) AS v FROM t JOIN lone USING (key) WHERE side = 0 GROUP BY ALL),
    {TOP}
    SELECT a, b, round(least(0.7 + 0.05 * v, 0.92), 6) AS confidence FROM v2 WHERE r = 1 AND v >= 2 AND v - second >= 1""")

# Content scores.

_SCORE = """(0.5 + 0.5 * (x.enum = y.enum)::INT + 0.5 + 0.5 + 0.5 * (x.enum = y.enum)::INT + 2.0 * (x.nm = y.nm)::INT
        + CASE WHEN len(list_concat(x.ss, y.ss)) > 0 THEN 3.0 * len(list_intersect(x.ss, y.ss)) / len(list_distinct(list_concat(x.ss, y.ss))) ELSE 0 END
        + 2.0 * len(list_intersect(x.rs, y.rs)) / len(list_distinct(list_concat(x.rs, y.rs))) + 1.5 * (x.c = y.c)::INT)
        / (8.0 + CASE WHEN len(list_concat(x.ss, y.ss)) > 0 THEN 3.0 ELSE 0 END)"""


def bucket_disambig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customers share a folder; three of four are mapped."""
    a, b = shop(spark, sf_dir)
    k = F.regexp_extract("cid", "([0-9]+)", 1)
    mapping = a.classes.where(k.cast("long") % 4 != 0).select(F.col("cid").alias("a"), F.concat(F.lit("LX/b"), k, F.lit(";")).alias("b"))
    return rounded(Matcher("bucket_disambig", 3, structure.bucket_best()).candidates(a, b, mapping))


register("bucket_disambig", bucket_disambig, _SHOP + f""",
    left4 AS (SELECT *, list_distinct(list_concat({_set("'p' || (x.p % 500)")}, {_set("'s' || (x.s % 13)")}, ['t' || left(pr, 1)])) AS rs, c % 300 AS folder FROM base WHERE k % 4 = 0),
    known AS (SELECT DISTINCT c % 300 AS folder FROM base WHERE k % 4 <> 0),
    full4 AS (SELECT folder, count(*) AS n FROM left4 JOIN known USING (folder) WHERE side = 1 GROUP BY folder HAVING count(*) >= 2),
    scored AS (SELECT x.cid AS a, y.cid AS b, {_SCORE} AS score FROM left4 x JOIN full4 USING (folder) JOIN left4 y USING (folder) WHERE x.side = 0 AND y.side = 1),
    best AS (SELECT *, row_number() OVER w AS r, score - lead(score) OVER w AS ahead FROM scored WINDOW w AS (PARTITION BY a ORDER BY score DESC, b DESC))
    SELECT a, b, round(0.6 + ahead, 6) AS confidence FROM best WHERE r = 1 AND score >= 0.75 AND ahead >= 0.18""")
