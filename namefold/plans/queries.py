"""Operators of the matching engine over the driver's tables, each with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namefold.operators import content, harness, members, structure
from namefold.operators import validators as V
from namefold.operators.commit import State, churn, commit
from namefold.operators.content import Matcher
from namefold.operators.project import Project
from namefold.plans import shop_queries, source_queries  # noqa: F401  (they register their queries)
from namefold.plans.adapters import SOURCES, Graph, conversations, docs, graph, lambdas
from namefold.plans.engine import Engine
from namefold.plans.registry import ORACLE_SQL, QUERIES, TOP, Query, register, rounded

__all__ = ["ORACLE_SQL", "QUERIES"]


def _ref(kind: str, key: str, side: str) -> str:
    return f"'LX/{kind}' || {key} || ';'" if side == "a" else f"'LX/{kind}' || (({key} * 7919 + 13) % (SELECT {kind} FROM n)) || ';'"


def _edges(side: str) -> str:
    r = lambda k, c: _ref(k, c, side)
    return f"""e{side} AS (
        SELECT {r('o', 'o_orderkey')} AS src, {r('c', 'o_custkey')} AS dst, 'extends' AS kind, 4 AS w FROM orders
        UNION SELECT {r('c', 'c_custkey')}, 'Lnation/' || c_nationkey || ';', 'extends', 4 FROM customer
        UNION SELECT {r('s', 's_suppkey')}, 'Lnation/' || s_nationkey || ';', 'implements', 4 FROM supplier
        UNION SELECT {r('o', 'l_orderkey')}, {r('p', 'l_partkey')}, 'call', 1 FROM lineitem
        UNION SELECT {r('o', 'l_orderkey')}, {r('s', 'l_suppkey')}, 'field_access', 2 FROM lineitem),
    l{side} AS (SELECT DISTINCT src, dst FROM e{side})"""


def _mapped(kinds: str, nations: bool = True, drop: int = 4) -> str:
    parts = [f"SELECT {_ref(k, c, 'a')} AS a, {_ref(k, c, 'b')} AS b FROM {t} WHERE {c} % {drop} <> 0" for k in kinds for t, c in [SOURCES[k]]]
    if nations:
        parts.append("SELECT 'Lnation/' || n_nationkey || ';', 'Lnation/' || n_nationkey || ';' FROM nation")
    return "m AS (" + " UNION ALL ".join(parts) + ")"


def _lines(side: str) -> str:
    """Per order its lines in order, as lists."""
    r = lambda k, c: _ref(k, c, side)
    order = f"ORDER BY l_linenumber, {_ref('p', 'l_partkey', 'a')}, l_suppkey"
    return f"""o{side} AS (
        SELECT {r('o', 'o_orderkey')} AS cid, any_value({r('c', 'o_custkey')}) AS super, count(l_orderkey) AS nm,
               list({r('p', 'l_partkey')} {order}) FILTER (l_orderkey IS NOT NULL) AS ps,
               list({r('s', 'l_suppkey')} {order}) FILTER (l_orderkey IS NOT NULL) AS ss,
               list(l_linenumber {order}) FILTER (l_orderkey IS NOT NULL) AS ns
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


_N = "n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM part) AS p, (SELECT count(*) FROM orders) AS o)"
_GRAPH = f"WITH {_N}, {_edges('a')}, {_edges('b')}"
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '')"
_DOCS = f"""WITH d AS (SELECT doc_id, 'LX/d' || doc_id || ';' AS cid, lang, {_WORDS} AS ws FROM documents),
    t AS (SELECT DISTINCT doc_id % 2 AS side, cid, s FROM (SELECT doc_id, cid, unnest(ws) AS s FROM d) WHERE length(s) >= 4)"""


def _on_graph(matcher: Matcher, kinds: str, nations: bool = True, rich: bool = False, drop: int = 4) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir, rich)
        mapping = g.partial(kinds, drop)
        if not nations:
            mapping = mapping.where(F.col("a").startswith("LX/"))
        return rounded(matcher.candidates(*g.projects(), mapping))

    return query


def _on_docs(matcher: Matcher) -> Query:
    return lambda spark, sf_dir: rounded(matcher.candidates(*docs(spark, sf_dir)))


def _m(name: str, proposal: Callable) -> Matcher:
    return Matcher(name, 3, proposal)


# Sources and anchors.

def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).projects()[1].classes.select("cid", "super", F.col("nm").cast("long").alias("nm"), F.size("calls").cast("long").alias("n_calls"))


register("scan_project", scan_project, f"""WITH {_N}, {_lines('b')}
    SELECT cid, super, nm, coalesce(len(list_distinct(ps)), 0) AS n_calls FROM ob
    UNION ALL SELECT {_ref('c', 'c_custkey', 'b')}, 'Lnation/' || c_nationkey || ';', 0, 0 FROM customer
    UNION ALL SELECT {_ref('s', 's_suppkey', 'b')}, NULL, 0, 0 FROM supplier
    UNION ALL SELECT {_ref('p', 'p_partkey', 'b')}, NULL, 0, 0 FROM part
    UNION ALL SELECT 'Lnation/' || n_nationkey || ';', NULL, 0, 0 FROM nation""")
register("project_edges", lambda spark, sf_dir: graph(spark, sf_dir).projects()[1].edges, f"WITH {_N}, {_edges('b')} SELECT src, dst, kind FROM eb")
register("fqn_anchor", lambda spark, sf_dir: rounded(content.content_matchers()[0].candidates(*graph(spark, sf_dir).projects())),
          "SELECT 'Lnation/' || n_nationkey || ';' AS a, 'Lnation/' || n_nationkey || ';' AS b, 1.0 AS confidence FROM nation")

# Content.

register("uniq_token", _on_docs(Matcher("unique_string", 2, content.unique_string(6))), _DOCS + """,
    u AS (SELECT side, s, min(cid) AS cid FROM t WHERE length(s) >= 6 GROUP BY side, s HAVING count(*) = 1)
    SELECT DISTINCT x.cid AS a, y.cid AS b, 0.95 AS confidence FROM u x JOIN u y ON x.s = y.s AND x.side = 0 AND y.side = 1""")
register("uniq_token_corroborated", _on_docs(Matcher("long_unique_string", 2, content.long_unique_string)), _DOCS + """,
    u AS (SELECT side, s, min(cid) AS cid FROM t WHERE length(s) >= 20 GROUP BY side, s HAVING count(*) = 1)
    SELECT DISTINCT x.cid AS a, y.cid AS b, 0.55 AS confidence FROM u x JOIN u y ON x.s = y.s AND x.side = 0 AND y.side = 1""")
register("fp_set_equal", _on_docs(Matcher("fp_set", 2, content.fingerprint(content.string_set(4, 3, 30), 0.9, "both"))), _DOCS + """,
    k AS (SELECT side, cid, list_sort(list(s)) AS key FROM t GROUP BY side, cid HAVING count(*) >= 3 AND sum(length(s)) >= 30),
    z AS (SELECT side, key, count(*) AS n FROM k GROUP BY side, key)
    SELECT x.cid AS a, y.cid AS b, round(CASE WHEN p.n * q.n <= 1 THEN 0.9 ELSE greatest(0.9 / sqrt(p.n * q.n), 0.4) END, 6) AS confidence
    FROM k x JOIN k y ON x.key = y.key AND x.side = 0 AND y.side = 1 JOIN z p ON p.key = x.key AND p.side = 0 JOIN z q ON q.key = x.key AND q.side = 1""")
register("bucket_assign", _on_docs(Matcher("identical_strings", 1, content.bucketed(content.string_set(4, 3, 30), 0.97))))
_OVER = """, o AS (SELECT x.cid AS a, y.cid AS b, count(*) AS n FROM t x JOIN t y ON x.s = y.s AND x.side = 0 AND y.side = 1 GROUP BY ALL),
    c AS (SELECT cid, count(*) AS n FROM t GROUP BY cid)"""
register("sim_jaccard", _on_docs(Matcher("jaccard_strings", 2, content.string_jaccard())), _DOCS + _OVER + """
    SELECT a, b, round(0.6 + 0.32 * (o.n / (x.n + y.n - o.n) - 0.7) / (1 - 0.7), 6) AS confidence
    FROM o JOIN c x ON x.cid = a JOIN c y ON y.cid = b WHERE o.n >= 3 AND o.n / (x.n + y.n - o.n) >= 0.7""")
register("sim_contained", _on_docs(Matcher("contained_strings", 2, content.contained_strings())), _DOCS.replace("length(s) >= 4", "length(s) >= 8") + _OVER + """
    SELECT a, b, round(least(0.65 + 0.15 * (o.n / x.n - 0.8) / (1 - 0.8 + 1e-9), 0.85), 6) AS confidence
    FROM o JOIN c x ON x.cid = a JOIN c y ON y.cid = b
    WHERE x.n >= 3 AND y.n >= 2 * x.n AND o.n >= greatest(3, CAST(trunc(0.8 * x.n) AS BIGINT))""")

# Division and votes.


def _lock_step_sql(here: str, there: str, least: int, kinds: str, cap: str = "") -> str:
    return _GRAPH + f""", {_mapped(kinds)},
    i AS (SELECT DISTINCT l.{here} AS a, m.b AS image FROM la l JOIN m ON m.a = l.{there} WHERE l.{here} NOT IN (SELECT a FROM m)),
    k AS (SELECT a, count(*) AS k FROM i GROUP BY a HAVING count(*) >= {least}),
    r AS (SELECT {there} AS image, {here} AS cand FROM lb),
    z AS (SELECT image, count(*) AS n FROM r GROUP BY image),
    need AS (SELECT a, count(z.n) AS filled, min(z.n) AS least FROM i JOIN k USING (a) LEFT JOIN z USING (image) GROUP BY a HAVING count(z.n) > 0{cap}),
    f AS (SELECT a, cand, count(*) AS n FROM i JOIN r USING (image) WHERE a IN (SELECT a FROM need) GROUP BY a, cand),
    c AS (SELECT a, cand FROM f JOIN need USING (a) WHERE f.n = filled AND cand NOT IN (SELECT b FROM m))
    SELECT a, min(cand) AS b, round(least(0.85 + 0.02 * min(k), 0.97), 6) AS confidence FROM c JOIN k USING (a) GROUP BY a HAVING count(*) = 1"""


register("div_lockstep_fwd", _on_graph(_m("lockstep_n2", structure.lock_step(2)), "csp"), _lock_step_sql("src", "dst", 2, "csp"))
register("div_lockstep_rev", _on_graph(_m("reverse_lockstep_n2", structure.lock_step(2, reverse=True)), "o"), _lock_step_sql("dst", "src", 2, "o", " AND min(z.n) <= 500"))



def _classes(side: str) -> str:
    return f"""SELECT cid, nm, super FROM o{side} UNION ALL SELECT {_ref('c', 'c_custkey', side)}, 0, 'Lnation/' || c_nationkey || ';' FROM customer
        UNION ALL SELECT {_ref('s', 's_suppkey', side)}, 0, '' FROM supplier"""


register("div_disambiguate", _on_graph(_m("disambig_lockstep_n3", structure.disambiguating_lock_step(1)), "cs"), _GRAPH + f""", {_lines('a')}, {_lines('b')}, {_mapped('cs')},
    ca AS ({_classes('a')}), cb AS ({_classes('b')}),
    i AS (SELECT DISTINCT l.src AS a, m.b AS image FROM la l JOIN m ON m.a = l.dst WHERE l.src NOT IN (SELECT a FROM m)),
    r AS (SELECT dst AS image, src AS cand FROM lb),
    z AS (SELECT image, count(*) AS n FROM r GROUP BY image),
    need AS (SELECT a, count(*) AS filled FROM i LEFT JOIN z USING (image) GROUP BY a HAVING count(z.n) = count(*)),
    f AS (SELECT a, cand, count(*) AS n FROM i JOIN r USING (image) WHERE a IN (SELECT a FROM need) GROUP BY a, cand),
    c AS (SELECT a, cand FROM f JOIN need USING (a) WHERE f.n = filled AND cand NOT IN (SELECT b FROM m)),
    few AS (SELECT a FROM c GROUP BY a HAVING count(*) BETWEEN 2 AND 5),
    scored AS (
        SELECT c.a, c.cand AS b, (2.5 + 2 * (x.nm = y.nm)::INT + 1.5 * (coalesce(m.b, x.super) = y.super)::INT) / 6.0 AS score
        FROM c JOIN few USING (a) JOIN ca x ON x.cid = c.a JOIN cb y ON y.cid = c.cand LEFT JOIN m ON m.a = x.super),
    best AS (SELECT *, row_number() OVER w AS r, score - lead(score) OVER w AS ahead FROM scored WINDOW w AS (PARTITION BY a ORDER BY score DESC, b DESC))
    SELECT a, b, round(0.65 + ahead * 0.5, 6) AS confidence FROM best WHERE r = 1 AND score >= 0.6 AND ahead >= 0.1""")
register("extended_by", _on_graph(_m("extended_by_lockstep_n2", structure.extended_by(2)), "o"), _GRAPH + f""", {_mapped('o')},
    x AS (SELECT l.dst AS a, m.b AS image FROM ea l JOIN m ON m.a = l.src WHERE kind = 'extends' AND l.dst NOT IN (SELECT a FROM m)),
    y AS (SELECT a, min(e.dst) AS b, max(e.dst) AS b2, count(*) AS k FROM x JOIN eb e ON e.src = image AND e.kind = 'extends' GROUP BY a HAVING count(*) >= 2)
    SELECT a, b, round(least(0.85 + 0.03 * k, 0.97), 6) AS confidence FROM y WHERE b = b2 AND b NOT IN (SELECT b FROM m)""")
register("implemented_by", _on_graph(_m("implemented_by_lockstep_n2", structure.implemented_by(2)), "s", nations=False), _GRAPH + f""", {_mapped('s', nations=False)},
    x AS (SELECT l.dst AS a, m.b AS image FROM ea l JOIN m ON m.a = l.src WHERE kind = 'implements' AND l.dst NOT IN (SELECT a FROM m)),
    k AS (SELECT a, count(*) AS k FROM x GROUP BY a HAVING count(*) >= 2),
    f AS (SELECT a, e.dst AS b, count(*) AS n FROM x JOIN eb e ON e.src = image AND e.kind = 'implements' GROUP BY ALL),
    c AS (SELECT a, b, k FROM f JOIN k USING (a) WHERE n = k AND b NOT IN (SELECT b FROM m))
    SELECT a, min(b) AS b, round(least(0.85 + 0.02 * min(k), 0.97), 6) AS confidence FROM c GROUP BY a HAVING count(*) = 1""")


def _vote_sql(weight: str, kind: str, least: int, rise: float, most: float) -> str:
    edges = ("ea", "eb") if kind else ("la", "lb")
    on = " AND y.kind = x.kind" if kind else ""
    by = "dst, kind" if kind else "dst"
    same = "z.dst = y.dst AND z.kind = y.kind" if kind else "z.dst = y.dst"
    return _GRAPH + f""", {_mapped('csp')},
    z AS (SELECT {by} FROM {edges[1]} GROUP BY {by} HAVING count(*) <= 200),
    votes AS (
        SELECT x.src AS a, y.src AS b, sum({weight}) AS v FROM {edges[0]} x JOIN m ON m.a = x.dst JOIN {edges[1]} y ON y.dst = m.b{on} JOIN z ON {same}
        WHERE x.src NOT IN (SELECT a FROM m) GROUP BY ALL),
    {TOP}
    SELECT a, b, round(least(0.55 + {rise} * (v - second), {most}), 6) AS confidence FROM v2 WHERE r = 1 AND v >= {least} AND v - second >= 2"""


register("vote_neighbour", _on_graph(_m("neighbour_vote", structure.neighbour_vote(4, 2, 0.03, 0.9)), "csp"), _vote_sql("1", "", 4, 0.03, 0.9))
register("vote_weighted", _on_graph(_m("neighbour_vote_w_n4", structure.neighbour_vote(4, 2, 0.02, 0.92, structure.EDGE_WEIGHTS)), "csp"), _vote_sql("x.w", "kind", 4, 0.02, 0.92))
_PLACE = """,
    votes AS (SELECT x AS a, y AS b, count(*) AS v FROM p WHERE x NOT IN (SELECT a FROM m) AND y NOT IN (SELECT b FROM m) GROUP BY ALL),
    {top}
    SELECT a, b, round(least({base} + {rise} * (v - second), {most}), 6) AS confidence FROM v2 WHERE r = 1 AND v >= {least} AND v - second >= 1"""
register("vote_super", _on_graph(_m("super_lx_vote_n2", structure.position_vote(structure._super, 0.75, 0.04, 0.95, 2)), "o"), f"WITH {_N}, {_lines('a')}, {_lines('b')}, {_mapped('o')}," + """
    p AS (SELECT oa.super AS x, ob.super AS y FROM m JOIN oa ON oa.cid = m.a JOIN ob ON ob.cid = m.b)""" + _PLACE.format(top=TOP, base=0.75, rise=0.04, most=0.95, least=2))
register("vote_position_list", _on_graph(_m("field_position_lx_vote_n2", structure.position_vote(structure._list("field_types", strip=True), 0.7, 0.05, 0.93, 2)), "o"), f"WITH {_N}, {_lines('a')}, {_lines('b')}, {_mapped('o')}," + """
    p AS (SELECT unnest(oa.ps) AS x, unnest(ob.ps) AS y FROM m JOIN oa ON oa.cid = m.a JOIN ob ON ob.cid = m.b)""" + _PLACE.format(top=TOP, base=0.7, rise=0.05, most=0.93, least=2))

# Substitution.

_SUB = f"WITH {_N}, {_lines('a')}, {_lines('b')}, {_mapped('csp')}, mm AS (SELECT map(list(a), list(b)) AS f FROM m)"


def _to(x: str) -> str:
    return f"f[{x}]"


register("subst_field_types", _on_graph(_m("field_type_seq_sub", structure.field_types(2, True, 0.85)), "csp"), _SUB + f""",
    x AS (SELECT cid AS a, nm, coalesce({_to('super')}, super) AS super, list_transform(ps, lambda t: {_to('t')}) AS ts FROM oa, mm WHERE nm >= 2),
    j AS (SELECT x.a, ob.cid AS b FROM x JOIN ob ON ob.ps = x.ts AND ob.super = x.super AND ob.nm = x.nm WHERE len(list_filter(ts, lambda t: t IS NULL)) = 0),
    z AS (SELECT ps, super, nm, count(*) AS n FROM ob GROUP BY ALL)
    SELECT j.a, j.b, round(CASE WHEN z.n = 1 THEN 0.85 ELSE greatest(0.85 / sqrt(z.n), 0.4) END, 6) AS confidence FROM j JOIN ob ON ob.cid = j.b JOIN z ON z.ps = ob.ps AND z.super = ob.super AND z.nm = ob.nm""")
register("subst_signature", _on_graph(_m("sig_substituted", structure.signature_fingerprint), "csp"), _SUB + f""",
    x AS (SELECT cid AS a, len(ps) AS n, list_sort(list_transform(range(1, len(ps) + 1), lambda i: 'm(' || coalesce({_to('ps[i]')}, 'LX/?;') || 'I)' || coalesce({_to('ss[i]')}, 'LX/?;'))) AS ts,
                 list_sort(list_transform(range(1, len(ps) + 1), lambda i: 'm(' || ps[i] || 'I)' || ss[i])) AS own,
                 len(list_filter(ps, lambda t: {_to('t')} IS NULL)) + len(list_filter(ss, lambda t: {_to('t')} IS NULL)) AS missing FROM oa, mm WHERE nm >= 2),
    y AS (SELECT cid AS b, list_sort(list_transform(range(1, len(ps) + 1), lambda i: 'm(' || ps[i] || 'I)' || ss[i])) AS ts FROM ob WHERE nm >= 2)
    SELECT a, b, 0.7 AS confidence FROM x JOIN y ON x.ts = y.ts WHERE x.ts <> own AND missing <= n""")
register("fp_neighbours_fwd", _on_graph(_m("mapped_nb_fp_n2_r5", structure.mapped_neighbours(2, 0.5)), "csp"), _SUB + f""",
    x AS (SELECT cid AS a, nm, coalesce({_to('super')}, super) AS super, list_distinct(list_concat(coalesce(ps, []), coalesce(ss, []))) AS rs FROM oa, mm),
    x2 AS (SELECT x.*, list_sort(list_filter(list_transform(rs, lambda t: {_to('t')}), lambda t: t IS NOT NULL)) AS ts FROM x, mm WHERE len(rs) >= 2),
    y AS (SELECT cid AS b, nm, super, list_sort(list_distinct(list_concat(coalesce(ps, []), coalesce(ss, [])))) AS rs FROM ob),
    z AS (SELECT rs, super, nm, count(*) AS n FROM y WHERE len(rs) >= 2 GROUP BY ALL)
    SELECT a, b, round(CASE WHEN z.n = 1 THEN 0.85 ELSE greatest(0.85 / sqrt(z.n), 0.4) END, 6) AS confidence
    FROM x2 JOIN y ON y.rs = x2.ts AND y.super = x2.super AND y.nm = x2.nm JOIN z ON z.rs = y.rs AND z.super = y.super AND z.nm = y.nm
    WHERE len(ts) >= 2 AND len(ts) / len(x2.rs) >= 0.5""")
_SIBLING = _SUB + f""",
    ca AS (SELECT cid, super, nm FROM oa UNION ALL SELECT {_ref('c', 'c_custkey', 'a')}, 'Lnation/' || c_nationkey || ';', 0 FROM customer),
    cb AS (SELECT cid, super, nm FROM ob UNION ALL SELECT {_ref('c', 'c_custkey', 'b')}, 'Lnation/' || c_nationkey || ';', 0 FROM customer),
    x AS (SELECT cid AS a, nm, CASE WHEN super LIKE 'LX/%' THEN {_to('super')} ELSE super END AS super FROM ca, mm)"""
register("sibling_exact", _on_graph(_m("sibling_super", structure.siblings("exact")), "csp"), _SIBLING + """
    SELECT a, min(cid) AS b, 0.7 AS confidence FROM x JOIN cb ON cb.super = x.super AND cb.nm = x.nm GROUP BY a HAVING count(*) = 1""")
register("sibling_band", _on_graph(_m("sibling_super_loose", structure.siblings("loose")), "csp"), _SIBLING + """
    SELECT a, min(cid) AS b, 0.62 AS confidence FROM x JOIN cb ON cb.super = x.super AND abs(cb.nm - x.nm) <= 1
    WHERE cid NOT IN (SELECT b FROM m) GROUP BY a HAVING count(*) = 1""")

_BY_SIZE = "round(CASE WHEN z.n = 1 THEN {0} ELSE greatest({0} / sqrt(z.n), 0.4) END, 6) AS confidence"
register("field_type_ms_sub", _on_graph(_m("field_type_ms_sub", structure.field_types(3, False, 0.82)), "csp"), _SUB + f""",
    x AS (SELECT cid AS a, nm, coalesce({_to('super')}, super) AS super, list_transform(ps, lambda t: {_to('t')}) AS ts FROM oa, mm WHERE nm >= 3),
    y AS (SELECT cid AS b, nm, super, list_sort(ps) AS ts FROM ob WHERE nm >= 3),
    z AS (SELECT ts, super, nm, count(*) AS n FROM y GROUP BY ALL)
    SELECT a, b, {_BY_SIZE.format(0.82)} FROM x JOIN y ON y.ts = list_sort(x.ts) AND y.super = x.super AND y.nm = x.nm JOIN z ON z.ts = y.ts AND z.super = y.super AND z.nm = y.nm
    WHERE len(list_filter(x.ts, lambda t: t IS NULL)) = 0""")
register("sym_neighbours", _on_graph(_m("sym_nb_fp_n4_r6", structure.symmetric_neighbours(4, 0.6, sort=True)), "csp"), _SUB + f""",
    x AS (SELECT cid AS a, nm, list_distinct(list_concat([super], coalesce(ps, []), coalesce(ss, []))) AS rs FROM oa),
    x2 AS (SELECT x.*, list_sort(list_filter(list_transform(rs, lambda t: {_to('t')}), lambda t: t IS NOT NULL)) AS ts FROM x, mm WHERE len(rs) >= 4),
    y AS (SELECT cid AS b, nm, list_sort(list_distinct(list_concat([super], coalesce(ps, []), coalesce(ss, [])))) AS rs FROM ob),
    z AS (SELECT rs, nm, count(*) AS n FROM y GROUP BY ALL)
    SELECT a, b, {_BY_SIZE.format(0.85)} FROM x2 JOIN y ON y.rs = x2.ts AND y.nm = x2.nm JOIN z ON z.rs = y.rs AND z.nm = y.nm WHERE len(ts) / len(x2.rs) >= 0.6""")
register("rev_neighbours", _on_graph(_m("rev_nb_fp_n4_r6", structure.reverse_neighbours(4, 0.6)), "o", drop=10**9), _GRAPH + f""", {_mapped('o', drop=10**9)},
    nfa AS (SELECT {_ref('p', 'p_partkey', 'a')} AS cid, p_size AS nf FROM part), nfb AS (SELECT {_ref('p', 'p_partkey', 'b')} AS cid, p_size AS nf FROM part),
    x AS (SELECT l.dst AS a, coalesce(any_value(nf), 0) AS nf, count(*) AS every, list_sort(list(m.b) FILTER (m.b IS NOT NULL)) AS rs
          FROM la l LEFT JOIN m ON m.a = l.src LEFT JOIN nfa ON nfa.cid = l.dst WHERE l.dst LIKE 'LX/%' GROUP BY l.dst HAVING count(*) >= 4),
    y AS (SELECT l.dst AS b, coalesce(any_value(nf), 0) AS nf, list_sort(list(l.src)) AS rs FROM lb l LEFT JOIN nfb ON nfb.cid = l.dst WHERE l.dst LIKE 'LX/%' GROUP BY l.dst HAVING count(*) >= 4),
    z AS (SELECT rs, nf, count(*) AS n FROM y GROUP BY ALL)
    SELECT a, b, {_BY_SIZE.format(0.83)} FROM x JOIN y ON y.rs = x.rs AND y.nf = x.nf JOIN z ON z.rs = y.rs AND z.nf = y.nf WHERE len(x.rs) / every >= 0.6""")
register("call_targets_sub", _on_graph(_m("call_targets_sub", structure.call_targets(6)), "csp"), _SUB + f""",
    x AS (SELECT cid AS a, list_sort(list_distinct(list_filter(list_transform(range(1, len(ps) + 1), lambda i: {_to('ps[i]')} || ns[i]), lambda t: t IS NOT NULL))) AS ts FROM oa, mm),
    y AS (SELECT cid AS b, list_sort(list_distinct(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || ns[i]))) AS ts FROM ob),
    z AS (SELECT ts, count(*) AS n FROM y GROUP BY ts)
    SELECT a, b, {_BY_SIZE.format(0.85)} FROM x JOIN y USING (ts) JOIN z USING (ts) WHERE len(ts) >= 6""")
_KEPT = f"list_sort(list_transform(range(1, len(ps) + 1), lambda i: ns[i] || coalesce({_to('ps[i]')}, ps[i]) || coalesce({_to('ss[i]')}, ss[i])))"
register("method_callset_sub", _on_graph(_m("method_callset_sub", structure.method_call_sets(2)), "csp", rich=True), _SUB + f""",
    x AS (SELECT cid AS a, {_KEPT} AS ts FROM oa, mm WHERE nm >= 2),
    y AS (SELECT cid AS b, list_sort(list_transform(range(1, len(ps) + 1), lambda i: ns[i] || ps[i] || ss[i])) AS ts FROM ob WHERE nm >= 2),
    z AS (SELECT ts, count(*) AS n FROM y GROUP BY ts)
    SELECT a, b, {_BY_SIZE.format(0.9)} FROM x JOIN y USING (ts) JOIN z USING (ts)""")
register("sibling_signatures", _on_graph(_m("sibling_sub_sigs", structure.sibling_signatures(4)), "csp"), _SUB + f""",
    x AS (SELECT cid AS a, {_to('super')} AS super, list_sort(list_transform(range(1, len(ps) + 1), lambda i: coalesce({_to('ps[i]')}, ps[i]) || coalesce({_to('ss[i]')}, ss[i]))) AS ts FROM oa, mm WHERE nm >= 4),
    y AS (SELECT cid AS b, super, list_sort(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || ss[i])) AS ts FROM ob WHERE nm >= 4)
    SELECT a, min(b) AS b, 0.85 AS confidence FROM x JOIN y USING (super, ts) GROUP BY a HAVING count(*) = 1""")


def _owned(side: str) -> str:
    """Classes with interfaces: orders with their suppliers, suppliers with their nation and a field count."""
    return f"""SELECT cid, nm, nm AS nf, ss AS impls FROM o{side} WHERE nm > 0
        UNION ALL SELECT {_ref('s', 's_suppkey', side)}, 0, CAST(floor(abs(s_acctbal)) AS BIGINT) % 97, ['Lnation/' || s_nationkey || ';'] FROM supplier"""


register("sibling_interfaces", _on_graph(_m("sibling_impls", structure.siblings("interfaces")), "csp", rich=True), _SUB + f""",
    x AS (SELECT cid AS a, nm, nf, list_transform(impls, lambda t: CASE WHEN t LIKE 'LX/%' THEN {_to('t')} ELSE t END) AS i FROM ({_owned('a')}), mm),
    y AS (SELECT cid AS b, nm, nf, list_sort(impls) AS i FROM ({_owned('b')}))
    SELECT a, min(b) AS b, 0.7 AS confidence FROM x JOIN y ON y.i = list_sort(x.i) AND y.nm = x.nm AND y.nf = x.nf
    WHERE len(list_filter(x.i, lambda t: t IS NULL)) = 0 GROUP BY a HAVING count(*) = 1""")
for _name, _column, _list in (("vote_position_impls", "impls", "ss"), ("vote_position_anns", "anns", "ps")):
    register(_name, _on_graph(_m(_name, structure.position_vote(structure._list(_column), 0.7, 0.05, 0.93, 2)), "o", rich=True), f"WITH {_N}, {_lines('a')}, {_lines('b')}, {_mapped('o')}," + f"""
        p AS (SELECT unnest(oa.{_list}) AS x, unnest(ob.{_list}) AS y FROM m JOIN oa ON oa.cid = m.a JOIN ob ON ob.cid = m.b)""" + _PLACE.format(top=TOP, base=0.7, rise=0.05, most=0.93, least=2))
#: A method of a meets the last one of b with its signature, that is, of its line number.
_LAST = """
    ta AS (SELECT m.a, m.b, unnest(oa.ns) AS n, unnest(oa.ps) AS p, unnest(oa.ss) AS s FROM m JOIN oa ON oa.cid = m.a),
    tb AS (SELECT cid AS b, n, arg_max(p, i) AS p, arg_max(s, i) AS s FROM (SELECT cid, unnest(ns) AS n, unnest(ps) AS p, unnest(ss) AS s, unnest(range(len(ns))) AS i FROM ob) GROUP BY ALL),
    p AS (SELECT unnest([ta.p, ta.s]) AS x, unnest([tb.p, tb.s]) AS y FROM ta JOIN tb USING (b, n))"""
for _name, _proposal, _conf in (("vote_body_sequence", structure.body_sequence_vote(2), {"base": 0.72, "rise": 0.02, "most": 0.92}), ("vote_call_position", structure.call_position_vote(2), {"base": 0.74, "rise": 0.03, "most": 0.93})):
    register(_name, _on_graph(_m(_name, _proposal), "o", rich=True), f"WITH {_N}, {_lines('a')}, {_lines('b')}, {_mapped('o')}," + _LAST + _PLACE.format(top=TOP, least=2, **_conf))
#: Methods of one signature meet in order; a call counts twice, as the only one left or by its name and its place.
register("method_walk", _on_graph(_m("method_walk", structure.method_walk()), "op", rich=True), f"WITH {_N}, {_lines('a')}, {_lines('b')}, {_mapped('op')}," + """
    t AS (SELECT unnest(oa.ps) AS pa, unnest(ob.ps) AS pb, unnest(oa.ss) AS sa, unnest(ob.ss) AS sb FROM m JOIN oa ON oa.cid = m.a JOIN ob ON ob.cid = m.b),
    p AS (SELECT unnest([pa, pa, sa, sa]) AS x, unnest([pb, pb, sb, sb]) AS y FROM t)""" + _PLACE.format(top=TOP, base=0.65, rise=0.04, most=0.92, least=2))

# Members: the turns of conversations.


def _on_turns(matcher: Matcher) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = conversations(spark, sf_dir)
        return rounded(matcher.candidates(a, b, spark.createDataFrame([], "a string, b string")))

    return query


_TURNS = """WITH t AS (
        SELECT conv_id % 2 AS side, 'LX/v' || conv_id || ';' AS cid, turn, role || ':' || (length(text) % 5) AS h,
               role || '(' || substr('IJZ', length(text) % 3 + 1, 1) || ')V' AS sig FROM conversations)"""
register("fp_multiset_equal", _on_turns(Matcher("anon_body_ms", 2, content.fingerprint(content.body_key(2), 0.93, "b"))), _TURNS + """,
    k AS (SELECT side, cid, list_sort(list(h)) AS key FROM t GROUP BY side, cid HAVING count(*) >= 2),
    z AS (SELECT key, count(*) AS n FROM k WHERE side = 1 GROUP BY key)
    SELECT x.cid AS a, y.cid AS b, round(CASE WHEN z.n = 1 THEN 0.93 ELSE greatest(0.93 / sqrt(z.n), 0.4) END, 6) AS confidence
    FROM k x JOIN k y ON x.key = y.key AND x.side = 0 AND y.side = 1 JOIN z ON z.key = x.key""")
register("sim_body_jaccard", _on_turns(Matcher("anon_body_jac_m3_j60", 2, content.body_jaccard(3, 0.6))), _TURNS.replace("WITH t AS", "WITH t0 AS") + """,
    t AS (SELECT DISTINCT side, cid, h AS s FROM t0),
    big AS (SELECT cid, count(*) AS n FROM t GROUP BY cid HAVING count(*) >= 3),
    o AS (SELECT x.cid AS a, y.cid AS b, count(*) AS n FROM t x JOIN t y ON x.s = y.s AND x.side = 0 AND y.side = 1 GROUP BY ALL)
    SELECT a, b, round(0.65 + 0.27 * (o.n / (x.n + y.n - o.n) - 0.6) / (1 - 0.6), 6) AS confidence
    FROM o JOIN big x ON x.cid = a JOIN big y ON y.cid = b WHERE o.n >= 3 AND o.n / (x.n + y.n - o.n) >= 0.6""")


def _ratio_sql(token: str, least: int, ratio: float, most: float) -> str:
    return _TURNS + f""",
    total AS (SELECT cid AS a, count(*) AS n FROM t WHERE side = 0 GROUP BY cid HAVING count(*) >= {least}),
    votes AS (
        SELECT x.cid AS a, y.cid AS b, count(*) AS v FROM t x JOIN (SELECT DISTINCT cid, {token} AS token FROM t WHERE side = 1) y ON x.{token} = y.token
        WHERE x.side = 0 GROUP BY ALL),
    {TOP}
    SELECT a, b, round(least(0.7 + 0.05 * (v - second), {most}), 6) AS confidence FROM v2 JOIN total USING (a)
    WHERE r = 1 AND v >= {least} AND v - second >= 1 AND v / n >= {ratio}"""


register("vote_member_hash", _on_turns(_m("bha_method_vote", structure.body_hash_vote(2, 0.3))), _ratio_sql("h", 2, 0.3, 0.93))
register("vote_member_sig", _on_turns(_m("method_sig_sub_vote", structure.signature_vote(2, 0.3))), _ratio_sql("sig", 2, 0.3, 0.92))


def members_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations 2k and 2k + 1, paired by equal signature in order of appearance."""
    a, b = conversations(spark, sf_dir)
    k = F.regexp_extract("cid", "([0-9]+)", 1).cast("long")
    pairs = a.classes.select(F.col("cid").alias("a"), k.alias("k")).join(b.classes.select(F.col("cid").alias("b"), (k - 1).alias("k")), "k").select("a", "b")
    return members.method_mapping(a, b, pairs).where("sim = 1.0 and a = b").groupBy("a_class", "b_class", F.col("a").alias("sig")).agg(F.count("*").alias("n"))


register("members_exact", members_exact, _TURNS + """,
    c AS (SELECT cid, side, CAST(regexp_extract(cid, '([0-9]+)', 1) AS BIGINT) AS k, sig, count(*) AS n FROM t GROUP BY ALL)
    SELECT x.cid AS a_class, y.cid AS b_class, x.sig AS sig, least(x.n, y.n) AS n FROM c x JOIN c y ON x.sig = y.sig AND x.side = 0 AND y.side = 1 AND y.k = x.k + 1""")


def members_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of the same pairs, the rest by the best assignment."""
    a, b = conversations(spark, sf_dir)
    k = F.regexp_extract("cid", "([0-9]+)", 1).cast("long")
    pairs = a.classes.select(F.col("cid").alias("a"), k.alias("k")).join(b.classes.select(F.col("cid").alias("b"), (k - 1).alias("k")), "k").select("a", "b")
    return members.method_mapping(a, b, pairs)


register("members_assign", members_assign)
register("string_frequency", lambda spark, sf_dir: docs(spark, sf_dir)[0].string_frequency(), _DOCS + " SELECT s, count(*) AS count FROM t WHERE side = 0 GROUP BY s")

# Commit, validation, cleanup, members, measures.


def commit_conflict_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    a, b = g.projects()
    state = State(g.partial("csp"), spark.createDataFrame([], "a string, b string"))
    found = g.truth("o").select("a", "b", F.lit(0.8).alias("confidence"), F.lit("truth").alias("matcher_id"), F.lit(3).alias("tier"))
    return commit(state, found, a, b)[0].mapping.select("a", "b", F.round("confidence", 6).alias("confidence"), "locked")


register("commit_conflict_free", commit_conflict_free, f"""WITH {_N}, {_mapped('csp')}
    SELECT a, b, 0.9 AS confidence, a NOT LIKE 'LX/%' AS locked FROM m
    UNION ALL SELECT {_ref('o', 'o_orderkey', 'a')}, {_ref('o', 'o_orderkey', 'b')}, 0.8, false FROM orders""")


def commit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of customers and nations that meet incumbents, locks, revoked pairs and the namespace guard, and what
    becomes of each."""
    g = graph(spark, sf_dir)
    a, b = g.projects()
    t = g.truth("c")
    k = F.col("k")
    old = t.where("k % 4 <> 0").select("a", "b", F.lit(0.9).alias("confidence"), (k % 16 == 1).alias("locked"), F.array(F.lit("seed")).alias("matchers"))
    state = State(old, t.where("k % 16 = 12").select("a", "b"))
    shifted = t.where("k % 8 = 0").select("a", (k + 1).alias("k"), F.element_at(F.array(F.lit(0.5), F.lit(0.95), F.lit(1.0)), (k % 3 + 1).cast("int")).alias("confidence")).join(t.select("b", "k"), "k")
    found = shifted.select("a", "b", "confidence")
    found = found.unionByName(t.where("k % 8 = 3").select("a", "b", F.lit(0.97).alias("confidence"))).unionByName(t.where("k % 8 = 4").select("a", "b", F.lit(0.8).alias("confidence")))
    nations = a.classes.where(~a.obfuscated("cid")).select(F.col("cid").alias("a")).crossJoin(F.broadcast(t.where("k = 2").select("b")))
    found = found.unionByName(nations.select("a", "b", F.lit(0.99).alias("confidence")))
    return commit(state, found.withColumns({"matcher_id": F.lit("m"), "tier": F.lit(3)}), a, b)[1].select("a", "b", "outcome")


register("commit_outcomes", commit_outcomes, f"""WITH {_N}
    SELECT {_ref('c', 'c_custkey', 'a')} AS a, {_ref('c', '(c_custkey + 1)', 'b')} AS b, CASE WHEN c_custkey % 16 = 0 THEN 'locked-blocked' WHEN c_custkey % 3 = 2 THEN 'displaced' ELSE 'rejected' END AS outcome
    FROM customer WHERE c_custkey % 8 = 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT {_ref('c', 'c_custkey', 'a')}, {_ref('c', 'c_custkey', 'b')}, CASE WHEN c_custkey % 8 = 3 THEN 'updated' WHEN c_custkey % 16 = 12 THEN 'negative' ELSE 'added' END
    FROM customer WHERE c_custkey % 8 IN (3, 4)
    UNION ALL SELECT 'Lnation/' || n_nationkey || ';', {_ref('c', '2', 'b')}, 'cross-ns' FROM nation""")
register("churn", lambda spark, sf_dir: churn(graph(spark, sf_dir).partial("cs"), graph(spark, sf_dir).partial("cp", drop=3)).select("added", "removed", "changed", "size"), """
    SELECT CAST((SELECT count(*) FROM part WHERE p_partkey % 3 <> 0) + (SELECT count(*) FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 = 0) AS BIGINT) AS added,
           CAST((SELECT count(*) FROM supplier WHERE s_suppkey % 4 <> 0) + (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 <> 0) AS BIGINT) AS removed,
           CAST(0 AS BIGINT) AS changed,
           CAST((SELECT count(*) FROM part WHERE p_partkey % 3 <> 0) + (SELECT count(*) FROM customer WHERE c_custkey % 3 <> 0) + (SELECT count(*) FROM nation) AS BIGINT) AS size""")


def _shifted_sql(kind: str, every: int = 5) -> str:
    """Pairs of a kind, each fifth with the image of the next key, or with a class that is not there."""
    table, key = SOURCES[kind]
    image = f"({key} + CASE WHEN {key} % {every} = 0 THEN 1 ELSE 0 END)"
    return f"SELECT {_ref(kind, key, 'a')} AS a, CASE WHEN {image} < (SELECT {kind} FROM n) THEN {_ref(kind, image, 'b')} ELSE 'LX/{kind}-1;' END AS b FROM {table}"


def _validated(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir)
        return V.VALIDATORS[name](g.shifted("o"), *g.projects(), g.partial("csp")).select("a", "b", F.col("value").cast("long").alias("value"), "provisional")

    return query


def _steps(rate: str, *limits: tuple[float, int], below: int) -> str:
    return " ".join(f"WHEN {rate} >= {at} THEN {score}" for at, score in limits) + f" ELSE {below}"


_VALUES = f"""q AS ({_shifted_sql('o')}),
    shape AS (SELECT q.a, q.b, CASE WHEN y.cid IS NULL THEN 1 WHEN gap > 0.75 THEN 2 WHEN gap > 0.5 THEN 3 WHEN gap > 0.25 THEN 6 WHEN gap > 0.1 THEN 8 ELSE 10 END AS value, false AS provisional
        FROM q JOIN oa x ON x.cid = q.a LEFT JOIN ob y ON y.cid = q.b, LATERAL (SELECT abs(x.nm - y.nm) / greatest(1, x.nm, y.nm) AS gap)),
    near AS (SELECT q.a, q.b, count(*) AS n, count(lb.src) AS hits FROM q JOIN la ON la.src = q.a JOIN m ON m.a = la.dst LEFT JOIN lb ON lb.src = q.b AND lb.dst = m.b GROUP BY q.a, q.b),
    neighbour AS (SELECT q.a, q.b, CASE WHEN n IS NULL THEN 5 {_steps('hits / n', (0.9, 10), (0.7, 8), (0.4, 6), (0.2, 3), below=2)} END AS value, coalesce(n, 0) < 3 AS provisional FROM q LEFT JOIN near USING (a, b)),
    sigs AS (SELECT cid AS b, list_transform(range(1, len(ps) + 1), lambda i: ps[i] || ss[i]) AS g FROM ob),
    sig1 AS (SELECT q.a, q.b, len(x.ps) AS n, len(sigs.g) AS nb, len(list_filter(list_concat(x.ps, x.ss), lambda t: {_to('t')} IS NULL)) AS missing,
            len(list_filter(range(1, len(x.ps) + 1), lambda i: list_contains(sigs.g, coalesce({_to('x.ps[i]')}, x.ps[i]) || coalesce({_to('x.ss[i]')}, x.ss[i])))) AS hits
        FROM q JOIN oa x ON x.cid = q.a LEFT JOIN sigs ON sigs.b = q.b, mm),
    sig AS (SELECT a, b, CASE WHEN n IS NULL OR nb IS NULL THEN 5 WHEN hits = 0 THEN 2 {_steps('hits / n', (0.95, 10), (0.8, 8), (0.5, 6), (0.25, 4), below=3)} END AS value,
            coalesce(nb IS NOT NULL AND 2 * n - missing < 2 * n * 0.5, false) AS provisional FROM sig1)"""
_JUDGED = _GRAPH + f""", {_lines('a')}, {_lines('b')}, {_mapped('csp')}, mm AS (SELECT map(list(a), list(b)) AS f FROM m), """ + _VALUES
for _name, _validator, _table in (("val_shape", "shape", "shape"), ("val_neighbour", "neighbour_consistency", "neighbour"), ("val_sig", "signature_refs", "sig")):
    register(_name, _validated(_validator), _JUDGED + f" SELECT a, b, CAST(value AS BIGINT) AS value, provisional FROM {_table}")


def val_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    scored = V.scores(g.shifted("o"), *g.projects(), g.partial("csp"))
    return V.aggregate(scored).select("a", "b", F.round("score", 6).alias("score"), "provisional")


#: Orders have no methods and no interfaces: the last two validators are neutral.
register("val_aggregate", val_aggregate, _JUDGED + """,
    every AS (SELECT * FROM shape UNION ALL SELECT * FROM neighbour UNION ALL SELECT * FROM sig UNION ALL SELECT a, b, 5, false FROM q UNION ALL SELECT a, b, 5, false FROM q)
    SELECT a, b, round(CASE WHEN min(value) <= 1 THEN 0 ELSE (avg(value) - 1) / 9 END, 6) AS score, bool_or(provisional) AND min(value) > 1 AS provisional FROM every GROUP BY a, b""")


def _turn_pairs(a: Project, b: Project) -> DataFrame:
    """Conversations 2k and 2k + 1, and 4k and 4k + 3."""
    k = F.regexp_extract("cid", "([0-9]+)", 1).cast("long")
    left, right = a.classes.select(F.col("cid").alias("a"), k.alias("k")), b.classes.select(F.col("cid").alias("b"), k.alias("kb"))
    near = F.explode(F.when(F.col("k") % 4 == 0, F.array(F.col("k") + 1, F.col("k") + 3)).otherwise(F.array(F.col("k") + 1)))
    return left.select("a", near.alias("kb")).join(right, "kb").select("a", "b")


def val_method_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = conversations(spark, sf_dir)
    none = spark.createDataFrame([], "a string, b string")
    return V.method_pair_count(_turn_pairs(a, b), a, b, none).select("a", "b", F.col("value").cast("long").alias("value"), "provisional")


_PAIRED = "JOIN (SELECT DISTINCT conv_id AS kb FROM conversations) ON kb = conv_id + 1 OR (conv_id % 4 = 0 AND kb = conv_id + 3)"
register("val_method_pairs", val_method_pairs, f"""WITH t AS (SELECT conv_id, role || '(' || substr('IJZ', length(text) % 3 + 1, 1) || ')V' AS sig FROM conversations),
    n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
    q AS (SELECT n.conv_id AS ka, kb, n.n FROM n {_PAIRED.replace('conv_id +', 'n.conv_id +').replace('conv_id %', 'n.conv_id %')} WHERE n.conv_id % 2 = 0),
    h AS (SELECT q.ka, q.kb, q.n, count(*) FILTER (sig IN (SELECT sig FROM t y WHERE y.conv_id = q.kb)) AS hits FROM q JOIN t x ON x.conv_id = q.ka GROUP BY ALL)
    SELECT 'LX/v' || ka || ';' AS a, 'LX/v' || h.kb || ';' AS b, CAST(CASE WHEN h.n < 2 OR nb.n < 2 THEN 5 WHEN hits / h.n >= 0.8 THEN 10 WHEN hits / h.n >= 0.5 THEN 8 WHEN hits / h.n >= 0.25 THEN 6
        WHEN hits >= 2 THEN 5 WHEN hits = 0 THEN 2 ELSE 4 END AS BIGINT) AS value, false AS provisional FROM h JOIN n nb ON nb.conv_id = h.kb""")


def val_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = lambdas(spark, sf_dir)
    return V.merge_asymmetry(_turn_pairs(a, b), a, b, spark.createDataFrame([], "a string, b string")).select("a", "b", F.col("value").cast("long").alias("value"))


register("val_merges", val_merges, f"""WITH f AS (
        SELECT conv_id, conv_id % 3 < 2 AND bool_or(role = 'assistant' AND coalesce(length(text), 0) % 2 = 0) AND bool_or(role <> 'assistant' AND coalesce(length(text), 0) % 9 >= 5) AS merged
        FROM conversations GROUP BY conv_id),
    q AS (SELECT f.conv_id AS ka, kb, merged FROM f {_PAIRED.replace('conv_id +', 'f.conv_id +').replace('conv_id %', 'f.conv_id %')} WHERE f.conv_id % 2 = 0)
    SELECT 'LX/v' || ka || ';' AS a, 'LX/v' || kb || ';' AS b, CAST(CASE WHEN q.merged <> y.merged THEN 1 ELSE 5 END AS BIGINT) AS value FROM q JOIN f y ON y.conv_id = q.kb""")


def cleanup_fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders mapped to their neighbour's image: those none of whose mapped references agrees."""
    g = graph(spark, sf_dir)
    t = g.truth("o")
    wrong = t.select("a", (F.col("k") + 1).alias("k")).join(t.select("b", "k"), "k").select("a", "b", F.lit(0.5).alias("confidence"), F.lit(False).alias("locked"), F.array(F.lit("x")).alias("matchers"))
    state = State(g.partial("csp").unionByName(wrong), spark.createDataFrame([], "a string, b string"))
    return V.unsupported(state, *g.projects(), reverse_saves=False).where(F.col("a").startswith("LX/o"))


register("cleanup_fwd", cleanup_fwd, _GRAPH + f""", {_mapped('csp')},
    o AS (SELECT {_ref('o', 'o_orderkey', 'a')} AS a, {_ref('o', '(o_orderkey + 1)', 'b')} AS b FROM orders WHERE o_orderkey + 1 IN (SELECT o_orderkey FROM orders))
    SELECT o.a, o.b FROM o JOIN la ON la.src = o.a JOIN m ON m.a = la.dst LEFT JOIN lb ON lb.src = o.b AND lb.dst = m.b
    GROUP BY o.a, o.b HAVING count(*) >= 2 AND count(lb.src) = 0""")


def fields_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return members.field_mapping(*g.projects(), g.partial("csp").unionByName(g.truth("o").select("a", "b", F.lit(0.9).alias("confidence"), F.lit(False).alias("locked"), F.array(F.lit("t")).alias("matchers"))))


register("fields_pair", fields_pair)


def _mixed(g: Graph) -> DataFrame:
    """A mapping with wrong, shared and missing partners: shifted customers and suppliers, three of four orders, and
    nations, of which each third goes to the next one."""
    k = F.col("n_nationkey")
    name = lambda key: F.concat(F.lit("Lnation/"), key.cast("string"), F.lit(";"))
    nations = g.t["nation"].select(name(k).alias("a"), name(k + F.when(k % 3 == 0, 1).otherwise(0)).alias("b"))
    rows = g.shifted("c").unionByName(g.shifted("s", 3)).unionByName(g.truth("o").where("k % 4 <> 0").select("a", "b")).unionByName(nations)
    matchers = F.when(F.col("a").startswith("LX/c"), F.array(F.lit("m1"))).when(F.col("a").startswith("LX/o"), F.array(F.lit("m1"), F.lit("m2"), F.lit("m3"))).otherwise(F.array(F.lit("m2"), F.lit("m3")))
    return rows.select("a", "b", F.lit(0.9).alias("confidence"), F.lit(False).alias("locked"), matchers.alias("matchers"))


_MIXED = f"""m AS ({_shifted_sql('c')} UNION ALL {_shifted_sql('s', 3)} UNION ALL SELECT {_ref('o', 'o_orderkey', 'a')}, {_ref('o', 'o_orderkey', 'b')} FROM orders WHERE o_orderkey % 4 <> 0
    UNION ALL SELECT 'Lnation/' || n_nationkey || ';', 'Lnation/' || (n_nationkey + CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END) || ';' FROM nation)"""


def _measure(part: Callable) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir)
        return part(_mixed(g), *g.projects())

    return query


register("h_anchor", _measure(harness.anchors), f"""WITH {_N}, {_MIXED},
    s AS (SELECT a, b FROM m WHERE a NOT LIKE 'LX/%')
    SELECT (SELECT count(*) FROM nation) AS stable_total, count(*) FILTER (a = b) AS recovered, count(*) FILTER (a = b) / count(*) AS precision, count(*) FILTER (a = b) / (SELECT count(*) FROM nation) AS recall FROM s""")
register("h_neighbour", _measure(lambda mapping, a, b: harness.neighbour_consistency(mapping, a, b).select(F.round("neighbour_consistency", 6).alias("neighbour_consistency"))), _GRAPH + f""", {_MIXED},
    near AS (SELECT m.a, m.b, count(*) AS n, count(lb.src) AS hits FROM m JOIN la ON la.src = m.a JOIN m x ON x.a = la.dst LEFT JOIN lb ON lb.src = m.b AND lb.dst = x.b GROUP BY m.a, m.b)
    SELECT round(avg(hits / n), 6) AS neighbour_consistency FROM near""")
register("h_histogram", _measure(lambda mapping, a, b: harness.agreement(mapping).select(F.col("matchers").cast("long").alias("matchers"), "pairs")), f"""WITH {_N}, {_MIXED}
    SELECT CAST(CASE WHEN a LIKE 'LX/c%' THEN 1 WHEN a LIKE 'LX/o%' THEN 3 ELSE 2 END AS BIGINT) AS matchers, count(*) AS pairs FROM m GROUP BY ALL""")
register("h_coverage", _measure(lambda mapping, a, b: harness.coverage(mapping.dropDuplicates(["b"]), a, b).select("a_obfuscated_matched", F.col("a_obfuscated_total").cast("long").alias("a_obfuscated_total"), F.round("b", 6).alias("b"))), f"""WITH {_N}, {_MIXED},
    known AS (SELECT DISTINCT b FROM m WHERE b <> 'LX/c-1;' AND b <> 'LX/s-1;' AND b <> 'Lnation/25;')
    SELECT (SELECT count(DISTINCT b) FROM m WHERE a LIKE 'LX/%') AS a_obfuscated_matched, c + s + p + o AS a_obfuscated_total, round((SELECT count(*) FROM known) / (c + s + p + o + 25), 6) AS b FROM n""")
register("h_one_to_one", _measure(lambda mapping, a, b: harness.one_to_one(mapping).select(F.round("one_to_one_ratio", 6).alias("one_to_one_ratio"))), f"""WITH {_N}, {_MIXED}
    SELECT round(count(DISTINCT b) / count(*), 6) AS one_to_one_ratio FROM m""")


def h_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    a, b = g.projects()
    report = harness.evaluate(_mixed(g), a, b, {"m1": {"proposed": 10, "rejected": 3}, "m2": {"proposed": 5, "rejected": 3}})
    return spark.createDataFrame([(round(report["ambiguity_rate"], 6), round(report["overall_score"], 6), round(report["multi_matcher_agreement"]["mean_matchers_per_pair"], 6))], "ambiguity_rate double, overall_score double, mean_matchers double")


register("h_overall", h_overall, _GRAPH + f""", {_MIXED},
    near AS (SELECT m.a, m.b, count(*) AS n, count(lb.src) AS hits FROM m JOIN la ON la.src = m.a JOIN m x ON x.a = la.dst LEFT JOIN lb ON lb.src = m.b AND lb.dst = x.b GROUP BY m.a, m.b),
    parts AS (
        SELECT (SELECT count(*) FILTER (a = b) / count(*) FROM m WHERE a NOT LIKE 'LX/%') AS prec, (SELECT avg(hits / n) FROM near) AS near,
               (SELECT count(*) FILTER (a = b) FROM m WHERE a NOT LIKE 'LX/%') / 25 AS recall, (SELECT count(*) FROM m) / (SELECT c + s + p + o + 25 FROM n) AS cover,
               (SELECT avg(CASE WHEN a LIKE 'LX/c%' THEN 1 WHEN a LIKE 'LX/o%' THEN 3 ELSE 2 END) FROM m) AS mean)
    SELECT CAST(0.4 AS DOUBLE) AS ambiguity_rate, round(0.3 * prec + 0.25 * near + 0.15 * recall + 0.2 * cover + 0.1 * least(mean / 5, 1), 6) AS overall_score, round(mean, 6) AS mean_matchers FROM parts""")


def h_long_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under readable names, paired with the next one."""
    a, b = docs(spark, sf_dir)
    readable = lambda p, side: Project(p.records.withColumn("id", F.concat(F.lit(f"L{side}"), F.substring("id", 5, 100))), p.prefix)
    a, b = readable(a, "a"), readable(b, "b")
    k = F.regexp_extract("cid", "([0-9]+)", 1).cast("long")
    mapping = a.classes.select(F.col("cid").alias("a"), F.concat(F.lit("Lb"), (k + 1).cast("string"), F.lit(";")).alias("b"), F.array(F.concat(F.lit("m"), (k % 3).cast("string"))).alias("matchers"))
    n = [F.col(c).cast("long").alias(c) for c in ("n", "correct", "maybe", "wrong", "unknown")]
    return harness.long_range(mapping, a, b).select("matcher_id", *n, F.round("precision_estimate", 6).alias("precision_estimate"))


register("h_long_range", h_long_range, f"""WITH d AS (SELECT doc_id, list_distinct(list_filter({_WORDS}, lambda x: length(x) >= 6)) AS ws FROM documents),
    q AS (SELECT x.doc_id, x.ws AS wa, y.ws AS wb, len(list_intersect(x.ws, y.ws)) / len(x.ws) AS part FROM d x LEFT JOIN d y ON y.doc_id = x.doc_id + 1 WHERE x.doc_id % 2 = 0 AND len(x.ws) >= 2),
    l AS (SELECT 'm' || (doc_id % 3) AS matcher_id, CASE WHEN wb IS NULL OR len(wb) = 0 THEN 'unknown' WHEN part >= 0.5 THEN 'correct' WHEN part < 0.2 THEN 'wrong' ELSE 'maybe' END AS label FROM q),
    c AS (SELECT matcher_id, count(*) AS n, count(*) FILTER (label = 'correct') AS correct, count(*) FILTER (label = 'maybe') AS maybe, count(*) FILTER (label = 'wrong') AS wrong, count(*) FILTER (label = 'unknown') AS unknown FROM l GROUP BY ALL)
    SELECT *, round(correct / greatest(1, correct + wrong), 6) AS precision_estimate FROM c""")


def engine_nine_matchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule with nine of the matchers, in batch sweeps, at most three of tier 3, and without the second pass."""
    g = graph(spark, sf_dir)
    use = [m for m in content.content_matchers() if m.id in ("fqn_stable", "unique_string", "strings_plus_refs")]
    use += [m for m in structure.structure_matchers() if m.id in ("lockstep_n2", "reverse_lockstep_n2", "super_lx_vote_n2", "field_position_lx_vote_n1", "implemented_by_lockstep_n1", "neighbour_vote_w_n4")]
    # Many sweeps ask the same builds, so these are kept.
    a, b = (Project(p.records, p.prefix, unique=p.unique) for p in g.projects())
    result = Engine(a, b, matchers=use, batch_sweeps=True, tier3_max_iters=3, tier3_quiet_epochs=1, two_pass=False).run()
    return result.mapping.select("a", "b", F.round("confidence", 6).alias("confidence"), "locked")


register("engine_nine_matchers", engine_nine_matchers)


def unique_token_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even and odd documents by the words that one document of each side has, committed one to one."""
    a, b = docs(spark, sf_dir)
    found = Matcher("unique_string", 2, content.unique_string(6)).candidates(a, b)
    return commit(State.empty(spark), found, a, b)[0].mapping.select("a", "b", F.round("confidence", 6).alias("confidence"), "locked")


register("unique_token_mapping", unique_token_mapping)
