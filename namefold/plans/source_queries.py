"""Sources and sinks, each over files that the query writes from the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namefold.functions import refs
from namefold.plans.adapters import graph
from namefold.plans.engine import Engine, Result
from namefold.plans.registry import register
from namefold.plans.storage import work_dir
from namefold.sources import index, results, smali


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """A tree of one class file for each supplier, in two folders, with the nations' names as resources."""
    root = work_dir(spark)
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey")
    body = F.concat(
        F.lit(".class public final LX/s"), k, F.lit(";\n.super Lnation/"), n.cast("string"), F.lit(";\n.implements Lcom/acme/Kept;\n.field static count:I\n.field owner:[LX/n"), n.cast("string"),
        F.lit(";\n.method public m"), k, F.lit("(I)V\n    .line 7\n    const-string v0, \""), F.col("s_name"), F.lit("\"\n    invoke-static {v0}, Lcom/acme/S"), n.cast("string"),
        F.lit(";->say(I)V\n    const v1, 0x7f01"), F.lpad(F.lower(F.hex(n)), 4, "0"), F.repeat(F.lit("\n    if-eqz v0, :c"), (F.col("s_suppkey") % 3).cast("int")),
        F.lit("\n    return-void\n.end method\n.method public native nat"), k, F.lit("()V\n.end method\n"))
    files = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("smali_"), (F.col("s_suppkey") % 2).cast("string"), F.lit("/LX/s"), k, F.lit(".smali")).alias("path"), body.alias("text"))
    entry = F.concat(F.lit('<public type="string" name="n'), F.col("n_nationkey").cast("string"), F.lit('" id="0x7f01'), F.lpad(F.lower(F.hex("n_nationkey")), 4, "0"), F.lit('"/>'))
    literal = F.concat(F.lit('<string name="n'), F.col("n_nationkey").cast("string"), F.lit('">'), F.col("n_name"), F.lit("</string>"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    whole = lambda name, rows, text: rows.agg(F.array_join(F.array_sort(F.collect_list(text)), "").alias("x")).select(F.lit(f"res/values/{name}.xml").alias("path"), F.concat(F.lit("<resources>"), "x", F.lit("</resources>")).alias("text"))
    files = files.unionByName(whole("public", nations, entry)).unionByName(whole("strings", nations.where("n_nationkey % 2 = 0"), literal))
    smali.write_tree(files, root)
    return root


def _told(records: DataFrame) -> DataFrame:
    names = lambda c: F.array_join(c, ",").alias(c)
    size = lambda c: F.col(c).cast("long").alias(c)
    m = F.col("methods")
    return records.select(
        "id", "super", "bucket", *(size(c) for c in ("nf", "nm", "ns", "nn")), *(names(c) for c in ("impls", "mods", "strings", "calls", "trefs", "native_syms", "sigs", "field_types")),
        F.array_join(F.transform("call_targets", lambda x: F.concat(x["cls"], F.lit("->"), x["name"])), ",").alias("call_targets"), F.array_join(F.transform("line_refs", lambda x: F.concat(x["line"].cast("string"), F.lit("@"), x["cls"])), ",").alias("line_refs"),
        F.aggregate(m, F.lit(0), lambda n, x: n + x["br"]).cast("long").alias("branches"), F.size(F.filter(m, lambda x: x["bha"] != "")).cast("long").alias("bodies"))


_TREE = """SELECT 'LX/s' || s_suppkey || ';' AS id, 'Lnation/' || s_nationkey || ';' AS super, 'smali_' || (s_suppkey % 2) AS bucket, CAST(2 AS BIGINT) AS nf, CAST(2 AS BIGINT) AS nm, CAST(1 AS BIGINT) AS ns, CAST(1 AS BIGINT) AS nn,
        'Lcom/acme/Kept;' AS impls, 'final,public' AS mods, s_name || ',R.string' || CASE WHEN s_nationkey % 2 = 0 THEN '=' || n_name ELSE '' END AS strings,
        'Lcom/acme/S' || s_nationkey || ';' AS calls, '' AS trefs, 'nat' || s_suppkey AS native_syms, 'm' || s_suppkey || '(I)V,nat' || s_suppkey || '()V' AS sigs, 'I,[LX/n' || s_nationkey || ';' AS field_types,
        'Lcom/acme/S' || s_nationkey || ';->say' AS call_targets, '7@Lcom/acme/S' || s_nationkey || ';' AS line_refs, s_suppkey % 3 AS branches, CAST(1 AS BIGINT) AS bodies
    FROM supplier JOIN nation ON n_nationkey = s_nationkey"""


def tree_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree, indexed as JSON lines and read back."""
    out = f"{work_dir(spark)}/a.jsonl"
    index.index_tree(spark, _tree(spark, sf_dir), out)
    return _told(index.read_index(spark, out))


def tree_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree's Parquet index, made by the first call and only read by the second, which has no tree."""
    out = f"{work_dir(spark)}/a.parquet"
    index.cached_index(spark, _tree(spark, sf_dir), out)
    return _told(index.cached_index(spark, f"{out}-without-tree", out))


register("tree_scan", lambda spark, sf_dir: _told(smali.scan_tree(spark, _tree(spark, sf_dir))), _TREE)
register("tree_jsonl", tree_jsonl, _TREE)
register("tree_cached", tree_cached, _TREE)
register("resource_scan", lambda spark, sf_dir: spark.createDataFrame(list(smali.load_resources(spark, _tree(spark, sf_dir)).items()), "id long, token string"),
         "SELECT CAST(2130771968 + n_nationkey AS BIGINT) AS id, 'R.string' || CASE WHEN n_nationkey % 2 = 0 THEN '=' || n_name ELSE '' END AS token FROM nation")


def _result(spark: SparkSession, sf_dir: str) -> tuple[Engine, Result]:
    """Suppliers and nations as if matched, in builds that share their tables."""
    g = graph(spark, sf_dir)
    return Engine(*g.projects()), Result(g.partial("s"), spark.createDataFrame([], "a string, b string"), {"seed": {"proposed": 7}}, {}, 3, True)


def result_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, result = _result(spark, sf_dir)
    path = f"{work_dir(spark)}/result"
    body = results.document(engine, result, results.summary(engine, result))
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.text(path)
    mapping, about, stats = results.read_document(spark, path)
    return mapping.select("a", "b", "confidence", "locked", F.array_join("matchers", ",").alias("matchers"), F.lit(about["matched"]).alias("matched"), F.lit(stats["seed"]["proposed"]).alias("proposed"))


def result_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, result = _result(spark, sf_dir)
    path = f"{work_dir(spark)}/parts"
    results.write_parts(engine, result, path, results.summary(engine, result))
    about = json.loads(spark.read.text(f"{path}/summary").first()[0])
    return spark.read.parquet(f"{path}/mapping").select("a", "b", "confidence", "locked", F.array_join("matchers", ",").alias("matchers"), F.lit(about["summary"]["matched"]).alias("matched"), F.lit(about["matcher_stats"]["seed"]["proposed"]).alias("proposed"))


_MAPPED = """WITH m AS (
        SELECT 'LX/s' || s_suppkey || ';' AS a, 'LX/s' || ((s_suppkey * 7919 + 13) % (SELECT count(*) FROM supplier)) || ';' AS b FROM supplier WHERE s_suppkey % 4 <> 0
        UNION ALL SELECT 'Lnation/' || n_nationkey || ';', 'Lnation/' || n_nationkey || ';' FROM nation)
    SELECT a, b, CAST(0.9 AS DOUBLE) AS confidence, a NOT LIKE 'LX/%' AS locked, 'seed,seed2' AS matchers, CAST((SELECT count(*) FROM m) AS INT) AS matched, 7 AS proposed FROM m"""
register("result_document", result_document, _MAPPED)
register("result_parts", result_parts, _MAPPED)


def sig_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The obfuscated references in the orders' signatures by their position."""
    a, _ = graph(spark, sf_dir).projects()
    rows = a.classes.select(F.explode("sigs").alias("sig")).select(F.explode(refs.positions(F.col("sig"), a.prefix)).alias("x"))
    return rows.groupBy(F.col("x.pos").cast("long").alias("pos"), F.col("x.ref").alias("ref")).agg(F.count("*").alias("n"))


register("sig_positions", sig_positions, """SELECT CAST(1 AS BIGINT) AS pos, 'LX/p' || l_partkey || ';' AS ref, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey
    UNION ALL SELECT CAST(4 AS BIGINT), 'LX/s' || l_suppkey || ';', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_suppkey""")
