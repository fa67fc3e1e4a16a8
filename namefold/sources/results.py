"""Result documents: parts as Parquet, or one JSON object."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namefold.operators.members import field_mapping, method_mapping
from namefold.plans.engine import Engine, Result
from namefold.schema import MAPPING


def summary(engine: Engine, result: Result, load_seconds: float = 0.0, run_seconds: float = 0.0) -> dict:
    a, b, n = engine.a.classes.count(), engine.b.classes.count(), result.mapping.count()
    return {"a_total": a, "b_total": b, "matched": n, "a_coverage": n / a if a else 0.0, "b_coverage": n / b if b else 0.0, "epochs": result.epochs, "converged": result.converged, "load_seconds": round(load_seconds, 2), "run_seconds": round(run_seconds, 2)}


def write_parts(engine: Engine, result: Result, path: str, about: dict) -> None:
    """mapping, method_mapping and field_mapping as Parquet below ``path``, with the summary and statistics as JSON."""
    result.mapping.write.mode("overwrite").parquet(f"{path}/mapping")
    method_mapping(engine.a, engine.b, result.mapping).write.mode("overwrite").parquet(f"{path}/method_mapping")
    field_mapping(engine.a, engine.b, result.mapping).write.mode("overwrite").parquet(f"{path}/field_mapping")
    head = {"summary": about, "matcher_stats": result.matcher_stats, "validator_stats": result.validator_stats}
    engine.a.records.sparkSession.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def document(engine: Engine, result: Result, about: dict) -> dict:
    """The single document; it holds the whole mapping, so it is for results that fit the driver."""
    rows = lambda df: [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).collect()]
    return {"summary": about, "matcher_stats": result.matcher_stats, "validator_stats": result.validator_stats, "mapping": rows(result.mapping), "method_mapping": rows(method_mapping(engine.a, engine.b, result.mapping)), "field_mapping": rows(field_mapping(engine.a, engine.b, result.mapping))}


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, dict, dict]:
    """(mapping, summary, matcher_stats) of a single-document result."""
    text = spark.read.text(path, wholetext=True).first()[0]
    body = json.loads(text)
    rows = [(m["a"], m["b"], float(m["confidence"]), bool(m.get("locked")), list(m["matchers"])) for m in body["mapping"]]
    return spark.createDataFrame(rows, MAPPING), body.get("summary", {}), body.get("matcher_stats", {})
