"""Fixed schemas: the class record, candidates and the mapping."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
REF_NAME = T.ArrayType(T.StructType([T.StructField("cls", _S), T.StructField("name", _S)]))


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.ArrayType(_S)) for n in names]


METHOD = T.StructType([
    T.StructField("sig", _S), T.StructField("name", _S), T.StructField("native", T.BooleanType()),
    T.StructField("bh", _S), T.StructField("bha", _S),
    *(T.StructField(n, REF_NAME) for n in ("calls", "calls_full", "facc", "facc_typed")),
    *_strings("strs"), T.StructField("br", T.IntegerType()), *_strings("body_lx"),
])

CLASS = T.StructType([
    T.StructField("id", _S), T.StructField("super", _S), *_strings("impls", "mods"),
    *(T.StructField(n, T.IntegerType()) for n in ("nf", "nm", "ns", "nn")),
    *_strings("strings", "anns"), T.StructField("bucket", _S),
    *_strings("sigs", "bh", "calls", "facc", "trefs", "native_syms"),
    T.StructField("call_targets", REF_NAME), T.StructField("field_targets", REF_NAME),
    T.StructField("methods", T.ArrayType(METHOD)),
    T.StructField("line_refs", T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("cls", _S)]))),
    *_strings("field_types", "kotlin_meta", "annotation_values"),
])

CANDIDATE = "a string, b string, confidence double, matcher_id string, tier int"
MAPPING = "a string, b string, confidence double, locked boolean, matchers array<string>"
PAIR = "a string, b string"
