"""Class records as JSON lines, with pairs as two-element arrays, and as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namefold.schema import CLASS, METHOD, REF_NAME
from namefold.sources.smali import scan_tree

_PAIRS = T.ArrayType(T.ArrayType(T.StringType()))


def _raw(schema: T.StructType) -> T.StructType:
    """The schema with each list of pairs as a list of lists of strings."""
    def kind(t: T.DataType) -> T.DataType:
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            return T.ArrayType(_raw(t.elementType)) if t.elementType == METHOD else _PAIRS
        return t

    return T.StructType([T.StructField(f.name, kind(f.dataType)) for f in schema])


def _named(pairs: Column, first: str = "cls", second: str = "name", cast: str = "string") -> Column:
    return F.transform(F.coalesce(pairs, F.array().cast("array<array<string>>")), lambda p: F.struct(p[0].cast(cast).alias(first), p[1].alias(second)))


def _listed(pairs: Column, first: str = "cls", second: str = "name") -> Column:
    return F.transform(pairs, lambda p: F.array(p[first].cast("string"), p[second]))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records with the full schema; keys that a line lacks are empty lists."""
    raw = spark.read.schema(_raw(CLASS)).json(path)
    fields = {f.name: f.dataType for f in CLASS}
    columns = []
    for name, kind in fields.items():
        value = F.col(name)
        if name == "methods":
            inner = lambda m: F.struct(*((_named(m[f.name]) if f.dataType == REF_NAME else m[f.name]).alias(f.name) for f in METHOD))
            value = F.transform(F.coalesce(value, F.array().cast(_raw(CLASS)["methods"].dataType)), inner)
        elif name == "line_refs":
            value = _named(value, "line", "cls", "int")
        elif kind == REF_NAME:
            value = _named(value)
        elif isinstance(kind, T.ArrayType):
            value = F.coalesce(value, F.array().cast(kind))
        columns.append(value.cast(kind).alias(name))
    return raw.select(*columns)


def write_jsonl(records: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a line, in the layout that read_jsonl takes."""
    columns = []
    for f in CLASS:
        value = F.col(f.name)
        if f.name == "methods":
            value = F.transform(value, lambda m: F.struct(*((_listed(m[x.name]) if x.dataType == REF_NAME else m[x.name]).alias(x.name) for x in METHOD)))
        elif f.name == "line_refs":
            value = _listed(value, "line", "cls")
        elif f.dataType == REF_NAME:
            value = _listed(value)
        columns.append(value.alias(f.name))
    records.select(*columns).write.mode(mode).json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A written index: JSON lines if the name says so, else Parquet."""
    return read_jsonl(spark, path) if path.endswith((".jsonl", ".json")) else spark.read.schema(CLASS).parquet(path)


def write_index(records: DataFrame, path: str, mode: str = "error") -> None:
    if path.endswith((".jsonl", ".json")):
        write_jsonl(records, path, mode)
    else:
        records.write.mode(mode).parquet(path)


def index_tree(spark: SparkSession, tree: str, out: str, prefix: str = "LX/") -> None:
    write_index(scan_tree(spark, tree, prefix), out, "overwrite")


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def cached_index(spark: SparkSession, tree: str, path: str, force: bool = False) -> DataFrame:
    """The index of a tree, made unless it is there already."""
    if force or not exists(spark, path):
        index_tree(spark, tree, path)
    return read_index(spark, path)
