"""Disassembled class files and resource tables as DataFrames."""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namefold.schema import CLASS

#: Access flags that are kept, and the annotation that names Kotlin sources.
FLAGS = frozenset("public private protected static final abstract interface enum annotation synthetic native bridge varargs".split())
KOTLIN_METADATA = "Lkotlin/coroutines/jvm/internal/DebugMetadata;"
#: Value files by the resource type whose literals they hold.
VALUE_FILES = {"strings": "string", "bools": "bool", "integers": "integer", "dimens": "dimen", "colors": "color", "drawables": "drawable", "ids": "id"}
LITERAL_CHARS = 80
BRANCHES = ("if-", "packed-switch", "sparse-switch", "goto")
REGISTER = re.compile(r"[vp][0-9]+\Z")
PARAM_REF = re.compile(r"L[^;]*;")


def is_ref(text: str) -> bool:
    return text.startswith("L") and text.endswith(";")


def quoted(line: str) -> str | None:
    """What stands between the first and the last quote."""
    _, first, rest = line.partition('"')
    value, last, _ = rest.rpartition('"')
    return value if first and last else None


def instruction(line: str, drop_lists: bool = False) -> str:
    """Opcode and operands without registers and labels. A list of one register goes; longer lists are split at
    their commas and leave parts behind, unless ``drop_lists``."""
    op, rest = (line.split(None, 1) + [""])[:2]
    if drop_lists:
        rest = re.sub(r"\{[^}]*\}", "{}", rest)
    kept = []
    for part in map(str.strip, rest.split(", ")):
        if part and not REGISTER.match(part) and part[0] != ":" and not (part[0] == "{" and part[-1] == "}"):
            kept.append(part)
    return " ".join([op, *kept])


def digest(lines: list[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(lines)).encode(), digest_size=8).hexdigest()


class ClassText:
    """One class file, read line by line into the class record."""

    def __init__(self, bucket: str, resources: dict[int, str], prefix: str, drop_lists: bool = False) -> None:
        self.resources, self.prefix, self.drop_lists = resources, prefix, drop_lists
        self.anonymous = re.compile(re.escape("L" + prefix[1:]) + r"[^;]*;")
        lists = ("impls", "strings", "anns", "sigs", "bh", "native_syms", "call_targets", "field_targets", "methods", "line_refs", "field_types", "kotlin_meta", "annotation_values")
        self.r: dict = {"id": None, "super": None, "bucket": bucket, "nf": 0, "nm": 0, "ns": 0, "nn": 0} | {k: [] for k in lists}
        self.flags: set[str] = set()
        self.refs: dict[str, set[str]] = {"calls": set(), "facc": set(), "trefs": set()}
        self.method: dict | None = None
        self.body: list[str] = []
        self.annotation: str | None = None
        self.line = 0

    def record(self, text: str) -> dict | None:
        for line in map(str.strip, text.splitlines()):
            if line and line[0] != "#":
                (self.outside if self.method is None else self.inside)(line)
        if self.r["id"] is None:
            return None
        return self.r | {"mods": sorted(self.flags)} | {k: sorted(v - {self.r["id"]}) for k, v in self.refs.items()}

    # Lines of the class.

    def outside(self, line: str) -> None:
        word = line.split(None, 1)[0]
        rest = line[len(word) :]
        if word == ".class" and rest:
            *flags, self.r["id"] = rest.split()
            self.flags |= FLAGS.intersection(flags)
        elif word == ".super" and rest:
            self.r["super"] = rest.split()[-1]
        elif word == ".implements" and rest:
            self.r["impls"].append(rest.split()[-1])
        elif word == ".field" and rest:
            self.field(rest)
        elif word == ".method" and rest:
            self.start(rest)
        elif line.startswith(".annotation"):
            self.annotation = next(filter(is_ref, line.split()), "")
            if self.annotation:
                self.r["anns"].append(self.annotation)
        elif line.startswith(".end annotation"):
            self.annotation = None
        elif self.annotation == KOTLIN_METADATA:
            if line.startswith(('c = "', 'f = "')) and (value := quoted(line)) is not None:
                self.r["kotlin_meta"].append(f"{line[0]}={value}")
        elif self.annotation is not None and " = " in line.partition('"')[0]:
            value = quoted(line) or ""
            if 2 <= len(value) <= 80:
                self.r["annotation_values"].append(value)

    def field(self, rest: str) -> None:
        self.r["nf"] += 1
        self.r["ns"] += " static " in f"{rest} "
        kind = rest.rpartition(":")
        if kind[1] and kind[2].split():
            name = kind[2].split()[0]
            self.r["field_types"].append(name)
            if is_ref(name):
                self.refs["trefs"].add(name)

    def start(self, rest: str) -> None:
        sig, native = rest.split()[-1], " native " in f"{rest} "
        name = sig.partition("(")[0]
        self.r["nm"] += 1
        self.r["sigs"].append(sig)
        method = {"sig": sig, "name": name, "native": native, "bh": "", "bha": "", "calls": [], "calls_full": [], "facc": [], "facc_typed": [], "strs": [], "br": 0, "body_lx": []}
        if native:
            self.r["nn"] += 1
            self.r["native_syms"].append(name)
            self.r["methods"].append(method)
        else:
            self.method, self.body = method, []
        params, closed, result = sig.partition("(")[2].partition(")")
        if closed:
            self.refs["trefs"].update(PARAM_REF.findall(params))
            if is_ref(result):
                self.refs["trefs"].add(result)

    # Lines of a method.

    def inside(self, line: str) -> None:
        m = self.method
        if line.startswith(".end method"):
            if self.body:
                m["bh"] = digest(self.body)
                m["bha"] = digest([self.anonymous.sub(self.prefix[:-1] + ";", x) for x in self.body])
                self.r["bh"].append(m["bh"])
            self.r["methods"].append(m)
            self.method = None
            return
        if line.startswith("const-string"):
            value = quoted(line)
            if value is not None:
                m["strs"].append(value)
                self.r["strings"].append(value)
            return
        if line.startswith(".line "):
            number = line.split()[1:2]
            if number and re.fullmatch(r"[+-]?[0-9_]+", number[0]):
                self.line = int(number[0])
            return
        if line.startswith("invoke-"):
            self.call(m, *self.member(line))
        elif line[:4] in ("iget", "iput", "sget", "sput"):
            self.access(m, *self.member(line))
        elif line.startswith(BRANCHES):
            m["br"] += 1
        elif line.startswith(("new-instance ", "check-cast ", "instance-of ")):
            last = line.split()[-1]
            if is_ref(last):
                self.refs["trefs"].add(last)
                self.sequence(m, last)
        elif token := self.resource(line):
            self.r["strings"].append(token)
        self.body.append(instruction(line, self.drop_lists))

    @staticmethod
    def member(line: str) -> tuple[str, str]:
        """Class and member of ``... Lclass;->member``; empty if there is no such thing."""
        head, _, tail = line.partition("->")
        cls = head.rpartition(" ")
        return (cls[2], tail) if cls[1] and tail.strip() and is_ref(cls[2]) else ("", "")

    def sequence(self, m: dict, ref: str) -> None:
        if ref.startswith(self.prefix):
            m["body_lx"].append(ref)

    def call(self, m: dict, cls: str, tail: str) -> None:
        if not cls:
            return
        sig = tail.split()[0]
        name = sig.partition("(")[0]
        self.refs["calls"].add(cls)
        self.r["call_targets"].append((cls, name))
        m["calls"].append((cls, name))
        m["calls_full"].append((cls, sig))
        self.sequence(m, cls)
        if self.line and not cls.startswith(self.prefix):
            self.r["line_refs"].append((self.line, cls))

    def access(self, m: dict, cls: str, tail: str) -> None:
        if not cls:
            return
        self.refs["facc"].add(cls)
        name, colon, kind = tail.partition(":")
        if colon and kind.split():
            kind = kind.split()[0]
            self.r["field_targets"].append((cls, name))
            m["facc"].append((cls, name))
            m["facc_typed"].append((cls, kind))
            self.sequence(m, cls)
            self.sequence(m, kind)

    def resource(self, line: str) -> str | None:
        if line.startswith(("const ", "const/4 ", "const/16 ")):
            value = line.rpartition(", ")[2].strip() if ", " in line else ""
            if re.fullmatch(r"0x(7f|01)[0-9a-fA-F_]*", value):
                return self.resources.get(int(value, 16))
        return None


def parse_class(text: str, bucket: str, resources: dict[int, str] | None = None, prefix: str = "LX/", drop_lists: bool = False) -> dict | None:
    """The record of one class file; None without a .class line."""
    return ClassText(bucket, resources or {}, prefix, drop_lists).record(text)


def parse_resources(files: dict[str, str]) -> dict[int, str]:
    """Resource id to token from the texts of public.xml and the value files: type and literal, or the type alone."""
    literals: dict[str, dict[str, str]] = {}
    for name, kind in VALUE_FILES.items():
        try:
            root = ET.fromstring(files.get(name, "<resources/>"))
        except ET.ParseError:
            continue
        literals[kind] = {e.get("name"): (e.text or "").strip() for e in root if e.get("name")}
    out = {}
    for e in ET.fromstring(files["public"]).iter("public") if "public" in files else ():
        try:
            number = int(e.get("id", ""), 16)
        except ValueError:
            continue
        kind = e.get("type", "")
        value = literals.get(kind, {}).get(e.get("name", ""), "")
        out[number] = f"R.{kind}={value[:LITERAL_CHARS]}" if value else f"R.{kind}"
    return out


def load_resources(spark: SparkSession, root: str) -> dict[int, str]:
    """The resource tokens of a tree; empty without public.xml. One entry per resource id of the application."""
    path = f"{root.rstrip('/')}/res/values"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/public.xml")
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return {}
    names = ["public", *VALUE_FILES]
    glob = f"{path}/{{{','.join(names)}}}.xml"
    rows = spark.read.text(glob, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\w+)\.xml$", 1).alias("name"), "value").collect()
    return parse_resources({r["name"]: r["value"] for r in rows})


def scan_tree(spark: SparkSession, root: str, prefix: str = "LX/", drop_lists: bool = False) -> DataFrame:
    """Class records of all ``*.smali`` files below the folders of ``root`` whose names begin with smali."""
    resources = spark.sparkContext.broadcast(load_resources(spark, root))
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.smali").text(f"{root.rstrip('/')}/smali*", wholetext=True)
    base = root.rstrip("/").rpartition("/")[2]
    files = files.select("value", F.regexp_extract(F.col("_metadata.file_path"), rf"/{re.escape(base)}/(smali[^/]*)/", 1).alias("bucket"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = (parse_class(t, b, resources.value, prefix, drop_lists) for t, b in zip(batch["value"], batch["bucket"], strict=True))
            yield pd.DataFrame([r for r in found if r], columns=CLASS.fieldNames())

    return files.mapInPandas(parse, CLASS)


def write_tree(classes: DataFrame, root: str) -> None:
    """Write class files (path, text) below ``root``, each from the task that holds it."""
    from pyarrow import fs

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                system, local = fs.FileSystem.from_uri(f"{root.rstrip('/')}/{path}")
                system.create_dir(local.rpartition("/")[0], recursive=True)
                with system.open_output_stream(local) as f:
                    f.write(text.encode())
            yield pd.DataFrame({"files": [len(batch)]})

    classes.select("path", "text").mapInPandas(write, "files long").agg(F.sum("files")).collect()
