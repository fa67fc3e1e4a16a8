"""One build as DataFrames: its class records and what is derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBF_PREFIX = "LX/"
#: Edge kinds and the weight of each in the weighted vote.
EDGE_WEIGHTS = {"extends": 4, "implements": 4, "annotation": 3, "field_access": 2, "type_ref": 2, "call": 1}
MERGE_INTERFACE = r"^Lkotlin/jvm/functions/Function[0-9]+;$"


class Project:
    """The records of a build, one per id, and its satellites.

    With ``keep`` each satellite is computed once and kept. Without, it is computed where it is used, from the columns
    that are used there: for one matcher over records that come from large tables. ``unique`` tells that no id repeats,
    which is looked up otherwise.
    """

    def __init__(self, records: DataFrame, obf_prefix: str = OBF_PREFIX, keep: bool = True, unique: bool = False) -> None:
        self.records, self.prefix, self.keep, self.unique = records, obf_prefix, keep, unique
        self._kept: list[DataFrame] = []

    def _keep(self, df: DataFrame) -> DataFrame:
        if self.keep:
            self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def unpersist(self) -> None:
        for df in self._kept:
            df.unpersist()

    @cached_property
    def classes(self) -> DataFrame:
        """Of records with one id, the one with the greatest content stays; ``duplicates`` counts the others."""
        if self.unique or self.duplicates.isEmpty():  # whole records are neither shuffled nor hashed, and unused columns not made
            return self._keep(self.records.withColumnRenamed("id", "cid"))
        order = Window.partitionBy("id").orderBy(F.xxhash64(*self.records.columns).desc())
        return self._keep(self.records.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").withColumnRenamed("id", "cid"))

    @property
    def duplicates(self) -> DataFrame:
        return self.records.groupBy("id").count().where("count > 1")

    def obfuscated(self, column: Column | str) -> Column:
        return (F.col(column) if isinstance(column, str) else column).startswith(self.prefix)

    @staticmethod
    def _targets() -> dict[str, Column]:
        """What a class refers to, by kind of edge."""
        return {"extends": F.array("super"), "implements": F.col("impls"), "call": F.col("calls"), "field_access": F.col("facc"), "type_ref": F.col("trefs"), "annotation": F.col("anns")}

    @cached_property
    def edges(self) -> DataFrame:
        """Distinct (src, dst, kind) whose both ends are classes of the build."""
        def tagged(kind: str, targets: Column) -> Column:
            return F.transform(F.coalesce(targets, F.array().cast("array<string>")), lambda r: F.struct(r.alias("dst"), F.lit(kind).alias("kind")))

        # A class is one record, so its edges are distinct if those of its record are.
        every = F.array_distinct(F.flatten(F.array(*(tagged(kind, targets) for kind, targets in self._targets().items()))))
        raw = self.classes.select(F.col("cid").alias("src"), F.explode(every).alias("e")).select("src", "e.dst", "e.kind").where("dst is not null")
        return self._keep(raw.join(self.classes.select(F.col("cid").alias("dst")), "dst", "left_semi").select("src", "dst", "kind"))

    def targets(self) -> DataFrame:
        """(cid, to): all classes with the distinct names that they refer to, also those of no class of the build."""
        empty = F.array().cast("array<string>")
        every = F.array_distinct(F.concat(*(F.coalesce(x, empty) for x in self._targets().values())))
        return self.classes.select("cid", F.filter(every, lambda x: x.isNotNull()).alias("to"))

    @cached_property
    def links(self) -> DataFrame:
        """Distinct (src, dst) over all kinds."""
        if self.keep:
            return self._keep(self.edges.select("src", "dst").distinct())
        raw = self.targets().select(F.col("cid").alias("src"), F.explode("to").alias("dst"))
        return raw.join(self.classes.select(F.col("cid").alias("dst")), "dst", "left_semi").select("src", "dst")

    @cached_property
    def methods(self) -> DataFrame:
        """One row per method, numbered within its class."""
        return self._keep(self.classes.select("cid", F.posexplode("methods").alias("midx", "m")).select("cid", "midx", "m.*"))

    @cached_property
    def strings(self) -> DataFrame:
        """Distinct (cid, s) of literals of four and more characters, the inverted index."""
        return self._keep(self.classes.select("cid", F.explode(F.array_distinct("strings")).alias("s")).where(F.length("s") >= 4))

    def string_frequency(self) -> DataFrame:
        return self.strings.groupBy("s").count()

    def classes_containing_string(self, s: str) -> DataFrame:
        return self.strings.where(F.col("s") == s).select("cid")

    def classes_with_native_symbol(self, name: str) -> DataFrame:
        return self.classes.where(F.array_contains("native_syms", name)).select("cid")

    def classes_with_annotation(self, ref: str) -> DataFrame:
        return self.classes.where(F.array_contains("anns", ref)).select("cid")

    def neighbours(self, cid: str, kind: str | None = None) -> DataFrame:
        return (self.edges if kind is None else self.edges.where(F.col("kind") == kind)).where(F.col("src") == cid).select("dst").distinct()

    def reverse_neighbours(self, cid: str, kind: str | None = None) -> DataFrame:
        return (self.edges if kind is None else self.edges.where(F.col("kind") == kind)).where(F.col("dst") == cid).select("src").distinct()

    def stable_refs(self, repeats: bool = True) -> Column:
        """Unobfuscated references of a class in all its roles."""
        empty = F.array().cast("array<string>")
        every = F.concat(F.filter(F.array("super"), lambda x: x.isNotNull() & (x != "")), *(F.coalesce(F.col(c), empty) for c in ("impls", "calls", "facc", "trefs", "anns")))
        found = F.filter(every, lambda x: (x != "") & ~x.startswith(self.prefix))
        return found if repeats else F.array_distinct(found)

    def body_refs(self) -> Column:
        """Unobfuscated references of bodies and signatures."""
        return F.array_distinct(F.filter(F.concat("calls", "facc", "trefs"), lambda x: ~x.startswith(self.prefix)))

    @cached_property
    def merges(self) -> DataFrame:
        """Ids of lambda-merge containers: a function interface, a constructor with an I among its parameters, and
        an invoke method with five branches or more."""
        params = lambda m: F.regexp_extract(m["sig"], r"\(([^)]*)\)", 1)
        ctor = F.exists("methods", lambda m: m["sig"].startswith("<init>") & params(m).contains("I"))
        branches = F.exists("methods", lambda m: (m["name"] == "invoke") & (m["br"] >= 5))
        return self._keep(self.classes.where(F.exists("impls", lambda i: i.rlike(MERGE_INTERFACE)) & ctor & branches).select("cid"))

    def substitute(self, mapping: DataFrame) -> Project:
        """The build with obfuscated references replaced by their images; ids and methods stay."""
        from namefold.functions.refs import kept, resolved, substituted

        one = F.filter(F.array("super"), lambda x: x.isNotNull())
        sides = {"super": one} | {c: F.col(c) for c in ("impls", "calls", "facc", "trefs", "anns")}
        sides |= {"call_cls": F.transform("call_targets", lambda x: x["cls"]), "field_cls": F.transform("field_targets", lambda x: x["cls"]), "line_cls": F.transform("line_refs", lambda x: x["cls"])}
        base = self.classes
        found = resolved(base, ["cid"], mapping, self.prefix, **{f"_{k}": v for k, v in sides.items()})
        texts = base.select("cid", F.explode_outer(F.concat("sigs", "field_types")).alias("sig"))
        table = substituted(texts.where("sig is not null"), mapping, self.prefix)
        order = base.select("cid", F.posexplode(F.concat(F.transform("sigs", lambda s: F.struct(F.lit(0).alias("k"), s.alias("sig"))), F.transform("field_types", lambda s: F.struct(F.lit(1).alias("k"), s.alias("sig"))))).alias("pos", "x")).select("cid", "pos", "x.k", "x.sig")
        lists = order.join(table.select("sig", "keep"), "sig").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("pos", "k", "keep"))).alias("xs"))
        pick = lambda k: F.transform(F.filter("xs", lambda x: x["k"] == k), lambda x: x["keep"])
        lists = lists.select("cid", pick(0).alias("_sigs"), pick(1).alias("_field_types"))
        out = base.join(found, "cid").join(lists, "cid", "left")
        empty = F.array().cast("array<string>")
        new = {"super": F.coalesce(F.get(kept(F.col("_super")), F.lit(0)), F.col("super")), "impls": kept(F.col("_impls")), "anns": kept(F.col("_anns"))}
        new |= {c: F.array_sort(F.array_distinct(kept(F.col(f"_{c}")))) for c in ("calls", "facc", "trefs")}
        new |= {"sigs": F.coalesce("_sigs", empty), "field_types": F.coalesce("_field_types", empty)}
        named = lambda xs, cls: F.zip_with(xs, kept(F.col(cls)), lambda x, c: F.struct(c.alias("cls"), x["name"].alias("name")))
        new |= {"call_targets": named("call_targets", "_call_cls"), "field_targets": named("field_targets", "_field_cls"), "line_refs": F.zip_with("line_refs", kept(F.col("_line_cls")), lambda x, c: F.struct(x["line"].alias("line"), c.alias("cls")))}
        return Project(out.withColumns(new).select(*base.columns).withColumnRenamed("cid", "id"), self.prefix)
