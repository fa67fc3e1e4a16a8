"""The driver's tables seen as two builds of one application.

``graph``: customers, orders, parts, suppliers and nations are classes. Build B is build A with every key k
replaced by (7919 k + 13) mod N, so the true mapping is known. ``docs``: the documents of even and of odd
ids are the two builds, and their words the literals.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namefold.operators.project import Project
from namefold.schema import CLASS, METHOD

FACTOR, SHIFT = 7919, 13
#: Table and key of each kind of class.
SOURCES = {"c": ("customer", "c_custkey"), "s": ("supplier", "s_suppkey"), "p": ("part", "p_partkey"), "o": ("orders", "o_orderkey")}


_MADE: dict[tuple, object] = {}


def once(make: Callable) -> Callable:
    """``make(spark, sf_dir, ...)``, made once in a session, so that queries share what its projects keep."""

    @functools.wraps(make)
    def made(spark: SparkSession, sf_dir: str, *args: object) -> object:
        key = (spark.sparkContext.applicationId, make.__qualname__, sf_dir, *args)
        if key not in _MADE:
            _MADE[key] = make(spark, sf_dir, *args)
        return _MADE[key]

    return made


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unique(df: DataFrame, key: Column) -> bool:
    return df.groupBy(key.alias("k")).count().where("count > 1").isEmpty()


def as_records(df: DataFrame) -> DataFrame:
    """The columns of the class record; those that ``df`` lacks are empty lists, zero or null."""
    columns = []
    for f in CLASS:
        kind = f.dataType.simpleString()
        if f.name in df.columns:
            columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif kind.startswith("array"):
            columns.append(F.array().cast(f.dataType).alias(f.name))
        elif kind == "int":
            columns.append(F.lit(0).alias(f.name))
        else:
            columns.append(F.lit(None if f.name == "super" else "").cast("string").alias(f.name))
    return df.select(*columns)


def moved(key: Column, n: int) -> Column:
    return F.pmod(key * FACTOR + SHIFT, F.lit(n))


class Graph:
    """Both builds over the tables of ``sf_dir``, and the true mapping.

    With ``rich``, orders also have their lines' suppliers as interfaces, their parts as annotations, and a method for
    each line that calls its part and reads its supplier; customers and suppliers have field counts of their own.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, rich: bool = False) -> None:
        self.spark, self.sf_dir, self.rich = spark, sf_dir, rich
        self.t = {n: _table(spark, sf_dir, n) for n in ("nation", "customer", "supplier", "part", "orders", "lineitem")}
        self.n = {k: self.t[t].count() for k, t in (("c", "customer"), ("s", "supplier"), ("p", "part"), ("o", "orders"))}

    def ref(self, kind: str, key: Column | str, side: str) -> Column:
        k = (F.col(key) if isinstance(key, str) else key).cast("long")
        return F.concat(F.lit(f"LX/{kind}"), (k if side == "a" else moved(k, self.n[kind])).cast("string"), F.lit(";"))

    def records(self, side: str) -> DataFrame:
        """Orders extend their customer, call their parts and access their suppliers; customers extend and suppliers
        implement their nation. Orders have a method for each line, parts a literal."""
        nation = lambda key: F.concat(F.lit("Lnation/"), F.col(key).cast("string"), F.lit(";"))
        nations = self.t["nation"].select(nation("n_nationkey").alias("id"), F.array("n_name").alias("strings"))
        size = lambda c: [(F.floor(F.abs(c)) % 97).cast("int").alias("nf")] if self.rich else []
        customers = self.t["customer"].select(self.ref("c", "c_custkey", side).alias("id"), nation("c_nationkey").alias("super"), F.array("c_mktsegment").alias("anns"), *size("c_acctbal"))
        suppliers = self.t["supplier"].select(self.ref("s", "s_suppkey", side).alias("id"), F.array(nation("s_nationkey")).alias("impls"), *size("s_acctbal"))
        parts = self.t["part"].select(self.ref("p", "p_partkey", side).alias("id"), F.array("p_type", F.concat_ws(" ", "p_name", "p_brand", F.round(F.col("p_retailprice") * 100).cast("long").cast("string"))).alias("strings"), F.col("p_size").alias("nf"))
        # Numbers are shuffled, the same for both sides, and names made behind. The order of lines must not depend on renamed keys.
        line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("k"))
        lines = self.t["lineitem"].select("l_orderkey", line.alias("x")).repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_list("x").alias("xs"))
        named = lambda x: F.struct(x["n"].alias("n"), self.ref("p", x["p"], "a").alias("pa"), x["k"].alias("k"), self.ref("p", x["p"], side).alias("p"), self.ref("s", x["k"], side).alias("s"))
        xs = F.sort_array(F.transform("xs", named))
        orders = self.t["orders"].join(lines.withColumn("xs", xs), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        orders = orders.withColumn("some", F.col("xs").isNotNull()).withColumn("xs", F.coalesce("xs", F.filter(F.array(F.col("xs")[0]), lambda x: F.lit(False))))
        sig = lambda x: F.concat(F.lit("m("), x["p"], F.lit("I)"), x["s"])
        rich = [F.when(F.col("some"), F.transform("xs", lambda x: x["s"])).alias("impls"), F.when(F.col("some"), F.transform("xs", lambda x: x["p"])).alias("anns"), F.transform("xs", _line_method).alias("methods")]
        orders = orders.select(
            self.ref("o", "o_orderkey", side).alias("id"), self.ref("c", "o_custkey", side).alias("super"),
            F.array_sort(F.array_distinct(F.transform("xs", lambda x: x["p"]))).alias("calls"), F.array_sort(F.array_distinct(F.transform("xs", lambda x: x["s"]))).alias("facc"),
            F.transform("xs", sig).alias("sigs"), F.transform("xs", lambda x: F.concat(F.lit("["), x["p"])).alias("field_types"), F.size("xs").alias("nm"), F.size("xs").alias("nf"),
            F.transform("xs", lambda x: F.struct(x["p"].alias("cls"), F.concat(F.lit("l"), x["n"].cast("string")).alias("name"))).alias("call_targets"),
            *(rich if self.rich else []),
        )
        made = as_records(nations)
        for df in (customers, suppliers, parts, orders):
            made = made.unionByName(as_records(df))
        return made

    @functools.cached_property
    def _projects(self) -> tuple[Project, Project]:
        sides = []
        for side in "ab":
            unique = all(_unique(self.t[t], self.ref(k, key, side)) for k, (t, key) in SOURCES.items()) and _unique(self.t["nation"], F.col("n_nationkey"))
            sides.append(Project(self.records(side), keep=False, unique=unique))
        return sides[0], sides[1]

    def projects(self) -> tuple[Project, Project]:
        return self._projects

    def truth(self, kinds: str = "cspo") -> DataFrame:
        """The true pairs of obfuscated classes."""
        out = None
        for kind in kinds:
            table, key = SOURCES[kind]
            rows = self.t[table].select(self.ref(kind, key, "a").alias("a"), self.ref(kind, key, "b").alias("b"), F.col(key).cast("long").alias("k"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def shifted(self, kind: str, every: int = 5) -> DataFrame:
        """Pairs of a kind in which each ``every``-th a has the image of the key behind its own: a wrong partner, which
        another a has too, or none for the last key."""
        table, key = SOURCES[kind]
        k = F.col(key).cast("long")
        image = k + F.when(k % every == 0, 1).otherwise(0)
        return self.t[table].select(self.ref(kind, key, "a").alias("a"), F.concat(F.lit(f"LX/{kind}"), F.when(image < self.n[kind], moved(image, self.n[kind])).otherwise(-1).cast("string"), F.lit(";")).alias("b"))

    def partial(self, kinds: str = "csp", drop: int = 4) -> DataFrame:
        """A mapping of the true pairs of these kinds, without every ``drop``-th key, and of all nations."""
        nations = self.t["nation"].select(F.concat(F.lit("Lnation/"), F.col("n_nationkey").cast("string"), F.lit(";")).alias("a")).withColumn("b", F.col("a"))
        rows = self.truth(kinds).where(F.col("k") % drop != 0).select("a", "b").unionByName(nations)
        return rows.select("a", "b", F.lit(0.9).cast("double").alias("confidence"), (~F.col("a").startswith("LX/")).alias("locked"), F.array(F.lit("seed"), F.lit("seed2")).alias("matchers"))


def method(**parts: Column) -> Column:
    """A method record; what is not given is empty."""
    empty = {"string": F.lit(""), "boolean": F.lit(False), "int": F.lit(0)}
    every = {f.name: parts.get(f.name, empty.get(f.dataType.simpleString(), F.array())).cast(f.dataType) for f in METHOD}
    return F.struct(*(v.alias(k) for k, v in every.items()))


def _pair(cls: Column, name: Column) -> Column:
    return F.struct(cls.alias("cls"), name.alias("name"))


def _line_method(x: Column) -> Column:
    """m{line}(I)V, which calls the part, then the supplier."""
    name = F.concat(F.lit("m"), x["n"].cast("string"))
    calls = F.array(_pair(x["p"], F.concat(F.lit("g"), x["n"].cast("string"), F.lit("()V"))), _pair(x["s"], F.lit("h(I)V")))
    return method(sig=F.concat(name, F.lit("(I)V")), name=name, calls=calls, calls_full=calls, facc=F.array(_pair(x["s"], F.lit("f"))), body_lx=F.array(x["p"], x["s"]), br=x["n"] % 3)


@once
def shop(spark: SparkSession, sf_dir: str, flat: bool = False) -> tuple[Project, Project]:
    """Orders as classes of two builds whose contents are unobfuscated; every fifth one of B lacks its first line.

    With ``flat`` classes have no member counts.
    """
    t = {n: _table(spark, sf_dir, n) for n in ("orders", "lineitem")}
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"))
    lines = t["lineitem"].select("l_orderkey", line.alias("x")).repartition("l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    base = t["orders"].join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "o_orderpriority", "xs")

    def records(side: str) -> DataFrame:
        rows = base if side == "a" else base.withColumn("xs", F.when(F.col("o_orderkey") % 5 == 0, F.slice("xs", 2, 100_000)).otherwise(F.col("xs")))
        text = lambda x: x.cast("string")
        part = lambda x: F.concat(F.lit("Lp/P"), text(x["p"] % 500), F.lit(";"))
        supplier = lambda x: F.concat(F.lit("Ls/S"), text(x["s"] % 13), F.lit(";"))
        named = lambda x: F.concat(F.lit("com.shop.P"), text(x["p"] % 500), F.lit(" (P"), text(x["p"] % 500), F.lit(".kt:"), text(x["n"]), F.lit(")"))
        constant = lambda x: F.concat(F.lit("NAME"), text(x["s"] % 60), F.lit("x"), text(x["n"] % 2))
        distinct = lambda f: F.array_sort(F.array_distinct(F.transform("xs", f)))

        def line_method(x: Column) -> Column:
            name = F.concat(F.lit("f"), text(x["n"]))
            calls = F.array(_pair(part(x), F.concat(F.lit("m"), text(x["n"]))), _pair(supplier(x), F.lit("x")))
            return method(sig=F.concat(name, F.lit("("), F.repeat(F.lit("I"), (x["p"] % 3).cast("int")), F.lit(")V")), name=name, bha=F.concat(F.lit("h"), text(x["p"] % 500)),
                          calls=calls, calls_full=calls, facc_typed=F.array(_pair(supplier(x), x["f"])), br=(x["s"] % 4).cast("int"))

        kind = F.when(F.col("o_orderkey") % 3 == 0, "enum").otherwise("final")
        size = F.lit(0) if flat else F.size("xs")
        return as_records(rows.select(
            F.concat(F.lit(f"LX/{side}"), text(F.col("o_orderkey")), F.lit(";")).alias("id"), F.concat(F.lit("Lc/C"), text(F.col("o_custkey") % 50 if flat else F.col("o_custkey")), F.lit(";")).alias("super"),
            F.array(F.concat(F.lit("Li/I"), text(F.col("o_custkey") % 3), F.lit(";"))).alias("impls"), F.array(kind).alias("mods"), size.alias("nm"), size.alias("nf"),
            F.concat(F.transform("xs", named), F.transform("xs", constant)).alias("strings"), F.concat(F.lit("dir"), text(F.col("o_custkey") % 300)).alias("bucket"),
            distinct(part).alias("calls"), distinct(supplier).alias("facc"), F.array(F.concat(F.lit("Lt/T"), F.substring("o_orderpriority", 1, 1), F.lit(";"))).alias("trefs"),
            F.transform("xs", lambda x: _pair(part(x), F.concat(F.lit("m"), text(x["n"])))).alias("call_targets"), F.transform("xs", lambda x: _pair(supplier(x), F.concat(F.lit("q"), text(x["n"] % 3)))).alias("field_targets"),
            F.transform("xs", line_method).alias("methods"), F.transform("xs", lambda x: F.struct((x["n"] * 10).alias("line"), part(x).alias("cls"))).alias("line_refs"),
            F.when(F.col("o_orderkey") % 2 == 0, distinct(lambda x: F.concat(F.lit("n"), text(x["p"] % 500)))).otherwise(F.array().cast("array<string>")).alias("native_syms"),
            F.when(F.col("o_orderkey") % 4 == 1, F.array(F.concat(F.lit("f="), "o_orderpriority"), F.concat(F.lit("c="), text(F.col("o_custkey"))))).otherwise(F.array().cast("array<string>")).alias("kotlin_meta"),
            F.transform("xs", lambda x: F.concat(F.lit("v"), text(x["p"] % 500))).alias("annotation_values"),
        ))

    unique = _unique(t["orders"], F.col("o_orderkey"))
    return Project(records("a"), keep=False, unique=unique), Project(records("b"), keep=False, unique=unique)


@once
def docs(spark: SparkSession, sf_dir: str) -> tuple[Project, Project]:
    """Documents of even and odd ids. Words of letters are the literals, lines and words the counts."""
    rows = _table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: w != "")
    made = as_records(rows.select(
        "doc_id", F.concat(F.lit("LX/d"), F.col("doc_id").cast("string"), F.lit(";")).alias("id"), words.alias("strings"),
        F.array("lang").alias("mods"), F.col("source").alias("bucket"), F.size(F.split("text", "\n")).alias("nf"), F.size(words).alias("nm"),
    ))
    even = F.regexp_extract("id", "([0-9]+)", 1).cast("long") % 2 == 0
    return Project(made.where(even), keep=False), Project(made.where(~even), keep=False)


@once
def conversations(spark: SparkSession, sf_dir: str) -> tuple[Project, Project]:
    """Conversations of even and odd ids as classes, their turns as methods: the role and the length of the text
    modulo five stand for the body, the role and the length modulo three for the signature."""
    turn = F.struct(
        F.col("turn").alias("at"), F.concat("role", F.lit("("), F.element_at(F.array(F.lit("I"), F.lit("J"), F.lit("Z")), F.length("text") % 3 + 1), F.lit(")V")).alias("sig"),
        F.concat("role", F.lit(":"), (F.length("text") % 5).cast("string")).alias("bha"), (F.length("text") % 3).cast("int").alias("br"),
    )
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    def turn_method(t: Column) -> Column:
        return method(sig=t["sig"], name=F.substring_index(t["sig"], "(", 1), bh=t["bha"], bha=t["bha"], br=t["br"])

    made = as_records(rows.select("conv_id", F.concat(F.lit("LX/v"), F.col("conv_id").cast("string"), F.lit(";")).alias("id"), F.transform("turns", turn_method).alias("methods"), F.transform("turns", lambda t: t["sig"]).alias("sigs"), F.size("turns").alias("nm")))
    even = F.regexp_extract("id", "([0-9]+)", 1).cast("long") % 2 == 0
    return Project(made.where(even)), Project(made.where(~even))


@once
def lambdas(spark: SparkSession, sf_dir: str) -> tuple[Project, Project]:
    """Conversations of even and odd ids; those of two of three ids have a function interface. The turns of assistants
    are constructors with an int or a long by the length of the text, the others invoke methods with its length modulo
    nine as branches."""
    turn = F.struct("turn", "role", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def turn_method(t: Column) -> Column:
        own = t["role"] == "assistant"
        sig = F.when(own, F.concat(F.lit("<init>("), F.when(t["n"] % 2 == 0, "I").otherwise("J"), F.lit(")V"))).otherwise("invoke()V")
        return method(sig=sig, name=F.when(own, "<init>").otherwise("invoke"), br=F.when(own, 9).otherwise(t["n"] % 9))

    impls = F.when(F.col("conv_id") % 3 < 2, F.array(F.lit("Lkotlin/jvm/functions/Function1;"))).otherwise(F.array().cast("array<string>"))
    made = as_records(rows.select(F.concat(F.lit("LX/v"), F.col("conv_id").cast("string"), F.lit(";")).alias("id"), impls.alias("impls"), F.transform("turns", turn_method).alias("methods")))
    even = F.regexp_extract("id", "([0-9]+)", 1).cast("long") % 2 == 0
    return Project(made.where(even)), Project(made.where(~even))


@once
def graph(spark: SparkSession, sf_dir: str, rich: bool = False) -> Graph:
    return Graph(spark, sf_dir, rich)
