"""What the plans over large tables must not do: shuffle whole records, or group pairs that are distinct."""

from pyspark.sql import functions as F

from namefold.operators import content, structure
from namefold.operators.project import Project
from namefold.plans.adapters import as_records, graph, shop

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_of_distinct_ids_are_not_shuffled(spark):
    rows = as_records(spark.range(9).select(F.col("id").cast("string").alias("id"), F.array(F.lit("a string")).alias("strings")))
    p = Project(rows, keep=False)
    assert p.classes.count() == 9 and "Window" not in plan(p.classes) and "Exchange" not in plan(p.classes.select("cid", "strings"))
    twice = Project(rows.unionByName(rows), keep=False)
    assert twice.classes.count() == 9 and twice.classes.select("cid").distinct().count() == 9


def test_each_side_of_equal_keys_is_dealt_once(spark):
    a, b = shop(spark, SF)
    m = next(m for m in content.optional_content_matchers() if m.id == "annotation_values")
    text = plan(m.candidates(a, b))
    assert "InMemoryTableScan" not in text and "Window" in text
    assert text.count("Exchange hashpartitioning(key#") <= 2 and "Exchange hashpartitioning(a#" not in text


def test_buckets_are_dealt_once(spark):
    a, b = shop(spark, SF, True)
    m = next(m for m in content.content_matchers() if m.id == "string_pair")
    text = plan(m.candidates(a, b))
    assert "InMemoryTableScan" not in text
    assert text.count("Exchange hashpartitioning(bucket#") == 1 and "Exchange hashpartitioning(cid#" not in text


def test_null_keys_meet_none_and_equal_keys_all(spark):
    from namefold.operators.primitives import fingerprint_pairs

    side = lambda rows: spark.createDataFrame(rows, "cid string, key array<string>")
    a, b = side([("a1", ["x", None]), ("a2", ["x", None]), ("a3", None), ("a4", ["x", "null"])]), side([("b1", ["x", None]), ("b2", None), ("b3", ["x"])])
    rows = fingerprint_pairs(a, b, 0.9, spec="both").collect()
    assert {(r["a"], r["b"], round(r["confidence"], 6)) for r in rows} == {("a1", "b1", 0.636396), ("a2", "b1", 0.636396)}

def test_places_become_rows_behind_the_pairs(spark):
    """Lists meet whole: no shuffle by a place, and the mapping meets sums of votes."""
    g = graph(spark, SF, True)
    m = structure.Matcher("anns", 3, structure.position_vote(structure._list("anns"), 0.7, 0.05, 0.93, 2))
    text = plan(m.candidates(*g.projects(), g.partial("o")))
    assert "InMemoryTableScan" not in text and "pos#" not in text


def test_methods_meet_as_whole_lists(spark, monkeypatch):
    """A class's methods are not dealt by their signatures, and what led to the pairs is stored before partners meet."""
    from namefold.operators import members

    moved = []
    monkeypatch.setattr(members, "settled", lambda df: moved.append(plan(df)) or df)
    g = graph(spark, SF, True)
    text = plan(next(members.paired_by_signature(*g.projects(), g.partial("o"), body_hash=True, field="body_lx")))
    assert len(moved) == 1 and "body_lx" in text and "calls_full" not in text.split("Scan")[0]
    assert "Exchange hashpartitioning(sig#" not in text and "Window" not in text


def test_lists_of_methods_keep_the_order_of_hashes_and_the_last_of_a_signature(spark, monkeypatch):
    from namefold.operators import members
    from namefold.plans.adapters import method

    def build(name, *methods):
        made = F.array(*(method(sig=F.lit(sig), bha=F.lit(bha), body_lx=F.array(F.lit(body))) for sig, bha, body in methods))
        return Project(as_records(spark.range(1).select(F.lit(name).alias("id"), made.alias("methods"))), keep=False)

    a = build("LX/a;", ("f(LX/x;)V", "h", "1"), ("g()V", "", "2"), ("lost()V", "h", "3"), ("gone()V", "h", "4"), ("k(LX/q;)V", "", "5"))
    b = build("LX/b;", ("f(LX/y;)V", "h", "p"), ("free()V", "h", "q"), ("g()V", "", "r"), ("g()V", "h", "s"), ("other()V", "h", "t"), ("k(LX/q;)V", "h", "u"))
    mapping = spark.createDataFrame([("LX/a;", "LX/b;"), ("LX/x;", "LX/y;")], "a string, b string")
    found = lambda hashed: {(r["x"][0], r["y"][0]) for part in members.paired_by_signature(a, b, mapping, hashed, "body_lx") for r in part.collect()}
    assert found(False) == {("1", "p"), ("2", "s"), ("5", "u")}
    monkeypatch.setattr(members, "PART", 1)  # more parts than pairs
    assert found(True) == {("1", "p"), ("2", "s"), ("5", "u"), ("3", "q"), ("4", "t")}


def test_metadata_is_made_without_lines(spark):
    """Its key has no part of a line, so lines are only asked whether there are any, and nothing is kept in memory."""
    a, b = shop(spark, SF)
    m = next(m for m in content.optional_content_matchers() if m.id == "kotlin_debug_metadata")
    text = plan(m.candidates(a, b))
    assert "InMemoryTableScan" not in text and "l_partkey" not in text and text.count("Exchange hashpartitioning(key#") <= 2


def test_equal_enums_are_dealt_once_and_not_grouped(spark):
    a, b = shop(spark, SF)
    m = next(m for m in content.content_matchers() if m.id == "enum_value_names")
    text = plan(m.candidates(a, b))
    assert "InMemoryTableScan" not in text
    assert text.count("Exchange hashpartitioning(key#") <= 2 and "Exchange hashpartitioning(a#" not in text


def test_equal_lines_are_dealt_once_and_not_grouped(spark):
    a, b = shop(spark, SF)
    m = next(m for m in content.content_matchers() if m.id == "line_refs_ms")
    text = plan(m.candidates(a, b))
    assert "InMemoryTableScan" not in text
    assert text.count("Exchange hashpartitioning(key#") <= 2 and "Exchange hashpartitioning(a#" not in text


def test_buckets_of_equal_string_sets_are_dealt_once(spark):
    a, b = shop(spark, SF, True)
    m = next(m for m in content.content_matchers() if m.id == "identical_strings")
    text = plan(m.candidates(a, b))
    assert "InMemoryTableScan" not in text
    assert text.count("Exchange hashpartitioning(bucket#") == 1 and "Exchange hashpartitioning(cid#" not in text


def test_walked_methods_are_paired_once(spark):
    """The votes of a walk read stored pairs; the lines that methods come from are not in their plan."""
    g = graph(spark, SF, True)
    text = plan(structure.method_walk()(*g.projects(), g.partial("op")))
    assert "l_linenumber" not in text and "Window" in text


def test_neighbours_vote_in_parts(spark, monkeypatch):
    """Pairs are counted a part at a time where their a is, whatever the number of parts."""
    g = graph(spark, SF)
    moved = []
    monkeypatch.setattr(structure, "settled", lambda df: moved.append(plan(df)) or df.localCheckpoint())
    vote = structure.neighbour_vote(2, 1, 0.02, 0.92, structure.EDGE_WEIGHTS)
    whole = set(vote(*g.projects(), g.partial("csp")).collect())
    assert len(moved) == 3 and "Exchange hashpartitioning(a#" in moved[2] and moved[2].count("Exchange hashpartitioning(a#") == 1
    monkeypatch.setattr(structure, "VOTES", 60_000)
    assert whole and set(vote(*g.projects(), g.partial("csp")).collect()) == whole and len(moved) > 6


def test_validators_over_large_tables_are_stored_one_by_one(spark, monkeypatch):
    """What combines their scores has no shuffle of a validator behind it."""
    from namefold.operators import validators as V

    g = graph(spark, SF)
    scored = V.scores(g.shifted("o"), *g.projects(), g.partial("csp"))
    assert "Exchange" not in plan(scored) and plan(scored).count("FileScan") == len(V.VALIDATORS)
    assert scored.groupBy("validator").count().where("count = 1500").count() == len(V.VALIDATORS)
