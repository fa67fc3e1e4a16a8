import json

from pyspark.sql import functions as F

from namefold.sources import index
from namefold.sources.smali import instruction, parse_class, parse_resources, scan_tree

TEXT = '''# a comment
.class public final LX/01a;
.super Lcom/acme/Base;
.implements LX/02b;
.implements Ljava/lang/Runnable;
.annotation runtime Lcom/acme/Named;
    value = "the_name"
.end annotation
.annotation system Lkotlin/coroutines/jvm/internal/DebugMetadata;
    c = "com.acme.Flow"
    f = "Flow.kt"
.end annotation
.field public static final A:I = 0x1
.field private b:LX/03c;
.field c:[LX/04d;
.method public constructor <init>(ILX/05e;[LX/06f;)V
    .registers 3
    .line 12
    invoke-static {v0}, Lcom/acme/Log;->say(Ljava/lang/String;)V
    invoke-virtual {p0, v1}, LX/07g;->go(I)LX/08h;
    const-string v0, "hello "world""
    const v1, 0x7f010002
    iget-object v0, p0, LX/01a;->b:LX/03c;
    sget v0, Lcom/acme/K;->N:I
    if-eqz v0, :cond_0
    new-instance v0, LX/09i;
    check-cast v0, Lcom/acme/T;
    :cond_0
    return-void
.end method
.method public native nat()LX/0aj;
.method abstract bare()[LX/0bk;
.end method
'''


def test_class_record():
    r = parse_class(TEXT, "smali_classes2", {0x7F010002: "R.string=Hi"})
    assert (r["id"], r["super"], r["bucket"], r["mods"]) == ("LX/01a;", "Lcom/acme/Base;", "smali_classes2", ["final", "public"])
    assert (r["nf"], r["nm"], r["ns"], r["nn"]) == (3, 3, 1, 1)
    assert r["impls"] == ["LX/02b;", "Ljava/lang/Runnable;"]
    assert r["strings"] == ['hello "world"', "R.string=Hi"]
    assert r["calls"] == ["LX/07g;", "Lcom/acme/Log;"] and r["facc"] == ["Lcom/acme/K;"]
    assert r["trefs"] == ["LX/03c;", "LX/05e;", "LX/06f;", "LX/09i;", "LX/0aj;", "Lcom/acme/T;"]
    assert r["field_types"] == ["I", "LX/03c;", "[LX/04d;"]
    assert r["kotlin_meta"] == ["c=com.acme.Flow", "f=Flow.kt"] and r["annotation_values"] == ["the_name"]
    assert r["line_refs"] == [(12, "Lcom/acme/Log;")] and r["native_syms"] == ["nat"]
    m = r["methods"][0]
    assert m["br"] == 1 and m["strs"] == ['hello "world"']
    assert m["calls_full"] == [("Lcom/acme/Log;", "say(Ljava/lang/String;)V"), ("LX/07g;", "go(I)LX/08h;")]
    assert m["body_lx"] == ["LX/07g;", "LX/01a;", "LX/03c;", "LX/09i;"]
    assert m["facc_typed"] == [("LX/01a;", "LX/03c;"), ("Lcom/acme/K;", "I")]
    assert [x["bh"] != "" for x in r["methods"]] == [True, False, False] and len(r["bh"]) == 1


def test_body_hash_ignores_registers_and_names():
    a, b = (parse_class(TEXT.replace("LX/07g;", name).replace("v0", reg), "s") for name, reg in (("LX/07g;", "v0"), ("LX/zzz;", "v7")))
    x, y = a["methods"][0], b["methods"][0]
    assert x["bha"] == y["bha"] and x["bh"] != y["bh"]


def test_instruction():
    assert instruction("move v0, p1") == "move"
    assert instruction("invoke-static {v0}, La;->b()V") == "invoke-static La;->b()V"
    assert instruction("invoke-static {v0, v1}, La;->b()V") == "invoke-static {v0 v1} La;->b()V"
    assert instruction("invoke-static {v0, v1}, La;->b()V", drop_lists=True) == "invoke-static La;->b()V"
    assert instruction(":cond_0") == ":cond_0"


def test_no_class_line():
    assert parse_class(".super La;", "s") is None and parse_class("", "s") is None


def test_resources():
    files = {
        "public": '<resources><public type="string" name="a" id="0x7f010001"/><public type="anim" name="b" id="0x7f020001"/><public type="string" name="none" id="zz"/></resources>',
        "strings": f'<resources><string name="a">{"x" * 100}</string></resources>',
        "bools": "<broken",
    }
    assert parse_resources(files) == {0x7F010001: "R.string=" + "x" * 80, 0x7F020001: "R.anim"}
    assert parse_resources({}) == {}


def test_tree_and_index_round_trip(spark, tmp_path):
    for folder, name in (("smali", "A"), ("smali_classes2/deep/er", "B"), ("other", "C")):
        (tmp_path / "tree" / folder).mkdir(parents=True)
        (tmp_path / "tree" / folder / f"{name}.smali").write_text(TEXT.replace("LX/01a;", f"L{name};"))
    (tmp_path / "tree/smali/empty.smali").write_text("nothing")
    (tmp_path / "tree/res/values").mkdir(parents=True)
    (tmp_path / "tree/res/values/public.xml").write_text('<resources><public type="string" name="a" id="0x7f010002"/></resources>')
    records = scan_tree(spark, str(tmp_path / "tree"))
    assert {(r["id"], r["bucket"]) for r in records.select("id", "bucket").collect()} == {("LA;", "smali"), ("LB;", "smali_classes2")}
    assert records.select(F.explode("strings")).distinct().count() == 2
    for out in ("x.jsonl", "x.parquet"):
        index.write_index(records, str(tmp_path / out))
        back = index.read_index(spark, str(tmp_path / out))
        assert sorted(map(str, back.collect())) == sorted(map(str, records.collect()))
    line = json.loads(next(iter((tmp_path / "x.jsonl").glob("part*.json"))).read_text().splitlines()[0])
    assert line["call_targets"][0] == ["Lcom/acme/Log;", "say"]
