import pytest
from oracle import SF, same_rows

from namefold.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    same_rows(spark, QUERIES[name], ORACLE_SQL[name])


def test_pipeline_equals_its_operators_by_hand(spark):
    """Each stage of run() against brute force on its own input."""
    import corpus_pipeline
    from test_operators import components_by_hand, hits_by_hand, lines_by_hand

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    from namefold.llm import toxicity

    clean = toxicity.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0")
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(r["doc_id"] for r in clean.select("doc_id").collect())
    from hashlib import sha256

    lines = stages["line dedup"](spark, kept, SF)
    want = {i: h for i, _, _, h in lines_by_hand(pairs(kept))}
    assert {i: sha256((t or "").encode()).hexdigest() for i, t in pairs(lines)} == want
    single = stages["n-gram Jaccard join"](spark, lines, SF)
    assert sorted(i for i, _ in pairs(single)) == sorted(i for i, _, c in components_by_hand(pairs(lines)) if i == c)
    clean = stages["benchmark decontamination"](spark, single, SF)
    assert sorted(i for i, _ in pairs(clean)) == sorted(x[0] for x in hits_by_hand(pairs(single), bench) if not x[-1])
    packed = stages["best-fit packing"](spark, clean, SF)
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in pairs(clean)}
    assert corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").exceptAll(packed.select("doc_id", "piece", "ids_crc32")).count() == 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
