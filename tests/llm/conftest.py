import pytest

#: Names that operators use for columns of their own.
CLASHING = ("_drop", "_id", "kept_text", "n_lines", "row", "key", "h", "node", "id", "text_hash", "kept", "gone", "_salt", "part", "held_out")


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) rows, with columns whose names clash with those that operators use."""

    def make(rows):
        full = [(i, t, "en", f"src{k % 3}", len(t or ""), "x", 1.0, 7, *(f"own {c}" for c in CLASHING)) for k, (i, t) in enumerate(rows)]
        kinds = "doc_id long, text string, lang string, source string, n_chars long, digest string, score double, n long, "
        return spark.createDataFrame(full, kinds + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(3)

    return make
