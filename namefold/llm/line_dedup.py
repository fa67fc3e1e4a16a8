"""Lines that many documents share: explode, hash, count distinct documents per hash, drop, reassemble by position.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, with A-Z lower-cased. Keys of at least
``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except in the
document with the largest doc_id that holds the key.

Defined cases: a null or empty text is one empty line; a key repeated inside its last document stays there
each time; rows that repeat a doc_id count as one document but each give a row; rows without a doc_id are one
document that sorts below all others; very long texts and lines are taken whole; an empty table gives an empty
result; other columns, whatever their names, are carried but not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from namefold.llm.common import join_hot, stored, texts

_STRIP = b" \t\n\x0b\x0c\r"


def _keys(text: bytes, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(position, 16-byte hash) of each line whose key is long enough."""
    for at, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(_STRIP).lower()
            if len(key) >= min_chars and (key.isascii() or len(key) - sum(0x80 <= b < 0xC0 for b in key) >= min_chars):
                yield at, hashlib.blake2b(key, digest_size=16).digest()


def exploded(docs: DataFrame, min_chars: int) -> DataFrame:
    """(hash, doc_id, h, pos) of each long line; h is a hash of the row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(_keys(text, min_chars)) for text in texts(batch.column("text"))]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            columns = {"hash": pa.array([h for x in found for _, h in x], pa.binary()), "pos": pa.array([p for x in found for p, _ in x], pa.int32())}
            yield pa.RecordBatch.from_pydict(columns | {n: batch.column(n).take(row) for n in ("doc_id", "h")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "hash binary, pos int, doc_id long, h long")


def dropped(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """(doc_id, h, gone, copies): the positions of the lines that go, of the ``copies`` rows of this id and text hash."""
    lines = stored(exploded(docs, min_chars))
    total = lines.count()
    # Lines may repeat inside a document: of the few keys that come often enough, count documents.
    often = stored(lines.groupBy("hash").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id")).where(F.col("n") >= min_docs))
    hits = stored(join_hot(lines, often, "hash", "n", total))
    held = hits.select("hash", "doc_id").distinct().groupBy("hash").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    common = stored(often.join(held, "hash").select("hash", "n"))
    gone = join_hot(hits.drop("n"), common, "hash", "n", total).where(~F.col("doc_id").eqNullSafe(F.col("last_id")))
    # Rows of one id and text have the same lines, so each position comes once for each of them.
    gone = gone.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("gone"), F.count("*").alias("n"))
    return gone.select("doc_id", "h", "gone", F.floor(F.col("n") / F.size("gone")).alias("copies"))


def drop_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """(row, kept_text, n_lines, n_dropped): the columns of ``docs`` other than text, and the lines that stay."""
    spark = docs.sparkSession
    gone = stored(dropped(docs, min_docs, min_chars))
    total = gone.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    # Structs are equal where both have null ids.
    groups = gone.select(F.struct("doc_id", "h").alias("key"), "gone", "copies")
    others = [c for c in docs.columns if c != "text"]
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).alias("key")
    joined = join_hot(docs.select(F.struct(*others).alias("row"), "text", key), groups, "key", "copies", total, "left").select("row", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist(), strict=True):
                n_lines.append((text or b"").count(b"\n") + 1)
                n_dropped.append(len(gone or ()))
                if gone:
                    out = set(gone)
                    text = b"\n".join(x for p, x in enumerate(text.split(b"\n")) if p not in out)
                kept.append(text)
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})

    made = spark.createDataFrame([], "kept_text string, n_lines long, n_dropped long").schema
    return joined.mapInArrow(run, StructType([joined.schema["row"], *made]))


def clean(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """The rows of ``docs`` with the lines that stay as ``text``, and ``n_chars``, if there, of that text.

    A null text stays null, and rows that lose no line stay as they are; the other cases are the module's.
    """
    out = drop_lines(docs, min_docs, min_chars)
    columns = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("kept_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(columns["n_chars"])
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of ``drop_lines``."""
    out = drop_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
