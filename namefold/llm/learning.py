"""What the two learned scores share: labelled samples, remembered words, and the scoring pass."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.llm.common import stored, texts

#: Words that a worker remembers; when so many are new, the older half goes.
CACHE_WORDS = 400_000
#: Bytes of text that a score is learned from, at most.
SAMPLE_BYTES = 64 << 20


class Remembered(dict):
    """Two generations of values by word, made on first use."""

    def __init__(self, make: Callable, most: int = CACHE_WORDS) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str) -> object:
        value = self.old[word] if word in self.old else self.make(word)
        self[word] = value
        return value

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def give_back() -> None:
    """Return freed memory of this process to the system; texts and features leave many small pieces behind."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)


def fold(modulus: int) -> F.Column:
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: F.Column, most: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Whole texts and labels of at most ``most`` labelled documents, the first by a hash of their id, that hold at
    most ``most_bytes`` together; a document that does not fit beside those before it is left out.

    Rows without text, id or label are not learned from; an id that is labelled twice counts once, with the
    greater label, and of an id with several texts the least text counts.
    """
    spark = docs.sparkSession
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna().where(usable)
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna().join(F.broadcast(ids), "doc_id")
    rows = stored(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    sizes = rows.select("doc_id", F.xxhash64("doc_id").alias("at"), F.octet_length("text").alias("size")).toArrow()
    taken, left = [], most_bytes
    for row in sizes.sort_by([("at", "ascending"), ("doc_id", "ascending")]).to_pylist():
        if row["size"] <= left:
            taken.append((row["doc_id"],))
            left -= row["size"]
    if len(taken) < sizes.num_rows:
        rows = rows.join(F.broadcast(spark.createDataFrame(taken, "doc_id long")), "doc_id")
    rows = rows.toArrow().sort_by("doc_id")
    return rows.column("text").to_pylist(), rows.column("label").to_pylist()


def scored(docs: DataFrame, scorer: Callable[[object], Callable[[str], float]], model: object, held_out: F.Column, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted. ``scorer`` makes, on a worker, the function from text to score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for batch in batches:
            values = [score(x.decode("utf-8", "replace")) for x in texts(batch.column("text"))]
            columns = {n: batch.column(n) for n in ("doc_id", "held_out")}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(values, pa.float64()), "predicted": pa.array([int(v >= threshold) for v in values], pa.int32())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
