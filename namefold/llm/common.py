"""Helpers shared by the training-data operators: shared work folder, skew-safe joins, batch text access."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group counts as hot when it holds more than 1/HOT_SHARE of all rows; so at most HOT_SHARE groups are hot.
HOT_SHARE = 1000
#: No group of so few rows is hot.
HOT_LEAST = 50
#: Rows in an Arrow batch handed to Python; a batch of long texts stays small.
BATCH_ROWS = 512
#: Bytes of text that the numpy kernels take at a time; their arrays take some fifty times as much.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, through Spark's own reader."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this session has made.
_made: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share.

    Only a local session may do without that setting; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        base = tempfile.mkdtemp(prefix="namefold-")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/namefold-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Delete the folders made so far; call it when all results that read them are written."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to the one row per ``key`` of ``groups``, safe when a few keys hold most rows.

    ``groups[count]`` is the number of rows of the key. Keys with more than ``total / HOT_SHARE`` rows, at
    most HOT_SHARE of them, are dealt over as many salts as they have such shares, and their groups are repeated
    for each salt, at most 2 * HOT_SHARE times in all; the list of these keys is broadcast to salt the rows.
    The salt follows from a row's partition and its numbers, so a task that runs again deals its rows alike.
    """
    least = max(total // HOT_SHARE, HOT_LEAST)
    is_hot = F.col(count) > least
    salts = F.least(F.ceil(F.col(count) / least), F.lit(HOT_SHARE)).cast("int")
    hot = F.broadcast(groups.where(is_hot).select(key, salts.alias("_salts")))
    numbers = [F.col(f"`{c}`") for c, kind in rows.dtypes if kind in ("bigint", "int")]
    dealt = F.pmod(F.xxhash64(F.spark_partition_id(), *numbers), F.col("_salts").cast("long")).cast("int")
    salted = rows.join(hot, key, "left").withColumn("_salt", F.coalesce(dealt, F.lit(0))).drop("_salts")
    every = F.explode(F.when(is_hot, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0))))
    return salted.join(groups.withColumn("_salt", every), [key, "_salt"], how).drop("_salt")


#: Keys of a filter that are broadcast at most (8 to 16 MB); a longer list meets the rows in a shuffle.
BROADCAST_KEYS = 500_000


def without(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """``rows`` less those whose keys are in ``gone``; null equals null. A short list of keys is broadcast."""
    return _filtered(rows, gone, keys, "left_anti")


def only(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The ``rows`` whose keys are in ``wanted``; null equals null. A short list of keys is broadcast."""
    return _filtered(rows, wanted, keys, "left_semi")


def _filtered(rows: DataFrame, asked: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    asked = stored(asked.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct())
    if asked.count() <= BROADCAST_KEYS:
        asked = F.broadcast(asked)
    return rows.join(asked, [rows[k].eqNullSafe(asked[f"_{k}"]) for k in keys], how)


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text, b'' for null, without decoding."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches whose ``column`` holds at most ``most`` bytes, unless one row alone is longer."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(column).cast(pa.binary())).fill_null(0), dtype=np.int64)
        total, start = np.cumsum(sizes), 0
        while start < len(sizes):
            before = total[start - 1] if start else 0
            end = max(int(np.searchsorted(total, before + most, "right")), start + 1)
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words, so that every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


#: Bytes of a word from which on its hash is a digest.
LONG_WORD = 256
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hash) of each run of bytes other than the space; equal words have equal hashes everywhere.

    The hash of a word is a polynomial of its bytes modulo 2**64 with the word's length, passed through ``mix``.
    Words of more than LONG_WORD bytes, for which such polynomials have known collisions, have a digest in its place.
    """
    data = np.frombuffer(buffer, dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = data != 32
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.empty(0, dtype=np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    value = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        value[k] = int.from_bytes(hashlib.blake2b(buffer[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return starts, ends, value


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes, in order; empty when there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = mix(total + words[k : k + n] + np.uint64(k + 1))
    return total
