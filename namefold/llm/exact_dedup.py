"""Exact duplicates by static binary-fuse filters over immutable snapshots.

Each snapshot has, per digest bucket, one binary-fuse filter over its distinct digests. Digests of an
incoming batch are screened by the filters; only the rows of positives, and of digests that repeat inside the
batch, join the exact buckets, where whole texts are compared byte for byte. All other rows are known to be
alone, and their texts are not shuffled while the list of the suspect digests is short enough to be broadcast.

Defined cases: a null text is the empty text; repeated rows and repeated ids each count as a row; a null
doc_id is a row that never stays unless its whole group has null ids; very long texts are compared whole; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.llm.common import BROADCAST_KEYS, join_hot, mix, shuffle_partitions, stored, texts

#: Digests in one filter; a snapshot has as many buckets as this asks for.
BUCKET_KEYS = 100_000


class FuseFilter:
    """Static three-wise binary-fuse filter with 16-bit fingerprints over distinct 64-bit keys.

    Keys that were added are always found; others are found with probability about 2**-16.
    """

    def __init__(self, seed: int, segment: int, count: int, table: np.ndarray) -> None:
        self.seed, self.segment, self.count, self.table = seed, segment, count, table

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        first = ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        g = mix(h + np.uint64(1))
        mask = np.uint64(segment - 1)
        at = [(g >> np.uint64(s) & mask).astype(np.int64) for s in (0, 20, 40)]
        slots = np.stack([(first + k) * segment + at[k] for k in range(3)], axis=1)
        return slots, (mix(g) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peel in rounds: each round takes all keys that own a slot alone; assign in reverse."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << int(np.clip(np.log(max(n, 2)) / np.log(3.33) + 2.25, 2, 18))
        spread = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) + 0.05
        for seed in range(1, 1000):
            count = max(1, int(np.ceil(n * spread / segment)) - 2)
            slots, prints = cls._slots(keys, seed, segment, count)
            size = (count + 2) * segment
            degree = np.bincount(slots.ravel(), minlength=size)
            owner = np.zeros(size, dtype=np.int64)  # sum of the numbers of the keys at a slot
            np.add.at(owner, slots.ravel(), np.repeat(np.arange(n), 3))
            order, left = [], n
            alone = np.flatnonzero(degree == 1)
            while len(alone):
                key, at = np.unique(owner[alone], return_index=True)
                order.append((key, alone[at]))
                gone = slots[key].ravel()
                np.subtract.at(degree, gone, 1)
                np.subtract.at(owner, gone, np.repeat(key, 3))
                left -= len(key)
                touched = np.unique(gone)
                alone = touched[degree[touched] == 1]
            if not left:
                table = np.zeros(size, dtype=np.uint16)
                for key, at in reversed(order):
                    table[at] = 0
                    table[at] = prints[key] ^ table[slots[key]].T[0] ^ table[slots[key]].T[1] ^ table[slots[key]].T[2]
                return cls(seed, segment, count, table)
            spread *= 1.05
        raise ValueError("no seed makes a filter of these keys")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._slots(keys.astype(np.uint64), self.seed, self.segment, self.count)
        a, b, c = self.table[slots].T
        return (a ^ b ^ c) == prints


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def digested(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """(doc_id, digest, sha): the digest and the SHA-256 of each text with A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [x.lower() for x in texts(batch.column("text"))]  # bytes.lower() changes A-Z alone
            sha = pa.array([sha256(x) for x in low], pa.binary())
            own = sha if digest is sha256 else pa.array([digest(x) for x in low], pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "digest": own, "sha": sha})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, digest binary, sha binary")


def suspect_texts(docs: DataFrame, suspects: DataFrame, total: int, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """(doc_id, digest, text) of the rows whose digest is among the ``suspects`` (digest, n): text with A-Z lower-cased.

    A short list of suspects is sent to the scans, so that no other text leaves them; a longer one meets all
    texts in one shuffle by digest, hot ones salted.
    """
    few = suspects.count() <= BROADCAST_KEYS
    wanted = np.unique(_key(suspects.select("digest").toArrow().column("digest").to_pylist())) if few else np.empty(0, dtype=np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [x.lower() for x in texts(batch.column("text"))]
            digests = [digest(x) for x in low]
            held = np.flatnonzero(np.isin(_key(digests), shared.value)) if few else np.arange(len(low))
            columns = {"digest": pa.array([digests[k] for k in held], pa.binary()), "text": pa.array([low[k] for k in held], pa.binary())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(held))} | columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, digest binary, text binary")
    return rows if few else join_hot(rows, suspects, "digest", "n", total).drop("n")


def _key(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8].ljust(8, b"\0") for x in digests), dtype="<u8")


def build_filters(keys: DataFrame) -> DataFrame:
    """Filters of a snapshot: one row per bucket from (bucket, digest) with distinct digests."""

    def build(group: pa.Table) -> pa.Table:
        made = FuseFilter.build(_key(group.column("digest").to_pylist()))
        return pa.table({"bucket": group.column("bucket")[:1].cast(pa.int64()), "seed": [made.seed], "segment": [made.segment], "count": [made.count], "fingerprints": [made.table.tobytes()]})

    return keys.groupBy("bucket").applyInArrow(build, "bucket long, seed long, segment long, count long, fingerprints binary")


def screen(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """Rows of ``batch`` (bucket, digest; distinct) whose digest a filter of its bucket may hold."""

    def probe(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return asked.slice(0, 0).select(["digest"])
        keys = _key(asked.column("digest").to_pylist())
        hit = np.zeros(len(keys), dtype=bool)
        for row in held.to_pylist():
            hit |= FuseFilter(row["seed"], row["segment"], row["count"], np.frombuffer(row["fingerprints"], dtype=np.uint16)).contains(keys)
        return asked.select(["digest"]).filter(pa.array(hit))

    return batch.select("bucket", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, "digest binary")


def deduplicate(docs: DataFrame, snapshots: int = 1, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The rows are dealt by id over ``snapshots`` immutable snapshots and one incoming batch; each snapshot
    is screened against all later ones and the batch. ``digest`` may be replaced by a weaker one in tests:
    equal digests of different texts are told apart by their bytes.
    """
    spark = docs.sparkSession
    rows = stored(digested(docs, digest))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(snapshots + 1)))
    per_part = stored(dealt.groupBy("part", "digest").agg(F.count("*").alias("n")))
    total = rows.count()
    buckets = max(shuffle_partitions(spark), -(-total // BUCKET_KEYS))
    per_part = per_part.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    suspects = per_part.where("n > 1").select("digest")  # duplicates inside one snapshot or the new batch
    for k in range(snapshots):
        filters = build_filters(per_part.where(F.col("part") == k))
        later = per_part.where(F.col("part") > k).groupBy("bucket", "digest").agg(F.count("*").alias("_n"))
        suspects = suspects.unionByName(screen(later, filters))
    suspects = stored(per_part.join(suspects.distinct(), "digest", "left_semi").groupBy("digest").agg(F.sum("n").alias("n")))
    # Exact buckets: a group holds equal bytes, and copies meet in their own task first.
    exact = suspect_texts(docs, suspects, total, digest).groupBy("digest", "text").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    checked = stored(exact.select("digest", F.unhex(F.sha2("text", 256)).alias("sha"), "group_size", "keep_id"))
    by_digest = checked.groupBy("digest").agg(F.count("*").alias("texts"), F.sum("group_size").alias("n"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
    out = join_hot(rows, by_digest, "digest", "n", total, "left")
    same = out.where("texts is null or texts = 1").select("doc_id", "sha", "keep_id", "group_size")
    # Texts that share a digest: told apart by the bytes, through their own hash.
    clash = join_hot(out.where("texts > 1").select("doc_id", "sha"), checked.select("sha", "keep_id", "group_size"), "sha", "group_size", total)
    all_rows = same.unionByName(clash.select(*same.columns))
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return all_rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
