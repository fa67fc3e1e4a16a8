"""URL filter: host and path rules first, else a ratio of two character language models.

The models are smoothed variable-order Markov models over the bytes of host and path, one of the URLs that
rules allow and one of those that rules block. A context of k bytes falls back to k - 1 bytes as far as it is
unseen. Counts cover all URLs that rules decide, outside the calibration fold, one count for each distinct
context and for each with its byte, told apart by 64-bit hashes. They grow with what the URLs hold and stay in a
table: the URLs are dealt over chunks of bounded size, each chunk's distinct contexts meet the table in a join, and
a chunk is scored with the counts that came back. The difference of the log-likelihoods, divided by the length, is
compared with the threshold that best tells the calibration fold apart.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule, and its empty text
has the score 0; without URLs of both kinds every score is 0 and the threshold too, so the verdict is allow;
repeated rows count as often as they come and each give a row; a very long URL is scored whole; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.llm.common import mix, shuffle_partitions, stored, texts

#: (verdict, host and path) of the contract's rules.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Longest context, weight of the shorter context, and the calibration fold's modulus.
ORDER, BACKOFF, FOLDS = 5, 2.0, 5
#: Scores are cut to this range and counted in so many bins to find the threshold.
RANGE, BINS = 4.0, 4000
#: Bytes of host and path in one chunk, on average, and those whose contexts are in memory at a time.
CHUNK_BYTES, SLICE_BYTES = 512 << 10, 128 << 10


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host, tail = rest[:cut].encode().lower().decode(), rest[cut:]
    end = min((k for k in (tail.find(c) for c in "?#") if k >= 0), default=len(tail))
    return host, tail[:end]


def fitting(host: str, path: str, rules: tuple[tuple[str, str], ...]) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule that fits, if any."""
    best: tuple[str | None, str | None] = (None, None)
    for verdict, rule in rules:
        where, slash, prefix = rule.partition("/")
        if (host == where or host.endswith("." + where)) and path.startswith(slash + prefix) and (best[0] is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best


def _keys(names: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of the names: its name, and the hashes of its contexts without and with the byte, by order.

    A name begins behind ORDER zero bytes, so its first bytes have contexts too.
    """
    pad = b"\0" * ORDER
    data = np.frombuffer(b"".join(pad + x for x in names), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(x) for x in names], dtype=np.int64)
    owner = np.repeat(np.arange(len(names)), size)
    at = np.arange(len(owner)) + (owner + 1) * ORDER
    context = np.zeros((ORDER + 1, len(at)), dtype=np.int64)
    joint = np.zeros((ORDER + 1, len(at)), dtype=np.int64)
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(ORDER + 1):
        if k:
            value = mix(value * np.uint64(257) + data[at - k] + np.uint64(1))
        key = mix(value + np.uint64(7 * k + 1))
        context[k] = key.view(np.int64)
        joint[k] = mix(key * np.uint64(257) + data[at] + np.uint64(1)).view(np.int64)
    return owner, context, joint


def scores(names: list[bytes], model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log-likelihood of allowed minus blocked, per byte; 0 for empty names. Keys that the model has not count 0."""
    owner, context, joint = _keys(names)
    keys, counts = model

    def place(wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys[:-1], wanted)
        return np.where(keys[at] == wanted, at, len(keys) - 1)

    context, joint = place(context), place(joint)
    total = []
    for kind in range(2):
        p = np.full(len(owner), 1 / 256)
        for k in range(ORDER + 1):
            n = counts[kind][context[k]]
            p = (counts[kind][joint[k]] + BACKOFF * p) / (n + BACKOFF)
        total.append(np.bincount(owner, weights=np.log(p), minlength=len(names)))
    return (total[0] - total[1]) / np.maximum([len(x) for x in names], 1)


def _parsed(pages: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True):
                host, path = split_url(url)
                rows.append((page, host, path, *fitting(host, path, rules), zlib.crc32(str(page).encode()) % FOLDS == 0))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("page_id", "host", "path", "rule", "decided", "held"), columns, kinds, strict=True)})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, host string, path string, rule string, decided string, held boolean")


def _names(batch: pa.RecordBatch | pa.Table) -> list[bytes]:
    return [h + p for h, p in zip(texts(batch.column("host")), texts(batch.column("path")), strict=True)]


def _slices(names: list[bytes]) -> Iterator[slice]:
    """Runs of names of SLICE_BYTES bytes or so, or of one longer name."""
    ends = np.cumsum([len(x) for x in names])
    start = 0
    while start < len(names):
        end = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, "right")), start + 1)
        yield slice(start, end)
        start = end


def counted(parsed: DataFrame) -> DataFrame:
    """(key, allow, block): how often each context, and each with its byte, comes in the decided URLs outside the calibration fold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.array([x == "block" for x in batch.column("decided").to_pylist()], dtype=bool)
            names = _names(batch)
            for cut in _slices(names):
                owner, context, joint = _keys(names[cut])
                found, at = np.unique(np.concatenate([context, joint]), return_inverse=True)
                kind = np.tile(block[cut][owner], 2 * (ORDER + 1))
                n = [np.bincount(at.ravel()[kind == k], minlength=len(found)) for k in (False, True)]
                yield pa.RecordBatch.from_pydict({"key": pa.array(found), "allow": pa.array(n[0]), "block": pa.array(n[1])})

    rows = parsed.where("decided is not null and not held").mapInArrow(count, "key long, allow long, block long")
    return rows.groupBy("key").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def with_scores(parsed: DataFrame, model: DataFrame) -> DataFrame:
    """``parsed`` with the score of each row by the counts (key, allow, block) of ``model``."""
    size = F.octet_length("host") + F.octet_length("path")
    total = parsed.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    chunks = max(shuffle_partitions(parsed.sparkSession), -(-total // CHUNK_BYTES))
    dealt = stored(parsed.withColumn("chunk", F.pmod(F.xxhash64("page_id", "host", "path", F.spark_partition_id()), F.lit(chunks))))

    def ask(group: pa.Table) -> pa.Table:
        names = _names(group)
        keys = np.empty(0, dtype=np.int64)
        for cut in _slices(names):
            _, context, joint = _keys(names[cut])
            keys = np.union1d(keys, np.concatenate([context, joint]).ravel())
        return pa.table({"chunk": pa.array(np.full(len(keys), group.column("chunk")[0].as_py(), dtype=np.int64)), "key": pa.array(keys)})

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("key")
        counts = np.array([np.append(known.column(x).to_numpy(), 0) for x in ("allow", "block")], dtype=np.float64)
        mine = np.append(known.column("key").to_numpy(), 0), counts
        names = _names(rows)
        value = np.concatenate([scores(names[cut], mine) for cut in _slices(names)] or [np.empty(0)])
        return rows.drop_columns(["chunk"]).append_column("score", pa.array(value))

    # A key is asked for once by each chunk, so none is hot.
    told = dealt.groupBy("chunk").applyInArrow(ask, "chunk long, key long").join(model, "key")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parsed.schema)
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, f"{kinds}, score double")


def threshold(rows: DataFrame) -> float:
    """The score that best tells the decided rows of the calibration fold apart; 0 without rows of both kinds."""
    at = F.floor((F.greatest(F.lit(-RANGE), F.least(F.col("score"), F.lit(RANGE))) + RANGE) / (2 * RANGE) * BINS)
    table = rows.where("decided is not null and held").groupBy(F.least(at, F.lit(BINS - 1)).alias("bin"), "decided").count()
    held = np.zeros((2, BINS))
    for row in table.toArrow().to_pylist():  # two rows for each bin at most
        held[int(row["decided"] == "block"), row["bin"]] = row["count"]
    if not held.sum(axis=1).all():
        return 0.0
    # At the edge of bin k, bins from k on are allowed.
    allow = held[0][::-1].cumsum()[::-1] / held[0].sum()
    block = np.concatenate([[0], held[1].cumsum()[:-1]]) / held[1].sum()
    best = np.flatnonzero(allow + block >= (allow + block).max() - 1e-12)
    return float(best[len(best) // 2] * 2 * RANGE / BINS - RANGE)


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row."""
    parsed = stored(_parsed(pages, rules))
    kinds = parsed.where("decided is not null and not held").agg(F.countDistinct("decided")).first()[0]
    bar = 0.0
    if kinds == 2:
        rows = stored(with_scores(parsed, counted(parsed)))
        bar = threshold(rows)
    else:
        rows = parsed.withColumn("score", F.lit(0.0))
    verdict = F.coalesce("decided", F.when(F.col("score") >= bar, "allow").otherwise("block"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
