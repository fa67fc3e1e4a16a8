"""Packing of tokenised documents into sequences by best-two-fit.

A sequence is filled greedily with the longest pieces that fit. When nothing fits the gap that is left, its
smallest piece is replaced with the two unpacked pieces that fit the gap, expanded by that piece, most
tightly. Replacing a sequence's only piece, which puts long pieces off, more often costs sequences than it saves,
so each shard is filled with and without that, and the fewer sequences count. The pieces are dealt at random over shards of bounded size, each packed by one task.

Defined cases: a null or empty text is one piece that holds the end id alone; equal rows are pieces of
their own; equal lengths go in row order; very long texts are tokenised whole and cut; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.llm.common import shuffle_partitions, stored, texts

#: Pieces in one shard of the packing; a shard leaves at most about one sequence part empty.
SHARD_PIECES = 50_000
#: Words whose ids a worker remembers; when so many are new since the last change, the older half goes.
CACHE_WORDS = 400_000


def _byte_letters() -> dict[int, str]:
    """The published byte-level alphabet: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Words(dict):
    """Two generations of remembered words: when the newer is full, the older goes."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        self[word] = ids = self.make(word) if ids is None else ids
        return ids

    def age(self) -> None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()


class WordTokens:
    """Ids of a text by words between spaces and line feeds, each tokenised once and remembered.

    The tokenizer drops white space and no token spans it, so ids of a text are its words' ids in order.
    """

    #: A run of letters that Unicode normalisation keeps, with marks behind it that are a token of their own.
    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known = _Words(self._word)

    def _pretoken(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word without spaces, as little-endian 32-bit numbers."""
        m = self.PLAIN.fullmatch(word)
        if m:
            return self._pretoken(m[1].lower()) + (self._pretoken(m[2]) if m[2] else b"")
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        out = b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))
        self.known.age()
        return out


def tokenised(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """Pieces of at most ``size`` tokens: doc_id, piece, start, length, ids_crc32, the row's place, and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, row = WordTokens(tokenizer), 0
        part, end = TaskContext.get().partitionId(), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                ids = words.ids(text.decode("utf-8", "replace")) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    piece = ids[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece), part, row, piece))
                row += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "row", "ids")
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in list(zip(names, columns, kinds, strict=True))[: 8 if keep_ids else 7]})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, row long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _pair(free: int, back: int, counts: list[int], size: int, most: int, least: int) -> tuple[int, int] | None:
    """Lengths of two unpacked pieces with the largest sum in (least, most]."""
    for total in range(most, max(least, 1), -1):
        both = free & (back >> (size - total))  # bit x: x and total - x are both there
        while both:
            x = both.bit_length() - 1
            if 2 * x != total or counts[x] > 1:
                return x, total - x
            both ^= 1 << x
    return None


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece."""
    lengths = np.asarray(lengths, dtype=np.int64)
    bins = min((_filled(lengths, size, least) for least in (2, 1)), key=len)
    order = np.argsort(-lengths, kind="stable")
    first = np.searchsorted(-lengths[order], -np.arange(size + 1), "left").tolist()
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for k, held in enumerate(bins):
        at = 0
        for n in held:
            row = order[first[n]]
            first[n] += 1
            sequence[row], offset[row] = k, at
            at += n
    return sequence, offset


def _filled(lengths: np.ndarray, size: int, least: int) -> list[list[int]]:
    """The lengths in each sequence; one of fewer than ``least`` pieces has none replaced.

    Bits of two integers mark which lengths are still there.
    """
    counts = np.bincount(lengths, minlength=size + 1).tolist()
    free = sum(1 << n for n, c in enumerate(counts) if c)
    back = sum(1 << (size - n) for n, c in enumerate(counts) if c)

    def take(n: int) -> None:
        nonlocal free, back
        counts[n] -= 1
        if not counts[n]:
            free ^= 1 << n
            back ^= 1 << (size - n)

    def put(n: int) -> None:
        nonlocal free, back
        if not counts[n]:
            free ^= 1 << n
            back ^= 1 << (size - n)
        counts[n] += 1

    bins: list[list[int]] = []
    while free:
        held, gap = [], size
        while gap and (fit := free & ((1 << gap + 1) - 1)):
            n = fit.bit_length() - 1
            take(n)
            held.append(n)
            gap -= n
        while gap and len(held) >= least:
            small = min(held)
            pair = _pair(free, back, counts, size, gap + small, small)
            if pair is None:
                break
            held.remove(small)
            for n in pair:
                take(n)
                held.append(n)
            put(small)
            gap += small - sum(pair)
        bins.append(held)
    return bins


def packed(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Each piece with its sequence_id and offset; ``keep_ids`` also keeps the token ids."""
    spark = docs.sparkSession
    pieces = stored(tokenised(docs, tokenizer, size, end_id, keep_ids))
    n = pieces.count()
    shards = max(1, -(-n // SHARD_PIECES))
    tasks = max(shards, 1)
    # Shards of about equal size whatever the keys: the row's place in the input deals it.
    dealt = pieces.select("part", "row", "piece", "length").withColumn("shard", F.pmod(F.xxhash64("part", "row", "piece"), F.lit(shards)))

    def plan(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("part", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        sequence, offset = best_two_fit(group.column("length").to_numpy(), size)
        shard = group.column("shard")[0].as_py()
        return group.select(["part", "row", "piece"]).append_column("sequence_id", pa.array(sequence * shards + shard)).append_column("offset", pa.array(offset))

    plans = dealt.repartition(min(tasks, 4 * shuffle_partitions(spark)), "shard").groupBy("shard").applyInArrow(plan, "part int, row long, piece int, sequence_id long, offset long")
    return pieces.join(plans, ["part", "row", "piece"]).drop("part", "row")
