"""Benchmark passages in documents, by a prefix-filtered set join with exact checks.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. An item's windows are its
runs of ``size`` words, or the whole item when it is shorter. A window is contained only where all its
shingles are, so its necessary prefix, in the order of rarity over all documents, is its rarest shingle. A
document's shingles meet that index; the shingle's place in the window gives the only place of the window
in the document (positional bound), which must lie inside the document (length bound); the words are then
compared. Equal windows of a block are one, with the list of their items. The benchmark is taken in blocks of
bounded size, each against all documents.

Defined cases: null texts and texts without words have no words, no hits and are clean; an item without
words has no window; repeated items count once by item_id and a null item_id is the empty string; repeated
documents each give a row; very long texts are taken whole, one at a time, and repeated words in them cost no more
than others; empty tables give clean or no rows; other columns, whatever their names, are carried but not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.llm.common import slices, texts, windows, without, word_hashes

#: Bytes of benchmark text that are indexed and sent to the workers at a time.
BLOCK_BYTES = 4 << 20
#: Words of a shingle; shorter items are one shingle.
SHINGLE = 4

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Words:
    """The words of some texts, as one buffer and arrays over all words."""

    def __init__(self, documents: list[bytes]) -> None:
        self.buffer = b" ".join(documents).translate(_WORDS)
        begin = np.cumsum([0] + [len(x) + 1 for x in documents])
        self.starts, self.ends, self.hashes = word_hashes(self.buffer)
        self.doc = np.searchsorted(begin, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(documents)) if len(self.doc) else np.zeros(len(documents), dtype=np.int64)
        self.first = np.cumsum(self.counts) - self.counts

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the runs of ``width`` words inside one text."""
        value = windows(self.hashes, width)
        inside = np.flatnonzero(self.doc[: len(value)] == self.doc[width - 1 :]) if len(value) else np.empty(0, dtype=np.int64)
        return inside, value[inside]

    def bytes_at(self, at: int, n: int) -> list[bytes]:
        return self.buffer[self.starts[at] : self.ends[at + n - 1]].split()


class Block:
    """The distinct windows of some items and the shingles among which each picks its rarest."""

    def __init__(self, ids: list[str], items: list[bytes], size: int) -> None:
        self.ids, self.words = ids, Words(items)
        w = self.words
        at = np.concatenate([np.arange(f, f + max(c - size + 1, min(c, 1))) for f, c in zip(w.first, w.counts, strict=True)] or [np.empty(0)]).astype(np.int64)
        item = w.doc[at]
        first, number = self._distinct(at, np.minimum(w.counts[item], size))
        self.at = at[first]
        self.length = np.minimum(w.counts[w.doc[self.at]], size)
        # The items of window k are held[edge[k] : edge[k + 1]].
        pairs = np.unique(np.stack([number, item]), axis=1) if len(at) else np.empty((2, 0), dtype=np.int64)
        self.held, self.edge = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.at) + 1))
        self.spelled = self._spelled()
        width = np.minimum(self.length, SHINGLE)
        # Each window's shingles, as (window, offset, value).
        reach = self.length - width + 1
        self.window = np.repeat(np.arange(len(self.at)), reach)
        self.offset = np.arange(len(self.window)) - np.repeat(np.cumsum(reach) - reach, reach)
        place, self.width = self.at[self.window] + self.offset, width[self.window]
        self.value = np.zeros(len(self.window), dtype=np.uint64)
        for n in np.unique(self.width).tolist():
            mine = self.width == n
            self.value[mine] = windows(w.hashes, n)[place[mine]]
        self.values = np.unique(self.value)
        self.widths = np.unique(self.width).tolist()
        self.index: tuple[np.ndarray, ...] = ()
        self.filter = self._filter(self.values)

    def _distinct(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first window of each kind, kind of each window) by the hashes of all their words."""
        w, value = self.words, np.zeros(len(at), dtype=np.uint64)
        for n in np.unique(length).tolist():
            value[length == n] = windows(w.hashes, n)[at[length == n]] + np.uint64(n)
        first, number = np.unique(value, return_index=True, return_inverse=True)[1:]
        model = first[number]
        alike = length == length[model]
        for k in range(int(length.max(initial=0))):
            on = alike & (k < length)
            alike[on] = w.hashes[at[on] + k] == w.hashes[at[model[on]] + k]
        odd = np.flatnonzero(~alike)  # other words of the same hash are windows of their own
        number[odd] = len(first) + np.arange(len(odd))
        return np.concatenate([first, odd]), number

    def _spelled(self) -> dict[int, bytes | None]:
        """The word behind each hash; None where several words have it."""
        w, out = self.words, {}
        for h, a, b in zip(w.hashes.tolist(), w.starts.tolist(), w.ends.tolist(), strict=True):
            word = w.buffer[a:b]
            if out.setdefault(h, word) != word:
                out[h] = None
        return out

    @staticmethod
    def _filter(values: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << 20, dtype=bool)
        table[(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return table

    def pick(self, counts: np.ndarray) -> None:
        """Keep of each window the shingle that the fewest documents hold; ``counts`` follows ``values``."""
        rarity = counts[np.searchsorted(self.values, self.value)]
        order = np.lexsort((self.offset, self.value, rarity, self.window))
        first = order[np.unique(self.window[order], return_index=True)[1]]
        value, offset, window = self.value[first], self.offset[first], self.window[first]
        order = np.argsort(value, kind="stable")
        self.index = value[order], offset[order], window[order]
        self.filter = self._filter(value)

    def matches(self, words: Words, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, first of values, number of values) of the shingles of ``words`` among sorted ``values``."""
        places, low, count = [], [], []
        for n in self.widths:
            place, value = words.shingles(n)
            maybe = self.filter[(value & np.uint64((1 << 20) - 1)).astype(np.int64)]
            place, value = place[maybe], value[maybe]
            a, b = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
            places.append(place[b > a])
            low.append(a[b > a])
            count.append((b - a)[b > a])
        return tuple(np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (places, low, count))

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence of a window in ``words``."""
        values, offsets, owners = self.index
        place, low, count = self.matches(words, values)
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        place = np.repeat(place, count) - offsets[at]
        window = owners[at]
        length = self.length[window]
        doc = words.doc[place + offsets[at]]
        inside = (place >= words.first[doc]) & (place + length <= words.first[doc] + words.counts[doc])
        place, window, length = place[inside], window[inside], length[inside]
        same = np.ones(len(place), dtype=bool)
        for k in range(int(length.max(initial=0))):
            on = same & (k < length)
            same[on] = words.hashes[place[on] + k] == self.words.hashes[self.at[window[on]] + k]
        place, window = place[same], window[same]
        # Equal hashes are checked by the words themselves, each word that a hit covers once.
        step = np.zeros(len(words.starts) + 1, dtype=np.int64)
        np.add.at(step, place, 1)
        np.add.at(step, place + self.length[window], -1)
        covered = np.flatnonzero(np.cumsum(step) > 0)
        odd = np.zeros(len(words.starts) + 1, dtype=np.int64)
        odd[covered] = [self.spelled[h] != words.buffer[a:b] for h, a, b in zip(words.hashes[covered].tolist(), words.starts[covered].tolist(), words.ends[covered].tolist(), strict=True)]
        before = np.concatenate([[0], np.cumsum(odd)])
        exact = before[place + self.length[window]] == before[place]
        for k in np.flatnonzero(~exact).tolist():
            n = int(self.length[window[k]])
            exact[k] = words.bytes_at(int(place[k]), n) == self.words.bytes_at(int(self.at[window[k]]), n)
        return place[exact], window[exact]

    def items(self, doc: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (document, item) of hits."""
        doc, window = np.unique(np.stack([doc, window]), axis=1)
        many = self.edge[window + 1] - self.edge[window]
        at = np.repeat(self.edge[window] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return tuple(np.unique(np.stack([np.repeat(doc, many), self.held[at]]), axis=1))


def _counted(docs: DataFrame, block: Block) -> np.ndarray:
    """In how many documents each shingle of the block occurs, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        total = np.zeros(len(mine.values), dtype=np.int64)
        for batch in slices(batches, "text"):
            words = Words(texts(batch.column("text")))
            place, low, _ = mine.matches(words, mine.values)
            pairs = np.unique(words.doc[place] * len(mine.values) + low)
            total += np.bincount(pairs % max(len(mine.values), 1), minlength=len(mine.values))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(found), "n": pa.array(total[found])})

    sums = docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(block.values), dtype=np.int64)
    out[sums.column("k").to_numpy()] = sums.column("n").to_numpy()
    return out


def _blocks(benchmark: DataFrame, size: int) -> Iterator[Block]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // BLOCK_BYTES)
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toArrow()
        yield Block([x or "" for x in rows.column("item_id").to_pylist()], texts(rows.column("text").combine_chunks()), size)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """Per row of ``docs``: doc_id, row (a hash of its text), n_words, n_hit, items (sorted), contaminated."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = []
    for block in _blocks(benchmark, size):
        block.pick(_counted(docs, block))
        blocks.append(_scan(docs, block))
    if not blocks:
        blocks.append(_scan(docs, Block([], [], size)))
    if len(blocks) == 1:
        return blocks[0].select("doc_id", "row", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_hit"), "items").transform(_judged)
    # Blocks meet by row. Equal rows have equal answers, so of each block a row of them is kept with their number.
    every = None
    for k, block in enumerate(blocks):
        one = block.groupBy("doc_id", "row").agg(*(F.first(c).alias(c) for c in ("n_words", "spans", "items")), F.count("*").alias("copies")).withColumn("block", F.lit(k))
        every = one if every is None else every.unionByName(one)

    def merge(group: pa.Table) -> pa.Table:
        spans = sorted({(s["at"], s["at"] + s["n"]) for row in group.column("spans").to_pylist() for s in row})
        hit, end = 0, -1
        for a, b in spans:
            hit += max(0, b - max(a, end))
            end = max(end, b)
        items = sorted({x for row in group.column("items").to_pylist() for x in row})
        return group.slice(0, 1).select(["doc_id", "row", "n_words", "copies"]).append_column("n_hit", pa.array([hit], pa.int64())).append_column("items", pa.array([items], pa.list_(pa.string())))

    merged = every.groupBy("doc_id", "row").applyInArrow(merge, "doc_id long, row long, n_words long, copies long, n_hit long, items array<string>")
    each = merged.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "row", "n_words", "n_hit", "items").transform(_judged)


def _judged(df: DataFrame) -> DataFrame:
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _scan(docs: DataFrame, block: Block) -> DataFrame:
    """Per row: doc_id, a hash of its text, n_words, the hit words as spans, and the items found."""
    if not block.index:
        block.pick(np.zeros(len(block.values), dtype=np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in slices(batches, "text"):
            words = Words(texts(batch.column("text")))
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            items: list[list[str]] = [[] for _ in range(batch.num_rows)]
            place, window = mine.hits(words)
            if len(place):
                step = np.zeros(len(words.starts) + 1, dtype=np.int64)
                np.add.at(step, place, 1)
                np.add.at(step, place + mine.length[window], -1)
                inside = np.concatenate([[0], (np.cumsum(step)[:-1] > 0).astype(np.int8), [0]])
                edge = np.zeros(len(words.starts) + 1, dtype=bool)  # texts end spans
                edge[words.first[words.counts > 0]] = True
                starts = np.flatnonzero((inside[1:-1] == 1) & ((inside[:-2] == 0) | edge[:-1]))
                ends = np.flatnonzero((inside[1:-1] == 1) & ((inside[2:] == 0) | edge[1:])) + 1
                for a, b, d in zip(starts.tolist(), ends.tolist(), words.doc[starts].tolist(), strict=True):
                    spans[d].append({"at": a - int(words.first[d]), "n": b - a})
                for d, i in zip(*(x.tolist() for x in mine.items(words.doc[place], window)), strict=True):
                    items[d].append(mine.ids[i])
            kind = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "n_words": pa.array(words.counts.astype(np.int64)), "spans": pa.array(spans, kind), "items": pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))})

    return docs.withColumn("row", F.xxhash64("text")).mapInArrow(run, "doc_id long, row long, n_words long, spans array<struct<at:long,n:long>>, items array<string>")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated. A row goes for its own text, whatever
    other rows its doc_id stands on; the other cases are the module's."""
    bad = contamination(docs, benchmark, size).where("contaminated").select(F.col("doc_id").alias("id"), F.col("row").alias("text_hash"))
    marked = docs.select(F.struct(*docs.columns).alias("kept"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"))
    return without(marked, bad, "id", "text_hash").select("kept.*")


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = contamination(docs, benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
