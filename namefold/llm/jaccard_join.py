"""Exact Jaccard join of documents on word shingles, with the components of its links.

The join is a prefix-filtered one with set-relation skipping:

* Equal sets are one node. Tokens (shingles) are ordered rare first: tokens that come often over the whole
  corpus stand last by their count, all others before them by their hash. Two sets that link share a token in their
  prefixes, and at their first common token both have enough tokens left (the positional bound).
* Index lists hold the prefix tokens' sets with size and position. Round one verifies each list's pivot
  against the list, so a large group of near copies costs as many checks as it has members.
* Round two derives the rest from the pivots' answers: a block of list entries of one component is skipped
  against itself; two blocks are skipped when no entry's remaining tokens suffice; and a pair is skipped
  when ``|x & y| <= |y & p| + |x - p|`` for the pivot p already rules it out. Of what is left, a pair with a set
  x that links with p is answered from p's answer, ``|y & x| = |y & p| - |y & (p - x)| + |y & (x - p)|``, so
  that only x's differences from p travel to y; the others are verified in full.

Links inside a component found so far need no check, since the result is components. Sets are compared by
64-bit hashes of their shingles, and nodes are told apart by 64 bits of a digest of the whole set.

Defined cases: null, empty and blank texts have no shingles, link with nothing and are their own component;
fewer words than the width make one shingle; repeated rows and equal sets share a component; rows without a
doc_id link like others, but a null doc_id never names a component unless the whole component has none; very long
texts are taken whole, one at a time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namefold.llm.common import join_hot, mix, only, shuffle_partitions, slices, stored, texts, windows, without, word_hashes

#: Tokens that a task orders and deals at a time.
CHUNK_TOKENS = 750_000
#: Index entries of one part, which one task sorts.
PART_ENTRIES = 750_000
#: Entries of one token's list that a part may hold; tokens that come more often have their lists made by joins.
HOT_LIST = 150_000
#: A token is frequent if it comes so often, and at most so many (16 MB) are, those that come most. Other tokens
#: are ordered by hash, which changes no result: any one order of all tokens is exact.
FREQUENT, MOST_FREQUENT = 4, 1 << 21
#: Partners of one pivot that are verified together.
PIVOT_CHUNK = 256
#: Open pairs of one list, at most, that are verified one by one; beyond, its pivot's lists are counted in blocks.
LIST_PAIRS = 4096
#: Tokens of one block of sets.
BLOCK_TOKENS = 400_000
#: Links, at most, that one task unites (some 100 MB); more go through rounds of stars, with the same result.
SMALL_LINKS = 300_000
#: Routes of one node in one row.
ROUTES = 500
#: Rows of routes that are broadcast at most (of 40 bytes or so); more meet the documents in a shuffle.
BROADCAST_ROWS = 200_000

_LOW = bytes.maketrans(b"\t\n\x0b\x0c\r" + bytes(range(65, 91)), b"     " + bytes(range(97, 123)))


def shingle_sets(documents: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles of each text, sorted by owner and hash."""
    buffer = b" ".join(documents).translate(_LOW)
    begin = np.cumsum([0] + [len(x) + 1 for x in documents])
    starts, _, words = word_hashes(buffer)
    doc = np.searchsorted(begin, starts, "right") - 1
    whole = windows(words, width)
    fits = doc[: len(whole)] == doc[width - 1 :] if len(whole) else np.empty(0, dtype=bool)
    owners, hashes = [doc[: len(whole)][fits]], [whole[fits]]
    counts = np.bincount(doc, minlength=len(documents)) if len(doc) else np.zeros(len(documents), dtype=np.int64)
    first = np.cumsum(counts) - counts
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            owners.append(short)
            hashes.append(windows(words, n)[first[short]])
    owner, value = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def node_of(values: np.ndarray) -> int:
    """The node of a set: 64 bits of a digest of its sorted hashes."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes) of the rows of a batch that have shingles."""
    owner, value = shingle_sets(texts(batch.column("text")), width)
    rows, first = np.unique(owner, return_index=True)
    for row, a, b in zip(rows.tolist(), first, np.append(first[1:], len(value)), strict=True):
        yield row, value[a:b]


def needed(a: Column, b: Column) -> Column:
    """The least overlap of linked sets of these sizes: 100 * o >= 75 * (a + b - o)."""
    return F.floor((3 * (a + b) + 6) / 7)


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (3 * (a + b) + 6) // 7


def sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, h, n, node) of each row: a hash of its text, and a null node where there are no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            size, node = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for row, values in _sets(batch, width):
                size[row], node[row] = len(values), node_of(values)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "h": batch.column("h"), "n": pa.array(size), "node": pa.array(node, mask=size == 0)})

    return docs.withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id long, h long, n long, node long")


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, rep, rep_h, copies): the least doc_id of a node's rows, null if none has one, and that row's text hash."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("r")
    return rows.where("n > 0").groupBy("node").agg(least, F.count("*").alias("copies")).select("node", F.col("r.doc_id").alias("rep"), F.col("r.h").alias("rep_h"), "copies")


def _short(token: np.ndarray, parts: int) -> np.ndarray:
    """A token as its part and 32 bits. It only orders tokens and gathers candidates, which are verified in full."""
    part = (token >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return part << np.uint64(32) | token & np.uint64(0xFFFFFFFF)


def frequent_tokens(docs: DataFrame, width: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, count) of the short tokens that come FREQUENT times or more over all documents, rarest first; the
    MOST_FREQUENT ones at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)  # short tokens sort by part
            held.clear()
            part, cut = np.unique((token >> np.uint64(32)).astype(np.int32), return_index=True)
            ends = np.append(cut[1:], len(token))
            blobs = [[x[i:j].astype(np.uint32).tobytes() for i, j in zip(cut, ends, strict=True)] for x in (token, n)]
            return pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "token": pa.array(blobs[0], pa.binary()), "n": pa.array(blobs[1], pa.binary())})

        for batch in slices(batches, "text"):
            words = word_hashes(b" ".join(texts(batch.column("text"))).translate(_LOW))[2]
            held.append(_short(windows(words, width), parts))  # a few cross two texts; this only orders tokens
            if sum(map(len, held)) > CHUNK_TOKENS:
                yield flush()
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["part"], []).append(tuple(np.frombuffer(row[c], dtype=np.uint32) for c in ("token", "n")))
        for part in list(held):
            token, n = (np.concatenate(x) for x in zip(*held.pop(part), strict=True))
            order = np.argsort(token, kind="stable")
            token, n = token[order], n[order]
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            total = np.add.reduceat(n.astype(np.int64), first)
            often = total >= FREQUENT
            yield pa.RecordBatch.from_pydict({"token": pa.array(token[first][often].astype(np.int64) | np.int64(part) << np.int64(32)), "n": pa.array(total[often])})

    counted = docs.select("text").mapInArrow(run, "part int, token binary, n binary").repartition(parts, "part").mapInArrow(count, "token long, n long")
    # The bar is the least step of counts from which on no more than MOST_FREQUENT tokens are left.
    counted = stored(counted.withColumn("step", F.floor(F.log2("n") * 8).cast("int")))
    left, bar = MOST_FREQUENT, None
    for step, tokens in sorted(map(tuple, counted.groupBy("step").count().collect()), reverse=True):
        left -= tokens
        if left < 0:
            break
        bar = step
    if bar is None:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    most = counted.where(F.col("step") >= bar).select("token", "n").toArrow()
    token, n = most.column("token").to_numpy(), most.column("n").to_numpy()
    order = np.lexsort((token, n))
    return token[order].astype(np.uint64), n[order]


def index_blobs(docs: DataFrame, width: int, frequent: tuple[np.ndarray, np.ndarray], parts: int) -> DataFrame:
    """Prefix entries dealt by token over parts, as one row per chunk of texts and part.

    ``frequent`` holds the frequent short tokens of these parts, rarest first, and their counts. Equal sets of a chunk
    are indexed once. Entries of tokens that come more than HOT_LIST times are dealt by node instead, over as many more
    parts, with the token's place among the frequent ones.
    """
    by_value = np.argsort(frequent[0])
    shared = docs.sparkSession.sparkContext.broadcast((frequent[0][by_value], by_value + 1, frequent[1][by_value] > HOT_LIST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks, hot = shared.value
        held: dict[int, np.ndarray] = {}

        def entries() -> pa.RecordBatch:
            sets = list(held.values())
            size = np.array([len(x) for x in sets], dtype=np.int64)
            token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            if len(values):
                short = _short(token, parts)
                at = np.minimum(np.searchsorted(values, short), len(values) - 1)
                rank = np.where(values[at] == short, ranks[at], 0)
                order = np.argsort(owner * (len(values) + 1) + rank, kind="stable")
                token = token[order]
            first = np.cumsum(size) - size
            pos = np.arange(len(token)) - first[owner]
            prefix = pos <= (size - (3 * size + 3) // 4)[owner]
            token, owner, pos = token[prefix], owner[prefix], pos[prefix]
            node = np.array(list(held), dtype=np.int64)
            short = _short(token, parts)
            part = (short >> np.uint64(32)).astype(np.int64)
            if hot.any():
                at = np.minimum(np.searchsorted(values, short), len(values) - 1)
                often = hot[at] & (values[at] == short)
                token = np.where(often, at.astype(np.uint64), token)
                part = np.where(often, parts + node[owner] % parts, part)
            order = np.argsort(part, kind="stable")
            token, owner, pos, part = token[order], owner[order], pos[order], part[order]
            which, cut = np.unique(part, return_index=True)
            rows = []
            for p, a, b in zip(which.tolist(), cut, np.append(cut[1:], len(part)), strict=True):
                mine, local = np.unique(owner[a:b], return_inverse=True)
                rows.append((p, b - a, token[a:b].astype(np.uint32).tobytes(), local.astype(np.uint32).tobytes(), pos[a:b].astype(np.uint32).tobytes(), node[mine].tobytes(), size[mine].astype(np.uint32).tobytes()))
            held.clear()
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_pydict({"part": pa.array(columns[0], pa.int32()), "entries": pa.array(columns[1], pa.int64())} | {n: pa.array(c, pa.binary()) for n, c in zip(("token", "owner", "pos", "node", "size"), columns[2:], strict=True)})

        total = 0
        for batch in slices(batches, "text"):
            for _, values_of in _sets(batch, width):
                node = node_of(values_of)
                if node not in held:
                    held[node] = values_of
                    total += len(values_of)
            if total > CHUNK_TOKENS:
                yield entries()
                total = 0
        if held:
            yield entries()

    return docs.mapInArrow(run, "part int, entries long, token binary, owner binary, pos binary, node binary, size binary")


def lists(blobs: DataFrame, parts: int) -> DataFrame:
    """From the index lists: pivot pairs (kind 0) and the entries of lists of three and more (kind 1).

    Lists of a part with the same members are one, with each member's least position. Entries of hot tokens are
    passed on as they are (kind 2).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                token, owner, pos, size = (np.frombuffer(row[c], dtype=np.uint32) for c in ("token", "owner", "pos", "size"))
                node = np.frombuffer(row["node"], dtype=np.int64)
                if row["part"] >= parts:
                    lid = mix(token + np.uint64(parts)).view(np.int64)
                    yield from out(2, node[owner], node[owner], lid, size[owner].astype(np.int64), pos.astype(np.int64))
                    continue
                held.setdefault(row["part"], []).append((token, node[owner], size[owner].astype(np.int64), pos.astype(np.int64)))
        for part in list(held):
            yield from one(part, *(np.concatenate(x) for x in zip(*held.pop(part), strict=True)))

    def out(kind: int, a: np.ndarray, b: np.ndarray, lid: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(a), 50_000):
            cut = slice(k, k + 50_000)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(a[cut]), kind, dtype=np.int32)), "p": pa.array(a[cut]), "x": pa.array(b[cut]), "lid": pa.array(lid[cut]), "n": pa.array(n[cut]), "pos": pa.array(pos[cut])})

    def one(part: int, token: np.ndarray, node: np.ndarray, size: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((node, token))
        token, node, size, pos = token[order], node[order], size[order], pos[order]
        new = np.ones(len(token), dtype=bool)  # chunks may repeat a set
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, size, pos = token[new], node[new], size[new], pos[new]
        edge = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        length = np.diff(np.append(edge, len(token)))
        keep = np.repeat(length > 1, length)
        node, size, pos = node[keep], size[keep], pos[keep]
        length = length[length > 1]
        if not len(length):
            return
        edge = np.cumsum(length) - length
        # A list's pivot is its least node, the same in all lists with these members.
        lead = np.repeat(edge, length)
        need = _needed(size, size[lead])
        passes = (np.minimum(size - pos, (size - pos)[lead]) >= need) & (np.arange(len(node)) != lead)
        pairs = np.unique(np.stack([node[lead][passes], node[passes]]), axis=1)
        none = np.zeros(pairs.shape[1], dtype=np.int64)
        yield from out(0, pairs[0], pairs[1], none, none, none)
        sign = np.add.reduceat(mix(node.view(np.uint64)), edge)
        sign = mix(sign + np.uint64(part)).view(np.int64)
        long = np.repeat(length > 2, length)
        lid, node, size, pos, pivot = np.repeat(sign, length)[long], node[long], size[long], pos[long], node[lead][long]
        order = np.lexsort((pos, node, lid))
        lid, node, size, pos, pivot = lid[order], node[order], size[order], pos[order], pivot[order]
        new = np.ones(len(lid), dtype=bool)
        new[1:] = (lid[1:] != lid[:-1]) | (node[1:] != node[:-1])
        yield from out(1, pivot[new], node[new], lid[new], size[new], pos[new])

    return blobs.repartition(parts, "part").mapInArrow(run, "kind int, p long, x long, lid long, n long, pos long")


def hot_lists(found: DataFrame) -> DataFrame:
    """What ``lists`` gives of the other tokens, for the entries of the hot ones (kind 2), by joins that split them."""
    rows = stored(found.where("kind = 2").groupBy("lid", F.col("x").alias("node")).agg(F.min("n").alias("n"), F.min("pos").alias("pos")))
    pivots = rows.groupBy("lid").agg(F.min(F.struct("node", "n", "pos")).alias("lead"), F.count("*").alias("members"))
    both = stored(join_hot(rows, pivots, "lid", "members", rows.count()))
    p, m = F.col("lead.node").alias("p"), F.col("lead.n")
    room = F.least(F.col("n") - F.col("pos"), m - F.col("lead.pos"))
    pairs = both.where((F.col("node") != F.col("lead.node")) & (room >= needed(F.col("n"), m))).select(F.lit(0).alias("kind"), p, F.col("node").alias("x"), *(F.lit(0).cast("long").alias(c) for c in ("lid", "n", "pos")))
    return pairs.unionByName(both.where("members > 2").select(F.lit(1).alias("kind"), p, F.col("node").alias("x"), "lid", "n", "pos"))


def _sent(docs: DataFrame, routes: DataFrame, nodes: DataFrame, width: int, total: int) -> DataFrame:
    """(key, chunk, side, comp, node, hashes): the set of each node, once for each of its ``total`` routes.

    ``routes`` is (node, key, chunk, side, comp). They meet the documents by broadcast if they are few. A node's
    text is that of its least doc_id; one whose rows have no id is found by the text's hash. A task sends a node
    once, however often its rows repeat.
    """
    of = nodes.select("node", "rep", "rep_h").join(routes.groupBy("node").agg(F.count("*").alias("n_routes")), "node")
    routes = join_hot(routes, of, "node", "n_routes", total).withColumn("piece", F.pmod(F.xxhash64("key", "chunk"), F.ceil(F.col("n_routes") / ROUTES)))
    routes = stored(routes.groupBy("rep", "rep_h", "node", "piece").agg(F.collect_list(F.struct("key", "chunk", "side", "comp")).alias("to")))
    rows, every, nameless = routes.agg(F.count("*"), F.coalesce(F.sum(F.size("to")), F.lit(0)), F.count(F.when(F.col("rep").isNull(), 1))).first()
    few = F.broadcast if max(rows, every) <= BROADCAST_ROWS else lambda df: df
    found = docs.join(few(routes), docs["doc_id"] == routes["rep"]).select("text", "node", "piece", "to")
    if nameless:
        once = docs.where("doc_id is null").groupBy(F.xxhash64("text").alias("rep_h")).agg(F.first("text").alias("text"))
        found = found.unionByName(once.join(few(routes.where("rep is null")), "rep_h").select("text", "node", "piece", "to"))
    names, kinds = ("key", "chunk", "side", "comp", "node", "hashes"), (*[pa.int64()] * 5, pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in slices(batches, "text"):
            node, piece, to = (batch.column(c).to_pylist() for c in ("node", "piece", "to"))
            rows: list[tuple] = []
            for row, values in _sets(batch, width):
                # Rows that repeat a doc_id may hold another text.
                if (node[row], piece[row]) not in done and node_of(values) == node[row]:
                    done.add((node[row], piece[row]))
                    blob = values.tobytes()
                    for t in to[row]:
                        rows.append((t["key"], t["chunk"], t["side"], t["comp"], node[row], blob))
                        if len(rows) >= 200:
                            yield batch_of(rows)
                            rows = []
            yield batch_of(rows)

    return found.mapInArrow(send, "key long, chunk long, side long, comp long, node long, hashes binary")


def _dealt(pairs: DataFrame, key: str, partner: str, total: int) -> DataFrame:
    """``pairs`` with the chunk of the key's partners that each is in."""
    chunks = pairs.groupBy(key).agg(F.ceil(F.count("*") / PIVOT_CHUNK).alias("chunks"), F.count("*").alias("n_pairs"))
    return join_hot(pairs, chunks, key, "n_pairs", total).withColumn("chunk", F.pmod(F.xxhash64(partner), F.col("chunks")))


def _routes(pairs: DataFrame, key: str, node: str, side: int) -> DataFrame:
    return pairs.select(F.col(node).alias("node"), F.col(key).alias("key"), "chunk", F.lit(side).cast("long").alias("side"), F.lit(0).cast("long").alias("comp"))


def _in(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Mask of the sorted ``values`` that are among the sorted ``others``."""
    return others[np.minimum(np.searchsorted(others, values), len(others) - 1)] == values if len(others) else np.zeros(len(values), dtype=bool)


def _is_link(inter: Column, np_: Column, nx: Column) -> Column:
    return 100 * inter >= 75 * (np_ + nx - inter)


def verify(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, width: int, differences: bool = False) -> DataFrame:
    """(p, x, inter, np, nx) of distinct ``pairs`` (p, x): each pivot's set meets its partners' sets, in chunks.

    With ``differences`` also, of links, ``gone`` (the pivot's hashes that x lacks) and ``new`` (those that x has beside it).
    """
    spark = docs.sparkSession
    total = pairs.count()
    routed = _dealt(pairs, "p", "x", total)
    sent = _sent(docs, _routes(routed, "p", "x", 1).unionByName(_routes(routed, "p", "p", 0).distinct()), nodes, width, 2 * total)
    names = ("p", "x", "inter", "np", "nx", "gone", "new")[: 7 if differences else 5]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot, done = None, np.empty(0, dtype=np.uint64), set()
        for batch in batches:
            rows = []
            for p, chunk, side, node, blob in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "side", "node")), batch.column("hashes"), strict=True):
                values = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                if side == 0:
                    at, pivot, done = (p, chunk), values, set()
                elif at == (p, chunk) and node not in done:
                    done.add(node)
                    held = _in(pivot, values)
                    inter = int(held.sum())
                    row = (p, node, inter, len(pivot), len(values))
                    if differences:
                        linked = 100 * inter >= 75 * (len(pivot) + len(values) - inter)
                        row += (pivot[~held].tobytes(), values[~_in(values, pivot)].tobytes()) if linked else (None, None)
                    rows.append(row)
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64() if k < 5 else pa.binary()) for k, (n, c) in enumerate(zip(names, columns, strict=True))})

    tasks = max(shuffle_partitions(spark), total // 5_000)
    met = sent.repartition(tasks, "key", "chunk").sortWithinPartitions("key", "chunk", "side")
    return stored(met.mapInArrow(meet, "p long, x long, inter long, np long, nx long" + ", gone binary, new binary" * differences))


def derive(docs: DataFrame, pairs: DataFrame, checked: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(p, x, inter, np, nx) of distinct ``pairs`` (y, x, via, shared), as p = y: from y's overlap ``shared`` with the
    pivot ``via`` and the differences between that pivot and x, which links with it."""
    spark = docs.sparkSession
    total = pairs.count()
    routed = _dealt(pairs, "y", "x", total)
    sent = _sent(docs, _routes(routed, "y", "y", 0).distinct(), nodes, width, total)
    none = F.lit(None)
    asked = sent.select("key", "chunk", "side", "node", none.cast("long").alias("shared"), none.cast("long").alias("n"), "hashes", none.cast("binary").alias("new"))
    known = checked.where("gone is not null").select(F.col("p").alias("via"), "x", F.col("nx").alias("n"), F.col("gone").alias("hashes"), "new")
    told = routed.join(known, ["via", "x"]).select(F.col("y").alias("key"), "chunk", F.lit(1).cast("long").alias("side"), F.col("x").alias("node"), "shared", "n", "hashes", "new")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            rows = []
            for key, chunk, side, node, shared, n, blob, new in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "side", "node", "shared", "n", "hashes", "new")), strict=True):
                values = np.frombuffer(blob, dtype=np.uint64)
                if side == 0:
                    at, own = (key, chunk), values
                elif at == (key, chunk):
                    inter = shared - int(_in(values, own).sum()) + int(_in(np.frombuffer(new, dtype=np.uint64), own).sum())
                    rows.append((key, node, inter, len(own), n))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("p", "x", "inter", "np", "nx"), columns, strict=True)})

    met = asked.unionByName(told).repartition(max(shuffle_partitions(spark), total // 5_000), "key", "chunk").sortWithinPartitions("key", "chunk", "side")
    return stored(met.mapInArrow(meet, "p long, x long, inter long, np long, nx long"))


def block_links(sets: list[np.ndarray], side: np.ndarray, comp: np.ndarray, cross: bool) -> list[tuple[int, int]]:
    """Linked pairs of ``sets`` (of both sides, if ``cross``) that tie the components ``comp`` together.

    The sets of the largest component are asked by the others only.
    """
    size = np.array([len(x) for x in sets], dtype=np.int64)
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    names, number, counts = np.unique(comp, return_inverse=True, return_counts=True)
    group = number.copy()
    out = []
    for x in np.flatnonzero(number != np.argmax(counts)).tolist():
        low, high = np.searchsorted(token, sets[x], "left"), np.searchsorted(token, sets[x], "right")
        span = high - low
        at = np.repeat(low - np.cumsum(span) + span, span) + np.arange(span.sum())
        inter = np.bincount(owner[at], minlength=len(sets))
        near = (100 * inter >= 75 * (size + size[x] - inter)) & (group != group[x])
        if cross:
            near &= side != side[x]
        for y in np.flatnonzero(near).tolist():
            if group[y] != group[x]:
                out.append((x, y))
                group[group == group[y]] = group[x]
    return out


def cluster_links(docs: DataFrame, members: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Links (u, v) among the distinct ``members`` (p, node, n, comp) of each pivot p, found in blocks of sets.

    The sets of a pivot's largest component go to one block each, where all others meet them; the others also
    meet among themselves, each pair of blocks once. So only sets outside the largest component are sent often.
    """
    spark = docs.sparkSession
    sizes = members.groupBy("p", "comp").agg(F.sum("n").alias("tokens"), F.count("*").alias("m"))
    per = sizes.groupBy("p").agg(F.max(F.struct("m", "comp", "tokens")).alias("top"), F.sum("tokens").alias("tokens"), F.sum("m").alias("members"))
    per = per.select("p", "members", F.col("top.comp").alias("top"), F.ceil(F.col("top.tokens") / BLOCK_TOKENS).alias("large"), F.ceil((F.col("tokens") - F.col("top.tokens")) / BLOCK_TOKENS).alias("small"))
    total = members.count()
    dealt = join_hot(members, per, "p", "members", total)
    in_top = F.col("comp") == F.col("top")
    one = dealt.where(in_top).select("node", F.col("p").alias("key"), F.pmod(F.xxhash64("node"), F.col("large")).alias("chunk"), F.lit(0).cast("long").alias("side"), "comp")
    rest = dealt.where(~in_top).withColumn("block", F.pmod(F.xxhash64("node"), F.col("small")))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cross = rest.select("node", F.col("p").alias("key"), span("large").alias("chunk"), F.lit(1).cast("long").alias("side"), "comp")
    met = rest.withColumn("other", span("small"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    among = met.select("node", F.col("p").alias("key"), (F.col("large") + low * F.col("small") + high).alias("chunk"), (F.when(low == high, 2).otherwise((F.col("block") == high).cast("int"))).cast("long").alias("side"), "comp")
    routes = stored(one.unionByName(cross).unionByName(among))
    total = routes.count()
    sent = _sent(docs, routes, nodes, width, total)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def flush() -> pa.RecordBatch:
            rows = []
            if len(held) > 1:
                node = list(held)
                side = np.array([held[k][0] for k in node])
                rows = [(node[i], node[j]) for i, j in block_links([held[k][2] for k in node], side, np.array([held[k][1] for k in node]), bool((side < 2).any()))]
            return pa.RecordBatch.from_pydict({"u": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.int64())})

        for batch in batches:
            for key, chunk, side, comp, node, blob in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "side", "comp", "node")), batch.column("hashes"), strict=True):
                if at != (key, chunk):
                    yield flush()
                    at, held = (key, chunk), {}
                held[node] = (side, comp, np.frombuffer(blob.as_buffer(), dtype=np.uint64))
        yield flush()

    dealt_out = sent.repartition(shuffle_partitions(spark), "key", "chunk").sortWithinPartitions("key", "chunk")
    return stored(dealt_out.mapInArrow(meet, "u long, v long"))


def _forest(links: DataFrame) -> DataFrame:
    """The links of each task, reduced to a forest that connects as much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(a: int) -> int:
            while (b := root.setdefault(a, a)) != a:
                root[a] = a = root[b]
            return a

        def flushed() -> pa.RecordBatch:
            rows = [(a, find(a)) for a in root if find(a) != a]
            root.clear()
            return pa.RecordBatch.from_pydict({"u": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.int64())})

        for batch in batches:
            for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            if len(root) > 1_000_000:
                yield flushed()
        yield flushed()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node on a link (u, v), by rounds of large and small stars until nothing changes."""

    def stars(edges: DataFrame, large: bool) -> DataFrame:
        """Each node ties its neighbours (large: the greater ones; small: the lesser, and itself) to the least."""
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        back = join_hot(near, least, "u", "n", total)
        if large:
            made = back.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            made = back.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return made.where("u <> v").distinct()

    edges = stored(_forest(links).where("u <> v").distinct())
    total = edges.count()
    if 0 < total <= SMALL_LINKS:  # one task's forest of bounded size is the answer
        edges = stored(_forest(edges.repartition(1)))
        total = 0
    mark = None
    while total:
        edges = stored(stars(stars(edges, True), False))
        total, check = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (total, check) == mark:
            break
        mark = (total, check)
    tied = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tied.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _linked(checked: DataFrame) -> DataFrame:
    return checked.where(_is_link(F.col("inter"), F.col("np"), F.col("nx"))).select(F.col("p").alias("u"), F.col("x").alias("v"))


def _open_pairs(entries: DataFrame) -> DataFrame:
    """(p, x, y, via, shared, told) of pairs of list entries (lid, p, node, n, pos, comp, inter, near) that may link.

    ``told`` pairs can be answered from the overlap ``shared`` of y with the pivot ``via``, with which x links.
    """
    blocks = entries.groupBy("lid", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("room"))
    a, b = (blocks.select("lid", *(F.col(c).alias(f"{c}_{s}") for c in ("comp", "lo", "hi", "room"))) for s in "ab")
    both = a.join(b, "lid").where("comp_a < comp_b").where((4 * F.col("hi_a") >= 3 * F.col("lo_b")) & (4 * F.col("hi_b") >= 3 * F.col("lo_a")))
    both = both.where(F.least("room_a", "room_b") >= needed(F.col("lo_a"), F.col("lo_b"))).select("lid", "comp_a", "comp_b")
    x, y = (entries.select("lid", *(F.col(c).alias(f"{c}_{s}") for c in ("comp", "node", "n", "pos", "inter", "near", "p"))) for s in "ab")
    pairs = both.join(x, ["lid", "comp_a"]).join(y.drop("p_b"), ["lid", "comp_b"])
    need = needed(F.col("n_a"), F.col("n_b"))
    pairs = pairs.where(F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need)
    through = F.least(F.col("inter_b") + F.col("n_a") - F.col("inter_a"), F.col("inter_a") + F.col("n_b") - F.col("inter_b"))
    pairs = pairs.where(through.isNull() | (through >= need))
    way = lambda x, y: F.struct(F.lit(True).alias("told"), F.col("p_a").alias("via"), F.col(f"node_{x}").alias("x"), F.col(f"node_{y}").alias("y"), F.col(f"inter_{y}").alias("shared"))
    by = F.when(F.col("near_a") & F.col("inter_b").isNotNull(), way("a", "b")).when(F.col("near_b") & F.col("inter_a").isNotNull(), way("b", "a"))
    # Of several pivots through which a pair can be answered any one will do.
    pairs = pairs.groupBy(F.least("node_a", "node_b").alias("p"), F.greatest("node_a", "node_b").alias("q")).agg(F.max(by).alias("by"))
    return pairs.select("p", F.col("q").alias("x"), F.col("by.x").alias("near_x"), F.col("by.y").alias("y"), F.col("by.via").alias("via"), F.col("by.shared").alias("shared"), F.col("by").isNotNull().alias("told"))


def _roots(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows (doc_id, h, n, node), the nodes with ``root``, the same for all of a component, and the number of rows."""
    spark = docs.sparkSession
    rows = stored(sets(docs, width))
    total_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    nodes = stored(_nodes(rows))
    parts = max(shuffle_partitions(spark), -(-total * 27 // 100 // PART_ENTRIES))
    frequent = frequent_tokens(docs, width, parts)
    found = stored(lists(index_blobs(docs, width, frequent, parts), parts))
    if (frequent[1] > HOT_LIST).any():
        found = stored(found.where("kind < 2").unionByName(hot_lists(found)))
    pairs = stored(found.where("kind = 0").select("p", "x").distinct())
    checked = verify(docs, pairs, nodes, width, differences=True)
    tied = stored(components(_linked(checked)))
    # Round two: entries with their component and their overlap with the list's pivot.
    entries = found.where("kind = 1").select("lid", "n", "pos", "p", F.col("x").alias("node"))
    n_entries = entries.count()
    of = entries.groupBy("node").agg(F.count("*").alias("in_lists")).join(tied.withColumnRenamed("root", "comp"), "node")
    entries = join_hot(entries, of, "node", "in_lists", n_entries, "left").withColumn("comp", F.coalesce("comp", "node")).drop("in_lists")
    answers = checked.select("p", F.col("x").alias("node"), "inter", _is_link(F.col("inter"), F.col("np"), F.col("nx")).alias("near"))
    entries = entries.join(answers, ["p", "node"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    entries = stored(entries.withColumn("inter", F.when(F.col("p") == F.col("node"), F.col("n")).otherwise(F.col("inter"))))
    per_list = entries.groupBy("lid", "comp").agg(F.count("*").alias("m")).groupBy("lid").agg(F.count("*").alias("comps"), F.sum("m").alias("members"))
    mixed = per_list.where("comps > 1").select("lid", "members", ((F.col("comps") - 1) * F.col("members") > LIST_PAIRS).alias("many"))
    entries = stored(join_hot(entries, mixed, "lid", "members", n_entries))
    members = stored(entries.where("many").groupBy("p", "node").agg(F.max("n").alias("n"), F.max("comp").alias("comp")))
    rest = stored(_open_pairs(entries.where("not many")).join(pairs, ["p", "x"], "left_anti"))
    told, full = rest.agg(F.count(F.when(F.col("told"), 1)), F.count(F.when(~F.col("told"), 1))).first()
    more = []
    if told:
        answered = rest.where("told").select("y", F.col("near_x").alias("x"), "via", "shared")
        more.append(_linked(derive(docs, answered, checked, nodes, width)))
    if full:
        more.append(_linked(verify(docs, rest.where("not told").select("p", "x"), nodes, width)))
    if members.head(1):
        more.append(cluster_links(docs, members, nodes, width))
    if more:
        links = tied.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v")
        for found in more:
            links = links.unionByName(found)
        tied = stored(components(links))
    return rows, nodes.join(tied, "node", "left").withColumn("root", F.coalesce("root", "node")), total_rows


def join(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the least doc_id reachable over links."""
    rows, named, total = _roots(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("members"))
    named = stored(join_hot(named.select("node", "copies", "root"), least, "root", "members", total).select("node", "copies", "component_id"))
    out = join_hot(rows.where("n > 0"), named, "node", "copies", total).select("doc_id", "n", "component_id")
    out = out.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of ``docs``, with all its columns, of each component; rows without shingles all stay.

    The row with the least doc_id stays, a row without an id only where no other is in the component; of rows that
    share that id the one with the least text hash, then the first by all its columns. A row goes only for its own
    text, so a doc_id that stands on unrelated texts keeps them all.
    """
    rows, named, total = _roots(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width)
    best = F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("id"), F.col("rep_h").alias("text_hash"))).alias("best")
    best = named.groupBy("root").agg(best, F.count("*").alias("members"))
    named = stored(join_hot(named.select("node", "copies", "root"), best, "root", "members", total).select("node", "copies", F.col("best.id").alias("id"), F.col("best.text_hash").alias("text_hash")))
    of = stored(join_hot(rows.where("n > 0").select("doc_id", "h", "node"), named, "node", "copies", total))
    stays = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("text_hash"))
    gone = of.where(~stays).select(F.col("doc_id").alias("id"), F.col("h").alias("text_hash"))
    marked = docs.select(F.struct(*docs.columns).alias("kept"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"))
    left = without(marked, gone, "id", "text_hash")
    repeated = stored(of.where(stays).groupBy("id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("id", "text_hash"))
    if repeated.head(1):
        again = only(left, repeated, "id", "text_hash")
        once = again.groupBy("id", "text_hash").agg(F.min_by("kept", F.to_json("kept")).alias("kept"))
        left = without(left, repeated, "id", "text_hash").select("kept").unionByName(once.select("kept"))
    return left.select("kept.*")
