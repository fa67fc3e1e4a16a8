"""Chat formatting by columnar byte assembly, and the parser of its output.

A turn is ``### role: text</turn>\\n``. Inside roles and texts a backslash goes before every backslash, before
``###`` and before ``</turn>``, and in roles before ``:``; so a marker is one only where no escaping backslash
stands before it, and texts come back unchanged. Segment lengths, offsets and scatter indices are numpy
arrays; headers and contents are copied into one buffer that becomes the Arrow column.

Defined cases: null roles and texts are empty; rows of equal turn go by role, then text, and equal rows stay
as often as they come; a null turn comes first; rows without conv_id are one conversation; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.llm.common import shuffle_partitions, texts

HEAD, SEP, TAIL = b"### ", b": ", b"</turn>\n"
#: Bytes of content assembled at a time; one conversation is never cut.
ASSEMBLE_BYTES = 16 << 20


def _found(data: np.ndarray, what: bytes) -> np.ndarray:
    """Mask of the places where ``what`` begins."""
    out = np.ones(len(data), dtype=bool)
    for k, b in enumerate(what):
        out[: len(data) - k] &= data[k:] == b
        out[max(len(data) - k, 0) :] = False
    return out


def assemble(roles: list[bytes], contents: list[bytes], conversation: np.ndarray, n: int) -> tuple[pa.Array, list[list[dict]]]:
    """The formatted text of each of ``n`` conversations and its loss mask.

    ``conversation`` numbers each turn's conversation, in order. The mask is spans of code points, the
    escaped text of each assistant turn.
    """
    turns = len(roles)
    segments = [x for pair in zip(roles, contents, strict=True) for x in pair]
    size = np.array([len(x) for x in segments], dtype=np.int64)
    first = np.cumsum(size) - size
    data = np.frombuffer(b"".join(segments), dtype=np.uint8)
    segment = np.repeat(np.arange(2 * turns), size)
    left = (first + size)[segment] - np.arange(len(data))  # bytes to the segment's end
    escape = (data == ord("\\")) | (_found(data, b"###") & (left >= 3)) | (_found(data, b"</turn>") & (left >= 7)) | ((data == ord(":")) & (segment % 2 == 0))
    before = np.concatenate([[0], np.cumsum(escape)])
    longer = size + before[first + size] - before[first]
    role, text = longer[0::2], longer[1::2]
    length = len(HEAD) + role + len(SEP) + text + len(TAIL)
    start = np.cumsum(length) - length
    place = np.empty(2 * turns, dtype=np.int64)
    place[0::2] = start + len(HEAD)
    place[1::2] = start + len(HEAD) + role + len(SEP)
    out = np.empty(int(length.sum()), dtype=np.uint8)
    target = place[segment] + np.arange(len(data)) - first[segment] + before[1:] - before[first[segment]]
    out[target] = data
    out[target[escape] - 1] = ord("\\")
    for mark, at in ((HEAD, start), (SEP, place[0::2] + role), (TAIL, place[1::2] + text)):
        for k, b in enumerate(mark):
            out[at + k] = b
    total = np.bincount(conversation, weights=length, minlength=n).astype(np.int64) if turns else np.zeros(n, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(total)])
    column = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    spans: list[list[dict]] = [[] for _ in range(n)]
    for k in (k for k, r in enumerate(roles) if r == b"assistant"):
        c = int(conversation[k])
        zero = points[offsets[c]]
        spans[c].append({"start": int(points[place[2 * k + 1]] - zero), "end": int(points[place[2 * k + 1] + text[k]] - zero)})
    return column, spans


def _escaping(data: np.ndarray) -> np.ndarray:
    """Mask of the backslashes that escape the byte behind them."""
    slash = data == ord("\\")
    at = np.arange(len(data))
    other = np.maximum.accumulate(np.where(slash, -1, at)) if len(data) else at
    return slash & ((at - other) % 2 == 1)


def unescape(text: bytes) -> bytes:
    data = np.frombuffer(text, dtype=np.uint8)
    return data[~_escaping(data)].tobytes()


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn; ValueError if ``formatted`` is not what ``assemble`` writes."""
    data = np.frombuffer(formatted, dtype=np.uint8)
    escaping = _escaping(data)
    plain = np.ones(len(data), dtype=bool)
    plain[1:] = ~escaping[:-1]
    ends = np.flatnonzero(_found(data, TAIL) & plain)
    colons = np.flatnonzero(_found(data, SEP) & plain)
    out, at = [], 0
    for end in ends.tolist():
        k = int(np.searchsorted(colons, at))
        if formatted[at : at + len(HEAD)] != HEAD or k == len(colons) or colons[k] >= end:
            raise ValueError(f"no turn at byte {at}")
        role, text = slice(at + len(HEAD), colons[k]), slice(colons[k] + len(SEP), end)
        out.append((data[role][~escaping[role]].tobytes(), data[text][~escaping[text]].tobytes()))
        at = end + len(TAIL)
    if at != len(formatted):
        raise ValueError(f"no turn at byte {at}")
    return out


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation, its turns in order."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        roles: list[bytes] = []
        contents: list[bytes] = []

        def flush(upto: int) -> pa.RecordBatch:
            number, seen = np.zeros(upto, dtype=np.int64), [ids[0]] if upto else []
            for k in range(1, upto):
                if ids[k] != ids[k - 1]:
                    seen.append(ids[k])
                number[k] = len(seen) - 1
            column, spans = assemble(roles[:upto], contents[:upto], number, len(seen))
            del ids[:upto], roles[:upto], contents[:upto]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_pydict({"conv_id": pa.array(seen, pa.int64()), "formatted": column.cast(pa.string()), "loss": pa.array(spans, kind)})

        held = 0
        for batch in batches:
            ids += batch.column("conv_id").to_pylist()
            roles += texts(batch.column("role"))
            contents += texts(batch.column("text"))
            held += batch.nbytes
            if held > ASSEMBLE_BYTES:
                whole = len(ids)  # the last conversation may go on in the next batch
                while whole and ids[whole - 1] == ids[-1]:
                    whole -= 1
                if whole:
                    yield flush(whole)
                    held = sum(map(len, contents))
        if ids:
            yield flush(len(ids))

    return dealt.mapInArrow(run, "conv_id long, formatted string, loss array<struct<start:long,end:long>>")


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted texts and their loss masks hold, read back from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = parse(text.encode())
                under = "".join(unescape(text[s["start"] : s["end"]].encode()).decode() for s in loss)
                all_turns = b"".join(role + b"\n" + content + b"\n" for role, content in turns)
                for column, value in zip(columns, (len(turns), hashlib.sha256(all_turns).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)), strict=True):
                    column.append(value)
            names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id")} | {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return formatted(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
