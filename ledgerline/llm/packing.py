"""Packing: order-preserving dynamic programming over cut positions.

Documents stay in the order in which their partition delivers them. A window of at most ``size`` tokens may end at a
document or sentence boundary for nothing, and inside a sentence at a truncation penalty. The programme minimises
padding plus penalties:

    best[i] = size - T[i] + penalty[i] + min(best[j] + T[j])    over the cuts j with T[i] - T[j] <= size

where T is the token position of a cut; a monotone queue holds the minimum of the sliding window, so each cut is handled
in constant time. Cuts go on until ``SEGMENT`` tokens are gathered; what follows the last full window of a segment is
carried into the next, so memory is bounded and only the end of a partition is padded for want of text.

Null text is empty and becomes one piece with the closing id alone. Repeated rows are packed as they come.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import BLANK_WORD, _table, blocks, runs, utf8
from ledgerline.llm.token_counts import model_path

SIZE = 2048
END_ID = 1
#: Tokens that are gathered before a segment is cut.
SEGMENT = 1 << 18
#: Inside a sentence cuts are possible every STEP tokens, at PENALTY tokens of padding each.
STEP, PENALTY = 16, 4
#: Words whose ids a worker remembers before it forgets all of them.
CACHE_ENTRIES = 800_000
#: Bytes that end a sentence at the end of a word.
STOP = _table(b".!?")
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_models: dict[str, tuple] = {}


class _Words:
    """What is known of words, by number: their ids in a row, where each begins, how many it has."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.first, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, words: list[bytes], model) -> np.ndarray:
        """The number of each word; those not known yet are encoded, many words joined by blanks at a time."""
        new = [w for w in words if w not in self.number]
        ids, counts = [self.ids], [self.n]
        for at in range(0, len(new), 5_000):
            some = new[at : at + 5_000]
            text = b" ".join(some).decode()
            found = model.encode(text, add_special_tokens=False)
            word = np.cumsum(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)  # of each character
            begin = np.fromiter((x for x, _ in found.offsets), np.int64)
            counts.append(np.bincount(word[begin], minlength=len(some)))
            ids.append(np.array(found.ids, np.uint32))
        if new:
            self.ids, self.n = np.concatenate(ids), np.concatenate(counts)
            self.first = np.cumsum(self.n) - self.n
            self.number.update(zip(new, range(len(self.number), len(self.n)), strict=True))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def listed(words: pa.LargeBinaryArray) -> list[bytes]:
    """The words as a list, by one split of their bytes set apart by blanks."""
    bounds = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    spaced = np.full(bounds[-1] + len(words), 32, np.uint8)
    spaced[np.arange(bounds[-1]) + np.repeat(np.arange(len(words)), np.diff(bounds))] = np.frombuffer(words.buffers()[2], np.uint8)[: bounds[-1]]
    return spaced.tobytes().split()


def load(path: str) -> tuple:
    if path not in _models:
        from tokenizers import Tokenizer

        _models[path] = Tokenizer.from_file(path), _Words()
    return _models[path]


def encode(texts: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's ids with END_ID at the end, and the positions at which its sentences end.

    The vocabulary's own splitter drops white space and never joins over it, so a text's ids are those of its
    blank-separated parts in a row; equal parts are encoded once per worker, and the rest is done by array for the block.
    """
    model, known = load(path)
    if len(known.number) > CACHE_ENTRIES:
        known = _Words()
        _models[path] = model, known
    data, offsets = utf8(texts)
    inside = BLANK_WORD[data]
    starts, ends = runs(inside, offsets)
    bounds = [None, pa.py_buffer(np.append(0, np.cumsum(ends - starts)).astype(np.int64)), pa.py_buffer(data[inside])]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), bounds).dictionary_encode()
    at = known.numbers(listed(words.dictionary), model)[words.indices.to_numpy()]
    n = known.n[at]
    upto = np.append(0, np.cumsum(n))
    ids = known.ids[np.repeat(known.first[at] - upto[:-1], n) + np.arange(upto[-1])]
    stops = STOP[data[ends - 1]]
    cuts = np.searchsorted(starts, offsets).tolist()
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        a, b = upto[low], upto[high]
        yield np.append(ids[a:b], np.uint32(END_ID)), upto[low + 1 : high + 1][stops[low:high]] - a


def cut_points(ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a text of ``n`` ids after which a window may end, and what ending there costs."""
    free = np.unique(np.append(ends[(ends > 0) & (ends < n)], n))
    gaps = np.diff(free, prepend=0)
    count = (gaps - 1) // STEP + 1  # cuts every STEP tokens, and the last one where the sentence ends
    upto = np.cumsum(count)
    inner = np.arange(1, upto[-1] + 1) - np.repeat(upto - count, count)
    at = np.minimum(np.repeat(free - gaps, count) + STEP * inner, np.repeat(free, count))
    cost = np.full(len(at), PENALTY)
    cost[upto - 1] = 0
    return at, cost


def windows(points: list[int], costs: list[int], size: int) -> list[int]:
    """Indexes of the cuts that end a window; points[0] is the start, the last point always ends one."""
    best, back = [0] * len(points), [0] * len(points)
    queue: deque[tuple[int, int]] = deque([(points[0], 0)])  # (best + position, index), rising
    for i in range(1, len(points)):
        at = points[i]
        while points[queue[0][1]] < at - size:
            queue.popleft()
        value, back[i] = queue[0]
        best[i] = size - at + costs[i] + value
        mine = best[i] + at
        while queue and queue[-1][0] >= mine:
            queue.pop()
        queue.append((mine, i))
    out, i = [], len(points) - 1
    while i:
        out.append(i)
        i = back[i]
    return out[::-1]


class _Packer:
    """The documents of one partition, as far as they are not yet packed."""

    def __init__(self, size: int, first_sequence: int) -> None:
        self.size, self.sequence = size, first_sequence
        self.docs: list[tuple] = []  # key, ids, start of what is left, cut points, costs
        self.held = 0

    def add(self, key: object, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append((key, ids, 0, *cut_points(ends, len(ids))))
        self.held += len(ids)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        points, costs, base = [0], [0], 0
        for _, ids, start, at, cost in self.docs:
            points += (at - start + base).tolist()
            costs += cost.tolist()
            base += len(ids) - start
        ends = [points[i] for i in windows(points, costs, self.size)]
        if not last:
            ends = ends[: max(0, len(ends) - 2)]  # the windows before the end may yet be cut better
        k, used, begin = 0, 0, 0  # document, tokens before its rest, start of the window
        for end in ends:
            offset = 0
            while begin < end:
                key, ids, start, at, cost = self.docs[k]
                n = min(end - begin, len(ids) - start)
                yield key, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), self.sequence, offset
                begin, offset = begin + n, offset + n
                if start + n == len(ids):
                    k += 1
                else:
                    keep = at > start + n
                    self.docs[k] = key, ids, start + n, at[keep], cost[keep]
            self.sequence += 1
        self.docs = self.docs[k:]
        self.held = sum(len(x[1]) - x[2] for x in self.docs)


def pack(docs: DataFrame, *, model: str = "word_bpe_49k.json", size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every row of ``docs``: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each input partition is packed by itself, without a shuffle; its sequences are numbered from partition << 32.
    """
    path = model if "/" in model else model_path(model)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", *(x.split()[0] for x in SCHEMA.split(", "))]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(size, TaskContext.get().partitionId() << 32)
        key_type = None

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            if rows := list(packer.flush(last)):
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

        for block in blocks(batches):
            key_type = block.column("id").type
            for key, (ids, ends) in zip(block.column("id").to_pylist(), encode(block.column("text"), path), strict=True):
                packer.add(key, ids, ends)
                if packer.held > SEGMENT:
                    yield from out(False)
        yield from out(True)

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(pieces, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
