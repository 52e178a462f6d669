"""Suffix-array dedup: a logarithmic family of sparse suffix arrays finds every repeated stretch of ``length`` bytes.

Each window of ``length`` bytes is told by the smallest hash among its k-byte grams; windows in a row with the same such
gram are one segment, and the text from its gram on is one suffix of the index. Equal windows have equal grams at the same
place, so suffixes at these grams are enough to find every match: about 1 in 35 positions. A level of the index holds
suffixes sorted by their text: by its first HEAD bytes, and, where these are equal, by the hash of the segment. It is
stored in shards by gram, so a merge moves the new batch only. Batches come in document order; each is sorted and
scanned together with the levels in one merge, in which

* a suffix whose segment is there before repeats it, so all its windows are repeats;
* for others the longest prefix they have in common with a neighbour of another segment says which windows may have
  company at all: those that need no more bytes from the gram on. These, few, are compared again in blocks of STEP
  windows, told by what all windows of the block have in common, and at last window by window.

The new batch becomes a level, merged with the level of its own size, that with the next of its size, and so on.

Sorted suffixes are scanned as a stream, CHUNK at a time, so no group of equal suffixes is held. Repeats within a block, and
those of segments that a task has seen to repeat before, are settled before the shuffle, so a segment in a third of all
documents is about one row a task, not one a document.

Null texts are empty. A null id comes before all others. Rows that share an id are one document: equal stretches at equal
starts of such rows are no repeats. Repeated rows are judged alike; columns other than the id and the text are ignored.
Ids must be integers. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ledgerline.llm.common import blocks, mix, owner, prefix_hash, saved, shared_dir, slice_hash, utf8

LENGTH, GRAM, HEAD = 100, 32, 48
#: Bytes of text that are hashed at a time, and into how many batches a table is cut.
PIECE, BATCHES = 1 << 20, 4
#: Suffixes that a merge looks at together, and segments that a task remembers as repeated.
CHUNK, KNOWN = 1 << 16, 1 << 17
#: Windows of a segment that are compared together where segments differ.
STEP = 8
_MASK = np.uint64((1 << 21) - 1)
#: ``at`` packs the first window, the number of windows and the distance from there to the gram.
SUFFIX = "shard int, head binary, seg long, doc long, tag long, at long"
#: Blocks of windows are told by hashes alone.
BLOCKS = "key long, seg long, doc long, tag long, at long"
#: ``state`` of a suffix: its windows repeat others, or how many of its first windows were given out for comparison.
REPEATED = -1
_BASE = 1 << 11


def packed(start: np.ndarray, n: np.ndarray, off: np.ndarray) -> np.ndarray:
    return (start * _BASE + n) * _BASE + off


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at // (_BASE * _BASE), at // _BASE % _BASE, at % _BASE


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts of at most PIECE + length bytes together: the gram and segment hashes, the first window, the number of
    windows and the distance to the gram of each segment."""
    wide = length - gram + 1
    if len(data) < length:
        return (*[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 3)
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = slice_hash(prefix, at, at + gram)
    order = (grams & ~_MASK) | at.astype(np.uint64)
    fill = np.full(-len(order) % wide, np.iinfo(np.uint64).max, np.uint64)
    table = np.concatenate([order, fill]).reshape(-1, wide)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    least = (np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & _MASK).astype(np.int64)
    inside = owner(offsets, np.arange(n)) == owner(offsets, np.arange(length - 1, len(data)))
    windows = np.flatnonzero(inside)
    if not len(windows):
        return (*[np.zeros(0, np.uint64)] * 2, *[windows] * 3)
    least = least[windows]
    fresh = np.append(True, (np.diff(windows) != 1) | (np.diff(least) != 0))
    low = windows[fresh]
    n = np.diff(np.append(np.flatnonzero(fresh), len(windows)))
    return grams[least[fresh]], slice_hash(prefix, low, low + n + length - 1), low, n, least[fresh] - low


def pieces(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of each part, start of each part in its text), texts cut so that a piece stays small; parts of
    one text overlap by ``length`` - 1 bytes, so that each window is in one part."""
    data, offsets = utf8(texts)
    row = 0
    while row < len(offsets) - 1:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        if offsets[to] - offsets[row] <= PIECE:
            yield data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], np.arange(row, to), np.zeros(to - row, np.int64)
        else:
            for at in range(int(offsets[row]), int(offsets[to]), PIECE):
                part = data[at : min(at + PIECE + length - 1, int(offsets[to]))]
                yield part, np.array([0, len(part)]), np.array([row]), np.array([at - offsets[row]])
        row = to


def _earliest(keys: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows repeat an earlier one (by document, then start) with the same key."""
    again = np.zeros(len(keys), bool)
    order = np.lexsort((start, doc, keys))
    k, d, s = keys[order], doc[order], start[order]
    same = np.append(False, k[1:] == k[:-1])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(k)))) if len(k) else np.zeros(0, np.int64)
    again[order] = same & ((d != d[lead]) | (s != s[lead]))
    return again


def _rows(key: np.ndarray, seg: np.ndarray, doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """BLOCKS and ``again``: whether a row repeats an earlier one of the same block. Such rows need no comparison and get
    keys of their own."""
    again = _earliest(seg, doc, unpacked(at)[0])
    spread = mix(mix(doc.astype(np.uint64)) + at.astype(np.uint64))
    key, seg = np.where(again, spread, key), np.where(again, spread, seg)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(doc), pa.array(tag), pa.array(at), pa.array(again)], names=["key", "seg", "doc", "tag", "at", "again"])


class Seen:
    """Segments that repeat in the blocks of a task so far, with the first place of each: at most KNOWN, the earliest met."""

    def __init__(self) -> None:
        self.seg, self.doc, self.start = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def again(self, seg: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which rows repeat an earlier one of this block or task."""
        out = _earliest(seg, doc, start)
        if len(self.seg):
            k = np.minimum(np.searchsorted(self.seg, seg), len(self.seg) - 1)
            out |= (self.seg[k] == seg) & ((doc > self.doc[k]) | (doc == self.doc[k]) & (start > self.start[k]))
        mine = np.isin(seg, np.unique(seg[out])) & ~out
        seg, doc, start = (np.concatenate(x) for x in ((self.seg, seg[mine]), (self.doc, doc[mine]), (self.start, start[mine])))
        order = np.lexsort((start, doc, seg))
        seg, doc, start = seg[order], doc[order], start[order]
        first = np.append(True, seg[1:] != seg[:-1])[: len(seg)]
        if np.count_nonzero(first) <= KNOWN:
            self.seg, self.doc, self.start = seg[first], doc[first], start[first]
        return out


def binary(table: np.ndarray, size: np.ndarray) -> pa.Array:
    """Rows of bytes, each cut to its size."""
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    inside = table[np.arange(table.shape[1]) < size[:, None]] if len(table) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(inside))])


def bytes_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``binary``: rows of ``width`` bytes, filled up with zeros, and the sizes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.diff(offsets)
    table = np.zeros((len(column), width), np.uint8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    if len(column):
        table[np.arange(width) < size[:, None]] = data[offsets[0] : offsets[-1]]
    return table, size


def suffixes(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """SUFFIX and ``again`` of all segments of ``docs`` (doc, tag, text). Rows that repeat others of their task need no
    comparison; they have no head and lie in any shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for block in blocks(batches):
            doc, tag = block.column("doc").to_numpy(), block.column("tag").to_numpy()
            for data, offsets, row, base in pieces(block.column("text"), length):
                key, seg, low, n, off = segments(data, offsets, length, gram)
                part = owner(offsets, low)
                d, start = doc[row[part]], low - offsets[part] + base[part]
                again = seen.again(seg, d, start)
                size = np.where(again, 0, np.minimum(HEAD, n + length - 1 - off))
                places = np.minimum((low + off)[:, None] + np.arange(HEAD), max(len(data) - 1, 0))
                shard = np.where(again, mix(mix(d.astype(np.uint64)) + start.astype(np.uint64)), key) >> np.uint64(33)
                columns = [pa.array(shard.astype(np.int32)), binary(data[places], size) if len(low) else pa.array([], pa.binary()), pa.array(seg.view(np.int64)), pa.array(d), pa.array(tag[row[part]]), pa.array(packed(start, n, off)), pa.array(again)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "head", "seg", "doc", "tag", "at", "again"])

    return docs.select("doc", "tag", "text").mapInArrow(run, f"{SUFFIX}, again boolean")


def _opened(batches: Iterator[pa.RecordBatch], ranges: str) -> Iterator[pa.RecordBatch]:
    """Batches of (row: id, doc, tag, text; ranges) with the fields of ``row`` as columns."""
    for b in batches:
        row = b.column("row")
        yield pa.RecordBatch.from_arrays([*(row.field(c) for c in ("id", "doc", "tag", "text")), b.column(ranges)], names=["id", "doc", "tag", "text", ranges])


def cut(docs: DataFrame, step: int, length: int = LENGTH) -> DataFrame:
    """BLOCKS and ``again`` of the ranges ``some`` of ``docs`` (row: id, doc, tag, text), cut into blocks of ``step`` windows.

    Blocks are counted from the gram, so equal windows of different segments are in blocks that begin alike; the key is
    the hash of the bytes that all windows of a block have in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(_opened(batches, "some"), limit=PIECE):
            data, offsets = utf8(block.column("text"))
            doc, tag, some = block.column("doc").to_numpy(), block.column("tag").to_numpy(), block.column("some")
            row = np.repeat(np.arange(block.num_rows), np.diff(some.offsets.to_numpy()))
            start, n, off = unpacked(some.flatten().to_numpy(zero_copy_only=False))
            start = start + offsets[row]
            order = np.argsort(start, kind="stable")
            row, start, n, off = row[order], start[order], n[order], off[order]
            i = 0
            while i < len(start):
                j = int(np.searchsorted(start, start[i] + PIECE, "right"))
                j = i + max(1, int(np.searchsorted(np.cumsum(n[i:j]), PIECE, "right")))
                which = np.repeat(np.arange(i, j), n[i:j])
                p = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
                back = start[which] + off[which] - p  # from the window to its gram
                fresh = np.append(True, (which[1:] != which[:-1]) | (back[1:] // step != back[:-1] // step))
                low, which, back = p[fresh], which[fresh], back[fresh]
                m = np.diff(np.append(np.flatnonzero(fresh), len(p)))
                prefix = prefix_hash(data[start[i] : (low + m).max() + length - 1])
                common = low + back % step - start[i]
                key = slice_hash(prefix, common, common + length - step + 1)
                seg = slice_hash(prefix, low - start[i], low - start[i] + m + length - 1)
                r = row[which]
                yield _rows(key, seg, doc[r], tag[r], packed(low - offsets[r], m, back))
                i = j

    return docs.select("row", "some").mapInArrow(run, f"{BLOCKS}, again boolean")


_OUT = ["key", "seg", "doc", "tag", "at", "state"]
#: What the comparison says of a block of windows: alone, in company, or a repeat.
FIRST, SHARED, REPEAT = 0, 1, 2


def compared(rows: DataFrame, partitions: int) -> DataFrame:
    """BLOCKS and ``state`` of blocks of windows, sorted by key and judged in one pass."""
    columns = ["key", "seg", "doc", "tag", "at"]
    run = rows.select(*columns, "again").repartition(partitions, "key").sortWithinPartitions("key", "seg", "doc", "at")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, segment, and the document and start of the first row of that segment
        many, held = False, None  # of the last key: has it several segments; its first row, if it has one segment only

        def out(columns: dict[str, np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c][keep]) for c in _OUT], names=_OUT)

        for b in batches:
            if not b.num_rows:
                continue
            x = {c: b.column(c).to_numpy(zero_copy_only=False) for c in columns}
            key, seg, doc, start, again = x["key"], x["seg"], x["doc"], unpacked(x["at"])[0], b.column("again").to_numpy(zero_copy_only=False)
            goes_on = last is not None and key[0] == last[0]
            new_key = np.append(not goes_on, key[1:] != key[:-1])
            new_seg = np.append(not (goes_on and seg[0] == last[1]), (key[1:] != key[:-1]) | (seg[1:] != seg[:-1]))
            group = np.cumsum(new_key) - int(new_key[0])
            segs = np.bincount(group, weights=new_seg).astype(np.int64)
            if goes_on:
                segs[0] += 2 if many else 1
            lead = np.maximum.accumulate(np.where(new_seg, np.arange(len(key)), -1))
            lead_doc = np.where(lead >= 0, doc[lead], last[2] if last else 0)
            lead_start = np.where(lead >= 0, start[lead], last[3] if last else 0)
            repeat = again | ~new_seg & ((doc != lead_doc) | (start != lead_start))
            x["state"] = np.where(repeat, REPEAT, np.where(segs[group] > 1, SHARED, FIRST)).astype(np.int32)
            keep = np.ones(len(key), bool)
            if held is not None and (segs[0] > 1 or len(segs) > 1 or not goes_on):
                held["state"] = np.array([SHARED if goes_on and segs[0] > 1 else FIRST], np.int32)
                yield out(held, np.array([True]))
                held = None
            first = int(np.flatnonzero(new_key)[-1]) if new_key.any() else -1
            if first >= 0 and segs[-1] == 1 and not again[first]:
                held = {c: x[c][first : first + 1].copy() for c in _OUT}
                keep[first] = False
            many = bool(segs[-1] > 1)
            last = key[-1], seg[-1], lead_doc[-1], lead_start[-1]
            yield out(x, keep)
        if held is not None:
            yield out(held, np.array([True]))

    return run.mapInArrow(scan, f"{BLOCKS}, state int")


_JUDGED = ["shard", "head", "seg", "doc", "tag", "at", "level", "state", "newly"]


def _chunks(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Sorted suffixes, about CHUNK at a time, cut between grams; only a gram with more suffixes than that goes on in the
    next chunk. With each: whether its first gram goes on from before, and its last one in the next."""
    held, before = [], False

    def grams(table: pa.Table) -> np.ndarray:
        heads, _ = bytes_of(table.column("head").combine_chunks(), HEAD)
        return np.flatnonzero(np.append(True, (heads[1:, :gram] != heads[:-1, :gram]).any(axis=1)))

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) < CHUNK:
            continue
        table = pa.Table.from_batches(held)
        cut = int(grams(table)[-1])
        if cut:
            yield table.slice(0, cut), before, False
            held, before = table.slice(cut).to_batches(), False
        else:
            yield table, before, True
            held, before = [], True
    if held:
        yield pa.Table.from_batches(held), before, False


def _judge(table: pa.Table, before: bool, after: bool, last: list, length: int, gram: int) -> dict[str, np.ndarray | pa.Array]:
    """The columns of _JUDGED for one chunk. ``last`` holds head, segment, and the first document and start of the segment
    that the chunk before ended with, and is brought up to date."""
    heads, size = bytes_of(table.column("head").combine_chunks(), HEAD)
    seg, doc, tag, at, mark = (table.column(c).to_numpy() for c in ("seg", "doc", "tag", "at", "mark"))
    start, n, off = unpacked(at)
    level, was = mark // 4096 - 1, mark % 4096 - 1
    settled = was == REPEATED
    common = np.minimum.accumulate(heads[1:] == heads[:-1], axis=1).sum(axis=1) if len(heads) > 1 else np.zeros(0, np.int64)
    common = np.minimum(common, np.minimum(size[1:], size[:-1]))
    same_head = (common == size[1:]) & (common == size[:-1])
    fresh = np.append(True, ~same_head | (seg[1:] != seg[:-1]))  # the first row of each segment
    if before and last and bytes(heads[0, : size[0]]) == last[0] and seg[0] == last[1]:
        fresh[0] = False
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(seg)), -1))
    lead_doc = np.where(lead >= 0, doc[lead], last[2] if last else 0)
    lead_start = np.where(lead >= 0, start[lead], last[3] if last else 0)
    repeat = settled | ~fresh & ((doc != lead_doc) | (start != lead_start))
    # the longest prefix in common with the segment before or after; all of a head may go on, so it counts as no limit
    firsts = np.flatnonzero(fresh)
    joint = np.where(common < gram, 0, np.where(common >= np.minimum(size[1:], size[:-1]), length, common))
    beside = np.zeros(len(firsts), np.int64)  # with the segment before
    inner = firsts[firsts > 0]
    beside[firsts > 0] = joint[inner - 1]
    if before and len(firsts) and firsts[0] == 0:
        beside[0] = length
    following = np.append(beside[1:], length if after else 0)
    most = np.maximum(beside, following)
    run = np.cumsum(fresh) - 1
    reach = np.where(run >= 0, most[np.maximum(run, 0)] if len(most) else length, length)
    if before:  # rows that go on with the segment of the chunk before
        reach[run < 0] = length
    if before or after:  # a gram of several chunks: nothing is ruled out by neighbours out of sight
        edge = np.zeros(len(seg), bool)
        edge[0], edge[-1] = before, after
        reach[edge] = length
    need = np.where(reach >= length, n, np.clip(off - (length - reach) + 1, 0, n))
    need[repeat] = 0
    state = np.where(repeat, REPEATED, np.maximum(np.maximum(was, 0), need)).astype(np.int32)
    last[:] = [bytes(heads[-1, : size[-1]]), seg[-1], lead_doc[-1], lead_start[-1]]
    return {"seg": seg, "doc": doc, "tag": tag, "at": at, "level": level.astype(np.int32), "state": state, "newly": np.where(~repeat & (need > np.maximum(was, 0)), need, 0).astype(np.int32)}


def merge_scan(batch: DataFrame, levels: list[DataFrame], merging: set[int], partitions: int, length: int, gram: int, last: bool) -> DataFrame:
    """Sort a batch and the levels together, shard by shard, and judge each suffix in one pass.

    Returns _JUDGED (level -1: the batch; newly: windows given out for comparison, 0 for none) of the rows of the batch, of
    levels in ``merging``, and of others with windows to compare; of the ``last`` batch only what was found."""
    columns = ["shard", "head", "seg", "doc", "tag", "at"]
    new = batch.select(*columns, F.when(F.col("again"), 1 + REPEATED).otherwise(1).alias("mark")).repartition(partitions, "shard")
    old = [t.select(*columns, (F.lit(4096 * (k + 1)) + F.col("state") + 1).alias("mark")) for k, t in enumerate(levels)]
    run = reduce(DataFrame.union, [new, *old]).sortWithinPartitions("head", "seg", "doc", "at")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for table, before, after in _chunks(batches, gram):
            got = _judge(table, before, after, held, length, gram)
            keep = (got["newly"] > 0) | (got["level"] < 0) & (got["state"] == REPEATED)
            if not last:
                keep |= (got["level"] < 0) | np.isin(got["level"], list(merging))
            rows = np.flatnonzero(keep)
            head, shard = (table.column(c).combine_chunks().take(pa.array(rows)) for c in ("head", "shard"))
            yield pa.RecordBatch.from_arrays([shard, head, *(pa.array(got[c][rows]) for c in _JUDGED[2:])], names=_JUDGED)

    return run.mapInArrow(scan, f"{SUFFIX}, level int, state int, newly int")


class Family:
    """Levels of suffixes whose sizes, counted in batches, are powers of two. A level is a table bucketed by shard, so that
    it is merged where it lies: Spark unites tables of equal buckets bucket by bucket."""

    def __init__(self, partitions: int, length: int = LENGTH, gram: int = GRAM) -> None:
        self.partitions, self.length, self.gram = partitions, length, gram
        self.levels: list[tuple[int, DataFrame]] = []
        self.merges, self.names = 0, []

    def _stored(self, judged: DataFrame) -> DataFrame:
        spark, name = judged.sparkSession, f"suffixes_{uuid.uuid4().hex}"
        rows = judged.withColumn("part", F.spark_partition_id())
        rows.write.bucketBy(self.partitions, "shard").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
        self.names.append(name)
        table = spark.table(name)
        spread = table.select("shard", "part").distinct().agg(F.count("*"), F.count_distinct("shard")).first()
        if spread[0] != spread[1]:
            raise RuntimeError("a shard was merged in several tasks: Spark did not unite the buckets of equal tables")
        return table.drop("part")

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """Scan a batch (doc, tag, text), whose documents come after all before, and return what was found: ``doc, tag, at,
        state``, REPEATED rows of the batch, and ranges of windows to compare. The batch becomes a level, unless it is the
        ``last``."""
        size, merging = 1, set()
        for k in reversed(range(len(self.levels))):
            if self.levels[k][0] != size or last:
                break
            merging.add(k)
            size *= 2
        spark = docs.sparkSession
        setting = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
        before = spark.conf.get(setting)
        spark.conf.set(setting, "false")  # buckets stay buckets below a union
        try:
            judged = merge_scan(suffixes(docs, length=self.length, gram=self.gram), [t for _, t in self.levels], merging, self.partitions, self.length, self.gram, last)
            found = saved(judged.select("doc", "tag", "at", "level", "state", "newly"), "suffixes") if last else self._stored(judged)
        finally:
            spark.conf.set(setting, before)
        self.merges += len(merging)
        if not last:
            kept = found.filter((F.col("state") >= 0) & F.col("level").isin(-1, *merging))
            self.levels = [x for k, x in enumerate(self.levels) if k not in merging] + [(size, kept.select("shard", "head", "seg", "doc", "tag", "at", "state"))]
        repeated = found.filter((F.col("state") == REPEATED) & (F.col("level") < 0)).select("doc", "tag", "at", "state")
        some = F.shiftleft(F.shiftright("at", 22), 22) + F.col("newly") * _BASE + F.col("at") % _BASE
        return repeated.union(found.filter("newly > 0").select("doc", "tag", some.alias("at"), F.lit(SHARED)))

    def dropped(self, spark: SparkSession) -> None:
        """Take the levels' names out of the catalog; their files stay in the shared folder."""
        for name in self.names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def remaining(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (row: id, doc, tag, text; gone: packed ranges of repeated windows) as ``id, n_bytes, n_removed, n_spans, kept_sha256``,
    and the removed stretches as ``spans``."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(_opened(batches, "gone")):
            data, offsets = utf8(block.column("text"))
            gone = block.column("gone")
            ends, values = gone.offsets.to_numpy(), gone.values.to_numpy(zero_copy_only=False)
            rows = []
            for row in range(block.num_rows):
                whole = data[offsets[row] : offsets[row + 1]].tobytes()
                if ends[row] == ends[row + 1]:
                    rows.append((len(whole), 0, 0, hashlib.sha256(whole).hexdigest(), []))
                    continue
                begin, n, _ = unpacked(np.sort(values[ends[row] : ends[row + 1]]))
                end = np.maximum.accumulate(begin + n + length - 1)
                fresh = np.append(True, begin[1:] > end[:-1])
                begin, end = begin[fresh], end[np.append(fresh[1:], True)]
                digest = hashlib.sha256()
                for a, b in zip(np.append(0, end).tolist(), np.append(begin, len(whole)).tolist(), strict=True):
                    digest.update(whole[a:b])
                rows.append((len(whole), int((end - begin).sum()), len(begin), digest.hexdigest(), [{"start": a, "end": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)]))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([block.column("id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], span)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema["row"].dataType["id"].dataType.simpleString()
    return docs.select("row", "gone").mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def dedup(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row of ``docs`` (integer ids): what is left after
    each byte is removed that lies in a stretch of ``length`` bytes which also starts earlier."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be of an integer type, not {kind.simpleString()}: documents come in its order")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(docs[text_col], F.lit(""))
    own = docs.select(docs[id_col].alias("id"), F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("doc"), text.alias("text"))
    unique = not own.groupBy("doc").count().filter("count > 1").limit(1).count()
    own = own.withColumn("tag", F.lit(0).cast("long") if unique else F.xxhash64("text"))  # tells texts of one id apart
    cuts = own.select("doc").stat.approxQuantile("doc", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    family, found = Family(partitions, length, gram), []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    for low, high in zip(edges, edges[1:], strict=False):
        batch = own if low is None else own.filter(F.col("doc") >= low)
        found.append(family.add(batch if high is None else batch.filter(F.col("doc") < high), last=high is None))
    judged = saved(reduce(DataFrame.union, found), "found")
    family.dropped(spark)
    keys = ["doc"] if unique else ["doc", "tag"]
    # one column holds all of a row, so that every use of these rows has the same columns and Spark shuffles them once
    dealt = own.select(*keys, F.struct("id", "doc", "tag", "text").alias("row")).repartition(partitions, *keys)

    def with_ranges(rows: DataFrame, name: str, how: str) -> DataFrame:
        ranges = rows.groupBy(*keys).agg(F.collect_list("at").alias(name)).hint("shuffle_hash")
        return dealt.join(ranges, keys, how).select("row", F.coalesce(name, F.array().cast("array<long>")).alias(name))

    def where(rows: DataFrame, state: int) -> DataFrame:
        return rows.filter(F.col("state") == state).select("doc", "tag", "at")

    parts = compared(cut(with_ranges(where(judged, SHARED), "some", "inner"), STEP, length), partitions)
    windows = compared(cut(with_ranges(where(parts, SHARED), "some", "inner"), 1, length), partitions)
    gone = where(judged, REPEATED).union(where(parts, REPEAT)).union(where(windows, REPEAT))
    return remaining(with_ranges(gone, "gone", "left"), length).withColumnRenamed("id", id_col)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
