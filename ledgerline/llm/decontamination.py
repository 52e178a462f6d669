"""Benchmark decontamination: a positional inverted index of the training words, asked for the benchmark's windows.

The index is stored once in the shared folder, in shards of some documents: every word of a shard, sorted, in how many of its
documents it is, and the list of its places. It knows nothing of a benchmark, so any number of them can be asked. Summed over
the shards, the document frequencies of a benchmark's words say which words of each window are rarest. In a shard, a window's
rarest word is looked up and its list intersected with those of the next rarest, shifted by their distance; what is left is
compared over the whole window. Lists that meet within a few words, but not exactly, are proximity matches.

The benchmark is hashed in tasks and read in blocks of bounded size. Each block is asked against all shards, its matches
are saved, and what was sent for it is dropped before the next; so neither plans nor memory grow with the benchmark. A shard
is a bounded number of bytes of text or one longer text, so a word in every document is a short list in each shard.

Null texts and texts without words have no windows. Items are told apart by id: rows with the same id are one item; rows
with a null id count for hits, not as items. Repeated documents are judged alike; other columns are ignored. Empty tables
give no rows or no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import ALNUM_WORD, LOWER, blocks, owner, prefix_hash, runs, saved, slice_hash, utf8

WINDOW = 13
#: Shards that are written and read at once.
SHARDS = 4
#: Words of the benchmark that one block may have.
BLOCK_WORDS = 1 << 20
#: Rarest words of a window that are intersected, and how far apart from their places they may be in a proximity match.
RAREST, SLACK = 3, 3
#: Words that lie between two documents of a shard at least, more than any window; candidates that are compared at a time.
GAP, CANDIDATES = 256, 1 << 20
MATCHES = {"spans_from": "array<long>", "spans_to": "array<long>", "items": "array<string>", "near_items": "array<string>"}


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """The hash of each word of a block of texts, the row it is in, and the number of rows."""
    data, offsets = utf8(texts)
    data = LOWER[data]
    starts, ends = runs(ALNUM_WORD[data], offsets)
    return slice_hash(prefix_hash(data), starts, ends), owner(offsets, starts), len(offsets) - 1


def lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """A list array of ``n`` rows from values whose rows ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards, stored in the shared folder: ``shard`` (a number), ``ids`` and ``n_words`` of its documents, and its
    inverted lists: ``terms`` (hashes of all its words, ascending), ``n_docs`` of each, ``ends`` of each one's list in ``places``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            h, doc, n = words_of(block.column("text"))
            n_words = np.bincount(doc, minlength=n)
            spot = np.arange(len(h)) + doc * GAP
            order = np.argsort(h, kind="stable")
            h, doc, spot = h[order], doc[order], spot[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            fresh = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
            n_docs = np.add.reduceat(fresh, first) if len(first) else first
            whole = lambda values: lists(values, np.zeros(len(values), np.int64), 1)
            ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), block.column("id"))
            columns = [ids, whole(n_words.astype(np.int64)), whole(h[first].view(np.int64)), whole(n_docs.astype(np.int32)), whole(np.append(first[1:], len(h))[: len(first)].astype(np.int32)), whole(spot.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "n_words", "terms", "n_docs", "ends", "places"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    got = rows.mapInArrow(run, f"ids array<{kind}>, n_words array<long>, terms array<long>, n_docs array<int>, ends array<int>, places array<int>")
    return saved(got.withColumn("shard", F.monotonically_increasing_id()), "postings", together=SHARDS)


def _list(column: pa.ListArray, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def frequencies(postings: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many documents each word of ``vocabulary`` (ascending) is in, summed per task and then over the tasks."""
    terms = postings.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        total = np.zeros(len(known), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                h, n = _list(b.column("terms"), row).view(np.uint64), _list(b.column("n_docs"), row)
                if len(h):
                    at = np.minimum(np.searchsorted(h, known), len(h) - 1)
                    total += np.where(h[at] == known, n[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    got = postings.select("terms", "n_docs").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out[got["term"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    terms.destroy()
    return out


class Windows:
    """The distinct windows of a block of items, by length, with the words of each from the rarest on."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], size: int) -> None:
        self.vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        self.names = sorted({k for k, _ in items if k is not None})
        number = {k: i for i, k in enumerate(self.names)}
        found: dict[int, list] = {}
        for k, w in items:
            at, n = np.searchsorted(self.vocabulary, w), min(size, len(w))
            found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(at, n), number.get(k, -1)))
        self.groups = []
        for _, some in sorted(found.items()):
            rows, inverse = np.unique(np.concatenate([x for x, _ in some]), axis=0, return_inverse=True)
            owners = np.unique(np.stack([inverse.ravel(), np.concatenate([np.full(len(x), k) for x, k in some])], axis=1), axis=0)
            self.groups.append((rows, owners))

    def ranked(self, frequency: np.ndarray) -> list[tuple]:
        return [(rows, np.argsort(frequency[rows], axis=1, kind="stable"), owners) for rows, owners in self.groups]


def hashed(items: DataFrame) -> DataFrame:
    """(id, words) of the items (id, text) that have words, saved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            h, row, n = words_of(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("id"), lists(h.view(np.int64), row, n)], names=["id", "words"])

    return saved(items.mapInArrow(run, "id string, words array<long>").filter("size(words) > 0"), "items")


def item_blocks(items: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """(id, word hashes) of ``hashed`` items, in blocks of at most ``limit`` words (or one longer item)."""
    held, total = [], 0
    for r in items.toLocalIterator():
        h = np.array(r["words"], np.int64).view(np.uint64)
        if held and total + len(h) > limit:
            yield held
            held, total = [], 0
        held.append((r["id"], h))
        total += len(h)
    if held:
        yield held


def _expanded(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, value) for every value in low[row]:high[row], a bounded number at a time."""
    n = high - low
    ends = np.cumsum(n)
    at, total = 0, int(ends[-1]) if len(ends) else 0
    while at < total:
        flat = np.arange(at, min(total, at + CANDIDATES))
        row = np.searchsorted(ends, flat, "right")
        yield row, low[row] + flat - (ends[row] - n[row])
        at += CANDIDATES


def _ask(keys: np.ndarray, windows: list[tuple], reach: int, full: int) -> Iterator[tuple]:
    """(group, exact windows, their starts, windows in proximity, where their rarest word stands) of all matches; ``keys``
    are the places of the benchmark's words, each below its word's number, ascending."""
    shift = np.uint64(40)

    def stands(word: np.ndarray, where: np.ndarray, slack: int = 0) -> np.ndarray:
        k = np.searchsorted(keys, (word.astype(np.uint64) << shift) | np.maximum(where - slack, 0).astype(np.uint64))
        most = (word.astype(np.uint64) << shift) | (where + slack).astype(np.uint64)
        return (k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] <= most)

    for group, (rows, order, _) in enumerate(windows):
        first = rows[np.arange(len(rows)), order[:, 0]].astype(np.uint64)
        low, high = np.searchsorted(keys, first << shift), np.searchsorted(keys, (first + np.uint64(1)) << shift)
        for w, k in _expanded(low, high):
            start = (keys[k] & np.uint64((1 << 40) - 1)).astype(np.int64) - order[w, 0]
            ok = start >= 0
            w, start = w[ok], start[ok]
            exact = np.ones(len(w), bool)
            near = np.ones(len(w), bool)
            for r in range(1, min(RAREST, rows.shape[1])):
                o = order[w, r]
                near &= stands(rows[w, o], start + o, reach)
                exact[near] &= stands(rows[w[near], o[near]], start[near] + o[near])
                exact &= near
            for o in range(rows.shape[1]):
                some = np.flatnonzero(exact)
                exact[some] = stands(rows[w[some], o], start[some] + o)
            if rows.shape[1] < full:
                near &= exact  # a few words that are close say nothing
            near &= ~exact
            yield group, w[exact], start[exact], w[near], (start + order[w, 0])[near]


def matches(postings: DataFrame, block: Windows, frequency: np.ndarray, *, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """``shard, doc`` (its place there), ``spans`` of hit words, ``items`` and ``near`` (found in proximity) of each document in
    which something of one block of items is found. Saved."""
    sent = postings.sparkSession.sparkContext.broadcast((block.vocabulary, block.names, block.ranked(frequency)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, names, windows = sent.value
        for b in batches:
            for row in range(b.num_rows):
                n_words, terms, ends, places = (_list(b.column(c), row) for c in ("n_words", "terms", "ends", "places"))
                terms = terms.view(np.uint64)
                if not len(terms):
                    continue
                at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
                mine = np.flatnonzero(terms[at] == vocabulary)
                high = ends[at[mine]].astype(np.int64)
                low = np.where(at[mine] > 0, ends[at[mine] - 1], 0).astype(np.int64)
                size = high - low
                spot = places[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())].astype(np.uint64)
                keys = (np.repeat(mine, size).astype(np.uint64) << np.uint64(40)) | spot
                base = np.cumsum(n_words + GAP) - n_words - GAP
                begin, end, exact, near = [], [], set(), set()
                for group, w, start, w_near, spot_near in _ask(keys, windows, slack, window):
                    rows, _, owners = windows[group]
                    begin.append(start)
                    end.append(start + rows.shape[1])
                    exact |= _named(owners, w, np.searchsorted(base, start, "right") - 1)
                    near |= _named(owners, w_near, np.searchsorted(base, spot_near, "right") - 1)
                begin, end = _merged(np.concatenate([np.zeros(0, np.int64), *begin]), np.concatenate([np.zeros(0, np.int64), *end]))
                d = np.searchsorted(base, begin, "right") - 1
                found: dict[int, tuple[list, list, list]] = {}
                for k, x, y in zip(d.tolist(), (begin - base[d]).tolist(), (end - base[d]).tolist(), strict=True):
                    found.setdefault(k, ([], [], []))[0].append({"from": x, "to": y})
                for part, pairs in ((1, exact), (2, near)):
                    for k, item in sorted(pairs):
                        found.setdefault(k, ([], [], []))[part].append(names[item])
                if found:
                    spans, items, close = zip(*found.values(), strict=True)
                    shard = pa.array([b.column("shard")[row].as_py()] * len(found), pa.int64())
                    strings = pa.list_(pa.string())
                    yield pa.RecordBatch.from_arrays([shard, pa.array(list(found), pa.int32()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(items, strings), pa.array(close, strings)], names=["shard", "doc", "spans", "items", "near"])

    asked = postings.select("shard", "n_words", "terms", "ends", "places")
    out = saved(asked.mapInArrow(run, "shard long, doc int, spans array<struct<from:long,to:long>>, items array<string>, near array<string>"), "matches")
    sent.destroy()
    return out


def _named(owners: np.ndarray, w: np.ndarray, rows: np.ndarray) -> set[tuple[int, int]]:
    """The pairs (row, named item) for windows ``w`` found in ``rows``."""
    pairs = np.unique(np.stack([rows, w], axis=1), axis=0)
    low, high = (np.searchsorted(owners[:, 0], pairs[:, 1], side) for side in ("left", "right"))
    return {(int(r), int(k)) for (r, _), lo, hi in zip(pairs, low, high, strict=True) for k in owners[lo:hi, 1] if k >= 0}


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as disjoint ones in order."""
    if not len(begin):
        return begin, end
    order = np.lexsort((end, begin))
    begin, end = begin[order], np.maximum.accumulate(end[order])
    fresh = np.append(True, begin[1:] > end[:-1])
    return begin[fresh], end[np.append(fresh[1:], True)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: ``id, n_words, n_hit, items`` (ids as strings, sorted), ``near_items`` (found in proximity
    only), ``spans_from`` and ``spans_to`` (the hit words) and ``contaminated``."""
    if not 0 < window + 2 * slack < GAP // 2:
        raise ValueError(f"windows of {window} words and a slack of {slack} don't fit the gap of {GAP} words between documents")
    postings = index(docs, id_col=id_col, text_col=text_col)
    return asked(postings, benchmark, window=window, slack=slack, item_col=item_col, item_text_col=item_text_col, block_words=block_words).withColumnRenamed("id", id_col)


def asked(postings: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slack: int = SLACK, item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The result of ``decontaminate`` for a stored ``index``."""
    items = hashed(benchmark.select(benchmark[item_col].cast("string").alias("id"), benchmark[item_text_col].alias("text")))
    found = []
    for block in item_blocks(items, block_words):
        windows = Windows(block, window)
        found.append(matches(postings, windows, frequencies(postings, windows.vocabulary), window=window, slack=slack))
    rows = postings.select("shard", F.posexplode(F.arrays_zip("ids", "n_words")).alias("doc", "x")).select("shard", "doc", F.col("x.ids").alias("id"), F.col("x.n_words").alias("n_words"))
    nothing = [F.array().cast(kind).alias(c) for c, kind in MATCHES.items()]
    if not found:
        out = rows.select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), *nothing)
    else:
        hits = united(reduce(DataFrame.union, found))
        both = rows.join(hits, ["shard", "doc"], "left")
        out = both.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), *(F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in MATCHES.items()))
    return out.withColumn("contaminated", contaminated())


def united(found: DataFrame) -> DataFrame:
    """Matches of all blocks as one row a document: its spans are the union of theirs."""
    per = found.groupBy("shard", "doc").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("near")).alias("near"))
    span = F.struct(F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("to"))

    def step(state: Column, x: Column) -> Column:
        joins = x["from"] <= state["last"]["to"]
        last = F.struct(F.when(joins, state["last"]["from"]).otherwise(x["from"]).alias("from"), F.when(joins, F.greatest(state["last"]["to"], x["to"])).otherwise(x["to"]).alias("to"))
        return F.struct(last.alias("last"), F.when(joins, state["done"]).otherwise(F.concat(state["done"], F.array(state["last"]))).alias("done"))

    first = F.coalesce(F.get("spans", F.lit(0)), span)
    start = F.struct(first.alias("last"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("done"))
    merged = F.filter(F.aggregate("spans", start, step, lambda s: F.concat(s["done"], F.array(s["last"]))), lambda x: x["to"] > x["from"])
    own = per.select("shard", "doc", merged.alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"), "near")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return own.select("shard", "doc", n_hit.alias("n_hit"), F.col("spans.from").alias("spans_from"), F.col("spans.to").alias("spans_to"), "items", F.array_sort(F.array_distinct(F.array_except("near", "items"))).alias("near_items"))


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT item, n, array_to_string(ws[k + 1:k + n], ' ') AS w FROM (SELECT item, ws, least(len(ws), 13) AS n, unnest(range(0, greatest(len(ws) - 13, 0) + 1)) AS k FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw), words AS (SELECT DISTINCT w, n, item FROM bw),
dw AS (SELECT r, n, k, array_to_string(ws[k + 1:k + n], ' ') AS w FROM (SELECT r, ws, n, unnest(range(0, len(ws) - n + 1)) AS k FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT r, dw.n, k, item FROM dw JOIN words ON words.w = dw.w AND words.n = dw.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, n, k FROM hits)) GROUP BY 1),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""
