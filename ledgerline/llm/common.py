"""Shared helpers of the text operators: scratch tables, byte-bounded Arrow blocks and vectorised word kernels.

The kernels work on one block of texts at a time (at most BLOCK_BYTES of UTF-8), so the memory of a task does not depend on the
size of the corpus, of a partition or of an Arrow batch; only one text is ever held whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.scratch import saved, shared_dir  # noqa: F401

BLOCK_BYTES = 2 << 20


def bucketed(df: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, in ``n`` buckets by ``keys``; tasks read buckets where they would else shuffle.
    Its name is out of the catalog again, the files stay."""
    spark, name = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, *keys).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


#: Buckets that tables of numbered rows have at most, and rows whose marks are kept together.
SLOTS, CHUNK = 1 << 15, 1 << 14


class Numbered:
    """A stored copy of ``rows`` whose rows later stages name by number, whatever ids, nulls or repeats they have.

    ``table`` has ``row``, a number given once to every row, ``slot`` and all columns. A slot is what one task has written
    (beyond SLOTS tasks, what several have), and is a bucket of the table: each slot is a number whose hash is another bucket.
    Marks of rows are laid out in the order of the rows, CHUNK rows an array, stored in the same buckets, and looked up by
    place: the table is neither shuffled nor sorted, and nothing is broadcast."""

    def __init__(self, rows: DataFrame, name: str) -> None:
        spark = rows.sparkSession
        self.slots = min(SLOTS, max(1, rows.rdd.getNumPartitions()))
        bucket = F.pmod(F.hash("slot"), F.lit(self.slots))
        tried, keys = 16 * self.slots + 64, []
        while len(keys) < self.slots:
            keys = spark.range(tried).select(F.col("id").cast("int").alias("slot")).groupBy(bucket.alias("bucket")).agg(F.min("slot").alias("slot")).collect()
            tried *= 2
        slot = F.get(F.array(*(F.lit(k.slot) for k in keys)), F.pmod(F.spark_partition_id(), F.lit(self.slots)))
        self.table = bucketed(rows.select(F.monotonically_increasing_id().alias("row"), slot.alias("slot"), "*"), ["slot"], self.slots, name)

    def marked(self, marks: DataFrame) -> DataFrame:
        """``table`` with ``mark``, the other columns of ``marks`` (row, ...; a row has one mark at most) as a struct, or null."""
        mark = F.struct(*(c for c in marks.columns if c != "row"))
        of_row = self.table.select("slot", "row").join(marks.select("row", mark.alias("mark")), "row", "left")
        chunk = F.shiftright("row", CHUNK.bit_length() - 1)
        rows = of_row.groupBy("slot", chunk.alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "mark"))), lambda x: x["mark"]).alias("marks"))
        stored = bucketed(rows.repartition(self.slots, "slot"), ["slot"], self.slots, "marks")
        # the slot alone is the key of the join, or Spark would shuffle both sides by slot and chunk
        both = self.table.join(stored.withColumnRenamed("slot", "of").hint("shuffle_hash"), (F.col("slot") == F.col("of")) & (chunk - F.col("chunk") == 0), "left")
        place = (F.col("row") % CHUNK).cast("int")
        return both.select(*(self.table[c] for c in self.table.columns), F.get("marks", place).alias("mark"))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into blocks of at most ``limit`` bytes of text (or one longer text)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other and the offsets of each text; null is empty."""
    arr = texts.cast(pa.large_string()).fill_null("")
    raw = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8)[raw[0] : raw[-1]] if arr.buffers()[2] else np.zeros(0, np.uint8)
    return data, raw - raw[0]


def _table(keep: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(keep)] = True
    return out


#: Bytes of words that white space separates, and of words made of ASCII digits, letters and everything beyond ASCII.
BLANK_WORD = ~_table(b" \t\n\v\f\r")
ALNUM_WORD = _table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a run ends where its text ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(inside))]
    begin[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIERS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            factors = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which ``slice_hash`` gets the hash of any slice in constant time."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes have equal hashes in every block and task."""
    h = (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]
    return mix(h + (ends - starts).astype(np.uint64) * _MULTIPLIERS[0])


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive word hashes (the caller drops those across texts)."""
    count = max(0, len(words) - n + 1)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h += words[k : k + count] * _MULTIPLIERS[k % 64] if n <= 64 else mix(words[k : k + count] + np.uint64(k))
    return mix(h)


def owner(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row of the text that each byte position lies in."""
    return np.searchsorted(offsets, positions, "right") - 1
