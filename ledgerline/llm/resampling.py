"""Importance resampling towards a target corpus by a dictionary of distinct features.

Words are runs of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII; features are all runs of 1 to ``n``
consecutive words. Texts are taken in blocks of bounded bytes; a block becomes one row with its distinct features and, of each
document, the places of its features in that list and their counts. So a feature is written once a block, whatever its
frequency, and no word is a hot key: it has at most one row a block. The blocks' features are counted globally, each distinct
string is hashed once (CRC-32 modulo ``buckets``), buckets are summed, and the gains go back by a join of the blocks' features
with the dictionary; gathered in a block's order they give every document's weight without another look at its text.

The draw is Gumbel top-k: the documents of the highest scores. Scores are whole numbers whose range doesn't depend on the
corpus (gains are logarithms of count ratios), so their histogram is bounded (about 100,000 values) and gives, on the driver,
the rank at which each score begins; ranks within a score come from a window by score.

Null text has no words and weight 0. A null id draws its noise as the empty string and ranks after all others of its score.
Repeated rows are drawn as rows of their own, ties among them in any order. An empty corpus gives no rows; an empty target
has T = 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import ALNUM_WORD, LOWER, blocks, saved

#: Bytes of text a block holds; a longer text is a block of its own.
BLOCK = 4 << 20
#: Blocks that are written and read at once.
TOGETHER = 2
_WORDS = bytes(int(LOWER[k]) if ALNUM_WORD[k] else 32 for k in range(256))


class _Places(dict):
    """A key's place in the order of first sight."""

    def __missing__(self, key: bytes) -> int:
        self[key] = place = len(self)
        return place


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


def _runs(ws: list[bytes], n: int) -> list[bytes]:
    out = list(ws)
    for k in range(2, n + 1):
        out += map(b" ".join, zip(*(ws[j:] for j in range(k)), strict=False))
    return out


def _block(ids: pa.Array, texts: list, n: int) -> tuple:
    """The rows of one block: distinct features, their counts, and per document its id, sizes, places and counts."""
    places, at, sizes, n_words = _Places(), [], [], []
    for text in texts:
        ws = words(text)
        got = _runs(ws, n) if n > 1 else ws
        at.append(np.fromiter(map(places.__getitem__, got), np.int64, len(got)))
        sizes.append(len(got))
        n_words.append(len(ws))
    flat = np.concatenate(at) if at else np.zeros(0, np.int64)
    width = max(1, len(places))
    keys, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + flat, return_counts=True)
    ends = np.searchsorted(keys, np.arange(len(sizes) + 1) * width).astype(np.int32)
    total = np.bincount(flat, minlength=len(places)).astype(np.int64)
    docs = pa.StructArray.from_arrays(
        [
            ids,
            pa.array(n_words, pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array((keys % width).astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.int32))),
        ],
        names=["id", "n_words", "n_features", "places", "counts"],
    )
    return pa.array([k.decode() for k in places], pa.string()), total, docs


def vectors(texts: DataFrame, n: int, id_col: str, text_col: str, name: str) -> DataFrame:
    """``block, features, totals, docs`` of each block of texts, in the shared folder."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for part in blocks(batches, limit=BLOCK):
            features, total, docs = _block(part.column("id"), part.column("text").to_pylist(), n)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), one(features), one(pa.array(total)), one(docs)], names=["block", "features", "totals", "docs"])
            block += 1

    doc = f"struct<id:{kind},n_words:bigint,n_features:bigint,places:array<int>,counts:array<int>>"
    rows = texts.select(texts[id_col].alias("id"), texts[text_col].alias("text"))
    return saved(rows.mapInArrow(run, f"block long, features array<string>, totals array<long>, docs array<{doc}>"), name, together=TOGETHER)


def dictionary(held: DataFrame, buckets: int) -> DataFrame:
    """``feature, n, bucket`` of each distinct feature."""
    counted = held.select(F.inline(F.arrays_zip("features", "totals"))).groupBy(F.col("features").alias("feature")).agg(F.sum("totals").alias("n"))
    return counted.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` of every bucket that ``source`` uses, from two dictionaries; at most ``buckets`` rows."""
    s = source.groupBy("bucket").agg(F.sum("n").alias("s"))
    t = target.groupBy("bucket").agg(F.sum("n").alias("t"))
    all_s, all_t = (float(x.agg(F.sum("n")).first()[0] or 0) for x in (source, target))
    d = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    both = s.join(t, "bucket", "left")
    ratio = ((d("t") + 1) * (all_s + buckets)) / ((d("s") + 1) * (all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(held: DataFrame, gain_of: DataFrame) -> DataFrame:
    """``id, n_words, n_features, weight`` per document of ``held``; ``gain_of`` has each feature's gain."""
    posts = held.select("block", F.posexplode("features").alias("k", "feature")).join(gain_of, "feature").select(F.col("block").alias("of"), "k", F.col("gain").cast("int").alias("gain"))
    kind = held.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    pairs = held.select("block", "docs").groupBy("block").cogroup(posts.groupBy("of"))
    return pairs.applyInArrow(_weighed, f"id {kind}, n_words long, n_features long, weight long")


def _weighed(held: pa.Table, posts: pa.Table) -> pa.Table:
    """The documents of one block with their weights."""
    docs = held.column("docs").combine_chunks().values if held.num_rows else None
    if docs is None:
        raise ValueError("features of a block that is not there")
    gain = np.zeros(posts.num_rows, np.int64)
    gain[posts.column("k").to_numpy()] = posts.column("gain").to_numpy()
    ids, n_words, n_features, places, counts = docs.flatten()
    part = np.append(gain[places.values.to_numpy()] * counts.values.to_numpy(), 0).cumsum()
    ends = places.offsets.to_numpy()
    before = np.concatenate(([0], part))
    total = before[ends[1:]] - before[ends[:-1]]
    n = n_features.to_numpy()
    weight = np.where(n > 0, total // np.maximum(n, 1), 0)  # floors go down
    return pa.table([ids, n_words, n_features, pa.array(weight)], names=["id", "n_words", "n_features", "weight"])


def _noise(seed: int, id_col: Column) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """``id, n_features, weight, score, rank`` of every row of ``docs``; of those with at least ``least_words`` words,
    ``percent`` in a hundred are drawn (rank 1 has the highest score), the rank of all others is null."""
    held = vectors(docs, n, id_col, text_col, "resampling-documents")
    aimed = vectors(target.select(F.lit(0).alias("id"), target[target_text].alias("text")), n, "id", "text", "resampling-target")
    known = saved(dictionary(held, buckets), "feature-dictionary")
    gain = gains(known, dictionary(aimed, buckets), buckets)
    scored = saved(weights(held, known.join(F.broadcast(gain), "bucket").select("feature", "gain")).withColumn("score", F.col("weight") + _noise(seed, F.col("id"))), "scores")
    return drawn(scored, percent, least_words).withColumnRenamed("id", id_col)


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """The rows of ``scored`` (saved) with their rank."""
    eligible = F.col("n_words") >= least_words
    counts = sorted(scored.filter(eligible).groupBy("score").count().collect(), reverse=True)  # bounded by the range of scores
    wanted, begun, starts = percent * sum(c for _, c in counts) // 100, 0, []
    for score, count in counts:
        if begun < wanted:
            starts.append((score, begun))
        begun += count
    columns = ("id", "n_features", "weight", "score")
    if not starts:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    near = eligible & (F.col("score") >= starts[-1][0])
    begins = scored.sparkSession.createDataFrame(starts, "score long, before long")
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last()))
    rank = F.col("before") + within
    top = scored.filter(near).join(F.broadcast(begins), "score").select(*columns, F.when(rank <= wanted, rank).alias("rank"))
    return scored.filter(~near).select(*columns, F.lit(None).cast("long").alias("rank")).union(top)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resample(read("documents"), read("benchmark"))


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT doc_id, row_number() OVER () AS r, {_SPLIT} AS ws FROM documents),
df AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY 1, 2),
tf AS (SELECT w, count(*) AS n FROM (SELECT unnest({_SPLIT}) AS w FROM benchmark) GROUP BY 1),
f AS (SELECT w, xor(list_reduce(list_transform(range(octet_length(encode(w))), lambda j: CAST('0x' || substr(hex(encode(w)), CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b FROM (SELECT DISTINCT w FROM df UNION SELECT w FROM tf), crc),
s AS (SELECT b, sum(n) AS s FROM df JOIN f USING (w) GROUP BY 1), t AS (SELECT b, sum(n) AS t FROM tf JOIN f USING (w) GROUP BY 1),
g AS (SELECT b, floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT sum(s) FROM s) + 10000)::DOUBLE) / (CAST(s + 1 AS DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE))) AS gain FROM s LEFT JOIN t USING (b)),
w AS (SELECT r, floor(sum(gain * n) / sum(n)) AS weight FROM df JOIN f USING (w) JOIN g USING (b) GROUP BY 1),
scored AS (SELECT doc_id, len(ws) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
"""
