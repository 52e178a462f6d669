"""How sources of one language differ in their vocabulary: a tournament of compressed count vectors.

Terms are runs of ASCII letters (lower-cased) and characters beyond ASCII. A language keeps the terms of at least
``least_docs`` of its documents; a group (language, source) gives each kept term p = 1 + floor(SCALE (count + 1) / (N + V)).
The divergence of p from q is the sum over the kept terms of floor((p - q)^2 / q), in whole numbers throughout.

Kept terms are numbered in their byte order within shards of the vocabulary; a group has one sparse vector a shard
(differences of numbers and counts, Zstandard). Groups are dealt to BLOCKS blocks. Vectors are stored by (language, shard, block)
as a bucketed table and stay there; in each round of a round-robin tournament every block meets one other, whose vectors are sent
to it, and both directions of all pairs are summed in that meeting; one round more is for the pairs inside a block and
for the meeting with the language's own vector, where a heap of each group's ``ranks`` strongest terms is kept. Only a pair's
non-zero terms are visited; all others of the shard differ alike. So the number of rounds is fixed, and more terms or
groups make more shards (PER_TASK entries a block): what a task holds doesn't grow with the corpus, unless a single shard's
vectors of one block do, which are its terms times the block's sources.

Null text, lang and source are ''. Documents without terms make groups as well; in a language without kept terms every pair's
value is 0. Repeated rows count as documents. Equal values rank by the item's UTF-8 bytes. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import LOWER, blocks, bucketed, saved

BLOCKS = 8
#: Shards of the vocabulary at least, and entries (terms of groups) that one block holds of one shard, about.
SHARDS, PER_TASK = 8, 500_000
#: Distinct (group, term) entries that a task counts before it hands them on.
HELD = 400_000
SCALE = (1000, 3)  # 10^9, by three divisions whose remainders times 1000 fit 64 bits
_TERMS = bytes(int(LOWER[k]) if k > 127 or 65 <= k <= 90 or 97 <= k <= 122 else 32 for k in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents; each group also has a row without term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[Counter, Counter]] = {}

        def held() -> pa.RecordBatch:
            rows = [(lang, source, t.decode(), n, df[t]) for (lang, source), (counts, df) in found.items() for t, n in counts.items()]
            rows += [(lang, source, None, 0, 0) for lang, source in found]
            found.clear()
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["lang", "source", "term", "n", "docs"])

        size = 0
        for block in blocks(batches):
            for lang, source, text in zip(*(block.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                counts, df = found.setdefault((lang, source), (Counter(), Counter()))
                terms = text.encode().translate(_TERMS).split()
                before = len(counts)
                counts.update(terms)
                df.update(set(terms))
                size += len(counts) - before
            if size > HELD:
                yield held()
                size = 0
        yield held()

    cols = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(k) for c, k in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    parts = docs.select(*cols).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(numbers.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _vector(rows: pa.Table) -> pa.Table:
    """One group's terms of one shard as one row."""
    ids = rows.column("id").to_numpy()
    order = np.argsort(ids)
    gaps = np.diff(ids[order], prepend=0).astype(np.int32)
    counts = rows.column("n").to_numpy()[order].astype(np.int64)
    first = rows.slice(0, 1)
    return pa.table([first.column("lang"), first.column("source"), first.column("shard"), [_packed(gaps)], [_packed(counts)]], names=["lang", "source", "shard", "gaps", "counts"])


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), exact for totals up to 9 * 10^15."""
    left = counts.astype(np.int64) + 1
    out = np.zeros(len(left), np.int64)
    for _ in range(SCALE[1]):
        left *= SCALE[0]
        out = out * SCALE[0] + left // total
        left %= total
    return out + 1


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Vectors:
    """The vectors of a block's groups in one shard, unpacked, with the shares of their terms and of absent ones."""

    def __init__(self, rows: pa.Table) -> None:
        self.sources, self.ids, self.shares, self.absent = rows.column("source").to_pylist(), [], [], []
        for gaps, counts, total in zip(*(rows.column(c).to_pylist() for c in ("gaps", "counts", "total")), strict=True):
            self.ids.append(np.cumsum(_unpacked(gaps, np.int32), dtype=np.int64) if gaps else np.zeros(0, np.int64))
            counts = _unpacked(counts, np.int64) if counts else np.zeros(0, np.int64)
            self.shares.append(shares(counts, total) if total else counts)
            self.absent.append(int(shares(np.zeros(1, np.int64), total)[0]) if total else 1)


def _pair(a: _Vectors, i: int, b: _Vectors, j: int, terms: int) -> tuple[int, int]:
    """The divergence of i from j and of j from i over the ``terms`` of the shard."""
    at = np.searchsorted(b.ids[j], a.ids[i])
    both = at < len(b.ids[j])
    both[both] = b.ids[j][at[both]] == a.ids[i][both]
    q = np.full(len(at), b.absent[j], np.int64)
    q[both] = b.shares[j][at[both]]
    alone = np.ones(len(b.ids[j]), bool)
    alone[at[both]] = False
    only = b.shares[j][alone]
    rest = terms - len(at) - len(only)
    p0, q0 = a.absent[i], b.absent[j]
    there = int(_excess(a.shares[i], q).sum()) + int(_excess(np.full(len(only), p0, np.int64), only).sum()) + rest * ((p0 - q0) ** 2 // q0)
    back = int(_excess(q, a.shares[i]).sum()) + int(_excess(only, np.full(len(only), p0, np.int64)).sum()) + rest * ((p0 - q0) ** 2 // p0)
    return there, back


_PAIRS = "lang string, source string, item string, value long"
_FOUND = f"part string, {_PAIRS}"


def _table(rows: list[tuple]) -> pa.Table:
    cols = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(cols, (*[pa.string()] * 4, pa.int64()), strict=True)], names=["part", "lang", "source", "item", "value"])


def _met(home: pa.Table, guests: pa.Table) -> pa.Table:
    """A meeting of two blocks: both directions of all pairs."""
    if not home.num_rows or not guests.num_rows:
        return _table([])
    lang, terms = home.column("lang")[0].as_py(), home.column("terms")[0].as_py()
    a, b, rows = _Vectors(home), _Vectors(guests), []
    for i, x in enumerate(a.sources):
        for j, y in enumerate(b.sources):
            there, back = _pair(a, i, b, j, terms)
            rows += [("pair", lang, x, y, there), ("pair", lang, y, x, back)]
    return _table(rows)


def _at_home(ranks: int):
    def met(home: pa.Table, own: pa.Table) -> pa.Table:
        """The pairs inside a block, and the strongest terms of each group against its language."""
        if not home.num_rows:
            return _table([])
        lang, terms = home.column("lang")[0].as_py(), home.column("terms")[0].as_py()
        a, rows = _Vectors(home), []
        for i, x in enumerate(a.sources):
            for j in range(i):
                there, back = _pair(a, i, a, j, terms)
                rows += [("pair", lang, x, a.sources[j], there), ("pair", lang, a.sources[j], x, back)]
        if own.num_rows:
            names = own.column("names")[0].values
            all_of = shares(own.column("counts")[0].values.to_numpy(), own.column("total")[0].as_py())
            for x, ids, p in zip(a.sources, a.ids, a.shares, strict=True):
                q = all_of[ids - 1]
                over = np.flatnonzero(p > q)
                value = _excess(p[over], q[over])
                best = np.lexsort((ids[over], -value))[:ranks]
                rows += [("term", lang, x, t, int(v)) for t, v in zip(names.take(pa.array(ids[over][best] - 1)).to_pylist(), value[best], strict=True)]
        return _table(rows)

    return met


def _partner(block: Column, turn: int) -> Column:
    """Whom a block meets in a turn: the last stays, the others go round."""
    n = BLOCKS - 1
    other = F.pmod(F.lit(turn) - block, F.lit(n))
    return F.when(block == n, F.lit(turn * pow(2, -1, n) % n)).when(other == block, F.lit(n)).otherwise(other).cast("int")


def divergences(docs: DataFrame, *, least_docs: int = 3, ranks: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: of each group, part ``pair`` has all other sources of the language, part
    ``term`` the ``ranks`` strongest of the terms that it uses more than the language does."""
    counts = saved(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    all_of = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.count("*").alias("groups")).filter(F.col("docs") >= least_docs)
    all_of = saved(all_of.select("lang", "term", "n", "groups"), "kept-terms")
    entries = all_of.agg(F.sum("groups")).first()[0] or 0
    shards = max(SHARDS, -(-entries // (BLOCKS * PER_TASK)))
    shard = F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")
    number = F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term"))
    kept = saved(all_of.withColumn("shard", shard).select("lang", "term", "n", "shard", number.alias("id")), "numbered-terms")

    own = kept.groupBy("lang", "shard").agg(F.count("*").alias("terms"), F.sum("n").alias("n"))
    langs = own.groupBy("lang").agg(F.sum("terms").alias("v"), F.sum("n").alias("n"))
    seen = counts.filter("term IS NULL").select("lang", "source")
    entries_of = counts.filter("term IS NOT NULL").select("lang", "source", "term", "n").join(kept.select("lang", "term", "shard", "id"), ["lang", "term"])
    entries_of = saved(entries_of.select("lang", "source", "shard", "id", "n"), "group-terms")
    sizes = entries_of.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    totals = seen.join(langs.select("lang", "v"), "lang", "left").join(sizes, ["lang", "source"], "left")
    totals = totals.select("lang", "source", (F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"))

    packed = entries_of.groupBy("lang", "source", "shard").applyInArrow(_vector, "lang string, source string, shard int, gaps binary, counts binary")
    everywhere = totals.select("lang", "source", "total", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    vectors = everywhere.join(own.select("lang", "shard", "terms"), ["lang", "shard"], "left").join(packed, ["lang", "source", "shard"], "left")
    block = F.pmod(F.xxhash64("lang", "source"), F.lit(BLOCKS)).cast("int")
    key = ["lang", "shard", "block"]
    n = min(4096, 2 * BLOCKS * shards)
    home = bucketed(vectors.select(*key[:2], block.alias("block"), "source", "total", F.coalesce("terms", F.lit(0)).alias("terms"), "gaps", "counts").repartition(n, *key), key, n, "vectors")
    peers = home.select("lang", "shard", "block", "source", "total", "terms", "gaps", "counts")
    whole = kept.groupBy("lang", "shard").agg(F.array_sort(F.collect_list(F.struct("id", "term", "n"))).alias("all")).join(langs.withColumn("total", F.col("n") + F.col("v")).select("lang", "total"), "lang")
    whole = whole.select("lang", "shard", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"), F.transform("all", lambda x: x["term"]).alias("names"), F.transform("all", lambda x: x["n"]).alias("counts"), "total")
    found = [saved(home.groupBy(*key).cogroup(whole.groupBy(*key)).applyInArrow(_at_home(ranks), _FOUND), "meetings")]
    for turn in range(BLOCKS - 1):
        partner = _partner(F.col("block"), turn)
        guests = peers.filter(F.col("block") > partner).withColumn("block", partner)
        found.append(saved(home.groupBy(*key).cogroup(guests.groupBy(*key)).applyInArrow(_met, _FOUND).groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value")), "meetings"))
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    pairs = every.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ("lang", "source", "part", "item", "value", rank)
    terms = found[0].filter("part = 'term'").select(*columns).filter(F.col("rank") <= ranks)
    return pairs.select(*columns).union(terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_SPLIT} AS ws FROM documents),
c AS (SELECT r, lang, source, w, count(*) AS n FROM (SELECT r, lang, source, unnest(ws) AS w FROM d) GROUP BY ALL),
kept AS (SELECT lang, w, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY 1, 2 HAVING count(*) >= 3),
own AS (SELECT lang, source, w, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, k.w, coalesce(o.n, 0::HUGEINT) AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.w = k.w),
p AS (SELECT lang, source, w, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER g + count(*) OVER g)::HUGEINT AS p FROM dense WINDOW g AS (PARTITION BY lang, source)),
q AS (SELECT lang, w, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER g + count(*) OVER g)::HUGEINT AS q FROM kept WINDOW g AS (PARTITION BY lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', w, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, w) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every) WHERE part = 'pair' OR rank <= 200
"""
