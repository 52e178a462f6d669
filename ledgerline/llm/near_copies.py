"""Near copies: groups of texts whose sets of word shingles have a Jaccard similarity of at least a limit.

Candidates come from two places. SimHash fingerprints are joined by the binary trie of ``simhash``; but at a similarity of 0.8
most pairs differ in more bits than a trie walk can allow (README has the figures), so what it misses comes from buckets: BANDS
times ROWS minima of hashed shingles, one bucket a band. A pair at similarity s shares none with probability
(1 - s**ROWS)**BANDS, below 1 in 10,000 at 0.8. Every link is decided by the exact Jaccard similarity of both sets. Each text is
first compared with the smallest head of its buckets, so a text makes one pair; then with the heads of those buckets whose
group it hasn't joined. Members of buckets that still hold several groups are joined by prefixes: in one order of all shingles,
two sets of n and m at the limit L have L (n + m) / (1 + L) in common; from the k-th of these on each must have all but k - 1 of
them left, so both have the first COMMON among their first n - ceil(L n) + COMMON. The order takes rare shingles first, as a sketch of fixed size counts them, so
texts that share a frequent passage and little more make no pairs. While the sets of a prefix's shingle would make many more pairs
than they are, those outside its largest group are first compared with a few of that group, and groups that meet become one; then
every set outside is compared with all others of other groups, unless PARITY bits of both, which differ in no more places than the
sets in shingles, rule it out. So a large group of copies, or of texts just below the limit that
links hold together, costs no square of its size, and no link of a bucket is left out. Texts that are all just below the limit and
don't hang together are compared pair by pair.

Shingles are of lower-case (ASCII) words between white space; a text of fewer words is one shingle. Null texts and texts
without words are alike. Texts of equal sets are one node, however many documents have them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import _MULTIPLIERS, BLANK_WORD, LOWER, Numbered, blocks, bucketed, gram_hash, mix, owner, prefix_hash, runs, saved, slice_hash, utf8
from ledgerline.llm.simhash import fingerprints, links, roots

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
#: Words of a shingle of the fingerprints, and the bits in which linked ones may differ.
FP_SHINGLE, FP_BUDGET = 5, 2
#: Partners of a text that are compared in one task; rows of a bucket of the stored sets; counters of the sketch.
SHARE, SET_ROWS, SKETCH = 256, 20_000, 1 << 21
#: Shingles that a pair's prefixes must have in common.
COMMON = 3
#: Sets of a shingle's largest group that others are first compared with, and rows for each post up to which all pairs are made at once.
HEADS, AT_ONCE = 4, 4
#: Bits that each tell whether a set has an odd number of the shingles dealt to it.
PARITY = 512
_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after the other, and the row of each."""
    data, offsets = utf8(texts)
    data = LOWER[data]
    starts, ends = runs(BLANK_WORD[data], offsets)
    words, doc = slice_hash(prefix_hash(data), starts, ends), owner(offsets, starts)
    n_words = np.bincount(doc, minlength=len(texts))
    grams = gram_hash(words, shingle)
    inside = doc[: len(grams)] == doc[shingle - 1 :]
    few = n_words[doc] < shingle
    place = np.arange(len(words)) - (np.cumsum(n_words) - n_words)[doc]
    whole = np.zeros(len(texts), np.uint64)
    np.add.at(whole, doc[few], words[few] * _MULTIPLIERS[place[few] % 64])
    short = np.flatnonzero((n_words > 0) & (n_words < shingle))
    h = np.concatenate([grams[inside], mix(whole[short] + n_words[short].astype(np.uint64))])
    at = np.concatenate([doc[: len(grams)][inside], short])
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    first = np.append(True, (h[1:] != h[:-1]) | (at[1:] != at[:-1]))[: len(h)]
    return h[first], at[first]


def signatures(table: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``row, id, node, buckets`` of each row of ``table`` (row, doc); equal sets of shingles have one node (0: no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            h, at = shingles(block.column("text"), shingle)
            size = block.num_rows
            node, buckets = np.zeros(size, np.uint64), np.zeros((size, BANDS), np.uint64)
            some, starts = np.unique(at, return_index=True)
            if len(some):
                node[some] = mix(np.add.reduceat(mix(h), starts))
                for k in range(BANDS):
                    got = np.full(len(some), k + 1, np.uint64)
                    for row in range(ROWS):
                        n = k * ROWS + row
                        got = mix(got + np.minimum.reduceat(h * _FACTORS[n] + _SHIFTS[n], starts))
                    buckets[some, k] = got
            width = np.zeros(size + 1, np.int32)
            width[some + 1] = BANDS
            values = buckets[some].reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(width, dtype=np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([block.column("row"), block.column("id"), pa.array(node.view(np.int64)), lists], names=["row", "id", "node", "buckets"])

    doc = table.schema["doc"].dataType
    rows = table.select("row", F.col("doc")[id_col].alias("id"), F.col("doc")[text_col].alias("text"))
    return rows.mapInArrow(run, f"row long, id {doc[id_col].dataType.simpleString()}, node long, buckets array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``row, size, grams``: the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            h, at = shingles(block.column("text"), shingle)
            sizes = np.bincount(at, minlength=block.num_rows)
            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["row", "size", "grams"])

    return texts.mapInArrow(run, "row long, size long, grams array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs (a, b)`` whose ``sets`` (row, size, grams; bucketed by row) have at least this similarity. Pairs whose sizes
    rule that out end first. Sets go where their pairs are, once for each b and once for each SHARE partners of an a; the
    table of all sets stays in place."""
    sizes = sets.select("row", "size")
    sized = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    pairs = saved(sized.filter(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9).select("a", "b"), "pairs")
    tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("tasks"))
    dealt = pairs.join(tasks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("tasks")).alias("task"))
    grams = sets.select("row", "grams")
    theirs = dealt.join(grams.toDF("b", "gb"), "b")
    own = dealt.select("a", "task").distinct().join(grams.toDF("a", "ga"), "a")
    both = theirs.join(own, ["a", "task"])
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.filter(shared * (1 + similarity) >= similarity * (F.size("ga") + F.size("gb")) - 1e-9).select("a", "b")


def trie_pairs(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of ``reps`` whose SimHash fingerprints the trie join links: the smallest row of each fingerprint with
    that of each linked one, and with the other rows of its own."""
    fps = saved(fingerprints(texts, "row", "text", FP_SHINGLE).join(reps, F.col("id") == F.col("rep"), "left_semi"), "fingerprints")
    own = saved(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    linked = links(own.select("fp"), FP_BUDGET)
    across = linked.join(own.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(own.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    within = fps.join(own.filter("n > 1").select("fp", "first"), "fp").filter("id <> first")
    return across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(within.select(F.col("first").alias("a"), F.col("id").alias("b")))


def _with_heads(placed: DataFrame) -> DataFrame:
    """Members of a bucket that are in another group than its head, with the head."""
    first = placed.filter("rep = head").select("bucket", F.col("root").alias("theirs"))
    return placed.join(first, "bucket").filter("root <> theirs").select(F.col("head").alias("a"), F.col("rep").alias("b"))


def _counted(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle of each of SKETCH counters, up to 65,535; each task's counts are summed slice by slice."""
    width = SKETCH // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            at, n = np.unique(batch.column("grams").flatten().to_numpy() & (SKETCH - 1), return_counts=True)
            total[at] += n.astype(np.uint32)
        small = zstandard.ZstdCompressor(level=1)
        parts = [small.compress(x.tobytes()) for x in np.minimum(total, 65535).astype(np.uint16).reshape(64, width)]
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def summed(parts: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint32)
        for x in parts.column("counts"):
            total = np.minimum(total + np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.uint16), 65535)
        return pa.table([parts.column("slice")[:1], pa.array([total.astype(np.uint16).tobytes()], pa.binary())], names=["slice", "counts"])

    rows = sets.select("grams").mapInArrow(run, "slice int, counts binary").groupBy("slice").applyInArrow(summed, "slice int, counts binary").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.uint16) for r in sorted(rows)]) if rows else np.zeros(SKETCH, np.uint16)


def _prefixes(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``gram, place, rep, size, common`` of each shingle in the prefix of a member of ``placed`` that others may have too; common: how
    many of its prefix's these are, in thousandths."""
    members = sets.join(placed.select(F.col("rep").alias("row")).distinct(), "row")
    members = saved(members.select("row", "size", "grams"), "members")
    sent = members.sparkSession.sparkContext.broadcast(_counted(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            for row, size, grams in zip(*(batch.column(c) for c in ("row", "size", "grams")), strict=True):
                h = grams.values.to_numpy()
                n = counts[h & (SKETCH - 1)]
                first = np.lexsort((h, n))[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + COMMON]
                some = np.flatnonzero(n[first] > 1)
                one = lambda x, k=len(some): pa.array(np.full(k, x, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h[first][some]), pa.array(some), one(row.as_py()), one(size.as_py()), one(1000 * len(some) // max(len(first), 1))], names=["gram", "place", "rep", "size", "common"])

    return members.mapInArrow(run, "gram long, place long, rep long, size long, common long")


def _mixed(posts: DataFrame, placed: DataFrame) -> DataFrame:
    """``posts`` of the shingles that several groups of ``placed`` (rep, root) have, with their root, the shingle's number of posts and
    the group that has most of them."""
    rooted = posts.join(placed.select("rep", "root").distinct(), "rep")
    of_root = rooted.groupBy("gram", "root").agg(F.count("*").alias("k"))
    of_gram = of_root.groupBy("gram").agg(F.sum("k").alias("n"), F.max(F.struct("k", "root"))["root"].alias("largest"), F.count("*").alias("roots"))
    return saved(rooted.join(of_gram.filter("roots > 1").drop("roots"), "gram"), "prefixes")


def _parities(sets: DataFrame) -> DataFrame:
    """``rep, bits`` of each set, PARITY bits in longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.append(0, np.cumsum(pa.compute.list_value_length(batch.column("grams")).to_numpy()))
            of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            odd = np.zeros((batch.num_rows, PARITY), np.uint8)
            np.bitwise_xor.at(odd, (of, batch.column("grams").flatten().to_numpy() & (PARITY - 1)), 1)
            bits = np.packbits(odd, axis=1).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (PARITY // 64)), pa.array(bits))
            yield pa.RecordBatch.from_arrays([batch.column("row"), lists], names=["rep", "bits"])

    return sets.select("row", "grams").mapInArrow(run, "rep long, bits array<long>")


def _needed(similarity: float) -> Column:
    """What sets of ``size`` and ``nb`` shingles have in common at the limit."""
    return similarity / (1 + similarity) * (F.col("size") + F.col("nb")) - 1e-9


def _enough(both: DataFrame, similarity: float) -> DataFrame:
    """Pairs of the posts ``both`` (rep, place, size; y, pb, nb) whose prefixes have enough in common."""
    need = _needed(similarity)
    # what two sets have in common from their k-th common shingle on is at most what either has left there
    enough = F.least(F.col("size") - F.col("place"), F.col("nb") - F.col("pb")) >= need - (COMMON - 1)
    pairs = both.filter(enough).groupBy(F.least("rep", "y").alias("a"), F.greatest("rep", "y").alias("b")).agg(F.count("*").alias("n"), F.min(F.ceil(need)).alias("need"))
    return pairs.filter(F.col("n") >= F.least(F.lit(COMMON), "need")).select("a", "b")


def _with_largest(mixed: DataFrame, similarity: float, step: int) -> DataFrame:
    """Pairs of a few sets of each shingle's largest group, among them the one with the most common prefix, with those outside."""
    post = F.struct(F.col("rep").alias("y"), F.col("place").alias("pb"), F.col("size").alias("nb"))
    by_hash = [F.min_by(post, F.xxhash64("rep", F.lit(HEADS * step + k))) for k in range(1, HEADS)]
    heads = mixed.filter("root = largest").groupBy("gram").agg(F.array_distinct(F.array(F.max_by(post, F.struct("common", "rep")), *by_hash)).alias("heads"))
    return _enough(mixed.filter("root <> largest").join(heads.select("gram", F.explode("heads").alias("head")), "gram").select("*", "head.*"), similarity)


def _outside(mixed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each set outside a shingle's largest group with all that have the shingle and are in another group."""
    bits = saved(_parities(sets.join(mixed.select(F.col("rep").alias("row")).distinct(), "row", "left_semi")), "parities")
    mixed = mixed.join(bits, "rep")
    outer = mixed.filter("root <> largest").select("gram", "place", "rep", "root", "size", "bits")
    other = mixed.select("gram", F.col("place").alias("pb"), F.col("rep").alias("y"), F.col("root").alias("rb"), F.col("size").alias("nb"), F.col("bits").alias("bb"), "largest")
    apart = reduce(Column.__add__, (F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("bb", F.lit(k)))) for k in range(PARITY // 64)))
    both = outer.join(other, "gram").filter((F.col("rb") == F.col("largest")) | (F.col("root") < F.col("rb")))
    return _enough(both.filter(apart <= F.col("size") + F.col("nb") - 2 * _needed(similarity)), similarity)


def _across(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of the members of ``placed`` in different groups that share a shingle of both prefixes."""
    return _outside(_mixed(_prefixes(placed, sets, similarity), placed), sets, similarity)


def groups(stored: Numbered, *, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """For ``stored`` (numbered rows with a struct ``doc``): the saved signatures, and ``node, root, first`` of every distinct set: first is
    (id, row) of the smallest id and row that have it, root the smallest row of its group. Texts are never shuffled, only
    the sets of those that have candidates."""
    table = stored.table
    marked = saved(signatures(table, id_col, text_col, shingle), "signatures")
    own = marked.groupBy("node").agg(F.min("row").alias("rep"), F.min(F.struct(F.col("id").isNotNull().alias("named"), "id", "row")).alias("first"), F.first("buckets").alias("buckets"))
    own = saved(own, "nodes")
    # one shuffle of the posts: a bucket's head and size come by a window, whose rows are streamed
    bucket = Window.partitionBy("bucket")
    posts = own.select("rep", F.explode("buckets").alias("bucket")).withColumn("head", F.min("rep").over(bucket)).withColumn("n", F.count("*").over(bucket))
    posts = saved(posts.filter("n > 1").select("bucket", "head", "rep"), "buckets")
    close = trie_pairs(table.select("row", F.col("doc")[text_col].alias("text")), own.select("rep"))
    lowest = posts.groupBy(F.col("rep").alias("b")).agg(F.min("head").alias("a")).filter("a <> b").select("a", "b")
    pairs = saved(lowest.union(close).distinct(), "pairs")
    wanted = posts.select(F.col("rep").alias("row")).union(pairs.select(F.explode(F.array("a", "b")))).distinct()
    wanted = saved(wanted.withColumn("wanted", F.lit(True)), "wanted")
    texts = stored.marked(wanted).filter("mark.wanted").select("row", F.col("doc")[text_col].alias("text"))
    n = 8 + wanted.count() // SET_ROWS
    sets = bucketed(_sets(texts, shingle).repartition(n, "row"), ["row"], n, "sets")
    near = saved(_alike(pairs, sets, similarity), "links")
    tree = saved(roots(near), "groups")
    in_group = lambda reps: reps.join(tree, reps["rep"] == tree["node"], "left").select(*reps.columns, F.coalesce("root", "rep").alias("root"))

    def compare(made: DataFrame) -> None:
        """Links of those pairs that weren't compared before."""
        nonlocal pairs, near, tree
        fresh = saved(made.distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
        more = saved(_alike(fresh, sets, similarity), "links")
        pairs = pairs.union(fresh)
        if more.limit(1).count():
            near = near.union(more)
            tree = saved(roots(near), "groups")

    def in_mixed_buckets() -> DataFrame:
        placed = in_group(posts)
        mixed = placed.select("bucket", "root").distinct().groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
        return saved(placed.join(mixed, "bucket", "left_semi"), "placed")

    compare(_with_heads(in_mixed_buckets()))  # only what is still in different groups is compared
    left = saved(in_mixed_buckets().select("rep").distinct(), "left")
    prefixes, step, before = saved(_prefixes(left, sets, similarity), "posts"), 0, 0  # before: rows of all pairs a step earlier; once few are saved, they are made
    while True:
        mixed = _mixed(prefixes, in_group(left))
        most = mixed.agg(F.count("*").alias("n"), F.sum(F.when(F.col("root") != F.col("largest"), F.col("n"))).alias("rows")).first()
        rows = most["rows"] or 0
        if rows <= AT_ONCE * most["n"] or before and rows > 0.75 * before:
            break
        compare(_with_largest(mixed, similarity, step))
        step, before = step + 1, rows
    compare(_outside(mixed, sets, similarity))
    tree = tree.withColumnRenamed("node", "rep")
    return marked, saved(own.join(tree, "rep", "left").select("node", F.coalesce("root", "rep").alias("root"), "first"), "grouped")


def near_copies(docs: DataFrame, *, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, component_id`` per row of ``docs``: the smallest id of the row's group (null first)."""
    stored = Numbered(docs.select(F.struct(docs[id_col], docs[text_col]).alias("doc")), "texts")
    marked, grouped = groups(stored, similarity=similarity, shingle=shingle, id_col=id_col, text_col=text_col)
    smallest = grouped.groupBy("root").agg(F.min("first.id").alias("component_id"))
    return marked.select("id", "node").join(grouped.select("node", "root"), "node").join(smallest, "root").select(F.col("id").alias(id_col), "component_id")


def one_of_each_group(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id (null first), then the first row.

    The rows that go are those whose number isn't their group's chosen one; the texts stay where they are."""
    stored = Numbered(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc")), "documents")
    _, grouped = groups(stored, **options)
    chosen = grouped.groupBy("root").agg(F.min("first").alias("first")).select("first.row", F.lit(True).alias("chosen"))
    return stored.marked(chosen).filter("mark.chosen").select("doc.*")
