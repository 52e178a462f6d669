"""SimHash near-duplicates: a binary trie self-join over fingerprints, and the groups its links form.

Fingerprints are 64 bits. Under a budget of d differing bits, two linked fingerprints agree on two of d + 2 equal blocks
of bits; so the trie is laid out once for each choice of two blocks, with these blocks' bits first. In such a layout a
linked pair shares the path from the root through both blocks, and the subtrees below are joined with themselves: node
pairs go down together, eight bits a step, add up the bits in which they differ and end where they exceed the budget.
A node has at most 256 children and at most C(depth, <= d) partners, so no join key holds an unbounded group. Equal
fingerprints are one leaf, however many documents have them. A walk of node pairs from one root would come to the same
links, but its pairs aren't pruned before the error budget is spent: N fingerprints make about N * C(log2 N, <= d) / 2 pairs
on the way (86 a fingerprint at 230,000 of them, 330 at 5e10), against C(d + 2, 2) leaves a fingerprint here.

Null text and text without words have fingerprint zero and link like any other. A null id is never a component's id
unless the component has no other. Repeated rows are returned as often as they come. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import blocks, saved

BITS, STRIDE, SHINGLE, SEED = 64, 8, 3, 42
#: Fingerprints of many rows that may be broadcast.
HOT = 100_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The majority bits of the XXH64 hashes of all word shingles, repeats included."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id, fp`` of each row; fp is the fingerprint as a signed 64-bit value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            got = np.array([fingerprint((x or "").encode(), shingle) for x in block.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(got.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _layouts(budget: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each choice of two leading blocks: the bits of both, and all blocks as (lowest bit, width) in their order."""
    n = budget + 2
    edges = [BITS * k // n for k in range(n + 1)]
    cut = [(edges[k], edges[k + 1] - edges[k]) for k in range(n)]
    return [(cut[i][1] + cut[j][1], [cut[i], cut[j], *(b for k, b in enumerate(cut) if k not in (i, j))]) for i, j in combinations(range(n), 2)]


def _part(value: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1))


def _laid_out(fp: Column, order: list[tuple[int, int]]) -> Column:
    out, left = F.lit(0).cast("long"), BITS
    for low, width in order:
        left -= width
        out = out.bitwiseOR(F.shiftleft(_part(fp, low, width), left))
    return out


def _restored(value: Column, order: list[tuple[int, int]]) -> Column:
    out, left = F.lit(0).cast("long"), BITS
    for low, width in order:
        left -= width
        out = out.bitwiseOR(F.shiftleft(_part(value, left, width), low))
    return out


def links(fps: DataFrame, budget: int = 2) -> DataFrame:
    """All pairs ``a < b`` of distinct values of ``fps.fp`` that differ in at most ``budget`` bits."""
    layouts = _layouts(budget)
    trees = F.array(*(F.struct(F.lit(k).alias("tree"), F.shiftrightunsigned(_laid_out(F.col("fp"), order), BITS - root).alias("root"), _laid_out(F.col("fp"), order).alias("leaf")) for k, (root, order) in enumerate(layouts)))
    leaves = fps.select(F.inline(trees))
    full = leaves.groupBy("tree", "root").agg(F.count("*").alias("n")).filter("n > 1").select("tree", "root")
    shared = saved(leaves.join(full, ["tree", "root"], "left_semi"), "trie-leaves")
    depth_of = F.element_at(F.array(*(F.lit(root) for root, _ in layouts)), F.col("tree") + 1)
    pairs = shared.select("tree", F.col("root").alias("a"), F.col("root").alias("b"), F.lit(0).alias("differ")).distinct()
    deepest = max(BITS - root for root, _ in layouts)
    for step in range(ceil(deepest / STRIDE)):
        above = F.least(depth_of + STRIDE * step, F.lit(BITS))
        below = F.least(depth_of + STRIDE * (step + 1), F.lit(BITS))
        node = lambda depth: F.call_function("shiftrightunsigned", F.col("leaf"), F.lit(BITS) - depth)
        children = shared.select("tree", node(above).alias("parent"), node(below).alias("child")).distinct()
        left = children.select("tree", F.col("parent").alias("a"), F.col("child").alias("ca"))
        right = children.select("tree", F.col("parent").alias("b"), F.col("child").alias("cb"))
        fresh = F.call_function("shiftleft", F.lit(1).cast("long"), below - above) - 1  # the bits that this step adds
        differ = F.col("differ") + F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND(fresh))
        pairs = (
            pairs.join(left, ["tree", "a"])
            .join(right, ["tree", "b"])
            .filter((differ <= budget) & ((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb"))))
            .select("tree", F.col("ca").alias("a"), F.col("cb").alias("b"), differ.alias("differ"))
        )
    back = lambda c: F.coalesce(*(F.when(F.col("tree") == k, _restored(F.col(c), order)) for k, (_, order) in enumerate(layouts)))
    found = pairs.filter("differ > 0").select(back("a").alias("a"), back("b").alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected ``edges (a, b)``; the root is its component's smallest node.

    Alternates two contractions until nothing changes: every node's larger neighbours, then its smaller ones, are linked
    to the smallest node it knows. Both take minima by a combining aggregate and a join, so a hub is no single group.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def lowest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    edges = saved(edges.filter("a <> b").select("a", "b"), "edges")
    before = mark(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = both.join(lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.filter("u <> v")
        small = down.join(lowest(down), "u")
        small = small.select(F.col("v").alias("b"), F.col("m").alias("a")).union(small.select(F.col("u"), F.col("m"))).filter("a <> b")
        edges = saved(small.select("a", "b").distinct(), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    tree = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return tree.union(edges.select("a", "a")).distinct()


def near_duplicates(docs: DataFrame, *, budget: int = 2, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, root, component_id, n_links`` per row of ``docs``: root is the group's smallest fingerprint (signed),
    component_id its smallest id, n_links how many other fingerprints the row's own one is linked to."""
    marked = saved(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    own = saved(marked.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    near = saved(links(own.select("fp"), budget), "links")
    degree = near.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    tree = roots(near)
    linked = own.join(tree.withColumnRenamed("node", "fp"), "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    groups = linked.join(smallest, "root").join(degree, "fp").select("fp", "root", "smallest", "n_links")
    groups = own.join(groups, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("smallest", "first").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return _with_groups(marked, saved(groups, "groups")).select(F.col("id").alias(id_col), "fp", "root", "component_id", "n_links")


def _with_groups(marked: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row of ``marked`` with the one row of ``groups`` of its fingerprint. Fingerprints of many rows are sent to where the
    rows are: those of more than a HOT-th of all rows, so fewer than HOT of them; only rows of others are dealt by fingerprint."""
    total = groups.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > max(100, total // HOT)
    hot, others = groups.filter(often).drop("n"), groups.filter(~often).drop("n")
    return marked.join(F.broadcast(hot), "fp").union(marked.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(others, "fp"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
