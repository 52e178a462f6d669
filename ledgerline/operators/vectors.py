"""Nearest vectors by an inverted file: cells around centroids, first the likeliest cells, then those that could still matter.

Centroids come from k-means on a sample of at most SAMPLE vectors (only the speed depends on them; every vector is indexed). A
vector lies in the cell of the centroid at the smallest angle; a cell knows its widest angle. A query first reads its
``probes`` nearest cells. A cell at an angle A from the query whose widest angle is W holds nothing nearer than A - W; so only
cells that could beat the query's k-th result are read in the second step, and the result is exact. Cells are read in slices
of about SLICE vectors, and queries are dealt to the slices of their cells, so no cell is a hot key; a task multiplies one slice with
blocks of queries and keeps the best k of each. What is sent to all tasks are the centroids: at most CELLS of them.

Null or empty vectors, those of another length than most, and those without direction are in no result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.scratch import bucketed, saved

CELLS, SAMPLE, SLICE, BLOCK = 4096, 200_000, 16_384, 1024
#: Room for rounding when a bound is compared.
CLOSE = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a list column (all of one length, no null) as unit vectors."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(rows), -1) if len(rows) else flat.reshape(0, 0)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if x.size else x


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


class Index:
    """The inverted file of ``vectors``: ``table`` (cell, slice, id, vector), ``centres``, and each cell's widest angle and slices."""

    def __init__(self, vectors: DataFrame, *, id_col: str, vector_col: str, seed: int = 7, rounds: int = 8) -> None:
        rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("vector"))
        sizes = rows.filter(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
        self.size, self.id_type = (sizes[0]["size"] if sizes else 0), rows.schema["id"].dataType.simpleString()
        rows = self.usable(rows)
        n = rows.count()
        self.n, self.centres = n, np.zeros((0, self.size))
        if n:
            some = rows if n <= SAMPLE else rows.sample(fraction=SAMPLE / n, seed=seed).limit(SAMPLE)
            k = min(CELLS, max(1, int(np.sqrt(n))))
            unit = some.select(array_to_vector("vector").alias("x"))
            found = np.array(KMeans(k=k, maxIter=rounds, seed=seed, featuresCol="x", distanceMeasure="cosine").fit(unit).clusterCenters())
            self.centres = found / np.linalg.norm(found, axis=1, keepdims=True)
        placed = saved(self._placed(rows), "placed")
        cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("widest"))
        self.cells = {r["cell"]: (r["widest"], -(-r["n"] // SLICE)) for r in cells.collect()}  # at most CELLS
        slices = F.coalesce(*(F.when(F.col("n") <= SLICE * 4**j, 4**j) for j in range(20)))
        counted = placed.join(F.broadcast(cells.select("cell", slices.alias("slices"))), "cell")
        self.slices = {r["cell"]: r["slices"] for r in cells.select("cell", slices.alias("slices")).collect()}
        sliced = counted.select("cell", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), "id", "vector")
        self.buckets = max(8, min(4096, 2 * sum(self.slices.values())))
        self.table = bucketed(sliced.repartition(self.buckets, "cell", "slice"), ["cell", "slice"], self.buckets, "vectors")

    def usable(self, rows: DataFrame) -> DataFrame:
        norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        return rows.filter((F.size("vector") == self.size) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)) & (norm > 0))

    def _placed(self, rows: DataFrame) -> DataFrame:
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                angles = _angles(_matrix(batch.column("vector")), centres) if batch.num_rows else np.zeros((0, 1))
                cell = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])], names=["id", "vector", "cell", "angle"])

        return rows.mapInArrow(run, f"id {self.id_type}, vector {rows.schema['vector'].dataType.simpleString()}, cell int, angle double")

    def _routes(self, queries: DataFrame, probes: int, least: bool) -> DataFrame:
        """Which cells a query reads: its nearest ones, or, with ``least`` (the k-th result's cosine), all others that could beat it."""
        centres, held = self.centres, sorted(self.cells)
        widest, slices = np.array([self.cells[c][0] for c in held]), np.array([self.slices[c] for c in held])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    angles = _angles(_matrix(part.column("vector")), centres[held])
                    near = np.argsort(angles, axis=1, kind="stable")[:, :probes]
                    chosen = np.zeros(angles.shape, bool)
                    np.put_along_axis(chosen, near, True, axis=1)
                    if least:
                        bound = np.array([-2.0 if x is None else x for x in part.column("least").to_pylist()])
                        chosen = ~chosen & (np.cos(np.maximum(angles - widest, 0)) >= bound[:, None] - CLOSE)
                    row, cell = np.nonzero(chosen)
                    times = slices[cell]
                    row, cell = np.repeat(row, times), np.repeat(cell, times)
                    number = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(held, np.int32)[cell]), pa.array(number.astype(np.int32)), part.column("id").take(pa.array(row)), part.column("vector").take(pa.array(row))], names=["cell", "slice", "query", "vector"])

        kind = queries.schema["vector"].dataType.simpleString()
        return queries.mapInArrow(run, f"cell int, slice int, query {self.id_type}, vector {kind}")

    def _met(self, routes: DataFrame, k: int, itself: bool) -> DataFrame:
        def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
            out = []
            if vectors.num_rows and queries.num_rows:
                x, ids = _matrix(vectors.column("vector")), vectors.column("id")
                names = np.array(ids.to_pylist(), object)
                for at in range(0, queries.num_rows, BLOCK):
                    part = queries.slice(at, BLOCK)
                    cos = _matrix(part.column("vector")) @ x.T
                    for i, query in enumerate(part.column("query").to_pylist()):
                        row = cos[i].copy()
                        if not itself:
                            row[names == query] = -np.inf
                        kth = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                        out += [(query, names[j], float(row[j])) for j in np.flatnonzero((row >= kth) & (row > -np.inf))]
            cols = zip(*out, strict=True) if out else ([], [], [])
            kinds = (queries.schema.field("query").type, vectors.schema.field("id").type, pa.float64())
            return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["query", "id", "cosine"])

        found = self.table.groupBy("cell", "slice").cogroup(routes.groupBy("cell", "slice"))
        return found.applyInArrow(best, f"query {self.id_type}, id {self.id_type}, cosine double")

    def nearest(self, queries: DataFrame, k: int, *, id_col: str, vector_col: str, probes: int = 4, itself: bool = False, exact: bool = True) -> DataFrame:
        """``query, id, cosine, rank``: for each query its ``k`` nearest vectors, ties to the smaller id; without ``exact`` only its
        ``probes`` nearest cells are read. ``itself``: whether the vector of the query's own id may be among them."""
        asked = saved(self.usable(queries.select(queries[id_col].alias("id"), queries[vector_col].alias("vector"))), "queries")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
        top = lambda rows: rows.withColumn("rank", rank).filter(F.col("rank") <= k)
        first = top(self._met(self._routes(asked, probes, False), k, itself))
        if not exact:
            return first
        first = saved(first, "nearest")
        kth = first.filter(F.col("rank") == k).select(F.col("query").alias("id"), F.col("cosine").alias("least"))
        more = self._met(self._routes(asked.join(kth, "id", "left"), probes, True), k, itself)
        return top(first.drop("rank").union(more))
