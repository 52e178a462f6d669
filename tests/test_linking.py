"""Vectors, as-of and overlap joins, matches and batches against plain Python, with hot keys and odd rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerline.operators import assignment as A
from ledgerline.operators import blocks
from ledgerline.operators import temporal as N
from ledgerline.operators import vectors as V


def test_nearest_vectors_are_exact_and_probes_find_most(spark, monkeypatch):
    monkeypatch.setattr(V, "SLICE", 100)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[rng.integers(12)] + 0.35 * rng.normal(size=16)).astype(np.float32).tolist()) for k in range(900)]
    rows += [(1000 + k, rows[0][1]) for k in range(300)]  # a hot cell of equal vectors
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0] * 3), (2004, [float("nan")] * 16)]
    df = spark.createDataFrame(rows + odd, "id long, x array<float>").withColumn("cell", F.lit(1)).repartition(5)
    index = V.Index(df, id_col="id", vector_col="x")
    queries = df.filter("id % 30 = 0 OR id >= 2000")
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r[0] for r in rows])
    got = {}
    for r in index.nearest(queries, 5, id_col="id", vector_col="x", probes=2).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["id"], r["cosine"])
    want = {}
    for k in np.flatnonzero(ids % 30 == 0):
        cos = x @ x[k]
        order = [j for j in np.lexsort((ids, -np.round(cos, 12))) if j != k][:5]
        want[int(ids[k])] = [(int(ids[j]), cos[j]) for j in order]
    assert set(got) == set(want)
    for q, best in want.items():
        assert np.allclose([got[q][r + 1][1] for r in range(5)], [c for _, c in best], atol=1e-9)
    some = {(r["query"], r["id"]) for r in index.nearest(queries, 5, id_col="id", vector_col="x", probes=2, exact=False).collect()}
    every = {(q, i) for q, found in got.items() for i, _ in found.values()}
    assert len(some & every) >= 0.9 * len(every)
    assert index.nearest(df.limit(0), 5, id_col="id", vector_col="x").count() == 0


def test_no_vectors(spark):
    empty = spark.createDataFrame([(1, None)], "id long, x array<float>")
    assert V.Index(empty, id_col="id", vector_col="x").nearest(empty, 3, id_col="id", vector_col="x").count() == 0


def test_recall_of_the_probed_cells(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = V.Index(rows, id_col="vec_id", vector_col="embedding")
    asked = lambda **how: {(r["query"], r["id"]) for r in index.nearest(rows.filter("vec_id % 50 = 0"), 10, id_col="vec_id", vector_col="embedding", **how).collect()}
    every = asked()
    assert len(every) == 100 and len(asked(probes=len(index.cells) // 2, exact=False) & every) >= 0.75 * len(every)


def test_nearest_preceding(spark):
    rng = random.Random(4)
    points = [("hot" if rng.random() < 0.5 else rng.choice("abc"), rng.randrange(3000), k) for k in range(400)] + [("none", 5, 900)]
    marks = [("hot" if rng.random() < 0.5 else rng.choice("abc"), rng.randrange(3000), f"m{k}") for k in range(120)]
    p, m = spark.createDataFrame(points, "key string, at long, id long"), spark.createDataFrame(marks, "key string, at long, name string")
    for inclusive in (False, True):
        got = {r["id"]: r["name"] for r in N.nearest_preceding(p, m, keys=["key"], at="at", within=40, take=["name"], inclusive=inclusive).collect()}
        want = {}
        for key, at, k in points:
            near = [(x, name) for other, x, name in marks if other == key and at - 40 <= x <= at - (not inclusive)]
            want[k] = max(near)[1] if near else None
        assert got == want


def test_overlaps_are_reported_once_in_cells_and_tiles(spark):
    rng = random.Random(8)
    span = lambda: (lambda a: (a, a + rng.choice((0, 1, 5, 300, -2))))(rng.randrange(-200, 400))
    left = [("hot" if rng.random() < 0.7 else "b", *span(), k) for k in range(200)] + [("hot", 1, 3, 7)] * 2
    right = [("hot" if rng.random() < 0.7 else "b", *span(), k) for k in range(150)]
    l, r = spark.createDataFrame(left, "key string, a long, b long, id long"), spark.createDataFrame(right, "key string, c long, d long, id long")
    want = sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2])
    for tile in (10, 4096):
        got = N.overlapping(l, r, keys=["key"], left_span=("a", "b"), right_span=("c", "d"), tile=tile)
        assert sorted((x["l"]["id"], x["r"]["id"]) for x in got.select("l", "r").collect()) == want
    assert N.overlapping(l.limit(0), r, keys=["key"], left_span=("a", "b"), right_span=("c", "d")).count() == 0


def test_greedy_matches(spark):
    rng = random.Random(2)
    edges = sorted({(rng.randrange(40), 100 + rng.randrange(40)): rng.randrange(6) / 5 for _ in range(500)}.items())
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges], "a long, b long, score double")
    seen, want = set(), set()
    for (a, b), s in sorted(edges, key=lambda e: (-e[1], e[0])):
        if a not in seen and b not in seen:
            seen |= {a, b}
            want.add((a, b, s))
    assert {tuple(r) for r in A.one_to_one(df, "score").collect()} == want
    assert A.one_to_one(df.limit(0), "score").count() == 0


def test_similar_rows(spark):
    rng = random.Random(6)
    side = lambda: [(k, rng.choice("xy"), [rng.choice("abcdefgh") for _ in range(rng.randrange(7))]) for k in range(60)]
    left, right = side(), side()
    frame = lambda rows: spark.createDataFrame(rows, "id long, grp string, words array<string>")
    for least in (0.4, 0.8, 1.0):
        want = {(g, a, b) for a, g, x in left for b, h, y in right if g == h and x and y and len(set(x) & set(y)) >= least * len(set(x) | set(y))}
        got = {(r["grp"], r["a"], r["b"]) for r in A.similar_rows(frame(left), frame(right), keys=["grp"], id_col="id", tokens="words", least=least).collect()}
        assert got == want


def test_similar_rows_in_many_blocks(spark):
    """Every row has the two words that are in all others, so every two rows are candidates; several blocks a side, a null key."""
    rng = random.Random(9)
    side = lambda: [(k, rng.choice(("x", "y", None)), ["all", "both", *(rng.choice("abcdefghijkl") for _ in range(rng.randrange(5)))]) for k in range(50)]
    left, right = side(), side()
    frame = lambda rows: spark.createDataFrame(rows, "id long, grp string, words array<string>")
    alike = lambda x, y: len(set(x) & set(y)) >= 0.5 * len(set(x) | set(y))
    want = {(g, a, b) for a, g, x in left for b, h, y in right if g is not None and g == h and alike(x, y)}
    got = A.similar_rows(frame(left), frame(right), keys=["grp"], id_col="id", tokens="words", least=0.5, block=7)
    assert "block" in A.similar_rows.__kwdefaults__ and sorted(tuple(r)[:3] for r in got.collect()) == sorted(want)


def test_common_counts_frequent_and_rare_keys(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [rng.random((n, 60)) < rng.random(60) ** 3 for n in (31, 45)]
    for n, m in ((1, 10), (0, 7), (10**9, 1 << 22)):
        monkeypatch.setattr(blocks, "WORTH", n)
        monkeypatch.setattr(blocks, "PAIRS", m)
        sides = []
        for held in sets:
            rows, keys = np.nonzero(held)
            ms, ks, ends, places = blocks.packed(pa.chunked_array([rows]), pa.chunked_array([keys]))
            sides.append((ms.to_numpy(), blocks.Block(pa.array([{"ms": ms.to_pylist(), "ks": ks.to_pylist(), "ends": ends, "places": places}])[0])))
        (a, one), (b, two) = sides
        assert (blocks.common(one, two) == sets[0][a].astype(int) @ sets[1][b].astype(int).T).all()


def test_batches_of_one_chain(spark, monkeypatch):
    monkeypatch.setattr(A, "STRETCH", 16)
    rng = random.Random(1)
    for n, size in ((0, 3), (1, 3), (333, 5), (400, 40)):
        rows = [(k, rng.choice((0, 1, 2, 30)), rng.randrange(9)) for k in range(n)]
        want, held, batch = {}, [0, 0, 0], 1
        for k, u, c in rows:
            if held[0] and (held[0] + 1 > size or held[1] + u > 20 or held[2] + c > 25):
                held, batch = [0, 0, 0], batch + 1
            held = [held[0] + 1, held[1] + u, held[2] + c]
            want[k] = batch
        df = spark.createDataFrame(rows, "id long, u long, c long").repartition(3)
        assert {r["id"]: r["batch"] for r in A.greedy_batches(df, "id", size=size, limits={"u": 20, "c": 25}).collect()} == want


def test_added_cost(spark):
    rows = [([(0, 5), (3, 8), (10, 12)], 4, 11), ([], 1, 4), ([(0, 100)], 5, 9), ([(5, 9)], 0, 3), ([(1, 2), (1, 2)], 0, 4)]
    df = spark.createDataFrame(rows, "held array<struct<start:long,end:long>>, a long, b long")
    got = [r["c"] for r in df.select(N.added_cost(F.col("held"), F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [sum(all(not s <= p < e for s, e in held) for p in range(a, b)) for held, a, b in rows]


def test_copies_are_matched_in_one_round(spark, monkeypatch):
    names, saved = [], A.saved
    monkeypatch.setattr(A, "saved", lambda df, name, **k: names.append(name) or saved(df, name, **k))
    edges = [(a, b, 1.0) for a in range(9) for b in range(100, 112)] + [(a, b, 0.5) for a in range(5, 20) for b in range(110, 115)]
    got = {tuple(r) for r in A.one_to_one(spark.createDataFrame(edges, "a long, b long, score double"), "score").collect()}
    assert got == {(a, 100 + a, 1.0) for a in range(9)} | {(9 + k, 110 + k, 0.5) for k in range(5)}
    assert names.count("taken") <= 3
