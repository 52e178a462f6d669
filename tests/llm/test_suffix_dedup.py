"""Repeated stretches against a search through every window."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import suffix_dedup as S


def plain(docs, length):
    seen, out = {}, []
    rows = sorted(((-(1 << 63) if k is None else k, k, (t or "").encode()) for k, t in docs), key=lambda r: r[0])
    for d, _, raw in rows:
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            seen[w] = min(seen.get(w, (d, p)), (d, p))
    for d, k, raw in rows:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] < (d, p):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((k, len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.drop("spans").collect()), key=repr)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_random_texts(spark, batches):
    rng = random.Random(batches)
    stock = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([30, 60, 150, 700]))) for _ in range(12)]
    docs = []
    for k in rng.sample(range(1000), 60):
        t = "".join(rng.choice(stock) if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(rng.randrange(1, 90))) for _ in range(rng.randrange(5)))
        docs.append((k, t))
    docs += [(2000 + k, stock[3] * 2) for k in range(10)] + [(3000, "q" * 500), (3001, "ab" * 400), (None, stock[1]), (3002, None), (3003, ""), (3004, "q" * 99), (3005, "q" * 100), (3006, stock[5]), (3006, stock[5])]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, gone string, n int")
    assert result(S.dedup(df, batches=batches)) == plain(docs, 100)
    if batches == 2:
        assert S.dedup(df.limit(0)).count() == 0
        assert result(S.dedup(df, length=40, gram=9, batches=3)) == plain(docs, 40)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(9)
    a = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    docs = [(1, a), (2, a[2500:7000] + "x" + a[:300]), (3, "y" + a)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    import pyarrow as pa

    monkeypatch.setattr(S, "PIECE", 1000)
    seen = [len(data) for data, *_ in S.pieces(pa.array([a, "b"]), 100)]
    assert max(seen) <= 1099 and sum(seen) == 9001 + 99 * 8
    assert result(S.dedup(df)) == plain(docs, 100)


def test_query_on_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert result(S.op10_suffix_dedup(spark, sf_dir)) == plain([tuple(r) for r in docs.collect()], 100)


@pytest.mark.parametrize("chunk", [3, 40])
def test_grams_of_many_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rng = random.Random(chunk)
    word = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    core = word(70)
    docs = [(k, word(rng.randrange(90)) + rng.choice(["x", "yy", "z"]) * 20 + core + rng.choice(["p", "qq"]) * 30 + word(rng.randrange(60))) for k in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert result(S.dedup(df, batches=3)) == plain(docs, 100)


def test_levels_merge_geometrically(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, "".join(rng.choice("abcdefghij ") for _ in range(300))) for k in range(40)], "doc long, text string").withColumn("tag", F.lit(0).cast("long"))
    family, sizes = S.Family(8), []
    for k in range(0, 40, 5):
        family.add(docs.filter(f"doc >= {k} and doc < {k + 5}"))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1], [8]] and family.merges == 7
    heads = [bytes(r["head"]) for r in family.levels[0][1].sortWithinPartitions("head").filter("shard >= 0").collect()]
    assert len(heads) == family.levels[0][1].select("doc", "at").distinct().count()
    family.dropped(spark)


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        S.dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
