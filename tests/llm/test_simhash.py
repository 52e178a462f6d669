"""Fingerprints, links and groups against brute force."""

import random

import xxhash

from ledgerline.llm.simhash import fingerprint, links, near_duplicates, op4_simhash_near_dedup, roots

MASK = (1 << 64) - 1


def plain_fingerprint(text):
    words = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(values, budget):
    group = list(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= budget and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_links_and_roots(spark):
    rng = random.Random(3)
    for budget in (0, 1, 2, 3):
        values = set()
        for _ in range(40):
            centre = rng.getrandbits(64)
            for _ in range(rng.randrange(1, 9)):
                for _ in range(rng.randrange(3)):
                    centre ^= 1 << rng.randrange(64)
                values.add(centre)
        values |= {0, MASK, 1, 1 << 63}
        signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
        want = {tuple(sorted((signed[a], signed[b]))) for a in values for b in values if a < b and (a ^ b).bit_count() <= budget}
        near = links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), budget)
        got = [tuple(r) for r in near.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_long_chains_have_one_root(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = list(zip(order, order[1:], strict=False)) + [(100, 101)]
    got = {r["node"]: r["root"] for r in roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(order, 0), 100: 100, 101: 100}
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    assert [fingerprint(t.encode()) for _, t in rows] == prints
    group = plain_groups(prints, 2)
    first = {}
    for (k, _), g in zip(rows, group, strict=True):
        first[g] = min(k, first.get(g, k))
    want = {k: (f"{p:016x}", first[g]) for (k, _), p, g in zip(rows, prints, group, strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op4_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "A\tB"), (4, "A\tB"), (5, "x y z " * 5000), (6, "x y z " * 5001)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, root int")
    got = sorted(near_duplicates(df).select("doc_id", "component_id").collect(), key=lambda r: r["doc_id"] or 0)
    assert [tuple(r) for r in got] == [(None, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (6, 5)]
    assert near_duplicates(df.limit(0)).count() == 0
