"""Near copies against brute force, and as the pipeline's stage."""

import random

import corpus_pipeline as C

from ledgerline.llm import near_copies as N
from ledgerline.llm.near_copies import near_copies


def plain_sets(texts):
    words = [(t or "").lower().split() for t in texts]
    return [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in words]


def plain_groups(sets, least=0.8):
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and len(a & sets[j]) >= least * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def planted(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = [None, "", " \n", "a b", "A\tB", "a b c", "one two three four five", "one two three four five six"]
    for n in (100, 300, 1000):
        for changed in (0, 1, 2, 5, 9, n // 20):
            base = [word() for _ in range(n)]
            out.append(" ".join(base))
            for _ in range(3):  # each from the one before: chains, whose ends needn't be alike
                for k in rng.sample(range(n), changed):
                    base[k] = word()
                out.append(" ".join(base))
    centre = [word() for _ in range(200)]
    for _ in range(40):
        copy = centre[:]
        for k in rng.sample(range(200), rng.randrange(1, 5)):
            copy[k] = word()
        out.append(" ".join(copy))
    return out


def test_planted_near_copies_are_found(spark):
    texts = planted(random.Random(5))
    group = plain_groups(plain_sets(texts))
    first = {}
    for k, g in enumerate(group):
        first.setdefault(g, k)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(df).collect()}
    assert got == {k: first[g] for k, g in enumerate(group)}
    assert near_copies(df.limit(0)).count() == 0


def test_texts_just_below_the_limit_make_few_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(300)], []
    for _ in range(120):  # all share four fifths of their words, any two about 0.7 of their shingles
        texts.append(" ".join([*base[:250], *(word() for _ in range(50))]))
    texts += [" ".join([*texts[k].split(" ")[:296], *(word() for _ in range(4))]) for k in range(0, 120, 4)]
    stored = N.Numbered(spark.createDataFrame(list(enumerate(texts)), "row long, text string").select(N.F.struct("row", "text").alias("doc")), "texts")
    sets = N.saved(N._sets(stored.table.select("doc.row", "doc.text"), 5), "sets")
    placed = stored.table.select(N.F.col("doc.row").alias("rep"), N.F.col("doc.row").alias("root"))
    pairs = {tuple(r) for r in N._across(placed, sets, 0.8).distinct().collect()}
    exact = plain_sets(texts)
    want = {(i, j) for j in range(len(texts)) for i in range(j) if len(exact[i] & exact[j]) >= 0.8 * len(exact[i] | exact[j])}
    assert want <= pairs and len(want) >= 30 and len(pairs) < 4 * len(want)
    assert {tuple(r) for r in N._alike(N._across(placed, sets, 0.8).distinct(), sets, 0.8).collect()} == want


def test_a_large_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(150)], []
    for _ in range(240):  # one to three words changed: some pairs are alike, most aren't
        copy = base[:]
        for k in rng.sample(range(150), rng.randrange(1, 4)):
            copy[k] = word()
        texts.append(" ".join(copy))
    compared, exact = [], N._alike
    monkeypatch.setattr(N, "_alike", lambda pairs, *rest: compared.append(pairs.count()) or exact(pairs, *rest))
    got = {r["doc_id"]: r["component_id"] for r in near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    group = plain_groups(plain_sets(texts))
    assert got == {k: group.index(g) for k, g in enumerate(group)} and len(set(group)) < 100
    assert sum(compared) < 6 * len(texts), compared


def test_parities_differ_in_no_more_bits_than_sets(spark):
    rng = random.Random(4)
    sets = {0: [], 1: [-1]} | {k: rng.sample(range(-2000, 2000), rng.randrange(1, 700)) for k in range(2, 30)}
    rows = spark.createDataFrame([(k, x) for k, x in sets.items()], "row long, grams array<long>")
    bits = {r["rep"]: [x % 2**64 for x in r["bits"]] for r in N._parities(rows).collect()}
    for a in sets:
        for b in sets:
            apart = sum((x ^ y).bit_count() for x, y in zip(bits[a], bits[b], strict=True))
            differ = len(set(sets[a]) ^ set(sets[b]))
            assert apart <= differ and (apart - differ) % 2 == 0


def test_stage_keeps_one_of_each_group(spark, sf_dir):
    texts = planted(random.Random(6))[8:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in C.one_of_each_group(spark, docs, sf_dir).collect()}
    group = plain_groups(plain_sets(texts))
    assert len(kept) == len(set(group)) < len(texts) // 2 and {group[k] for k in kept} == set(group)
