"""Divergences against plain Python: all pairs, strongest terms, few and many shards, odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import divergence
from ledgerline.llm.divergence import BLOCKS, _partner, divergences, shares

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, ranks):
    df, n, own = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in docs:
        lang, source, ts = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        df[lang].update(set(ts))
        n[lang].update(ts)
        own[lang, source].update(ts)
    out = []
    for lang, source in groups:
        kept = [t for t, k in df[lang].items() if k >= least]

        def p(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        mine, all_of = p(own[lang, source]), p(n[lang])
        pairs = []
        for other in (s for x, s in groups if x == lang and s != source):
            q = p(own[lang, other])
            pairs.append((-sum((mine[t] - q[t]) ** 2 // q[t] for t in kept), other))
        terms = [(-((mine[t] - all_of[t]) ** 2 // all_of[t]), t) for t in kept if own[lang, source][t] and mine[t] > all_of[t]]
        for part, rows, most in (("pair", pairs, None), ("term", terms, ranks)):
            out += [(lang, source, part, item, -v, k + 1) for k, (v, item) in enumerate(sorted(rows, key=lambda r: (r[0], r[1].encode()))[:most])]
    return sorted(out)


def check(spark, docs, least=3, ranks=200):
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, source string, doc_id int, term string")
    got = sorted(tuple(r) for r in divergences(frame, least_docs=least, ranks=ranks).collect())
    assert got == plain(docs, least, ranks)


@pytest.mark.parametrize(("shards", "held"), [(1, 10), (5, 400_000)])
def test_groups(spark, monkeypatch, shards, held):
    monkeypatch.setattr(divergence, "SHARDS", shards)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcdéß" for b in "xyzöñ"]
    docs = [(" ".join(rng.choices(vocabulary, k=rng.randrange(40))), rng.choice(["en", "EN", "de", None]), f"s{min(rng.randrange(40), 11)}") for _ in range(150)]
    docs += [(None, "en", "empty"), ("", "en", None), ("1 2 ?", "none", "a"), ("", "none", "b"), ("once only", "few", "a"), ("A a Ä", "few", "a")] + [("the same", "hot", "a")] * 60 + [("other same", "hot", "b")]
    check(spark, docs, ranks=4)
    check(spark, [])
    check(spark, [(None, None, None)])


def test_all_blocks_meet_once(spark):
    rows = [spark.range(BLOCKS).select(_partner(F.col("id"), t).alias("p")).collect() for t in range(BLOCKS - 1)]
    met = {(i, r.p) for turn in rows for i, r in enumerate(turn)}
    assert met == {(i, j) for i in range(BLOCKS) for j in range(BLOCKS) if i != j}
    assert all(turn[r.p].p == i for turn in rows for i, r in enumerate(turn))


def test_shares_are_exact():
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        total = rng.randrange(1, 9 * 10**15)
        counts = [rng.randrange(total) for _ in range(5)] + [0, total - 1]
        assert shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]
