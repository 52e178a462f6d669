"""Counts, decision lists and language profiles."""

import re
from collections import Counter

import numpy as np

from ledgerline.llm import language_id as L
from ledgerline.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "a b\na b\n a b\n", "x y z w v x y z w v q", "a a a a a a", "é# |ü\n\n$%\né# |ü\nlast", "w " * 30000, "line\r\nline\r\n", "dup", "dup", "日本語 текст"]


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts(spark, sf_dir):
    odd = spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(ODD)] + [(None, "a b", 1, "y")], "doc_id long, text string, n_words int, kept string")
    for df in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = sorted(((r[0], *plain(r[1])) for r in df.select("doc_id", "text").collect()), key=repr)
        got = Q.document_counts(df).select("id", *Q.COUNTS[:5]).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    none = spark.createDataFrame([], "doc_id long, quality int")
    found, rules = Q.quality(odd, none)
    assert rules == [] and found.filter("kept").count() == 0 and Q.quality(odd.limit(0), none)[0].count() == 0


def test_rules_are_learned_and_ordered(spark, sf_dir):
    rng = np.random.default_rng(1)
    x = {f: rng.random(4000) for f in Q.FEATURES}
    bad = ((x["repeat_share"] > 0.8) & (x["words"] <= 0.5)) | (x["symbols_per_word"] > 0.9)
    rules = Q.learn(x, bad, rng.random(4000) < 0.33)
    hit = np.logical_or.reduce([r.holds(x) for r in rules])
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.03 * hit.sum()
    out = Q.op5_quality_rules(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = out.join(labels, "doc_id").select("base_failed", "kept", "quality").collect()
    kept = [r for r in rows if not r["base_failed"]]
    assert sum(r["kept"] == bool(r["quality"]) for r in kept) > 0.97 * len(kept)
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_held_out_accuracy(spark, sf_dir):
    import zlib

    out = L.op6_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.98 * len(held)


def test_odd_languages(spark):
    rows = [(i, t, "xx" if i % 2 else None) for i, t in enumerate(ODD)] + [(None, "12 34 !", "yy"), (50, "12 abc", "zz")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    langs, vectors = L.prototypes(df)
    assert langs == ["xx", "zz"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(df, langs, vectors).collect()}
    assert got[0] == got[1] == got[2] == got[None] == ("und", 0.0) and got[50] == ("zz", 1.0)
    assert all(p in langs for k, (p, _) in got.items() if k and k > 3 and k != 3)
    assert L.identify(df, *L.prototypes(df.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_bundles_are_sums_of_bound_trigrams():
    text = "Äb, ab"
    codes = [0, ord("ä"), ord("b"), 0, ord("a"), ord("b"), 0]
    v = lambda c: L.letter_vector(c).astype(int)
    want = sum(np.roll(v(a), 2) * np.roll(v(b), 1) * v(c) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
    assert (L.bundles([text, None])[0] == want).all() and not L.bundles([None, ""]).any()
