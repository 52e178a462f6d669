"""Phrases against a search through all words; templates on small texts."""

import random
import re

from ledgerline.llm import license_scan as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    w = WORD.findall((text or "").translate(UPPER))
    at = [(i, label) for p, label in S.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    where = [i for i, _ in at]
    return len(w), len(at), min(where, default=None), max(where, default=None), ",".join(sorted({x for _, x in at}))


def test_base_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = S.op2_license_scan(spark, sf_dir).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted((k, *plain(t)) for k, t in docs)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    nc = {k for k, t in docs if "CC BY-NC 4.0" in t}
    assert nc and nc == {r["doc_id"] for r in got if "cc-by-nc" in r["labels"].split(",")}


def test_odd_rows(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted"
    texts = [None, "", "!!", "MIT License", "mitKicense mit-license MIT  LICENSE", "é" * 5 + " general PUBLIC licensé general public license", bsd, "redistribution use binary forms modification permitted", "apache license " * 20000, "x " * 50 + bsd + " y" * 9, bsd, bsd]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "apache license", "x", 1)], "doc_id long, text string, found string, row int")
    got = {r["doc_id"]: r for r in S.license_scan(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], len(r["places"]), min(r["places"], default=None), max(r["places"], default=None), ",".join(r["base_labels"])) == plain(t), t and t[:40]
    assert [i for i, r in got.items() if r["method_labels"] == ["bsd"]] == [6, 9, 10, 11] and got[7]["score"] == 0
    assert got[None]["base_labels"] == ["apache"]
    assert S.license_scan(df.limit(0)).count() == 0


def test_templates_are_found_and_graded(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice("the of and source software public version free work copy alpha beta gamma delta".split()) for _ in range(n))
    texts, want = [], []
    for label, text, _ in S.TEMPLATES:
        texts.append(f"{filler(200)}\n# {text}.\n{filler(100)}")
        want.append((label, 1.0))
    mit, apache = S.TEMPLATES[2][1], S.TEMPLATES[6][1]
    words = mit.split(" ")
    texts += [" ".join(w for k, w in enumerate(words) if k % 7 or k < 20), " ".join(sorted(words)), mit.replace("free of charge", "at a price"), f"{mit} {filler(50)} {apache}", filler(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in S.license_scan(df).collect()}
    for k, (label, score) in enumerate(want):
        assert label in got[k]["method_labels"] and got[k]["score"] == score, S.TEMPLATES[k]
    n = len(want)
    assert got[n]["method_labels"] == ["mit"] and 0.7 < got[n]["score"] <= 1.0  # a word in seven is gone
    assert not got[n + 1]["method_labels"] and "mit" not in got[n + 2]["method_labels"]  # words out of order; a key phrase is missing
    assert got[n + 3]["method_labels"] == ["apache", "mit"] and not got[n + 4]["method_labels"] and got[n + 4]["score"] == 0


def test_licences_that_most_files_have_are_found(spark):
    notice = S.TEMPLATES[19][1]
    texts = [f"{k} {notice}" if k % 3 else f"{k} nothing here" for k in range(60)]
    got = S.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["method_labels"] == ["bsd"]} == {k for k in range(60) if k % 3}
