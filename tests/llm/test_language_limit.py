"""What the pipeline's language stage rejects: scripts never learned and random letters, but no short clean text."""

import random

import corpus_pipeline as C


def test_unlearned_texts_are_rejected(spark, sf_dir):
    rng = random.Random(1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    alphabets = {"cyrillic": [chr(c) for c in range(0x430, 0x450)], "greek": [chr(c) for c in range(0x3B1, 0x3CA)], "cjk": [chr(c) for c in range(0x4E00, 0x4F00)], "latin": "abcdefghijklmnopqrstuvwxyz"}
    more, kind = [], {}
    for name, letters in alphabets.items():
        for n in (1, 5, 20, 200) if name != "latin" else (20, 200, 500):
            for _ in range(50):
                kind[-len(more) - 1] = name, n
                more.append((-len(more) - 1, " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n)), None))
    clean = docs.filter("length(text) > 200").limit(300).collect()
    for r in clean:
        for n in (1, 3, 20):
            kind[-len(more) - 1] = "clean", n
            more.append((-len(more) - 1, " ".join(r["text"].split()[:n]), None))
    both = docs.union(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in C.languages(spark, both, sf_dir).select("doc_id").collect()}
    passed = {key: sum(kind[k] == key and k in kept for k in kind) / sum(v == key for v in kind.values()) for key in set(kind.values())}
    for (name, n), share in passed.items():
        assert share >= 0.97 if name == "clean" else share <= (0.06 if name == "latin" else 0), (name, n, share)
    assert all(r["doc_id"] in kept for r in docs.select("doc_id").collect())
