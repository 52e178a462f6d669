"""Windows found through the index against a search through all words."""

import hashlib
import re

from ledgerline.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def plain(docs, items, size=13):
    windows = {}
    for k, t in items:
        w = words(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1):
            if n:
                windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[x]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((k, len(w), len(hit), len(found - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def result(df):
    from pyspark.sql import functions as F

    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated").collect()), key=repr)


def test_all_documents(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert sum(r[-1] for r in want) > 5
    got = D.op3_decontamination(spark, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_odd_rows_and_blocks(spark, monkeypatch):
    long = " ".join(f"w{i % 7}x{i % 11}" for i in range(60))
    docs = [(1, None), (2, ""), (3, "... !"), (4, "A b"), (5, long), (5, long), (None, long.upper() + " tail"), (6, "the " * 4000), (7, "é " + long[5:90]), (8, "a b a b a b"), (9, long[:100] + " gap " + long[100:])]
    items = [(1, "a B"), (2, None), (3, ""), (4, long), (4, "tail"), (None, "gap"), (10, "the the"), (11, long[30:200]), (11, long[30:200])]
    ds = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, items string, n_words int")
    it = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, id int")
    want = plain(docs, items)
    assert result(D.decontaminate(ds, it)) == want
    asked = []
    matches = D.matches
    monkeypatch.setattr(D, "matches", lambda *a, **k: asked.append(matches(*a, **k)) or asked[-1])
    assert result(D.decontaminate(ds, it, block_words=40)) == want
    # what many blocks find is read from saved tables: no block makes the plan of the next longer
    assert len(asked) == 3 and not any("MapInArrow" in x._jdf.queryExecution().toString() for x in asked)
    assert all(r[2] == 0 for r in result(D.decontaminate(ds, it.limit(0))))
    assert D.decontaminate(ds.limit(0), it).count() == 0


def test_proximity(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november"
    far = item.replace("charlie", "charlie oh")
    ds = spark.createDataFrame([(1, item), (2, far), (3, "alpha mike " + "x " * 30 + "golf")], "doc_id long, text string")
    it = spark.createDataFrame([("a", item)], "item_id string, text string")
    got = {r["doc_id"]: (r["items"], r["near_items"]) for r in D.decontaminate(ds, it).collect()}
    assert got == {1: (["a"], []), 2: ([], ["a"]), 3: ([], [])}


def test_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = D.op3_decontamination(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({D.OP3_SQL})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_one_index_serves_any_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "c d")], "doc_id long, text string")
    postings = D.index(docs)
    for text, want in (("a b", {1}), ("c d", {2}), ("c", {1, 2}), ("x", set())):
        items = spark.createDataFrame([(1, text)], "item_id long, text string")
        assert {r["id"] for r in D.asked(postings, items).filter("n_hit > 0").collect()} == want


def test_few_shards_are_read_at_once(spark):
    import pyarrow.parquet as pq

    texts = [(k, f"w{k} " * 400_000) for k in range(10)]
    postings = D.index(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in postings.inputFiles()]
    groups = [f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]
    assert sum(groups) == 10 and max(groups) <= 4
