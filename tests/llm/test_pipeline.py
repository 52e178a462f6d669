"""Each stage of the pipeline against brute force, on the result of the stage before."""

import corpus_pipeline as C
from pyspark.sql import functions as F
from tests.llm.test_decontamination import plain as plain_windows
from tests.llm.test_near_copies import plain_groups, plain_sets
from tests.llm.test_pii import plain as plain_pii

from ledgerline.llm import common, language_id
from ledgerline.llm.common import saved


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(-5, None, "en", "s", None), (-4, "12 !", "en", "s", 4), (-3, "Oneronth the and tion of that ble", "en", "s", 33), (-3, "Oneronth the and tion of that ble", "en", "s", 33), (None, "Und der enichschung ist das keit einheit", "de", None, 5)], docs.schema)
    docs = docs.unionByName(more)
    rows = {n: docs.select(docs.columns).collect() for n in ["documents"]}
    for name, stage in C.STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage")
        rows[name] = docs.collect()
        if name != "packing":
            assert docs.columns == more.columns
    seen = {n: sorted(((r["doc_id"] or 0, r["text"] or "") for r in rows[n])) for n in list(rows)[:-1]}
    assert seen["language_id"] == [r for r in seen["documents"] if r[0] not in (-5, -4)]
    texts = [t for _, t in seen["language_id"]]
    group = plain_groups(plain_sets(texts))
    kept = set(seen["near_dedup"])
    assert len(seen["near_dedup"]) == len(kept) == len(set(group))
    assert {g for (k, t), g in zip(seen["language_id"], group, strict=True) if (k, t) in kept} == set(group)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    bad = {r[0] for r in plain_windows(seen["near_dedup"], items) if r[-1]}
    assert bad and seen["decontamination"] == [r for r in seen["near_dedup"] if r[0] not in bad]
    after = dict(seen["pii"])
    assert after.keys() == dict(seen["decontamination"]).keys()
    changed = {k for k, t in seen["decontamination"] if t != after[k]}
    assert changed >= {k for k, t in seen["decontamination"] if plain_pii(t)} and not any(plain_pii(t) for t in after.values())
    assert all(r["n_chars"] == len(r["text"]) for r in rows["pii"])
    assert {r["doc_id"] or 0 for r in rows["packing"]} == set(after)


def test_a_corpus_without_labels_or_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
    assert language_id.learned(docs)[0] == []


def test_null_ids_and_clashing_columns_lose_no_text(spark, sf_dir):
    docs = spark.range(20000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", *(F.xxhash64(F.col("id"), F.lit(k)).cast("string") for k in range(6))).alias("text"))
    docs = docs.select("*", *(F.lit(1).alias(c) for c in ("row", "doc", "id", "node", "key", "spans", "base")))
    docs = docs.union(docs.limit(5))
    kept = saved(C.one_of_each_group(spark, docs, sf_dir), "stage")
    assert kept.columns == docs.columns and kept.count() == kept.select("text").distinct().count() == 20000
    clean = saved(C.clean_of_benchmark(spark, kept, sf_dir), "stage")
    assert clean.columns == docs.columns and clean.count() == 20000
    assert C.without_personal_data(spark, clean.limit(50), sf_dir).columns == docs.columns

