"""Resampling against plain Python: weights of words and of word pairs, draws, odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

from ledgerline.llm.resampling import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    ws = WORD.findall((text or "").translate(LOWER))
    return [" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)], len(ws)


def plain(docs, target, n, buckets, seed, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text, n)[0]))
    for text in target:
        t.update(map(bucket, features(text, n)[0]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for i, text in docs:
        fs, n_words = features(text, n)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(order[: percent * len(order) // 100]):
        ranks.setdefault(r[:4], []).append(k + 1)
    return sorted((*r[:4], ranks[r[:4]].pop(0) if ranks.get(r[:4]) else None) for r in out if r[0] is not None), [r[:4] for r in out if r[0] is None]


def check(spark, docs, target, **how):
    how = {"n": 1, "buckets": 10_000, "seed": 2024, "percent": 10, "least_words": 20} | how
    frame = spark.createDataFrame([(i, t, 7, 1.5) for i, t in docs], "doc_id long, text string, id int, score double")
    got = resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), **how).collect()
    want, unnamed = plain(docs, target, how["n"], how["buckets"], how["seed"], how["percent"], how["least_words"])
    key = lambda r: (r[0], r[4] is None, r[4] or 0)
    assert sorted((tuple(r) for r in got if r[0] is not None), key=key) == sorted(want, key=key)
    assert [tuple(r)[:4] for r in got if r[0] is None] == unnamed


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "A b C naïve ÄÖ 9x_y"), (3, "A b C naïve ÄÖ 9x_y"), (4, "the cat " * 300), (None, "the dog " * 40), (5, "?!"), (6, "a " * 20)]
    docs += [(k, f"word{k % 7} the legal text of number {k} " * (k % 5 + 1)) for k in range(10, 90)]
    for n in (1, 2):
        check(spark, docs, ["the legal text", None, "cat"], n=n, percent=37, buckets=50)
    check(spark, docs, [], percent=100, least_words=0)
    check(spark, docs[:3], ["x"])
    check(spark, [], ["x"])


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    check(spark, docs, target)


def test_few_blocks_are_read_at_once(spark):
    import pyarrow.parquet as pq

    from ledgerline.llm import resampling as R

    texts = [(k, f"w{k} " * 700_000) for k in range(5)]
    held = R.vectors(spark.createDataFrame(texts, "id long, text string").coalesce(1), 1, "id", "text", "blocks")
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in held.inputFiles()]
    groups = [f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]
    assert sum(groups) == 5 and max(groups) <= 2
