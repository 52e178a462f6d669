"""Steps whose tasks must not grow with the table, whatever number of partitions the session asks for."""

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import assignment as A
from ledgerline.operators import graphs as G
from ledgerline.operators import identity as P
from ledgerline.operators import incremental as N
from ledgerline.operators import intervals as I
from ledgerline.operators import matching as M
from ledgerline.operators import rollups as R
from ledgerline.plans import catalog
from ledgerline.scratch import spread


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_spread_keeps_tasks_small(spark, one_partition):
    found = spread(spark.range(10_000), 10_000, "id", each=500).groupBy("id").count()
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) < 1_000


@pytest.mark.parametrize("high", [3, None])
def test_pairs_of_groups(spark, one_partition, high):
    sets = {k: {(k * k + j) % 11 for j in range(k % 6)} for k in range(40)}
    rows = spark.createDataFrame([(k, m) for k, ms in sets.items() for m in ms for _ in range(2)], "k long, m long")
    want = Counter(p for ms in sets.values() if 2 <= len(ms) <= (high or 99) for p in combinations(sorted(ms), 2))
    got = R.in_groups_of(rows, "k", "m", 2, high)
    assert {(r["first"], r["second"]): r["n"] for r in got.collect()} == want
    assert got.rdd.getNumPartitions() > 1


def test_pairs_by_key_in_tasks(spark, one_partition):
    rows = spark.createDataFrame([(k % 3, k) for k in range(60)], "k long, m long")
    got = R.pairs_by_key(rows, "k", "m", tile=8)
    assert got.count() == 3 * 190 and got.rdd.getNumPartitions() > 1


def test_similar_sets_in_tasks(spark, one_partition):
    sets = {k: {(k * j) % 13 for j in range(1, 6)} for k in range(1, 20)}
    rows = spark.createDataFrame([(k, m) for k, ms in sets.items() for m in ms for _ in range(2)] + [(99, None)], "k long, m long")
    got = M.similar_sets(rows, "k", "m", 0.4)
    want = {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.4}
    assert {(r["first"], r["second"]) for r in got.collect()} == want and want
    assert got.rdd.getNumPartitions() > 1


def test_merged_intervals_in_tasks(spark, one_partition):
    rows = [(k, a, a + (a * k) % 7) for k in range(9) for a in [0, 0, 3, 3, 9, 10, 10, 20, 26, 26, 33]]
    want = []
    for k in range(9):
        runs = []
        for _, a, b in sorted(r for r in rows if r[0] == k):
            if runs and a <= runs[-1][2]:
                runs[-1] = [k, runs[-1][1], max(runs[-1][2], b), runs[-1][3] + 1]
            else:
                runs.append([k, a, b, 1])
        want += map(tuple, runs)
    got = I.merged(spark.createDataFrame(rows, "k long, a long, b long"), "k", "a", "b")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert got.rdd.getNumPartitions() > 1


def test_repaired_sets_in_tasks(spark, one_partition):
    frame = lambda rows: spark.createDataFrame(rows, "g long, m long")
    have = frame([(1, 1), (1, 1), (2, 1), (3, 1), (None, 4), (5, None)])
    more = frame([(1, 2), (1, 2), (2, 2), (3, 1), (4, 7), (5, 1)])
    expected = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 1)], "g long, n long")
    got = N.repaired(have, more, "g", "m", expected)
    assert Counter(tuple(r) for r in got.collect()) == Counter([(1, 1), (1, 1), (1, 2), (2, 1), (3, 1), (None, 4), (4, 7), (5, None), (5, 1)])
    assert got.rdd.getNumPartitions() > 1


def test_agreement_judges_in_tasks(spark, sf_dir, one_partition):
    plan = catalog.QUERIES["valid_source_agreement"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_shares_lie_in_buckets(spark, one_partition):
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 3)], "src long, dst long")
    dealt = G._shares(edges)
    assert {(r["src"], r["dst"]): round(r["share"], 6) for r in dealt.collect()} == {(1, 2): 0.666667, (1, 3): 0.333333, (2, 3): 1.0}
    plan = G._along(dealt, spark.range(5))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("Exchange hashpartitioning") <= 1


def test_namesakes_are_not_multiplied_by_years(spark, one_partition):
    rows = [(k, "a" if k % 3 else "b", 1990 + k % 4 * 4, 20 + 10 * (k % 5) + k % 4 * 4) for k in range(60)] + [(99, "c", 1990, 30), (100, "c", 1994, 34), (101, "c", 1998, None)]
    frame = spark.createDataFrame(rows, "id long, key string, year long, age long").withColumn("born", F.col("year") - F.col("age") - 1)
    state = frame.filter("born is not null").selectExpr("id", "key", "year", "born", "id AS place", "struct(key, id AS place) AS cluster", "cast(null as struct<place:bigint,other:bigint>) AS last")
    counts = state.groupBy("key", "year", "born").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    stood = counts.groupBy("key").agg(F.collect_list(F.struct("year", "born", "n", "first")).alias("stood"))
    joins = P._joining(state, stood, 62)
    assert [tuple(r["pair"]) for r in joins.filter("key = 'c'").collect()] == [(99, 100)]
    got = {r["id"]: r["cluster"] for r in P.clustered(frame, id_col="id", key="key", year="year", age="age").collect()}
    assert len(got) == len(rows) and (got[99], got[100], got[101]) == (99, 99, 101)
    plan = joins._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(" not in plan and "REPARTITION_BY_NUM" in joins._jdf.queryExecution().toString()


def test_rounds_send_no_large_table_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(G, "SMALL", 0)
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (0, 1), (5, 6), (7, 7), (8, 9)]
    plans, cut = [], G._cut
    monkeypatch.setattr(G, "_cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    got = G.bow_tie(spark.createDataFrame(edges, "src long, dst long"))
    want = {0: (0, "IN"), 1: (1, "CORE"), 2: (1, "CORE"), 3: (1, "CORE"), 4: (4, "OUT"), 5: (4, "OUT"), 6: (6, "OUT"), 7: (7, "TENDRIL"), 8: (8, "TENDRIL"), 9: (9, "TENDRIL")}
    assert {r["id"]: (r["component"], r["zone"]) for r in got.collect()} == want
    assert any("SortMergeJoin" in p for p in plans)
    rounds = [p for p in plans if "min(c" in p]
    assert rounds and not any("BroadcastExchange" in p for p in rounds)


def test_clustering_looks_paths_up_in_tasks(spark, one_partition):
    edges = spark.createDataFrame([(a, b) for a in range(12) for b in range(12) if (a * b) % 5 != 1 or a == b], "src long, dst long")
    links = {(r["src"], r["dst"]) for r in edges.collect() if r["src"] != r["dst"]}
    got = G.clustering_in(spark.range(12), edges, least=3)
    for r in got.collect():
        into = [a for a, b in links if b == r["id"]]
        assert r["n_in"] == len(into) and abs(r["clustering"] - sum((a, b) in links for a in into for b in into) / (len(into) * (len(into) - 1))) < 1e-12
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [a" in plan and "SortMergeJoin [a" not in plan


def test_meeting_blocks_are_not_shuffled_for_each_other(spark, one_partition):
    sets = {k: {(k * k + j) % 11 for j in range(k % 6)} for k in range(40)}
    rows = spark.createDataFrame([(k, m) for m, ks in sets.items() for k in ks for _ in range(2)], "k long, m long")
    got = R.pairs_in_blocks(rows, "k", "m", block=7)
    want = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sets, 2) if sets[a] & sets[b]}
    assert {(r["first"], r["second"]): r["n"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan


def test_similar_rows_of_one_group_are_not_shuffled_for_each_other(spark, one_partition):
    sets = {k: {(k * j) % 13 for j in range(k % 7)} for k in range(60)}
    frame = lambda odd: spark.createDataFrame([(k, list(x) * 2) for k, x in sets.items() if k % 2 == odd], "id long, words array<long>")
    got = A.similar_rows(frame(0), frame(1), keys=[], id_col="id", tokens="words", least=0.4, block=7)
    want = {(a, b) for a in sets for b in sets if a % 2 < b % 2 and sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.4 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in got.collect()} == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan
