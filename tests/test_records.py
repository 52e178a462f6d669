"""Bundles, nested JSON, sketches and episodes by hand and against plain Python."""

import json
import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import nested as N
from ledgerline.operators import episodes as E
from ledgerline.operators import sketches as K
from ledgerline.sources import bundles as B


def bundle(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "place long, kind string, key string, json string")


RULES = {"evidence": lambda j: F.lit(None).cast("string"), "review": lambda j: F.when(F.expr("schema_of_json(json) NOT LIKE '%target: STRING%'"), "invalid field types")}


def test_imports_are_whole_or_nothing(spark):
    store = B.Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    told = B.imported(store, bundle(spark, ("evidence", "a", '{"x": 1}'), ("evidence", "b", '{"x": 2}'), ("evidence", "a", '{"x": 3}'), ("document", "d", "{}")), {"evidence": RULES["evidence"]})
    assert told == {"imported": {"evidence": 3}, "ignored": {"document": 1}} and store.latest() == 1
    held = store.read("evidence", 1)
    rows = lambda df: {r["key"]: json.loads(r["json"])["x"] for r in df.collect()}
    assert rows(held) == {"a": 3, "b": 2} and store.read("document") is None
    for bad in (("review", "", "{}"), ("review", None, "{}"), ("review", "r", "{oops"), ("review", "r", None), ("review", "r", '{"target": ["x"]}')):
        rules = dict(RULES, review=lambda j: F.when(F.get_json_object(j, "$.target").startswith("["), "invalid field types"))
        with pytest.raises(ValueError, match="review"):
            try:
                B.imported(store, bundle(spark, ("evidence", "c", '{"x": 9}'), bad), rules)
            except ValueError as error:
                raise ValueError(f"review: {error}") from error
    assert store.latest() == 1 and rows(store.read("evidence")) == {"a": 3, "b": 2}
    B.imported(store, bundle(spark, ("evidence", "b", '{"x": 7}'), ("evidence", "c", '{"x": 8}')), {"evidence": RULES["evidence"]})
    assert rows(store.read("evidence")) == {"a": 3, "b": 7, "c": 8} and rows(held) == rows(store.read("evidence", 1)) == {"a": 3, "b": 2}


def test_two_writers_cannot_make_one_version(spark):
    store = B.Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    one = spark.range(1).selectExpr("cast(id as string) AS key", "'{}' AS json")
    assert store.commit({"t": one}, 0) == 1
    with pytest.raises(RuntimeError, match="someone else"):
        store.commit({"t": one.limit(0)}, 0)
    assert store.read("t").count() == 1 and B.Store(spark, store.root).latest() == 1


def test_references_at_any_depth(spark):
    docs = [
        (1, '{"evidence_ids": ["a", 1], "x": {"my_evidence_ids": ["b"]}, "y": [{"evidence_ids": []}, {"z": {"evidence_ids": ["c", {"evidence_ids": ["not this"]}]}}], "evidence_id": ["no"]}'),
        (2, "[]"), (3, None), (4, "{oops"), (5, '"evidence_ids"'), (6, '{"evidence_ids": "text"}'), (7, "null"),
    ]
    walked = N.walked(spark.createDataFrame(docs, "id long, json string").withColumn("path", F.lit(1)), "id", "json")
    got = sorted((r["id"], r["path"], r["ref"]) for r in N.references(walked, "id", "evidence_ids").collect())
    assert got == [(1, "$.evidence_ids[0]", "a"), (1, "$.evidence_ids[1]", "1"), (1, "$.x.my_evidence_ids[0]", "b"), (1, "$.y[1].z.evidence_ids[0]", "c"), (1, "$.y[1].z.evidence_ids[1]", '{"evidence_ids":["not this"]}')]
    kinds = {(r["id"], r["kind"]) for r in walked.filter("path = '$'").collect()}
    assert kinds == {(1, "OBJECT"), (2, "ARRAY"), (4, "INVALID"), (5, "STRING"), (6, "OBJECT"), (7, "VOID")}


def test_shapes(spark):
    shape = {"$": ("OBJECT", False), "$.a": ("BIGINT", True), "$.b": ("ARRAY", False), "$.b[]": ("OBJECT", False), "$.b[].c": ("STRING", True)}
    docs = [(1, '{"a": 1, "b": [{"c": "x"}, {"c": 2}, {}, 5]}'), (2, '{"z": 1}'), (3, "nope"), (4, "[1]"), (5, '{"a": 3}')]
    got = N.schema_errors(N.walked(spark.createDataFrame(docs, "id long, json string"), "id", "json"), "id", shape)
    assert sorted((r["id"], r["path"], r["error"]) for r in got.collect()) == [
        (1, "$.b[1].c", "KIND"), (1, "$.b[2].c", "MISSING"), (1, "$.b[3]", "KIND"), (2, "$.a", "MISSING"), (2, "$.z", "EXTRA"), (3, "$", "INVALID"), (4, "$", "KIND"), (4, "$[0]", "EXTRA"),
    ]


def test_nested_values_know_their_arrays(spark):
    docs = [(1, '{"evidence_ids": ["a", ["b"]], "evidence_ids[7]": "no", "x.y": [{"evidence_ids": ["c\\u0022"]}], "n": [1, 1.5, true, null, 1e99, "2"]}'), (2, ' [["d"]]')]
    walked = N.walked(spark.createDataFrame(docs, "id long, json string"), "id", "json")
    refs = N.references(walked, "id", "evidence_ids")
    assert sorted(tuple(r) for r in refs.collect()) == [(1, "$.evidence_ids[0]", "a"), (1, "$.evidence_ids[1]", '["b"]'), (1, "$.x.y[0].evidence_ids[0]", 'c"')]
    assert [r["kind"] for r in walked.filter("id = 1 and path like '$.n[%'").orderBy("path").collect()] == ["BIGINT", "DECIMAL", "BOOLEAN", "VOID", "DOUBLE", "STRING"]
    plan = refs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_missing_fields_without_a_shuffle_of_values(spark):
    shape = {"$": ("OBJECT", False), "$.a": ("OBJECT", True), "$.a.b": ("BIGINT", True)}
    docs = [(1, '{"a": {}, "a.b": 1}'), (2, '{"a": {"b": null}}'), (3, "{}")]
    got = N.schema_errors(N.walked(spark.createDataFrame(docs, "id long, json string"), "id", "json"), "id", shape)
    assert {tuple(r) for r in got.filter("error = 'MISSING'").collect()} == {(1, "$.a.b", "MISSING"), (3, "$.a", "MISSING")}
    assert "SortMergeJoin" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "LeftAnti" not in plan


def test_sketches_merge(spark):
    rng = random.Random(3)
    rows = [("a" if k % 3 else "b", k % 4, rng.randrange(3000), rng.random()) for k in range(6000)]
    df = spark.createDataFrame(rows, "g string, day int, who long, v double")
    daily = K.sketched(df, ["g", "day"], F.col("who"), F.col("v"))
    got = {r["g"]: r for r in K.estimates(K.rolled_up(daily, ["g"]), ["g"], [0.25, 0.9]).collect()}
    for g in "ab":
        who, values = {w for x, _, w, _ in rows if x == g}, sorted(v for x, _, _, v in rows if x == g)
        assert got[g]["n"] == len(values) and abs(got[g]["distinct"] - len(who)) <= 0.03 * len(who)
        for q, v in zip((0.25, 0.9), got[g]["quantiles"], strict=True):
            assert abs(sum(x <= v for x in values) / len(values) - q) < 0.01


def plain_episode(kinds):
    state, moves, odd = "OPEN", 0, Counter()
    for k in kinds:
        if (state, k) in E.MOVES:
            state, moves = E.MOVES[state, k], moves + 1
        else:
            odd[f"{k} at {state}"] += 1
    said = [f"{k}: {n}" for k, n in sorted(odd.items())] + (["ANSWER_NOT_LOADED"] if state == "ASKED" else [])
    return state, moves, "; ".join(said)


def test_episodes(spark):
    rng = random.Random(4)
    kinds = ["QUESTION", "ANSWER", "DECISION", "WITHDRAWAL", "SPEECH"]
    matters = {m: [rng.choice(kinds) for _ in range(rng.randrange(1, 12))] for m in range(60)} | {100: ["ANSWER"] * 500 + ["QUESTION"] * 500, 101: ["QUESTION"], 102: ["NOTE", "NOTE"]}
    rows = [(m, k, kind) for m, ks in matters.items() for k, kind in enumerate(ks)]
    got = {r["matter"]: r for r in E.walked(spark.createDataFrame(rows, "matter long, at int, what string"), matter="matter", order=["at"], kind="what", notes=("NOTE",)).collect()}
    for m, ks in matters.items():
        want = plain_episode([k for k in ks if k != "NOTE"])
        assert (got[m]["state"], got[m]["n_moves"], got[m]["residuals"]) == want and got[m]["n_notes"] == ks.count("NOTE")
