"""Bundles, sketches, nested records and episodes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerline.functions import nested as N
from ledgerline.operators import episodes as E
from ledgerline.operators import sketches as K
from ledgerline.plans.registry import query, table
from ledgerline.scratch import saved, shared_dir
from ledgerline.sources import bundles as B


@query("""SELECT 'evidence' AS kind, CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS said, CAST(2 AS BIGINT) AS version FROM customer
UNION ALL SELECT 'review', CAST(n_nationkey AS VARCHAR), n_name, 2 FROM nation""")
def bundle_import(spark, d):
    """Two bundles imported, the second with newer rows, and a third refused for one bad row: all its other rows stay out."""
    store = B.Store(spark, f"{shared_dir(spark)}/bundles-{uuid.uuid4().hex}")
    rules = {k: lambda json: F.when(F.get_json_object(json, "$.said").isNull(), "says nothing") for k in ("evidence", "review")}
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    row = lambda place, kind, key, said: (place.alias("place"), F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.to_json(F.struct(said.alias("said"))).alias("json"))
    first = c.select(*row(F.col("c_custkey"), "evidence", F.col("c_custkey"), F.col("c_name"))).union(c.select(*row(F.col("c_custkey"), "statement", F.col("c_custkey"), F.col("c_name"))))
    second = c.filter("c_custkey % 3 = 0").select(*row(F.col("c_custkey"), "evidence", F.col("c_custkey"), F.col("c_mktsegment"))).union(n.select(*row(F.col("n_nationkey"), "review", F.col("n_nationkey"), F.col("n_name"))))
    third = c.select(*row(F.col("c_custkey"), "evidence", F.when(F.col("c_custkey") != 7, F.col("c_custkey")), F.lit("wrong")))
    for bundle in (first, second, third):
        try:
            B.imported(store, bundle, rules)
        except ValueError:
            pass  # the third
    version = F.lit(store.latest()).cast("long").alias("version")
    return store.read("evidence").select(F.lit("evidence").alias("kind"), "key", F.get_json_object("json", "$.said").alias("said"), version).union(store.read("review").select(F.lit("review"), "key", F.get_json_object("json", "$.said"), version))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_close, true AS median_close, true AS increment_equal FROM events GROUP BY 1""")
def sketch_rollup(spark, d):
    """Daily sketches rolled up by kind: estimates within their stated errors (3 % of the users, 1 % of the ranks), and an increment merged
    later gives what all days at once give."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    daily = saved(K.sketched(events, ["event_type", "day"], F.col("user_id"), F.col("value")), "daily-sketches")
    whole = K.estimates(K.rolled_up(daily, ["event_type"]), ["event_type"], [0.5])
    even = F.dayofmonth("day") % 2 == 0
    twice = K.rolled_up(K.rolled_up(daily.filter(even), ["event_type"]).unionByName(daily.filter(~even).drop("day")), ["event_type"])
    again = K.estimates(twice, ["event_type"], [0.5]).select("event_type", F.col("n").alias("n2"), F.col("distinct").alias("d2"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("all"))
    rank = events.join(whole.select("event_type", F.get("quantiles", F.lit(0)).alias("q")), "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("q")).cast("double")).alias("rank"))
    both = whole.join(exact, "event_type").join(again, "event_type").join(rank, "event_type")
    return both.select("event_type", "n", "users", (F.abs(F.col("distinct") - F.col("users")) <= F.greatest(0.03 * F.col("users"), F.lit(1))).alias("users_close"), F.col("rank").between(0.49, 0.51).alias("median_close"), ((F.col("n2") == F.col("n")) & (F.col("d2") == F.col("distinct")) & (F.col("n") == F.col("all"))).alias("increment_equal"))


def _records(spark, d):
    """A nested record for each order: its lines' evidence, and a certificate in which more is cited."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("e")))).alias("xs"))
    ids = F.transform("xs", lambda x: x["e"])
    body = F.struct(F.col("l_orderkey").alias("id"), ids.alias("evidence_ids"), F.struct(F.array(F.struct(F.slice(ids, 1, 1).alias("date_evidence_ids"), F.lit("x").alias("note"))).alias("parts"), F.when(F.col("l_orderkey") % 5 == 0, 1).alias("odd")).alias("certificate"))
    text = F.when(F.col("l_orderkey") % 97 == 0, "{oops").when(F.col("l_orderkey") % 11 == 0, F.replace(F.to_json(body), F.lit('"id"'), F.lit('"number"'))).otherwise(F.to_json(body))
    return lines.select(F.col("l_orderkey").alias("id"), text.alias("json"))


_LISTS = "l AS (SELECT l_orderkey AS id, list('e' || l_partkey ORDER BY l_linenumber, 'e' || l_partkey) AS es FROM lineitem WHERE l_orderkey % 97 <> 0 GROUP BY 1)"


@query(f"""WITH {_LISTS} SELECT id, '$.evidence_ids[' || k || ']' AS path, es[k + 1] AS ref FROM (SELECT id, es, unnest(range(len(es))) AS k FROM l) UNION ALL SELECT id, '$.certificate.parts[0].date_evidence_ids[0]', es[1] FROM l""")
def nested_ids(spark, d):
    """All evidence that nested records cite, with the paths."""
    return N.references(N.walked(_records(spark, d), "id", "json"), "id", "evidence_ids")


@query("""SELECT DISTINCT l_orderkey AS id, '$' AS path, 'INVALID' AS error FROM lineitem WHERE l_orderkey % 97 = 0 UNION ALL SELECT DISTINCT l_orderkey, '$.id', 'MISSING' FROM lineitem WHERE l_orderkey % 11 = 0 AND l_orderkey % 97 <> 0
UNION ALL SELECT DISTINCT l_orderkey, '$.number', 'EXTRA' FROM lineitem WHERE l_orderkey % 11 = 0 AND l_orderkey % 97 <> 0 UNION ALL SELECT DISTINCT l_orderkey, '$.certificate.odd', 'KIND' FROM lineitem WHERE l_orderkey % 5 = 0 AND l_orderkey % 97 <> 0""")
def schema_errors(spark, d):
    """What the nested records have too much, too little or of another kind than declared."""
    shape = {
        "$": ("OBJECT", False), "$.id": ("BIGINT", True), "$.evidence_ids": ("ARRAY", True), "$.evidence_ids[]": ("STRING", False), "$.certificate": ("OBJECT", True), "$.certificate.odd": ("STRING", False),
        "$.certificate.parts": ("ARRAY", True), "$.certificate.parts[]": ("OBJECT", False), "$.certificate.parts[].date_evidence_ids": ("ARRAY", True), "$.certificate.parts[].date_evidence_ids[]": ("STRING", False), "$.certificate.parts[].note": ("STRING", False),
    }
    return N.schema_errors(N.walked(_records(spark, d), "id", "json"), "id", shape)


_MOVE = "CASE " + " ".join(f"WHEN s.state = '{a}' AND x.state = '{k}' THEN '{b}'" for (a, k), b in E.MOVES.items()) + " END"


@query(f"""WITH e AS (SELECT user_id * 100 + dayofyear(ts) % 100 AS matter, ts, event_id, CASE event_type WHEN 'view' THEN 'QUESTION' WHEN 'click' THEN 'ANSWER' WHEN 'purchase' THEN 'DECISION' WHEN 'error' THEN 'WITHDRAWAL' ELSE 'NOTE' END AS kind FROM events),
g AS (SELECT matter, list(kind ORDER BY ts, event_id) FILTER (kind <> 'NOTE') AS ks, count(*) FILTER (kind = 'NOTE') AS n_notes FROM e GROUP BY 1),
w AS (SELECT matter, n_notes, list_reduce(list_transform(coalesce(ks, []), lambda k: {{'state': k, 'moves': 0::BIGINT, 'odd': CAST([] AS VARCHAR[])}}), lambda s, x: {{'state': coalesce({_MOVE}, s.state), 'moves': s.moves + CASE WHEN {_MOVE} IS NULL THEN 0 ELSE 1 END,
 'odd': CASE WHEN {_MOVE} IS NULL THEN list_append(s.odd, x.state || ' at ' || s.state) ELSE s.odd END}}, {{'state': 'OPEN', 'moves': 0::BIGINT, 'odd': CAST([] AS VARCHAR[])}}) AS r FROM g)
SELECT matter, r.state AS state, r.moves AS n_moves, n_notes, array_to_string(list_concat(list_transform(list_sort(list_distinct(r.odd)), lambda o: o || ': ' || len(list_filter(r.odd, lambda y: y = o))), CASE WHEN r.state = 'ASKED' THEN ['ANSWER_NOT_LOADED'] ELSE [] END), '; ') AS residuals FROM w""")
def episodes(spark, d):
    """Where each matter's questions, answers and decisions lead, and what didn't fit."""
    names = {"view": "QUESTION", "click": "ANSWER", "purchase": "DECISION", "error": "WITHDRAWAL"}
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in names.items()), F.lit("NOTE"))
    rows = table(spark, d, "events").select((F.col("user_id") * 100 + F.dayofyear("ts") % 100).alias("matter"), "ts", "event_id", kind.alias("kind"))
    return E.walked(rows, matter="matter", order=["ts", "event_id"], kind="kind", notes=("NOTE",))
