"""Retrieval, matching and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import matching as M
from ledgerline.plans.registry import n_if, query, table
from ledgerline.plans.texts import TOKENS

_RANKED = f"""p AS (SELECT doc_id, source, unnest(ts) AS token FROM (SELECT doc_id, source, {TOKENS} AS ts FROM documents WHERE text IS NOT NULL)),
q AS (SELECT item_id, unnest(ts) AS token FROM (SELECT item_id, {TOKENS} AS ts FROM benchmark)), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL),
s AS (SELECT item_id, doc_id, source, round(sum(ln(1 + n / df)), 6) AS score FROM q JOIN p USING (token) JOIN df USING (token) CROSS JOIN n GROUP BY 1, 2, 3),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def _tokens(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "source", T.retrieval_tokens(F.col("text")).alias("tokens"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.retrieval_tokens(F.col("text")).alias("tokens"))
    return docs, asked


@query(f"WITH {_RANKED} SELECT item_id, doc_id, round(score, 4) AS score, rank FROM ranked WHERE rank <= 5")
def idf_retrieval_topk(spark, d):
    found = M.retrieved(*_tokens(spark, d), top=5)
    return found.select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


_RELEVANT = "rel AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 101, 200)) WHERE length(b.text) >= 300)"


@query(f"""WITH {_RANKED}, {_RELEVANT}, k AS (SELECT unnest([1, 5, 10, 50]) AS k) SELECT k, count(*) AS n_relevant, count(*) FILTER (rank <= k) AS n_found, round(count(*) FILTER (rank <= k) / count(*), 6) AS recall
FROM rel LEFT JOIN ranked USING (item_id, doc_id) CROSS JOIN k GROUP BY 1""")
def recall_at_k(spark, d):
    """How many of the documents that hold a long passage of an item retrieval finds among its first k."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    items = table(spark, d, "benchmark").filter("length(text) >= 300").select(F.col("item_id").alias("query_id"), F.substring("text", 101, 200).alias("passage"))
    relevant = M.holding(docs, items)
    return M.recall_at(M.retrieved(*_tokens(spark, d), top=50), relevant, [1, 5, 10, 50])


@query(f"""WITH {_RANKED}, own AS (SELECT s.item_id, s.doc_id, s.score, row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, s.doc_id) AS rank FROM s WHERE s.source = 'src' || s.item_id % 5)
SELECT item_id, doc_id, round(score, 4) AS score, rank FROM own WHERE rank <= 3""")
def scoped_retrieval(spark, d):
    """Each item among the documents of one source only; weights are those of all documents."""
    docs, asked = _tokens(spark, d)
    asked = asked.withColumn("source", F.concat(F.lit("src"), (F.col("query_id") % 5).cast("string")))
    found = M.retrieved(docs, asked, top=3, scope=["source"])
    return found.select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS m FROM lineitem WHERE l_discount > 0.05), z AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.k AS first, b.k AS second, count(*) AS shared FROM s a JOIN s b ON a.m = b.m AND a.k < b.k GROUP BY 1, 2)
SELECT first, second, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN z x ON x.k = first JOIN z y ON y.k = second WHERE shared / (x.n + y.n - shared) >= 0.1""")
def jaccard_pairs(spark, d):
    return M.similar_sets(table(spark, d, "lineitem").filter("l_discount > 0.05"), "l_suppkey", "l_partkey", 0.1)


_NODES = """n AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderdate AS t, CASE WHEN o_orderpriority = '5-LOW' THEN 'X' ELSE left(o_orderpriority, 1) END AS topic, [o_totalprice] AS amounts,
coalesce((SELECT list(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey), []) AS refs, coalesce((SELECT list(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey), []) AS words FROM orders),
p AS (SELECT a.id AS target, b.id AS source, least(CASE WHEN a.topic = b.topic AND a.topic <> 'X' THEN 0.35 ELSE 0 END + CASE WHEN a.amounts[1] > 0 AND b.amounts[1] > 0 AND a.amounts[1] / b.amounts[1] > 0.5 AND a.amounts[1] / b.amounts[1] < 2 THEN 0.3 ELSE 0 END
 + CASE WHEN list_has_any(a.refs, b.refs) THEN 0.25 ELSE 0 END + CASE WHEN len(a.words) > 0 AND len(b.words) > 0 AND len(list_intersect(a.words, b.words)) / greatest(len(list_distinct(list_concat(a.words, b.words))), 1) > 0.2 THEN 0.1 ELSE 0 END, 1)::DOUBLE AS confidence
 FROM n a JOIN n b ON a.c = b.c AND (b.t < a.t OR (b.t = a.t AND b.id < a.id)))"""


def _pairs(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("refs"), F.collect_set("l_linenumber").alias("words"))
    topic = F.when(F.col("o_orderpriority") == "5-LOW", "X").otherwise(F.substring("o_orderpriority", 1, 1))
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("t"), topic.alias("topic"), F.array("o_totalprice").alias("amounts")).join(lines, "id", "left")
    nodes = nodes.withColumn("refs", F.coalesce("refs", F.array().cast("array<bigint>"))).withColumn("words", F.coalesce("words", F.array().cast("array<int>")))
    a, b = nodes.alias("a"), nodes.alias("b")
    before = (F.col("b.t") < F.col("a.t")) | ((F.col("b.t") == F.col("a.t")) & (F.col("b.id") < F.col("a.id")))
    both = lambda c: (F.col(f"a.{c}"), F.col(f"b.{c}"))
    confidence = M.pair_confidence(both("topic"), both("amounts"), both("refs"), both("words"))
    return a.join(b, (F.col("a.c") == F.col("b.c")) & before).select(F.col("a.id").alias("target"), F.col("b.id").alias("source"), confidence.alias("confidence"))


@query(f"WITH {_NODES} SELECT target, source, round(confidence, 6) AS confidence FROM p WHERE confidence > 0")
def pair_confidence(spark, d):
    return _pairs(spark, d).filter("confidence > 0").select("target", "source", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_NODES} SELECT target, source, round(confidence, 6) AS confidence FROM p WHERE round(confidence, 6) >= 0.3 QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(confidence, 6) DESC, source) = 1")
def best_match_edge(spark, d):
    return M.best_match(_pairs(spark, d).withColumn("confidence", F.round("confidence", 6)), "target", "confidence", 0.3, "source")


@query("""WITH a AS (SELECT o_custkey % 40 AS topic, o_orderkey AS id, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 7 <> 0),
b AS (SELECT o_custkey % 40 AS topic, o_orderkey AS id, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderpriority = '5-LOW' AND o_custkey % 5 <> 0)
SELECT 'UNADDRESSED' AS kind, a.topic, a.id AS first, NULL AS second FROM a ANTI JOIN b USING (topic) WHERE a.r <= 3
UNION ALL SELECT 'DIVERGENCE', a.topic, a.id, b.id FROM a JOIN b USING (topic) WHERE a.r <= 2 AND b.r <= 2 AND greatest(a.v, b.v) > 2 * least(a.v, b.v)
UNION ALL SELECT 'CORROBORATION', a.topic, a.id, b.id FROM a JOIN b USING (topic) WHERE a.r <= 2 AND b.r <= 2 AND greatest(a.v, b.v) <= 2 * least(a.v, b.v)""")
def cross_topic_matches(spark, d):
    """Per topic: first claims that nothing answers, and first claims against first answers, apart or alike."""
    orders = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("topic"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), "o_orderdate", "o_custkey", "o_orderpriority")
    order = Window.partitionBy("topic").orderBy("o_orderdate", "id")
    side = lambda p, k, n: orders.filter((F.col("o_orderpriority") == p) & (F.col("o_custkey") % k != 0)).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).select("topic", "id", "v", "r")
    a, b = side("1-URGENT", 7, 3), side("5-LOW", 5, 2)
    alone = a.join(b, "topic", "left_anti").select(F.lit("UNADDRESSED").alias("kind"), "topic", F.col("id").alias("first"), F.lit(None).cast("long").alias("second"))
    both = a.filter("r <= 2").select("topic", F.col("id").alias("first"), F.col("v").alias("va")).join(b.select("topic", F.col("id").alias("second"), F.col("v").alias("vb")), "topic")
    kind = F.when(F.greatest("va", "vb") > 2 * F.least("va", "vb"), "DIVERGENCE").otherwise("CORROBORATION")
    return alone.union(both.select(kind.alias("kind"), "topic", "first", "second"))


_JUDGED = "j AS (SELECT quality AS gold, CASE WHEN n_chars IS NULL OR n_chars < 20 THEN NULL WHEN n_chars >= 500 THEN 1 WHEN n_chars % 10 = 0 THEN 2 ELSE 0 END AS pred, source FROM labels JOIN documents USING (doc_id))"


def _predicted(spark, d):
    n = F.col("n_chars")
    pred = F.when(n.isNull() | (n < 20), None).when(n >= 500, 1).when(n % 10 == 0, 2).otherwise(0)
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "source"), "doc_id").select(F.col("quality").alias("gold"), pred.alias("pred"), "source")


@query(f"""WITH {_JUDGED}, c AS (SELECT unnest([0, 1, 2, 3]) AS class), s AS (SELECT class, count(*) FILTER (gold = class AND pred = class) AS tp, count(*) FILTER (gold IS DISTINCT FROM class AND pred = class) AS fp, count(*) FILTER (gold = class AND pred IS DISTINCT FROM class) AS fn FROM c CROSS JOIN j GROUP BY 1)
SELECT round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1, count(*) AS n_classes FROM s""")
def macro_f1(spark, d):
    """The mean F1 of a fixed list of classes; those that the data lack count as 0."""
    per = M.classification(_predicted(spark, d).select("gold", "pred"), [0, 1, 2, 3])
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return per.agg(F.round(F.avg(f1), 6).alias("macro_f1"), F.count("*").alias("n_classes"))


@query(f"WITH {_JUDGED} SELECT gold, source, count(*) AS n, count(*) FILTER (pred = gold) AS n_right, round(count(*) FILTER (pred = gold) / count(*), 6) AS accuracy FROM j GROUP BY GROUPING SETS ((gold), (source), ())")
def class_accuracy(spark, d):
    rows = _predicted(spark, d)
    right = n_if(F.col("pred") == F.col("gold"))
    cube = rows.cube("gold", "source").agg(F.count("*").alias("n"), right.alias("n_right"), F.round(right / F.count("*"), 6).alias("accuracy"), F.grouping_id().alias("level"))
    return cube.filter("level > 0").drop("level")


@query(f"WITH {_JUDGED} SELECT count(*) AS n, count(*) FILTER (pred IS NULL) AS n_abstained, round(count(*) FILTER (pred IS NULL) / count(*), 6) AS abstention, round(count(*) FILTER (pred = gold) / nullif(count(pred), 0), 6) AS precision_of_decided, round(count(*) FILTER (pred = gold) / count(*), 6) AS recall FROM j")
def abstention(spark, d):
    right, n = n_if(F.col("pred") == F.col("gold")), F.count("*")
    none = n_if(F.col("pred").isNull())
    return _predicted(spark, d).agg(n.alias("n"), none.alias("n_abstained"), F.round(none / n, 6).alias("abstention"), F.round(F.try_divide(right, F.count("pred")), 6).alias("precision_of_decided"), F.round(right / n, 6).alias("recall"))


_RUNS = """r AS (SELECT doc_id AS item, run, (n_chars // (100 * run)) % 3 AS label, source AS format FROM documents, (SELECT unnest([1, 2, 3]) AS run) WHERE n_chars IS NOT NULL AND source IS NOT NULL)"""


def _runs(spark, d):
    docs = table(spark, d, "documents").filter("n_chars is not null and source is not null")
    return docs.select(F.col("doc_id").alias("item"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("run"), "n_chars", F.col("source").alias("format")).withColumn("label", F.floor(F.col("n_chars") / (100 * F.col("run"))) % 3)


@query(f"WITH {_RUNS} SELECT b.format, b.run, count(*) AS n, round(count(*) FILTER (a.label = b.label) / count(*), 6) AS consistency FROM r b JOIN r a ON a.item = b.item AND a.run = 1 WHERE b.run > 1 GROUP BY 1, 2")
def run_consistency(spark, d):
    """How often later runs give what the first one gave."""
    rows = _runs(spark, d)
    first = rows.filter("run = 1").select("item", F.col("label").alias("before"))
    same = F.count(F.when(F.col("label") == F.col("before"), 1))
    return rows.filter("run > 1").join(first, "item").groupBy("format", F.col("run")).agg(F.count("*").alias("n"), F.round(same / F.count("*"), 6).alias("consistency"))


@query(f"""WITH {_RUNS}, m AS (SELECT format, round(avg(label), 6) AS mean FROM r GROUP BY 1) SELECT format, mean, round(mean - (SELECT mean FROM m WHERE format = 'src0'), 6) AS delta FROM m""")
def report_delta(spark, d):
    """Means by format and their distance from the reference format's."""
    means = _runs(spark, d).groupBy("format").agg(F.round(F.avg("label"), 6).alias("mean"))
    base = means.filter("format = 'src0'").select(F.col("mean").alias("base"))  # one row
    return means.join(F.broadcast(base), F.lit(True), "left").select("format", "mean", F.round(F.col("mean") - F.col("base"), 6).alias("delta"))


@query(f"""WITH {_RUNS}, a AS (FROM r WHERE run = 1 AND item % 7 <> 0), b AS (FROM r WHERE run = 2 AND item % 11 <> 0)
SELECT CASE WHEN a.item IS NULL THEN 'ONLY_SECOND' WHEN b.item IS NULL THEN 'ONLY_FIRST' WHEN a.label = b.label THEN 'SAME' ELSE 'DIFFERENT' END AS state, count(*) AS n FROM a FULL JOIN b ON a.item = b.item GROUP BY 1""")
def two_run_compare(spark, d):
    rows = _runs(spark, d)
    a = rows.filter("run = 1 and item % 7 <> 0").select("item", F.col("label").alias("la"))
    b = rows.filter("run = 2 and item % 11 <> 0").select("item", F.col("label").alias("lb"))
    state = F.when(F.col("la").isNull(), "ONLY_SECOND").when(F.col("lb").isNull(), "ONLY_FIRST").when(F.col("la") == F.col("lb"), "SAME").otherwise("DIFFERENT")
    return a.join(b, "item", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT source, len(list_filter(['de', 'en', 'es', 'fr'], lambda l: NOT list_contains(langs, l))) AS n_missing, array_to_string(list_sort(list_filter(['de', 'en', 'es', 'fr'], lambda l: NOT list_contains(langs, l))), ',') AS missing FROM (SELECT source, list(DISTINCT lang) FILTER (lang IS NOT NULL) AS langs FROM documents GROUP BY 1)")
def gold_diversity(spark, d):
    """Which of the expected classes a set lacks."""
    missing = F.array_except(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.collect_set("lang"))
    return table(spark, d, "documents").groupBy("source").agg(F.size(missing).cast("long").alias("n_missing"), F.array_join(F.array_sort(missing), ",").alias("missing"))
