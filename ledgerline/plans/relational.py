"""Joins, roll-ups and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import rollups as R
from ledgerline.plans.registry import cents, n_if, query, table


@query("""SELECT n_name, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT o_orderkey) AS n_orders, count(l_orderkey) AS n_rows,
CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS total_cents, CAST(coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)), 0) AS BIGINT) AS line_cents
FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_name""")
def ministry_profile_fanout(spark, d):
    """Both left joins before the sums, so an order's price counts once for each of its lines, as in the plain SQL form."""
    lines = table(spark, d, "lineitem").select("l_orderkey", cents("l_extendedprice").alias("line"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", cents("o_totalprice").alias("total"))
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey")
    rows = people.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.groupBy("n_name").agg(
        F.count_distinct("c_custkey").alias("n_customers"), F.count_distinct("o_orderkey").alias("n_orders"), F.count("l_orderkey").alias("n_rows"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_cents"), F.coalesce(F.sum("line"), F.lit(0)).alias("line_cents"),
    )


@query("""WITH s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS k, l_suppkey AS p FROM lineitem)
SELECT a.p AS first, b.p AS second, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2""")
def co_occurrence_by_date(spark, d):
    rows = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_suppkey")
    return R.pairs_in_blocks(rows, "day", "l_suppkey", least=2)


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS p FROM lineitem), few AS (SELECT k FROM s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50),
dates AS (SELECT DISTINCT a.p AS first, b.p AS second FROM (SELECT DISTINCT l_partkey AS k, l_suppkey AS p FROM lineitem WHERE l_discount > 0.095) a JOIN (SELECT DISTINCT l_partkey AS k, l_suppkey AS p FROM lineitem WHERE l_discount > 0.095) b ON a.k = b.k AND a.p < b.p)
SELECT first, second, n FROM (SELECT a.p AS first, b.p AS second, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.p < b.p SEMI JOIN few ON few.k = a.k GROUP BY 1, 2) ANTI JOIN dates USING (first, second)""")
def co_occurrence_in_groups(spark, d):
    """Suppliers together in orders of 2 to 50 suppliers that share no part sold at the highest discount."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount")
    known = R.pairs_by_key(lines.filter("l_discount > 0.095"), "l_partkey", "l_suppkey").select("first", "second")
    return R.in_groups_of(lines, "l_orderkey", "l_suppkey", 2, 50).join(known, ["first", "second"], "left_anti")


@query("""SELECT l_orderkey, count(*) AS n_lines FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P') GROUP BY 1""")
def orphan_ballots(spark, d):
    """Lines whose order isn't among the kept ones: counted by order, before the anti-join."""
    kept = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey")
    counted = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    return counted.join(kept, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


@query("""SELECT l_partkey, round(sum(o_totalprice / n), 2) AS allocated FROM lineitem JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = l_orderkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def allocation_even(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_partkey")
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    return R.allocated(lines, parents, "key", "o_totalprice").filter("share is not null").groupBy("l_partkey").agg(F.round(F.sum("share"), 2).alias("allocated"))


@query("""WITH w AS (SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'R' THEN l_discount * 2 END AS weight FROM lineitem),
s AS (SELECT *, greatest(1 - coalesce(sum(weight) OVER (PARTITION BY l_orderkey), 0), 0) AS rest, count(*) FILTER (weight IS NULL) OVER (PARTITION BY l_orderkey) AS free FROM w)
SELECT l_partkey, round(sum(o_totalprice * coalesce(weight, rest / nullif(free, 0))), 0) AS allocated FROM s JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def allocation_explicit(spark, d):
    """Explicit weights first, the remainder (never below nothing) evenly over the rest."""
    weight = F.when(F.col("l_returnflag") == "R", F.col("l_discount") * 2)
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_partkey", weight.alias("weight"))
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    got = R.allocated(lines, parents, "key", "o_totalprice", "weight").filter("o_totalprice is not null")
    return got.groupBy("l_partkey").agg(F.round(F.sum("share"), 0).alias("allocated"))


@query("""WITH a AS (SELECT l_partkey AS k, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT l_partkey AS k, CAST(max(CAST(round(l_extendedprice * 100) AS BIGINT)) * 3 AS BIGINT) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0 ELSE greatest(coalesce(a.v, 0), coalesce(b.v, 0), CAST(round(p_retailprice * 100) AS BIGINT)) + 100 END AS budget_cents
FROM part LEFT JOIN a ON a.k = p_partkey LEFT JOIN b ON b.k = p_partkey""")
def combined_budget_greatest(spark, d):
    """The greatest of three layers and an additive pool; nothing where the part is no longer in force. One pass over the lines."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum(F.when(F.col("l_returnflag") == "R", cents("l_extendedprice"))).alias("a"), (F.max(F.when(F.col("l_linestatus") == "O", cents("l_extendedprice"))) * 3).alias("b")
    )
    budget = F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)), cents("p_retailprice")) + 100
    return table(spark, d, "part").join(lines, "p_partkey", "left").select("p_partkey", F.when(F.col("p_size") % 5 == 0, 0).otherwise(budget).alias("budget_cents"))


@query("""WITH r AS (SELECT *, CASE p_type WHEN 'LARGE' THEN 'HIGH' WHEN 'STANDARD' THEN 'HIGH' WHEN 'MEDIUM' THEN 'MEDIUM' WHEN 'SMALL' THEN 'LOW' ELSE 'NONE' END AS confidence FROM part)
SELECT p_brand, p_size, p_partkey, confidence FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY CASE confidence WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, p_partkey) AS n FROM r) WHERE n = 1""")
def confidence_rank_dedupe(spark, d):
    confidence = F.when(F.col("p_type").isin("LARGE", "STANDARD"), "HIGH").when(F.col("p_type") == "MEDIUM", "MEDIUM").when(F.col("p_type") == "SMALL", "LOW").otherwise("NONE")
    rows = table(spark, d, "part").select("p_brand", "p_size", "p_partkey", confidence.alias("confidence"))
    return R.ranked_dedupe(rows, ["p_brand", "p_size"], "confidence", ["HIGH", "MEDIUM", "LOW"], "p_partkey")


@query("""WITH y AS (SELECT year(o_orderdate) AS y, count(DISTINCT month(o_orderdate)) AS months, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents FROM orders GROUP BY 1)
SELECT y AS year, months, total_cents FROM y WHERE y = (SELECT max(y) FROM y WHERE months = 12 AND total_cents > 100000000)""")
def latest_full_year(spark, d):
    years = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count_distinct(F.month("o_orderdate")).alias("months"), F.sum(cents("o_totalprice")).alias("total_cents"))
    full = years.filter((F.col("months") == 12) & (F.col("total_cents") > 100_000_000))
    return full.orderBy(F.desc("year")).limit(1)


@query("""WITH e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst),
o AS (SELECT src AS id, count(*) AS n_out, count(*) FILTER (p_size % 5 = 0) AS n_stale FROM e JOIN part ON p_partkey = dst GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n_in FROM e GROUP BY 1)
SELECT p_partkey AS id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(n_stale, 0) AS n_stale, round(n_stale / n_out, 6) AS dead_ref_rate FROM part LEFT JOIN o ON o.id = p_partkey LEFT JOIN i ON i.id = p_partkey""")
def reference_census(spark, d):
    """In and out references of each part, how many point to parts no longer in force, and that rate (null without any)."""
    from ledgerline.plans.catalog import _edges

    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5 == 0).alias("stale"))
    edges = _edges(spark, d).join(parts.select(F.col("id").alias("dst"), "stale"), "dst")
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.col("stale").cast("int").alias("s")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("s")))).alias("e"))
    counted = both.groupBy("e.id").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"), F.sum("e.s").alias("n_stale"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return parts.select("id").join(counted, "id", "left").select("id", zero("n_in").alias("n_in"), zero("n_out").alias("n_out"), zero("n_stale").alias("n_stale"), F.round(F.try_divide("n_stale", "n_out"), 6).alias("dead_ref_rate"))


@query("SELECT l_partkey, count(*) AS n_total, count(*) FILTER (year(l_shipdate) >= 2000) AS n_recent, min(year(l_shipdate)) AS first_year, max(year(l_shipdate)) AS last_year FROM lineitem GROUP BY 1")
def attention_recent(spark, d):
    year = F.year("l_shipdate").cast("long")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n_total"), n_if(year >= 2000).alias("n_recent"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))


@query("""SELECT l_suppkey, l_partkey % 50 AS area, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'R'), 0) WHEN count(*) FILTER (l_returnflag = 'A') > 0
THEN coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'A'), 0) ELSE sum(CAST(l_quantity AS BIGINT)) END::BIGINT AS total,
CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'R' WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'A' ELSE 'ALL' END AS basis, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds FROM lineitem GROUP BY 1, 2""")
def area_precedence_votes(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("area"), "l_returnflag", F.col("l_quantity").cast("long").alias("quantity"))
    return R.by_precedence(rows, ["l_suppkey", "area"], "l_returnflag", "quantity", ["R", "A"])


_SIGNALS = """s AS (SELECT o_orderkey AS id, coalesce(n, 0) AS n_lines, coalesce(r, 0) AS n_returned, coalesce(q, 0) AS quantity, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def _signals(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n_lines"), n_if(F.col("l_returnflag") == "R").alias("n_returned"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("urgent"))
    return orders.join(lines, "id", "left").na.fill(0, ["n_lines", "n_returned", "quantity"])


@query(f"""WITH {_SIGNALS} SELECT id, round(least(n_lines / 7.0, 1) * 0.3 + least(n_returned / 3.0, 1) * 0.25 + least(quantity / 100.0, 1) * 0.25 + least(urgent / 1.0, 1) * 0.2, 4) AS score FROM s""")
def composite_score(spark, d):
    return _signals(spark, d).select("id", R.composite({"n_lines": (7.0, 0.3), "n_returned": (3.0, 0.25), "quantity": (100.0, 0.25), "urgent": (1.0, 0.2)}).alias("score"))


@query(f"WITH {_SIGNALS} SELECT id, CAST(n_lines > 0 AS INT) + CAST(n_returned > 0 AS INT) + CAST(quantity > 0 AS INT) + CAST(urgent > 0 AS INT) AS n_active FROM s")
def active_signals(spark, d):
    return _signals(spark, d).select("id", R.active("n_lines", "n_returned", "quantity", "urgent").alias("n_active"))


@query("""SELECT o_custkey, year(o_orderdate) AS year, count(DISTINCT month(o_orderdate)) AS months, count(DISTINCT month(o_orderdate)) < 10 AS partial FROM orders GROUP BY 1, 2""")
def partial_period(spark, d):
    months = F.count_distinct(F.month("o_orderdate"))
    return table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(months.alias("months"), (months < 10).alias("partial"))


@query("""WITH w AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS warned FROM lineitem GROUP BY 1)
SELECT CASE WHEN o_orderstatus = 'F' THEN 'PASSED' WHEN o_orderstatus = 'P' THEN 'RETURNED' ELSE 'OTHER' END AS outcome, CASE WHEN warned IS NULL THEN 'UNKNOWN' WHEN warned > 0 THEN 'WARNED' ELSE 'CLEAR' END AS warning, count(*) AS n,
round(count(*) / sum(count(*)) OVER (PARTITION BY outcome), 6) AS share FROM orders LEFT JOIN w ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def outcome_crosstab(spark, d):
    warned = table(spark, d, "lineitem").groupBy("l_orderkey").agg(n_if(F.col("l_returnflag") == "R").alias("warned"))
    rows = table(spark, d, "orders").join(warned, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    outcome = F.when(F.col("o_orderstatus") == "F", "PASSED").when(F.col("o_orderstatus") == "P", "RETURNED").otherwise("OTHER")
    warning = F.when(F.col("warned").isNull(), "UNKNOWN").when(F.col("warned") > 0, "WARNED").otherwise("CLEAR")
    counted = rows.groupBy(outcome.alias("outcome"), warning.alias("warning")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("outcome")), 6))


@query("""WITH e AS (SELECT event_id, user_id, unnest(CAST('[' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 || ',' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 || ']' AS BIGINT[])) AS ref FROM events)
SELECT ref, count(*) AS n, count(DISTINCT user_id) AS n_users FROM e WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY 1""")
def json_unnest_semi(spark, d):
    """References from a JSON array, of users with a purchase."""
    events = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    refs = F.from_json(F.concat(F.lit("["), k % 7, F.lit(","), k % 3, F.lit("]")), "array<bigint>")
    buyers = events.filter("event_type = 'purchase'").select("user_id").distinct()
    rows = events.select("user_id", F.explode(refs).alias("ref")).join(buyers, "user_id", "left_semi")
    return rows.groupBy("ref").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 500 AND 20000 AND lang IS NOT NULL")
def length_range_filter(spark, d):
    return table(spark, d, "documents").filter(F.length("text").between(500, 20000) & F.col("lang").isNotNull()).select("doc_id", "n_chars")


@query("SELECT a.p_partkey AS id, count(*) AS n FROM part a JOIN supplier b ON (a.p_size = b.s_nationkey OR b.s_nationkey = 0 OR b.s_nationkey IS NULL) WHERE a.p_size < 25 GROUP BY 1")
def null_aware_or_join(spark, d):
    """A disjunctive join condition as two equi-joins: the equal keys, and the few wildcard rows, counted once, for every row."""
    parts, suppliers = table(spark, d, "part").filter("p_size < 25"), table(spark, d, "supplier")
    wild = suppliers.filter("s_nationkey = 0 or s_nationkey is null").agg(F.count("*").alias("w"))  # one row
    keyed = suppliers.filter("s_nationkey <> 0").groupBy(F.col("s_nationkey").alias("p_size")).agg(F.count("*").alias("k"))
    both = parts.join(keyed, "p_size", "left").crossJoin(F.broadcast(wild))
    return both.select(F.col("p_partkey").alias("id"), (F.coalesce("k", F.lit(0)) + F.col("w")).alias("n")).filter("n > 0")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' AND p_name NOT LIKE 'small%'")
def like_title_filter(spark, d):
    return table(spark, d, "part").filter(F.col("p_name").like("%ring%") & ~F.col("p_name").like("small%")).select("p_partkey", "p_name")


@query("""SELECT doc_id FROM documents WHERE list_bool_and([contains(lower(text), t) for t in ['die', 'und', 'der']])""")
def all_terms_filter(spark, d):
    """Documents that have every term of a query, in any case and order."""
    terms = F.split(F.lower(F.lit("die UND der")), r"\s+")
    return table(spark, d, "documents").filter(F.forall(terms, lambda t: F.contains(F.lower("text"), t))).select("doc_id")


@query("""WITH t AS (SELECT user_id, min(ts) AS a, max(ts) FILTER (event_type = 'error') AS b FROM events GROUP BY 1)
SELECT user_id, a IS NOT NULL AND coalesce(a, TIMESTAMP '0001-01-01') <= TIMESTAMP '2024-01-20' AND coalesce(b, TIMESTAMP '9999-12-31') >= TIMESTAMP '2024-01-10' AS serves FROM t""")
def period_overlaps_term(spark, d):
    """Whether a user's period (first event to last error, open without one) meets a term; periods without both ends don't."""
    t = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("b"))
    inside = (F.col("a") <= F.lit("2024-01-20").cast("timestamp")) & (F.coalesce("b", F.lit("9999-12-31").cast("timestamp")) >= F.lit("2024-01-10").cast("timestamp"))
    return t.select("user_id", (F.col("a").isNotNull() & inside).alias("serves"))


@query("""SELECT n, count(*) AS n_docs FROM (SELECT CASE WHEN regexp_matches(text, '(?i)license') THEN 'LICENSED' WHEN regexp_matches(text, '[0-9]{4}') THEN 'DATED' WHEN regexp_matches(text, '[#*$%&|<>]') THEN 'MARKED' ELSE 'PLAIN' END AS n FROM documents) GROUP BY 1""")
def regex_case_classes(spark, d):
    """Ordered classes: the first pattern that is found decides."""
    text = F.col("text")
    label = F.when(text.rlike("(?i)license"), "LICENSED").when(text.rlike("[0-9]{4}"), "DATED").when(text.rlike("[#*$%&|<>]"), "MARKED").otherwise("PLAIN")
    return table(spark, d, "documents").groupBy(label.alias("n")).agg(F.count("*").alias("n_docs"))


@query("""WITH e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)
SELECT CASE WHEN a.p_type = b.p_type THEN 'AMENDS' WHEN b.p_type = 'ECONOMY' THEN 'ISSUED_UNDER' WHEN a.p_size > b.p_size THEN 'CITES' ELSE 'REFERS' END AS kind, count(*) AS n FROM e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst GROUP BY 1""")
def edge_types(spark, d):
    """Edges typed by what stands at both ends."""
    from ledgerline.plans.catalog import _edges

    end = lambda side: table(spark, d, "part").select(F.col("p_partkey").alias(side), F.col("p_type").alias(f"{side}_type"), F.col("p_size").alias(f"{side}_size"))
    rows = _edges(spark, d).join(end("src"), "src").join(end("dst"), "dst")
    kind = F.when(F.col("src_type") == F.col("dst_type"), "AMENDS").when(F.col("dst_type") == "ECONOMY", "ISSUED_UNDER").when(F.col("src_size") > F.col("dst_size"), "CITES").otherwise("REFERS")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, count(l_orderkey) AS n_open FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = 'O' GROUP BY 1""")
def left_join_constant_predicate(spark, d):
    """The predicate belongs to the join, so orders without an open line stay."""
    lines = table(spark, d, "lineitem").filter("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.count("*").alias("n_open"))
    return table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("n_open", F.lit(0)).alias("n_open"))


@query("""SELECT s_suppkey, n_name, count(l_orderkey) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_discount > 0.05 GROUP BY 1, 2 HAVING count(l_orderkey) >= 100""")
def three_way_having(spark, d):
    lines = table(spark, d, "lineitem").filter("l_discount > 0.05").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    seats = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return seats.join(lines, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", "n_name", F.coalesce("n", F.lit(0)).alias("n")).filter("n >= 100")


@query("""SELECT l_suppkey, l_partkey % 100 AS item, min_by(l_returnflag, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := l_returnflag)) AS response, count(*) AS n_attempts, count(DISTINCT l_returnflag) > 1 AS conflict FROM lineitem GROUP BY 1, 2""")
def merged_attempts(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 100).alias("item"), F.col("l_returnflag").alias("response"), "l_shipdate", "l_orderkey", "l_linenumber")
    return R.merged_attempts(rows, ["l_suppkey", "item"], "response", ["l_shipdate", "l_orderkey", "l_linenumber", "response"])


@query("SELECT p_brand, p_type, p_size, count(*) AS n, CAST(grouping_id(p_brand, p_type, p_size) AS BIGINT) AS level FROM part GROUP BY CUBE (p_brand, p_type, p_size)")
def cube_counts(spark, d):
    return table(spark, d, "part").cube("p_brand", "p_type", "p_size").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT p_brand, p_type, count(*) AS n, CAST(grouping_id(p_brand, p_type) AS BIGINT) AS level FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def grouping_sets_counts(spark, d):
    parts = table(spark, d, "part")
    return parts.groupingSets([[parts.p_brand], [parts.p_type], []], parts.p_brand, parts.p_type).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""SELECT o_custkey, count(DISTINCT o_orderkey) AS n_docs, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year, left(string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority), 200) AS roles,
max_by(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS last_status, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents FROM orders GROUP BY 1""")
def person_profile(spark, d):
    """Documents, years, roles and last status of each person in one aggregation."""
    year = F.year("o_orderdate").cast("long")
    roles = F.substring(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; "), 1, 200)
    last = F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count_distinct("o_orderkey").alias("n_docs"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), roles.alias("roles"), last.alias("last_status"), F.sum(cents("o_totalprice")).alias("total_cents")
    )


@query("""SELECT l_suppkey, CAST(sum(abs(CAST(round((l_extendedprice - 30000) * 100) AS BIGINT))) AS BIGINT) AS total_abs, count(*) AS n, list_aggregate(list_sort(list(DISTINCT l_linenumber)), 'string_agg', ',') AS lines, max(l_quantity) AS most FROM lineitem GROUP BY 1""")
def sum_abs_list(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.abs(cents(F.col("l_extendedprice") - 30000))).alias("total_abs"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("l_linenumber")).cast("array<string>"), ",").alias("lines"), F.max("l_quantity").alias("most")
    )


@query("""WITH refs AS (SELECT doc_id, unnest([doc_id + 1, doc_id + 7]) AS ref FROM documents) SELECT doc_id, count(*) AS n_dangling FROM refs WHERE ref NOT IN (SELECT doc_id FROM documents WHERE lang IS NOT NULL) GROUP BY 1""")
def dangling_refs(spark, d):
    """References to documents that aren't there."""
    docs = table(spark, d, "documents")
    refs = docs.select("doc_id", F.explode(F.array(F.col("doc_id") + 1, F.col("doc_id") + 7)).alias("ref"))
    known = docs.filter("lang is not null").select(F.col("doc_id").alias("ref")).distinct()
    return refs.join(known, "ref", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_dangling"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS title, 1 AS p FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT DISTINCT l_orderkey, 'shell', 0 FROM lineitem)
SELECT id, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, title) AS r FROM o) WHERE r = 1""")
def union_later_wins(spark, d):
    """Official objects over shells of the same id: an anti-join takes the shells that are left."""
    official = table(spark, d, "orders").filter("o_orderkey % 3 = 0").groupBy(F.col("o_orderkey").alias("id")).agg(F.min("o_orderstatus").alias("title"))
    shells = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return official.union(shells.join(official, "id", "left_anti").withColumn("title", F.lit("shell")))


@query("""SELECT c_custkey, r AS rank FROM (SELECT c_custkey, row_number() OVER (ORDER BY coalesce(TRY_CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT), 1000000000000), c_custkey) AS r FROM customer) WHERE r <= 100""")
def numeric_id_top(spark, d):
    """The first hundred by the number in the name: a distributed top-k, then ranks of a hundred rows."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(c_name, '([0-9]+)$', 1) AS bigint)"), F.lit(10**12))
    top = table(spark, d, "customer").select("c_custkey", number.alias("number")).orderBy("number", "c_custkey").limit(100)
    return top.select("c_custkey", F.row_number().over(Window.orderBy("number", "c_custkey")).cast("long").alias("rank"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1999 GROUP BY 1)
SELECT count(*) FILTER (a.n IS NOT NULL) AS n_all, count(*) FILTER (b.n IS NOT NULL) AS n_recent, count(*) FILTER (a.n IS NOT NULL AND b.n IS NULL) AS n_old_only FROM a FULL JOIN b USING (k)""")
def intersection_counts(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(n_if(F.year("o_orderdate") >= 1999).alias("recent"))
    return per.agg(F.count("*").alias("n_all"), n_if(F.col("recent") > 0).alias("n_recent"), n_if(F.col("recent") == 0).alias("n_old_only"))


@query("""SELECT s_suppkey, CASE WHEN jaa IS NULL OR ei IS NULL THEN 'UNKNOWN' WHEN jaa > ei THEN 'FIRST' WHEN jaa < ei THEN 'SECOND' ELSE 'TIE' END AS winner FROM supplier LEFT JOIN
(SELECT l_suppkey, nullif(count(*) FILTER (l_returnflag = 'N' AND l_quantity > 45), 0) AS jaa, nullif(count(*) FILTER (l_returnflag = 'R' AND l_quantity > 45), 0) AS ei FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def vote_disposition(spark, d):
    """Which of two alternatives the published totals chose; an unpublished total stays unknown."""
    side = lambda v: F.nullif(n_if((F.col("l_returnflag") == v) & (F.col("l_quantity") > 45)), F.lit(0))
    totals = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(side("N").alias("jaa"), side("R").alias("ei"))
    jaa, ei = F.col("jaa"), F.col("ei")
    winner = F.when(jaa.isNull() | ei.isNull(), "UNKNOWN").when(jaa > ei, "FIRST").when(jaa < ei, "SECOND").otherwise("TIE")
    return table(spark, d, "supplier").join(totals, "s_suppkey", "left").select("s_suppkey", winner.alias("winner"))


@query("""WITH t AS (SELECT s_nationkey AS g, l_returnflag AS label, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT g, label, n, round(n / sum(n) OVER (PARTITION BY g), 6) AS share FROM t""")
def matter_label_report(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))  # before the join
    rows = lines.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("s_nationkey").alias("g"), F.col("l_returnflag").alias("label")).agg(F.sum("n").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("g")), 6))


@query("""SELECT 'orders' AS what, count(*) AS n, count(DISTINCT o_custkey) AS n_keys FROM orders UNION ALL SELECT 'lines', count(*), count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'documents', count(*), count(DISTINCT source) FROM documents""")
def coverage_report(spark, d):
    counted = lambda what, name, key: table(spark, d, name).agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys")).select(F.lit(what).alias("what"), "n", "n_keys")
    return counted("orders", "orders", "o_custkey").union(counted("lines", "lineitem", "l_orderkey")).union(counted("documents", "documents", "source"))
