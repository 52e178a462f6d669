"""All queries of the library by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import ballots as B
from ledgerline.operators import graphs as G
from ledgerline.operators import intervals as I
from ledgerline.operators import rollups as R
from ledgerline.plans.registry import ORACLES, QUERIES, cents, query, table  # noqa: F401
from ledgerline.scratch import spread

def _ballots(spark: SparkSession, d: str) -> DataFrame:
    one = B.one_ballot(table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("vote"), F.col("l_suppkey").alias("person"), F.col("l_returnflag").alias("response")), ["vote", "person"], "response")
    seats = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("person"), F.col("n_regionkey").alias("grp"))
    return one.join(seats, "person")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return B.leave_one_out(_ballots(spark, d), vote="vote", group="grp", response="response", yes="N", no="R")


_BALLOTS = """ballots AS (SELECT CAST(l_shipdate AS DATE) AS vote, l_suppkey AS person, min(l_returnflag) AS response FROM lineitem GROUP BY 1, 2),
seated AS (SELECT vote, person, response, n_regionkey AS grp FROM ballots JOIN supplier ON person = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
peers AS (SELECT *, CAST(sum(CASE WHEN response = 'N' THEN 1 ELSE 0 END) OVER w - CASE WHEN response = 'N' THEN 1 ELSE 0 END AS BIGINT) AS peers_for,
  CAST(sum(CASE WHEN response = 'R' THEN 1 ELSE 0 END) OVER w - CASE WHEN response = 'R' THEN 1 ELSE 0 END AS BIGINT) AS peers_against
  FROM seated WINDOW w AS (PARTITION BY vote, grp)),
judged AS (SELECT *, CASE WHEN response NOT IN ('N', 'R') THEN 'NON_SUBSTANTIVE' WHEN peers_for + peers_against < 2 THEN 'TOO_FEW_PEERS'
  WHEN peers_for = peers_against THEN 'TIE' WHEN response = CASE WHEN peers_for > peers_against THEN 'N' ELSE 'R' END THEN 'MATCH' ELSE 'DIFFER' END AS state FROM peers)"""


@query(f"WITH {_BALLOTS} SELECT vote, person, grp, response, peers_for, peers_against, state FROM judged")
def leave_one_out_majority(spark, d):
    return _judged(spark, d).select("vote", "person", "grp", "response", "peers_for", "peers_against", "state")


@query(f"""WITH {_BALLOTS} SELECT person, count(*) FILTER (state = 'MATCH') AS n_match, count(*) FILTER (state = 'DIFFER') AS n_differ,
count(*) FILTER (state = 'TIE') AS n_tie, count(*) AS n_ballots,
round(count(*) FILTER (state = 'MATCH') / nullif(count(*) FILTER (state IN ('MATCH', 'DIFFER')), 0), 6) AS agreement FROM judged GROUP BY person""")
def person_agreement_summary(spark, d):
    return B.agreement(_judged(spark, d), "person")


_OBSERVED = "observed AS (SELECT CAST(l_shipdate AS DATE) AS vote, count(*) AS n FROM lineitem GROUP BY 1)"


@query(f"""WITH {_OBSERVED}, published AS (SELECT vote, n + CASE WHEN dayofyear(vote) % 50 = 0 THEN 1 ELSE 0 END AS n FROM observed WHERE dayofyear(vote) % 77 <> 0)
SELECT vote, o.n AS observed_n, p.n AS published_n, CASE WHEN o.n IS NULL THEN 'NOT_OBSERVED' WHEN p.n IS NULL THEN 'NOT_PUBLISHED' WHEN o.n = p.n THEN 'RECONCILED' ELSE 'MISMATCH' END AS state
FROM observed o FULL JOIN published p USING (vote)""")
def vote_reconciliation(spark, d):
    seen = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("vote")).agg(F.count("*").alias("observed_n"))
    published = seen.filter(F.dayofyear("vote") % 77 != 0).select("vote", (F.col("observed_n") + F.when(F.dayofyear("vote") % 50 == 0, 1).otherwise(0)).alias("published_n"))
    return B.reconciled(seen, published, ["vote"], "n")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def ballots_missing_anti(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS n_items, count(*) FILTER (o_orderkey IS NULL) AS n_dead, round(count(*) FILTER (o_orderkey IS NULL) / count(*), 6) AS dead_rate FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey")
def dead_ref_rate(spark, d):
    known = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey")
    both = table(spark, d, "lineitem").select("l_orderkey").join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    dead = F.count(F.when(F.col("o_orderkey").isNull(), 1))
    return both.agg(F.count("*").alias("n_items"), dead.alias("n_dead"), F.round(dead / F.count("*"), 6).alias("dead_rate"))


@query("""WITH items AS (SELECT l_orderkey, count(*) AS n_items, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY 1)
SELECT n_name, count(DISTINCT c_custkey) AS n_customers, count(o_orderkey) AS n_orders, CAST(coalesce(sum(n_items), 0) AS BIGINT) AS n_items, CAST(coalesce(sum(cents), 0) AS BIGINT) AS revenue_cents
FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN items ON l_orderkey = o_orderkey GROUP BY n_name""")
def ministry_profile_preagg(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_items"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    both = customers.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_name").agg(
        F.countDistinct("c_custkey").alias("n_customers"), F.count("o_orderkey").alias("n_orders"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("cents"), F.lit(0)).alias("revenue_cents")
    )


@query("""SELECT o_custkey, count(*) AS n_orders, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent, count(*) FILTER (o_orderstatus = 'F') AS n_final,
round(count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 6) AS urgent_share FROM orders GROUP BY 1""")
def rollup_conditional_counts(spark, d):
    urgent = F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), urgent.alias("n_urgent"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_final"), F.round(urgent / F.count("*"), 6).alias("urgent_share"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS p FROM lineitem) SELECT a.p AS first, b.p AS second, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2""")
def co_occurrence_pairs(spark, d):
    # pairs are made from each order's own small array, so the lines are shuffled once and not joined with themselves
    return R.in_groups_of(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", 2, None).filter("n >= 2")


@query("""SELECT l_partkey, round(sum(o_totalprice * l_extendedprice / total), 1) AS allocated FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN (SELECT l_orderkey AS k, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) ON k = l_orderkey WHERE total > 0 GROUP BY 1""")
def allocation_weighted(spark, d):
    total = F.sum("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").withColumn("total", total).filter("total > 0")
    both = lines.join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("l_partkey").agg(F.round(F.sum(F.col("o_totalprice") * F.col("l_extendedprice") / F.col("total")), 1).alias("allocated"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_shipdate) AS r FROM lineitem) WHERE r = 1""")
def confidence_dedupe(spark, d):
    return I.latest(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_shipdate").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size)")
def census_counts(spark, d):
    return table(spark, d, "part").rollup("p_brand", "p_size").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, round(sum(value), 3) AS total FROM events GROUP BY 1, 2)
SELECT *, round(total - lag(total) OVER (PARTITION BY event_type ORDER BY day), 3) AS delta FROM m""")
def longitudinal_delta(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 3).alias("total"))
    return daily.withColumn("delta", F.round(F.col("total") - F.lag("total").over(Window.partitionBy("event_type").orderBy("day")), 3))


@query("SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0")
def json_path_filter(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter(F.col("k") % 3 == 0)


@query("""WITH t AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'signup'))
SELECT t.user_id, t.ts AS start, count(*) AS n, round(sum(e.value), 3) AS total FROM t JOIN events e ON e.user_id = t.user_id AND e.event_type = 'purchase' AND e.ts >= t.ts AND (t.until IS NULL OR e.ts < t.until) GROUP BY 1, 2""")
def role_interval_join(spark, d):
    events = table(spark, d, "events").select("user_id", "ts", "value", "event_type")
    terms = I.terms(events.filter("event_type = 'signup'").select("user_id", "ts").distinct(), "user_id", "ts").withColumnRenamed("ts", "start")
    inside = I.within(events.filter("event_type = 'purchase'"), terms, "user_id", "ts", "start", "until")
    return inside.groupBy("i.user_id", "i.start").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("""WITH r AS (SELECT s_suppkey, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + 3 AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY s_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM r),
g AS (SELECT *, sum(f) OVER (PARTITION BY s_suppkey ORDER BY a, b, f DESC ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT s_suppkey, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY s_suppkey, i""")
def interval_merge(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.to_date("l_shipdate").alias("a")).withColumn("b", F.date_add("a", 3))
    return I.merged(rows.join(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", "left_semi"), "s_suppkey", "a", "b")


@query("""WITH s AS (SELECT c_custkey AS id, count(o_orderkey) AS n, coalesce(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT), 0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
r AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS by_count, row_number() OVER (ORDER BY total DESC, id) AS by_total FROM s)
SELECT id, by_count, by_total, round(log2(by_count / by_total), 6) AS divergence FROM r""")
def rank_divergence(spark, d):
    """Places by two metrics (ties by id) and the logarithm of their ratio; places come from ranges, not from one task."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("total"))
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(orders, "id", "left").na.fill(0, ["n", "total"])
    both = G.ranks(G.ranks(s, F.desc("n"), "id", name="by_count"), F.desc("total"), "id", name="by_total")
    return both.select("id", "by_count", "by_total", F.round(F.log2(F.col("by_count") / F.col("by_total")), 6).alias("divergence"))


@query("SELECT c_nationkey, c_custkey, c_acctbal, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def topn_per_group(spark, d):
    return I.top_n(table(spark, d, "customer"), "c_nationkey", 3, F.desc("c_acctbal"), "c_custkey").select("c_nationkey", "c_custkey", "c_acctbal", F.col("rank").cast("long"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, d):
    got = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, f ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, i""")
def session_window(spark, d):
    return I.sessions(table(spark, d, "events"), "user_id", "ts", "30 minutes")


@query("SELECT page_id, sha256(x) AS text_sha256, length(x) AS n_chars FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), '^ | $', '', 'g') AS x FROM pages)")
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("x")).select("page_id", F.sha2("x", 256).alias("text_sha256"), F.length("x").cast("long").alias("n_chars"))


@query("SELECT href, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1")
def href_extract(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(T.hrefs(F.col("html"))).alias("href"))
    return links.groupBy("href").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query("SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])[ \\n\\t\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS n_sentences FROM documents")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n_numbers, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS n_capitalised, len(regexp_extract_all(text, '\\n')) AS n_breaks, sha256(text) AS text_sha256 FROM documents")
def regex_counts(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.n_matches(text, "[0-9]+").alias("n_numbers"), T.n_matches(text, "[A-Z][a-z]+").alias("n_capitalised"), T.n_matches(text, "\n").alias("n_breaks"), F.sha2("text", 256).alias("text_sha256"))


@query("SELECT DISTINCT p_type, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slug(spark, d):
    return table(spark, d, "part").select("p_type", T.slug(F.col("p_type")).alias("slug")).distinct()


def _dealt_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines by order, in tasks of about a million rows."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return spread(lines, lines.count(), "l_orderkey")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    steps = _dealt_lines(spark, d).withColumn("dst", F.lead("l_partkey").over(order)).select(F.col("l_partkey").alias("src"), "dst")
    return steps.filter("dst is not null and src <> dst").distinct()


_EDGES = """edges AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    """The edges with repeats: one row for each step of an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    steps = _dealt_lines(spark, d).withColumn("dst", F.lead("l_partkey").over(order)).select(F.col("l_partkey").alias("src"), "dst")
    return steps.filter("dst is not null and src <> dst")


_SHARES = f"""{_EDGES.replace("edges AS (SELECT DISTINCT", "links AS (SELECT")}, w AS (SELECT src, dst, count(*) AS n FROM links GROUP BY 1, 2),
shares AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM w)"""


def _rounds(n: int) -> str:
    steps = [f"v{k} AS (SELECT id, own, own + 0.3 * coalesce(gain, 0) AS value FROM v0 LEFT JOIN (SELECT dst, sum(x.value * share) AS gain FROM v{k - 1} x JOIN shares ON src = x.id GROUP BY dst) ON dst = id)" for k in range(1, n + 1)]
    return ", ".join(steps)


@query(f"""WITH {_SHARES}, v0 AS (SELECT p_partkey AS id, p_retailprice AS own, p_retailprice AS value FROM part), {_rounds(3)}
SELECT id, round(value, 3) AS value FROM v3""")
def propagation_k(spark, d):
    """Three rounds of damped propagation from the citing to the cited, shared by the source's references, repeats counted."""
    vertices = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("own"))
    return G.propagation(vertices, _links(spark, d)).select("id", F.round("value", 3).alias("value"))


_PR = ", ".join(f"r{k} AS (SELECT v.id, 0.15 / n + 0.85 * coalesce(g, 0) AS rank FROM r0 v CROSS JOIN size LEFT JOIN (SELECT dst, sum(rank * share) AS g FROM shares JOIN r{k - 1} ON id = src GROUP BY dst) ON dst = v.id)" for k in (1, 2, 3))


@query(f"""WITH {_SHARES}, size AS (SELECT count(*) AS n FROM part), r0 AS (SELECT p_partkey AS id, 1.0 / n AS rank FROM part CROSS JOIN size), {_PR}
SELECT id, round(rank, 9) AS rank FROM r3""")
def pagerank_directed(spark, d):
    return G.pagerank(table(spark, d, "part").select(F.col("p_partkey").alias("id")), _links(spark, d)).select("id", F.round("rank", 9).alias("rank"))


@query(f"""WITH RECURSIVE {_SHARES}, v AS (SELECT 0 AS k, p_partkey AS id, CAST(p_retailprice AS DOUBLE) AS own, CAST(p_retailprice AS DOUBLE) AS value, CAST(1e300 AS DOUBLE) AS delta FROM part
UNION ALL SELECT k + 1, id, own, fresh, max(abs(fresh - value)) OVER () FROM (SELECT v.k, v.id, v.own, v.value, v.own + 0.3 * coalesce(gain, 0) AS fresh
  FROM v LEFT JOIN (SELECT dst, sum(x.value * share) AS gain FROM v x JOIN shares ON src = x.id GROUP BY dst) ON dst = v.id WHERE v.delta >= 1 AND v.k < 20))
SELECT id, round(value, 3) AS value FROM v WHERE k = (SELECT max(k) FROM v)""")
def propagation_converged(spark, d):
    vertices = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("own"))
    return G.propagation_converged(vertices, _links(spark, d)).select("id", F.round("value", 3).alias("value"))


@query(f"""WITH RECURSIVE {_SHARES}, v AS (SELECT 0 AS k, p_partkey AS id, CAST(1.0 / count(*) OVER () AS DOUBLE) AS rank, count(*) OVER () AS n, CAST(1e300 AS DOUBLE) AS delta FROM part
UNION ALL SELECT k + 1, id, fresh, n, sum(abs(fresh - rank)) OVER () FROM (SELECT v.k, v.id, v.rank, v.n, CAST(0.15 AS DOUBLE) / v.n + 0.85 * coalesce(gain, 0) AS fresh
  FROM v LEFT JOIN (SELECT dst, sum(x.rank * share) AS gain FROM v x JOIN shares ON src = x.id GROUP BY dst) ON dst = v.id WHERE v.delta >= 1e-8 AND v.k < 100))
SELECT id, round(rank / max(rank) OVER (), 9) AS rank FROM v WHERE k = (SELECT max(k) FROM v)""")
def pagerank_converged(spark, d):
    return G.pagerank_converged(table(spark, d, "part").select(F.col("p_partkey").alias("id")), _links(spark, d)).select("id", F.round("rank", 9).alias("rank"))


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT p_partkey AS id, 0 AS hops FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part) UNION SELECT dst, hops + 1 FROM r JOIN edges ON src = id WHERE hops < 2) SELECT id, min(hops) AS hops FROM r GROUP BY id")
def reachability(spark, d):
    """What lies within two references of the dearest parts."""
    part = table(spark, d, "part")
    starts = part.join(part.agg(F.max("p_retailprice").alias("p_retailprice")), "p_retailprice").select(F.col("p_partkey").alias("id"))
    return G.reachable(starts, _edges(spark, d), 2)


@query(f"""WITH RECURSIVE {_EDGES}, starts AS (SELECT p_partkey AS id FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)),
f AS (SELECT id FROM starts UNION SELECT dst FROM f JOIN edges ON src = id), b AS (SELECT id FROM starts UNION SELECT src FROM b JOIN edges ON dst = id)
SELECT coalesce(f.id, b.id) AS id, f.id IS NOT NULL AS forward, b.id IS NOT NULL AS backward FROM f FULL JOIN b ON f.id = b.id""")
def reachability_exhaustive(spark, d):
    """What the dearest parts reach and what reaches them, over any number of edges."""
    part, edges = table(spark, d, "part"), _edges(spark, d)
    starts = part.join(part.agg(F.max("p_retailprice").alias("p_retailprice")), "p_retailprice").select(F.col("p_partkey").alias("id"))
    forward = G.reached(starts, edges).select("id", F.lit(True).alias("forward"))
    backward = G.reached(starts, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("id", F.lit(True).alias("backward"))
    return forward.join(backward, "id", "full_outer").select("id", F.coalesce("forward", F.lit(False)).alias("forward"), F.coalesce("backward", F.lit(False)).alias("backward"))


@query(f"WITH {_EDGES} SELECT id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) + sum(i) AS BIGINT) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY id")
def weighted_degree(spark, d):
    return G.degrees(_edges(spark, d))


@query("""WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part QUALIFY r <= 200), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part QUALIFY r <= 200)
SELECT p_partkey, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 9) AS score FROM a FULL JOIN b USING (p_partkey)""")
def rrf_fusion(spark, d):
    """Two top-200 lists fused by reciprocal rank; each list comes from a distributed top-k, its ranks from 200 rows."""

    def ranked(column: str) -> DataFrame:
        top = table(spark, d, "part").select("p_partkey", column).orderBy(F.desc(column), "p_partkey").limit(200)
        return top.select("p_partkey", (1.0 / (60 + F.row_number().over(Window.orderBy(F.desc(column), "p_partkey")))).alias(column))

    both = ranked("p_retailprice").join(ranked("p_size"), "p_partkey", "full_outer")
    return both.select("p_partkey", F.round(F.coalesce("p_retailprice", F.lit(0.0)) + F.coalesce("p_size", F.lit(0.0)), 9).alias("score"))


@query("""WITH p AS (SELECT quality AS gold, CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END AS pred FROM labels JOIN documents USING (doc_id)), c AS (SELECT unnest([0, 1]) AS class),
s AS (SELECT class, count(*) FILTER (gold = class AND pred = class) AS tp, count(*) FILTER (gold <> class AND pred = class) AS fp, count(*) FILTER (gold = class AND pred <> class) AS fn FROM p CROSS JOIN c GROUP BY class)
SELECT class, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM s""")
def precision_recall(spark, d):
    pairs = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("gold"), F.when(F.col("n_chars") >= 500, 1).otherwise(0).alias("pred"))
    per = pairs.groupBy("gold", "pred").agg(F.count("*").alias("n")).select("gold", "pred", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("class"))
    n = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0))
    is_gold, is_pred = F.col("gold") == F.col("class"), F.col("pred") == F.col("class")
    s = per.groupBy("class").agg(n(is_gold & is_pred).alias("tp"), n(~is_gold & is_pred).alias("fp"), n(is_gold & ~is_pred).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("class", "tp", "fp", "fn", B.share(tp, tp + fp).alias("precision"), B.share(tp, tp + fn).alias("recall"), B.share(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_difference(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("""SELECT c_custkey, c_name, c_acctbal, source FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY v DESC) AS r FROM (
SELECT c_custkey, c_name, c_acctbal, 'old' AS source, 0 AS v FROM customer UNION ALL SELECT c_custkey, c_name || ' (new)', c_acctbal + 1, 'new', 1 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal, 'new', 1 FROM customer WHERE c_custkey % 50 = 0)) WHERE r = 1""")
def dedupe_upsert(spark, d):
    """Rows of a newer version replace those of the same key: anti-join and union, so only the target is shuffled by key."""
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = old.filter("c_custkey % 10 = 0").select("c_custkey", F.concat("c_name", F.lit(" (new)")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    added = old.filter("c_custkey % 50 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_name", "c_acctbal")
    new = changed.union(added)
    return old.join(new, "c_custkey", "left_anti").withColumn("source", F.lit("old")).union(new.withColumn("source", F.lit("new")))


@query("""SELECT a.conv_id, a.turn, b.turn - a.turn AS gap, length(b.text) AS n_chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn <= a.turn + 3 AND b.role = 'assistant' WHERE a.role = 'user'
QUALIFY row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn) = 1""")
def near_pattern(spark, d):
    """The next answer within three turns of each question, by one window over the conversation."""
    following = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(1, 3)
    answer = F.first(F.when(F.col("role") == "assistant", F.struct("turn", "text")), ignorenulls=True).over(following)
    rows = table(spark, d, "conversations").withColumn("answer", answer).filter((F.col("role") == "user") & F.col("answer").isNotNull())
    return rows.select("conv_id", "turn", (F.col("answer.turn") - F.col("turn")).alias("gap"), F.length("answer.text").cast("long").alias("n_chars"))


from ledgerline.plans import clauses, evidence, graph, linking, markup, matching, records, relational, sequences, texts  # noqa: E402, F401  each module registers its queries
