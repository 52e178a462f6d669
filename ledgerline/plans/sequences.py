"""Ballots, windows and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import ballots as B
from ledgerline.operators import intervals as I
from ledgerline.plans.catalog import _BALLOTS, _judged
from ledgerline.plans.registry import n_if, query, table
from ledgerline.scratch import spread


@query(f"""WITH {_BALLOTS}, l AS (SELECT person, CAST(year(vote) AS VARCHAR) AS label, count(*) AS n, count(*) FILTER (state = 'MATCH') AS m FROM judged WHERE state IN ('MATCH', 'DIFFER') GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, label) AS r FROM l)
SELECT person, count(*) AS n_labels, round(avg(m / n), 6) AS mean_within_label, max(label) FILTER (r = 1) AS largest_label, max(n) FILTER (r = 1) AS largest_count, round(max(m / n) FILTER (r = 1), 6) AS largest_rate,
round(sum(m) FILTER (r > 1) / nullif(sum(n) FILTER (r > 1), 0), 6) AS rate_without_largest FROM t GROUP BY 1""")
def label_sensitivity(spark, d):
    return B.label_sensitivity(_judged(spark, d).withColumn("label", F.year("vote").cast("string")), "person", "label")


_SOURCES = """b AS (SELECT CAST(l_shipdate AS DATE) AS vote, CASE WHEN l_quantity = 1 THEN NULL ELSE l_orderkey * 10 + l_linenumber END AS person,
  CASE WHEN l_quantity = 2 THEN '' WHEN l_quantity = 3 THEN 'no' WHEN l_returnflag = 'N' THEN 'JAA' WHEN l_returnflag = 'R' THEN 'EI' WHEN l_tax > 0.04 THEN 'TYHJAA' ELSE 'POISSA' END AS said FROM lineitem WHERE dayofyear(l_shipdate) % 7 <> 0 OR l_quantity > 3),
o AS (SELECT vote, count(*) AS n, count(*) FILTER (said = 'JAA') AS jaa, count(*) FILTER (said = 'EI') AS ei, count(*) FILTER (said = 'TYHJAA') AS ty, count(*) FILTER (said = 'POISSA') AS po, count(*) FILTER (said IN ('', 'no')) AS bad,
  count(*) - count(DISTINCT person) > 0 AS dup FROM b GROUP BY 1),
p AS (SELECT vote, CASE WHEN dayofyear(vote) % 50 = 0 THEN NULL ELSE jaa END AS pj, ei + CASE WHEN dayofyear(vote) % 41 = 0 THEN 1 ELSE 0 END AS pe, ty AS pt, po AS pp, jaa + ei + ty + po AS ps, dayofyear(vote) % 31 = 0 AS void FROM o),
j AS (SELECT *, pj IS NULL AS gone FROM o JOIN p USING (vote))"""


def _sources(spark, d) -> tuple[DataFrame, DataFrame]:
    """Published votes, some of them void, incomplete or not what the ballots say, and the ballots' totals."""
    q = F.col("l_quantity")
    raw = F.when(q == 2, " ").when(q == 3, "no").when(F.col("l_returnflag") == "N", " jaa").when(F.col("l_returnflag") == "R", "Ei ").when(F.col("l_tax") > 0.04, "TYHJÄÄ").otherwise("poissa")
    person = F.when(q != 1, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rows = table(spark, d, "lineitem").filter((F.dayofyear("l_shipdate") % 7 != 0) | (q > 3))
    seen = B.observed(rows.select(F.to_date("l_shipdate").alias("vote"), person.alias("person"), B.response(raw).alias("said")), "vote", "person", "said")
    day = F.dayofyear("vote")
    votes = seen.select(
        "vote", F.col("vote").alias("day"), (day % 31 == 0).alias("void"), F.when(day % 50 != 0, F.col("JAA")).alias("published_JAA"), (F.col("EI") + F.when(day % 41 == 0, 1).otherwise(0)).alias("published_EI"),
        F.col("TYHJAA").alias("published_TYHJAA"), F.col("POISSA").alias("published_POISSA"), (F.col("JAA") + F.col("EI") + F.col("TYHJAA") + F.col("POISSA")).alias("published_TOTAL"),
    )
    return votes, seen


@query(f"""WITH {_SOURCES}, r AS (SELECT *, list_sort(list_filter([CASE WHEN void THEN 'VOID_VOTE' END, CASE WHEN vote > DATE '2001-01-01' THEN 'FUTURE_CUTOFF' END, CASE WHEN gone THEN 'MISSING_PUBLISHED_TOTAL' END,
  CASE WHEN NOT gone AND ps <> pj + pe + pt + pp THEN 'PUBLISHED_TOTAL_BUCKET_SUM_MISMATCH' END, CASE WHEN NOT gone AND ps <> n THEN 'ROW_COUNT_MISMATCH' END, CASE WHEN NOT gone AND pe <> ei THEN 'EI_BUCKET_MISMATCH' END,
  CASE WHEN bad > 0 THEN 'UNRECOGNISED_OR_BLANK_RESPONSE' END, CASE WHEN dup THEN 'DUPLICATE_OR_BLANK_PERSON_ID' END], lambda x: x IS NOT NULL)) AS reasons FROM j)
SELECT vote, CASE WHEN list_contains(reasons, 'VOID_VOTE') THEN 'EXCLUDED_VOID' WHEN list_contains(reasons, 'FUTURE_CUTOFF') THEN 'EXCLUDED_FUTURE' WHEN len(reasons) > 0 THEN 'EXCLUDED_SOURCE_MISMATCH' ELSE 'VALID' END AS state,
array_to_string(reasons, ',') AS reasons, coalesce(pj > 0 AND pe > 0, false) AS contested FROM r""")
def source_diagnostics(spark, d):
    votes, seen = _sources(spark, d)
    return B.diagnosed(votes, seen, "vote", "2001-01-01")


@query(f"""WITH {_SOURCES} SELECT vote, CASE WHEN bad > 0 THEN 'INVALID_BALLOT_RESPONSES' WHEN gone THEN 'DECLARED_TOTAL_OR_BUCKET_UNKNOWN' WHEN ps <> n OR pe <> ei OR ps <> pj + pe + pt + pp THEN 'INCOMPLETE_OR_UNRECONCILED' ELSE 'COMPLETE_FOR_DECLARED_VOTE' END AS state FROM j""")
def vote_completeness(spark, d):
    votes, seen = _sources(spark, d)
    return B.completeness(votes, seen, "vote")


@query(f"WITH {_SOURCES} SELECT vote, CAST(n AS BIGINT) AS n_rows, jaa, ei, ty AS tyhjaa, po AS poissa, bad AS unknown_or_blank, dup AS duplicates FROM o")
def response_buckets(spark, d):
    seen = _sources(spark, d)[1]
    return seen.select("vote", F.col("rows").alias("n_rows"), F.col("JAA").alias("jaa"), F.col("EI").alias("ei"), F.col("TYHJAA").alias("tyhjaa"), F.col("POISSA").alias("poissa"), (F.col("UNKNOWN") + F.col("BLANK")).alias("unknown_or_blank"), F.col("DUPLICATES").alias("duplicates"))


@query("""WITH b AS (SELECT l_orderkey AS vote, l_suppkey AS person, CASE l_returnflag WHEN 'N' THEN 'JAA' WHEN 'R' THEN 'EI' ELSE 'TYHJAA' END AS said, CASE WHEN l_suppkey % 13 <> 0 THEN n_regionkey END AS grp FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
v AS (SELECT vote, vote % 31 <> 0 AND vote % 41 <> 0 AND count(*) = count(DISTINCT person) AS ok, count(*) FILTER (said = 'JAA') > 0 AND count(*) FILTER (said = 'EI') > 0 AS contested FROM b GROUP BY 1),
g AS (SELECT b.*, ok, contested, count(*) FILTER (said = 'JAA') OVER w - CASE WHEN said = 'JAA' THEN 1 ELSE 0 END AS f, count(*) FILTER (said = 'EI') OVER w - CASE WHEN said = 'EI' THEN 1 ELSE 0 END AS a FROM b JOIN v USING (vote) WINDOW w AS (PARTITION BY vote, grp)),
j AS (SELECT person, ok AND contested AS contested, CASE WHEN NOT ok THEN 'EXCLUDED' WHEN grp IS NULL THEN 'NO_GROUP' WHEN said = 'TYHJAA' THEN 'NON_SUBSTANTIVE' WHEN f + a < 2 THEN 'TOO_FEW_PEERS' WHEN f = a THEN 'TIE' WHEN (said = 'JAA') = (f > a) THEN 'MATCH' ELSE 'DIFFER' END AS state FROM g),
p AS (SELECT person, count(*) FILTER (state = 'MATCH') AS n_match, count(*) FILTER (state = 'DIFFER') AS n_differ, count(*) FILTER (state = 'TIE') AS n_tie, count(*) FILTER (state = 'TOO_FEW_PEERS') AS n_too_few_peers, count(*) FILTER (state = 'NON_SUBSTANTIVE') AS n_non_substantive,
 count(*) FILTER (state = 'NO_GROUP') AS n_no_group, count(*) FILTER (state = 'EXCLUDED') AS n_excluded, count(*) FILTER (state = 'MATCH' AND contested) AS contested_match, count(*) FILTER (state = 'DIFFER' AND contested) AS contested_differ, count(*) AS n FROM j GROUP BY 1)
SELECT * EXCLUDE (n), round(n_match / nullif(n_match + n_differ, 0), 6) AS agreement, round(contested_match / nullif(contested_match + contested_differ, 0), 6) AS contested_agreement,
 CASE WHEN n_match + n_differ > 0 THEN 'COMPARABLE' WHEN n_excluded = n THEN 'NO_VALID_SOURCE' ELSE 'NOT_COMPARABLE' END AS status FROM p""")
def valid_source_agreement(spark, d):
    """Each person's agreement with the own group, over sources that hold: none that is void, unreconciled or has a person twice."""
    seats = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("person"), F.when(F.col("s_suppkey") % 13 != 0, F.col("n_regionkey")).alias("grp"))
    raw = F.when(F.col("l_returnflag") == "N", "jaa").when(F.col("l_returnflag") == "R", " EI").otherwise("tyhjää")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("vote"), F.col("l_suppkey").alias("person"), B.response(raw).alias("said"))
    ballots = spread(lines.join(seats, "person"), lines.count(), "vote", each=1 << 18)  # what follows is by vote, several sorts and counts in a task
    seen = B.observed(ballots, "vote", "person", "said")
    total = F.col("JAA") + F.col("EI") + F.col("TYHJAA") + F.col("POISSA")
    votes = seen.select("vote", F.lit("2000-01-01").cast("date").alias("day"), (F.col("vote") % 31 == 0).alias("void"), F.col("JAA").alias("published_JAA"), (F.col("EI") + F.when(F.col("vote") % 41 == 0, 1).otherwise(0)).alias("published_EI"), F.col("TYHJAA").alias("published_TYHJAA"), F.col("POISSA").alias("published_POISSA"), total.alias("published_TOTAL"))
    return B.person_summary(ballots, B.diagnosed(votes, seen, "vote", "2001-01-01"), vote="vote", person="person", group="grp", response="said")


_NUMBERED = "e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM events)"


def _numbered(spark, d) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_type", "event_id", F.row_number().over(order).alias("sid"))


@query(f"""WITH {_NUMBERED}, t AS (SELECT *, lead(event_type, 1) OVER w AS t1, lead(sid, 1) OVER w AS s1, lead(event_type, 2) OVER w AS t2, lead(sid, 2) OVER w AS s2 FROM e WHERE event_type IN ('view', 'purchase', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY sid))
SELECT user_id, event_id, CASE WHEN t1 = 'purchase' AND s1 - sid <= 3 THEN s1 ELSE s2 END - sid AS gap FROM t WHERE event_type = 'view' AND ((t1 = 'purchase' AND s1 - sid <= 3) OR (t2 = 'purchase' AND s2 - sid <= 3))""")
def hedge_then_precise(spark, d):
    """A view followed by a purchase within the next two tagged events, at most three places on."""
    w = Window.partitionBy("user_id").orderBy("sid")
    tagged = _numbered(spark, d).filter("event_type in ('view', 'purchase', 'error')")
    gaps = [F.when((F.lead("event_type", k).over(w) == "purchase") & (F.lead("sid", k).over(w) - F.col("sid") <= 3), F.lead("sid", k).over(w) - F.col("sid")) for k in (1, 2)]
    return tagged.withColumn("gap", F.coalesce(*gaps)).filter("event_type = 'view' and gap is not null").select("user_id", "event_id", F.col("gap").cast("long").alias("gap"))


@query(f"""WITH {_NUMBERED} SELECT DISTINCT a.user_id, a.event_id FROM e a JOIN e b ON a.user_id = b.user_id AND b.event_type = 'error' AND abs(a.sid - b.sid) <= 4 WHERE a.event_type = 'purchase'""")
def near_both_sides(spark, d):
    """Purchases with an error within four places on either side."""
    rows = _numbered(spark, d)
    return rows.withColumn("close", I.near(rows, "user_id", "sid", F.col("event_type") == "error", 4)).filter("event_type = 'purchase' and close").select("user_id", "event_id")


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY md5('s42' || turn), turn) AS t, md5('s42' || conv_id) AS draw FROM conversations)
SELECT conv_id, turn, t AS round FROM r ORDER BY t, draw, conv_id LIMIT 200""")
def round_robin_sample(spark, d):
    got = I.round_robin(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", "s42")
    return got.orderBy("place", "draw", "conv_id").limit(200).select("conv_id", "turn", F.col("place").cast("long").alias("round"))


_ALIASES = """r AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderpriority AS phrase, CAST(o_orderdate AS DATE) AS day FROM orders),
c AS (SELECT c_custkey AS owner, '1-URGENT' AS phrase, 'C' || c_nationkey AS target FROM customer WHERE c_mktsegment = 'BUILDING'),
w AS (SELECT p AS phrase, make_date(1995 + n_regionkey, 1, 1) AS a, make_date(1996 + n_regionkey, 12, 31) AS b, 'T' || n_nationkey AS target FROM nation, (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) AS p) WHERE n_nationkey % 3 = CAST(left(p, 1) AS INT) - 1)"""


@query(f"""WITH {_ALIASES} SELECT id, coalesce(c.target, (SELECT min_by(w.target, struct_pack(x := -epoch(w.a), y := w.target)) FROM w WHERE w.phrase = r.phrase AND r.day BETWEEN w.a AND w.b), CASE WHEN r.phrase <> '5-LOW' THEN 'D' || r.phrase END) AS target FROM r LEFT JOIN c USING (owner, phrase)""")
def alias_priority_resolution(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("phrase"), F.to_date("o_orderdate").alias("day"))
    context = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("owner"), F.lit("1-URGENT").alias("phrase"), F.concat(F.lit("C"), "c_nationkey").alias("target"))
    nations = table(spark, d, "nation").select("*", F.explode(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM")))).alias("phrase")).filter(F.col("n_nationkey") % 3 == F.substring("phrase", 1, 1).cast("int") - 1)
    windows = nations.select("phrase", F.make_date(1995 + F.col("n_regionkey"), F.lit(1), F.lit(1)).alias("start"), F.make_date(1996 + F.col("n_regionkey"), F.lit(12), F.lit(31)).alias("end"), F.concat(F.lit("T"), "n_nationkey").alias("target"))
    default = rows.select("phrase").distinct().filter("phrase <> '5-LOW'").select("phrase", F.concat(F.lit("D"), "phrase").alias("target"))
    return I.resolved(rows, context, windows, default, phrase="phrase", owner="owner", at="day").select("id", "target")


@query("""WITH q AS (SELECT unnest(generate_series(date_trunc('quarter', (SELECT min(o_orderdate) FROM orders)), (SELECT max(o_orderdate) FROM orders), INTERVAL 3 MONTH)) AS q),
n AS (SELECT date_trunc('quarter', o_orderdate) AS q, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND month(o_orderdate) % 6 <> 1 GROUP BY 1)
SELECT CAST(q.q AS DATE) AS start, CAST(q.q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS last_day, coalesce(n.n, 0) AS n FROM q LEFT JOIN n USING (q)""")
def quarter_windows(spark, d):
    """All quarters of the period, those without a hit too."""
    orders = table(spark, d, "orders")
    ends = orders.agg(F.trunc(F.min("o_orderdate"), "quarter").alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    quarters = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 3 months"))).alias("start"))
    hits = orders.filter((F.col("o_orderpriority") == "1-URGENT") & (F.month("o_orderdate") % 6 != 1)).groupBy(F.trunc("o_orderdate", "quarter").alias("start")).agg(F.count("*").alias("n"))
    return quarters.join(hits, "start", "left").select("start", F.date_sub(F.add_months("start", 3), 1).alias("last_day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 10 THEN 1 ELSE CAST(ceil((n - 10) / 8.0) AS BIGINT) + 1 END)) AS k FROM n)
SELECT doc_id, k AS part, k * 8 AS first, least(k * 8 + 10, n) AS past FROM k""")
def overlapping_windows(spark, d):
    """Windows of ten lines, each two lines into the one before."""
    n = F.size(F.split("text", "\n", -1))
    got = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(I.windows_of(n, 10, 2)).alias("w"))
    return got.select("doc_id", F.col("w.k").cast("long").alias("part"), F.col("w.first").cast("long").alias("first"), F.col("w.end").cast("long").alias("past"))


@query("""WITH a AS (SELECT user_id, epoch(ts) - 900 AS a, epoch(ts) + 900 AS b FROM events WHERE event_type = 'error'),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM a),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY a, b, f DESC ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT user_id, CAST(round(min(a)) AS BIGINT) AS first, CAST(round(max(b)) AS BIGINT) AS last, count(*) AS n_anchors FROM g GROUP BY user_id, i""")
def anchor_windows(spark, d):
    """Stretches of fifteen minutes around errors, overlapping ones as one."""
    at = F.col("ts").cast("timestamp").cast("double")
    rows = table(spark, d, "events").filter("event_type = 'error'").select("user_id", (at - 900).alias("a"), (at + 900).alias("b"))
    return I.merged(rows, "user_id", "a", "b").select("user_id", F.round("a").cast("long").alias("first"), F.round("b").cast("long").alias("last"), F.col("n").alias("n_anchors"))


@query("""WITH v AS (SELECT l_shipdate AS vote, l_orderkey AS id, row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem)
SELECT CAST(vote AS DATE) AS vote, id, r AS rank FROM v WHERE r <= 5 ORDER BY vote, r LIMIT 400""")
def sample_cap(spark, d):
    """At most five rows a vote and four hundred in all."""
    rows = table(spark, d, "lineitem").withColumn("vote", F.to_date("l_shipdate"))
    top = I.top_n(rows, "vote", 5, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return top.orderBy("vote", "rank").limit(400).select("vote", F.col("l_orderkey").alias("id"), F.col("rank").cast("long").alias("rank"))


@query("""WITH n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 13 <> 0 UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_custkey % 17 = 0)
SELECT CASE WHEN o.c_custkey IS NULL THEN 'ADDED' WHEN n.id IS NULL THEN 'REMOVED' WHEN n.v <> o.c_acctbal THEN 'CHANGED' ELSE 'SAME' END AS state, count(*) AS n FROM customer o FULL JOIN n ON n.id = o.c_custkey GROUP BY 1""")
def snapshot_diff(spark, d):
    """A new snapshot against the one before."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    v = F.when(F.col("id") % 11 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    new = old.filter("id % 13 <> 0").select("id", v.alias("v")).union(old.filter("id % 17 = 0").select(F.col("id") + 1000000, "c_acctbal"))
    state = F.when(F.col("c_acctbal").isNull(), "ADDED").when(F.col("v").isNull(), "REMOVED").when(F.col("v") != F.col("c_acctbal"), "CHANGED").otherwise("SAME")
    return old.join(new, "id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderdate AS t, list_sort(list(DISTINCT l_suppkey)) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
p AS (SELECT *, lag(s) OVER (PARTITION BY c ORDER BY t, k) AS b FROM s)
SELECT k AS id, round(len(list_intersect(s, b)) / len(list_distinct(list_concat(s, b))), 6) AS jaccard FROM p WHERE b IS NOT NULL""")
def set_jaccard(spark, d):
    """Suppliers of each order against those of the customer's order before."""
    sets = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("s"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate").join(sets, "id")
    before = F.lag("s").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "id"))
    both = rows.withColumn("b", before).filter("b is not null")
    return both.select("id", F.round(F.size(F.array_intersect("s", "b")) / F.size(F.array_union("s", "b")), 6).alias("jaccard"))


@query("""SELECT conv_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(roles), lambda r: struct_pack(i := list_position(roles, r), r := r))), lambda x: x.r), '>') AS roles FROM (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations WHERE role IS NOT NULL GROUP BY 1)""")
def first_order_dedupe(spark, d):
    """Each conversation's roles in the order in which they first speak: the least turn of each role, no gathered rows."""
    first = table(spark, d, "conversations").filter("role is not null").groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"))


@query("""WITH v AS (SELECT l_suppkey AS g, CAST(l_shipdate AS DATE) AS day, CASE WHEN count(*) FILTER (l_returnflag = 'N') > count(*) FILTER (l_returnflag = 'R') THEN 'A' WHEN count(*) FILTER (l_returnflag = 'N') < count(*) FILTER (l_returnflag = 'R') THEN 'B' END AS winner FROM lineitem GROUP BY 1, 2)
SELECT g, day, winner, CASE WHEN lag(day) OVER w IS NULL THEN 'FIRST' WHEN lag(winner) OVER w IS NULL OR winner IS NULL THEN 'BROKEN' WHEN lag(winner) OVER w = winner THEN 'CONTINUED' ELSE 'TURNED' END AS state FROM v WINDOW w AS (PARTITION BY g ORDER BY day)""")
def bracket_continuity(spark, d):
    """Whether the winner of one vote goes on into the next of its chain."""
    n = lambda v: n_if(F.col("l_returnflag") == v)
    votes = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("g"), F.to_date("l_shipdate").alias("day")).agg(F.when(n("N") > n("R"), "A").when(n("N") < n("R"), "B").alias("winner"))
    w = Window.partitionBy("g").orderBy("day")
    before, first = F.lag("winner").over(w), F.lag("day").over(w).isNull()
    state = F.when(first, "FIRST").when(before.isNull() | F.col("winner").isNull(), "BROKEN").when(before == F.col("winner"), "CONTINUED").otherwise("TURNED")
    return votes.select("g", "day", "winner", state.alias("state"))


@query("""SELECT window_start AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 30 MINUTE]) AS window_start, ts FROM events) WHERE ts >= window_start AND ts < window_start + INTERVAL 1 HOUR GROUP BY 1, 2""")
def sliding_window(spark, d):
    got = table(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n")
