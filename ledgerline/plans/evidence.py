"""Identity, evidence, detectors, incremental and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import html as H
from ledgerline.functions import text as T
from ledgerline.operators import detectors as D
from ledgerline.operators import identity as P
from ledgerline.operators import incremental as N
from ledgerline.plans.registry import cents, n_if, query, table
from ledgerline.scratch import saved, shared_dir, spread
from ledgerline.sources import readers as R
from ledgerline.streaming import windows as S


def _people(spark, d):
    """Candidacies: a name, some in other spellings, an election year and an age."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    first = F.concat(F.lit("É"), F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, ' "').otherwise(""))
    last = F.concat(F.lit("Test–"), (F.col("c_nationkey") * 40 + F.col("c_custkey") % 40).cast("string"), F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(""))
    people = c.select("c_custkey", first.alias("first"), last.alias("last"), (30 + F.col("c_custkey") % 3 * 15).alias("base"))
    rows = o.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.min("o_orderkey").alias("id"))
    return rows.join(people, F.col("o_custkey") == F.col("c_custkey")).select("id", "first", "last", "year", F.when(F.col("id") % 17 != 0, F.col("base") + F.col("year") - 1996).alias("age"))


@query("""SELECT c_custkey AS id, regexp_replace(trim(regexp_replace(replace(lower('Test–' || c_nationkey || '!'), '–', '-'), '[^a-zé0-9 -]', ' ', 'g')), ' +', ' ', 'g') || '|' || regexp_replace(trim(regexp_replace(lower('É  ' || c_mktsegment || ' "x"'), '[^a-zé0-9 -]', ' ', 'g')), ' +', ' ', 'g') AS name_key,
list_has_any(string_split('test ' || c_nationkey, ' '), ['test']) AND lower(c_mktsegment) = 'building' AS compatible FROM customer""")
def name_key(spark, d):
    """Folded name keys, and whether a name is compatible with Building Test."""
    c = table(spark, d, "customer")
    first, last = F.concat(F.lit("É  "), "c_mktsegment", F.lit(' "x"')), F.concat(F.lit("Test–"), F.col("c_nationkey").cast("string"), F.lit("!"))
    rows = c.select(F.col("c_custkey").alias("id"), first.alias("first"), last.alias("last"))
    same = P.names_compatible((F.col("first"), F.lit("Buildíng")), (F.col("last"), F.lit("TEST")))
    return rows.select("id", P.name_key(F.col("first"), F.col("last")).alias("name_key"), same.alias("compatible"))


@query(None)
def identity_clusters(spark, d):
    """Candidacies that may be one person, and the register's member they are."""
    rows = saved(_people(spark, d).withColumn("key", P.name_key(F.col("first"), F.col("last"))), "people")
    n = rows.count()
    found = P.clustered(rows, id_col="id", key="key", year="year", age="age")
    members = rows.filter("year = 1998 and age is not null").groupBy("key", (F.col("year") - F.col("age")).alias("birth_year")).agg(F.min("id").alias("person_id"))
    members = members.select("person_id", "key", F.when(F.col("person_id") % 19 != 0, F.col("birth_year")).alias("birth_year"))
    told = spread(found, n, "id", each=P.EACH).join(spread(rows.select("id", "key", "year", "age"), n, "id", each=P.EACH), "id")
    actors = P.matched_members(spread(told, n, "cluster", each=P.EACH), members)
    return spread(found, n, "cluster", each=P.EACH).join(spread(actors, n, "cluster", each=P.EACH), "cluster").select("id", "cluster", "person_id", "status")


@query("""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN 1999 - c_custkey % 60 - 1 END AS al, CASE WHEN c_custkey % 5 <> 0 THEN 1999 - c_custkey % 60 END AS ah, 1950 + c_custkey % 30 AS b FROM customer)
SELECT id, al AS low, ah AS high, coalesce(al <= b AND b <= ah, false) AS fits FROM r""")
def birth_windows(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), P.birth_window(F.lit(1999).cast("long"), F.when(k % 5 != 0, k % 60)).alias("w"), (1950 + k % 30).alias("b"))
    return rows.select("id", "w.low", "w.high", P.windows_overlap(F.col("w"), F.struct(F.col("b").alias("low"), F.col("b").alias("high"))).alias("fits"))


_REVIEWS = """p AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_partkey) AS part, min(l_returnflag) AS review, min(l_quantity) AS q FROM lineitem GROUP BY 1),
v AS (SELECT id, part, q, review, sha256(p_name) AS now, sha256(CASE WHEN q % 5 = 0 THEN p_name || '?' ELSE p_name END) AS bound FROM p JOIN part ON p_partkey = part)"""


@query(f"WITH {_REVIEWS} SELECT CASE WHEN review = 'A' THEN 'UNREVIEWED' WHEN now <> bound THEN 'STALE_HASH' WHEN review = 'R' THEN 'REJECTED' ELSE 'ADMITTED' END AS state, count(*) AS n FROM v GROUP BY 1")
def relation_admission(spark, d):
    """Proposals whose review is bound to the text it saw."""
    proposals = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min("l_partkey").alias("p_partkey"), F.min("l_returnflag").alias("review"), F.min("l_quantity").alias("q"))
    rows = proposals.join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    bound = F.sha2(F.when(F.col("q") % 5 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")), 256) == F.sha2("p_name", 256)
    state = F.when(F.col("review") == "A", "UNREVIEWED").when(~bound, "STALE_HASH").when(F.col("review") == "R", "REJECTED").otherwise("ADMITTED")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_suppkey AS actor, l_orderkey AS matter, 'BALLOT' AS kind, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_returnflag <> 'A' UNION ALL SELECT o_custkey % 100, o_orderkey, 'AUTHOR', CAST(o_orderdate AS DATE) FROM orders)
SELECT actor, kind, count(*) AS n, count(DISTINCT matter) AS n_matters, min(day) AS first_day, max(day) AS last_day FROM a GROUP BY 1, 2""")
def matter_ledger(spark, d):
    """Who took part in which matters, by kind of action."""
    ballots = table(spark, d, "lineitem").filter("l_returnflag <> 'A'").select(F.col("l_suppkey").alias("actor"), F.col("l_orderkey").alias("matter"), F.lit("BALLOT").alias("kind"), F.to_date("l_shipdate").alias("day"))
    authors = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("actor"), F.col("o_orderkey").alias("matter"), F.lit("AUTHOR").alias("kind"), F.to_date("o_orderdate").alias("day"))
    return ballots.union(authors).groupBy("actor", "kind").agg(F.count("*").alias("n"), F.count_distinct("matter").alias("n_matters"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("""SELECT o_orderkey AS id, 'NO_LINES' AS code FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT o_orderkey, 'NO_RETURNS' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT DISTINCT l_orderkey, 'NO_MATTER' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")
def missingness_codes(spark, d):
    """What is missing of each matter, as coded rows, from one aggregate of the lines."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(n_if(F.col("l_returnflag") == "R").alias("r"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    both = orders.join(lines, "id", "full_outer")
    here = F.col("o_orderstatus").isNotNull()
    codes = [F.when(here & F.col("r").isNull(), "NO_LINES"), F.when(here & (F.col("r") == 0), "NO_RETURNS"), F.when(F.col("r").isNotNull() & (F.coalesce("o_orderstatus", F.lit("F")) == "F"), "NO_MATTER")]
    return both.select("id", F.explode(F.array_compact(F.array(*codes))).alias("code"))


@query("""WITH t AS (SELECT l_partkey AS matter, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS title, count(*) AS n FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) SELECT matter, title, CASE WHEN title IS NULL THEN 'DISAGREE' ELSE 'AGREED' END AS state FROM t""")
def subject_title(spark, d):
    """A title only where all objects of a matter agree."""
    rows = table(spark, d, "lineitem").filter("l_discount > 0.08").groupBy(F.col("l_partkey").alias("matter")).agg(F.min("l_linestatus").alias("a"), F.max("l_linestatus").alias("b"))
    return rows.select("matter", F.when(F.col("a") == F.col("b"), F.col("a")).alias("title"), F.when(F.col("a") == F.col("b"), "AGREED").otherwise("DISAGREE").alias("state"))


@query("SELECT source, arg_max(doc_id, struct_pack(q := CASE WHEN lang IS NULL THEN 0 ELSE 1 END, n := n_chars, i := -doc_id)) AS doc_id, count(*) AS n_rows, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def longest_substantive(spark, d):
    """Of the rows of one source the substantive one of most text, the smallest id among equals, and all owners."""
    order = F.struct(F.when(F.col("lang").isNull(), 0).otherwise(1), "n_chars", -F.col("doc_id"))
    rows = table(spark, d, "documents").filter("n_chars is not null and source is not null")
    return rows.groupBy("source").agg(F.max_by("doc_id", order).alias("doc_id"), F.count("*").alias("n_rows"), F.nullif(F.array_join(F.array_sort(F.collect_set("lang")), ","), F.lit("")).alias("langs"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders), a AS (SELECT l_orderkey AS id, min(CAST(l_shipdate AS DATE)) AS acted, count(*) FILTER (l_returnflag = 'R') AS against FROM lineitem GROUP BY 1)
SELECT id, CASE WHEN o_orderstatus = 'P' THEN 'NO_PROPOSITION' WHEN a.id IS NULL THEN 'NO_ACTION' WHEN acted < day THEN 'ACTED_BEFORE' WHEN acted > day + 90 THEN 'ACTED_LATE' WHEN against > 0 THEN 'ACTED_AGAINST' ELSE 'ACTED_FOR' END AS state FROM s LEFT JOIN a USING (id)""")
def trace_states(spark, d):
    """From statement to action: where each trace ends."""
    acted = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.to_date("l_shipdate")).alias("acted"), n_if(F.col("l_returnflag") == "R").alias("against"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.to_date("o_orderdate").alias("day")).join(acted, "id", "left")
    state = (
        F.when(F.col("o_orderstatus") == "P", "NO_PROPOSITION").when(F.col("acted").isNull(), "NO_ACTION").when(F.col("acted") < F.col("day"), "ACTED_BEFORE")
        .when(F.col("acted") > F.date_add("day", 90), "ACTED_LATE").when(F.col("against") > 0, "ACTED_AGAINST").otherwise("ACTED_FOR")
    )
    return rows.select("id", state.alias("state"))


_FLAGS = r"""f AS (SELECT doc_id AS id, text, n_chars, lower(text) AS low FROM documents WHERE text IS NOT NULL)
SELECT id, 'MARKED' AS detector, CASE WHEN len(regexp_extract_all(text, '[#*$%&|<>]')) >= 50 THEN 'HIGH' WHEN len(regexp_extract_all(text, '[#*$%&|<>]')) >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity, regexp_extract(text, '[#*$%&|<>]+') AS evidence FROM f WHERE regexp_matches(text, '[#*$%&|<>]')
UNION ALL SELECT id, 'NO_COMMON_WORDS', 'HIGH', left(text, 40) FROM f WHERE length(text) > 200 AND NOT regexp_matches(low, '(?:^|[^a-z])(?:the|und|les|de|la|der)(?:[^a-z]|$)')
UNION ALL SELECT id, 'OLD_DATA', CASE WHEN 2024 - CAST(regexp_extract(text, '(?:19|20)[0-9][0-9]') AS INT) >= 10 THEN 'HIGH' WHEN 2024 - CAST(regexp_extract(text, '(?:19|20)[0-9][0-9]') AS INT) >= 5 THEN 'MEDIUM' ELSE 'LOW' END, regexp_extract(text, '(?:19|20)[0-9][0-9]') FROM f WHERE regexp_matches(text, '(?:19|20)[0-9][0-9]')
UNION ALL SELECT id, 'CONTACT', 'MEDIUM', regexp_extract(text, '[a-z.]+@[a-z.]+') FROM f WHERE regexp_matches(text, '[a-z.]+@[a-z.]+')
UNION ALL SELECT id, 'LICENSED', 'LOW', regexp_extract(text, '(?i)[a-z0-9 ]{0,20}license') FROM f WHERE regexp_matches(text, '(?i)license')"""


@query(f"WITH {_FLAGS}")
def detector_flags(spark, d):
    """All detectors' flags on all documents."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text")
    text = F.col("text")
    year = 2024 - F.regexp_extract(text, "(?:19|20)[0-9][0-9]", 0).try_cast("int")
    return D.all_flags(
        [
            D.flagged(docs, "id", "MARKED", text.rlike("[#*$%&|<>]"), D.severity(T.n_matches(text, "[#*$%&|<>]"), 10, 50), F.regexp_extract(text, "[#*$%&|<>]+", 0)),
            D.flagged(docs, "id", "NO_COMMON_WORDS", (F.length(text) > 200) & ~F.lower(text).rlike("(?:^|[^a-z])(?:the|und|les|de|la|der)(?:[^a-z]|$)"), "HIGH", F.substring(text, 1, 40)),
            D.flagged(docs, "id", "OLD_DATA", text.rlike("(?:19|20)[0-9][0-9]"), D.severity(year, 5, 10), F.regexp_extract(text, "(?:19|20)[0-9][0-9]", 0)),
            D.flagged(docs, "id", "CONTACT", text.rlike("[a-z.]+@[a-z.]+"), "MEDIUM", F.regexp_extract(text, "[a-z.]+@[a-z.]+", 0)),
            D.flagged(docs, "id", "LICENSED", text.rlike("(?i)license"), "LOW", F.regexp_extract(text, "(?i)[a-z0-9 ]{0,20}license", 0)),
        ]
    )


@query("""WITH c AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'R' AND l_tax > 0.04) AS rp, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'N' AND l_tax > 0.04) AS np FROM lineitem GROUP BY 1)
SELECT id, round(rp / nullif(r, 0) - np / nullif(n, 0), 6) AS gap FROM c WHERE r > 0 AND n > 0 AND rp / r - np / n >= 0.3""")
def precision_asymmetry(spark, d):
    """Orders whose returned lines are marked more often than their kept ones."""
    n = lambda v, more=False: n_if((F.col("l_returnflag") == v) & ((F.col("l_tax") > 0.04) if more else F.lit(True)))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(n("R").alias("r"), n("R", True).alias("rp"), n("N").alias("n"), n("N", True).alias("np"))
    gap = D.share_gap((F.col("rp"), F.col("r")), (F.col("np"), F.col("n")))
    return rows.filter(gap >= 0.3).select("id", F.round(gap, 6).alias("gap"))


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def stale_keys(spark, d):
    """Keys without a stamp of the current version."""
    stamps = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("version"))
    return N.stale(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), stamps, ["id"], "1-URGENT")


@query("""WITH h AS (SELECT c_custkey AS id, sha256(c_name) AS h, 'now' AS captured FROM customer), o AS (SELECT c_custkey AS id, sha256(CASE WHEN c_custkey % 3 = 0 THEN c_name || '.' ELSE c_name END) AS h, 'day ' || c_nationkey AS captured FROM customer WHERE c_custkey % 7 <> 0)
SELECT h.id, coalesce(o.captured, h.captured) AS captured FROM h LEFT JOIN o ON o.id = h.id AND o.h = h.h""")
def restored_if_same_hash(spark, d):
    c = table(spark, d, "customer")
    new = c.select(F.col("c_custkey").alias("id"), F.sha2("c_name", 256).alias("h"), F.lit("now").alias("captured"))
    before = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("."))).otherwise(F.col("c_name"))
    old = c.filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"), F.sha2(before, 256).alias("h"), F.concat(F.lit("day "), "c_nationkey").alias("captured"))
    return N.restored(new, old, "id", "h", "captured").select("id", "captured")


@query("""WITH e AS (SELECT l_orderkey AS g, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1), h AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS m FROM lineitem WHERE l_linenumber % 3 <> 0), m AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS m FROM lineitem WHERE l_linenumber % 3 = 0 AND l_orderkey % 4 <> 0),
u AS (FROM h UNION FROM m), k AS (SELECT g FROM e WHERE coalesce((SELECT count(*) FROM h WHERE h.g = e.g), 0) < n AND (SELECT count(*) FROM u WHERE u.g = e.g) = n)
SELECT g, m FROM h UNION SELECT g, m FROM m WHERE g IN (FROM k)""")
def repair_short_sets(spark, d):
    """Short sets are filled up only where that makes them complete."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_suppkey").alias("m"), "l_linenumber")
    expected = spread(lines.select("g", "m"), lines.count(), "g").groupBy("g").agg(F.count_distinct("m").alias("n"))
    have, more = lines.filter("l_linenumber % 3 <> 0"), lines.filter("l_linenumber % 3 = 0 and g % 4 <> 0")
    return N.repaired(have, more, "g", "m", expected).distinct()


@query("SELECT 'orders' AS name, count(*) AS n, count(*) > 0 AS ok FROM orders UNION ALL SELECT 'none', 0, false UNION ALL SELECT 'documents', count(*), true FROM documents")
def table_contract(spark, d):
    return N.contract({"orders": table(spark, d, "orders"), "none": table(spark, d, "orders").filter("false"), "documents": table(spark, d, "documents")})


@query("""SELECT CASE WHEN regexp_matches(html, '(?i)^\\s*(<!doctype html|<html)') THEN 'HTML' WHEN regexp_matches(html, '^\\s*<\\?xml') THEN 'XML' WHEN regexp_matches(html, '^\\s*[\\[{]') THEN 'JSON' WHEN page_id % 3 = 0 THEN 'PDF' ELSE 'OTHER' END AS kind, count(*) AS n
FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '<?xml ?>' WHEN page_id % 5 = 0 THEN ' {}' WHEN page_id % 7 = 0 THEN 'x' ELSE html END AS html FROM pages) GROUP BY 1""")
def media_kinds(spark, d):
    k = F.col("page_id")
    head = F.when(k % 4 == 0, "<?xml ?>").when(k % 5 == 0, " {}").when(k % 7 == 0, "x").otherwise(F.col("html"))
    kind = N.media_kind(F.when(k % 3 == 0, "application/pdf").otherwise(""), F.lit("http://x"), F.substring(head, 1, 200))
    return table(spark, d, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


#: Parts in which the events arrive.
ARRIVALS = 4


def _arrivals(spark, d):
    """The events by the part of time in which they arrive; every 97th comes a part later."""
    rows = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    low, high = rows.agg(F.min("us"), F.max("us")).first()
    part = F.floor((F.col("us") - (low or 0)) * ARRIVALS / ((high or 0) - (low or 0) + 1)) + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)
    return rows.withColumn("part", F.least(part, F.lit(ARRIVALS - 1)))


def _run_parts(arrivals, sink, feed):
    for k in range(ARRIVALS):
        feed.arrive(arrivals.filter(F.col("part") == k))
        sink.run()
    return sink.rows()


_ARRIVALS = f"""a AS (SELECT *, least(((epoch_us(ts) - min(epoch_us(ts)) OVER ()) * {ARRIVALS}) // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1) + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END, {ARRIVALS - 1}) AS part FROM events)"""


@query(f"""WITH {_ARRIVALS}, m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 HOUR AS mark FROM a GROUP BY part),
k AS (SELECT date_trunc('hour', ts) AS start, event_type, value FROM a JOIN m USING (part) WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark)
SELECT start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM k WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM a) GROUP BY 1, 2""")
def stream_windows(spark, d):
    """Hourly windows in append mode: rows that come after their window has gone out are dropped, windows that aren't over stay in."""
    arrivals = _arrivals(spark, d)
    feed = S.Feed(arrivals, "events")
    got = _run_parts(arrivals, S.Sink(S.counted(feed.stream, at="ts", width="1 hour", late="2 hours", keys=["event_type"]), "event-windows"), feed)
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query(f"""WITH {_ARRIVALS}, t AS (SELECT part, event_type, max(max(ts)) OVER (PARTITION BY event_type ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a WHERE event_type IN ('purchase', 'signup') GROUP BY 1, 2),
m AS (SELECT part, CASE WHEN count(top) = 2 THEN min(top) - INTERVAL 2 HOUR END AS mark FROM t GROUP BY 1), k AS (SELECT a.* FROM a JOIN m USING (part) WHERE mark IS NULL OR ts > mark)
SELECT p.event_id AS purchase, s.event_id AS signup, p.user_id FROM k p JOIN k s ON p.user_id = s.user_id AND p.event_type = 'purchase' AND s.event_type = 'signup' AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 6 HOUR""")
def stream_interval_join(spark, d):
    """Purchases up to six hours after a signup of the same user, two streams joined with bounded state."""
    arrivals = _arrivals(spark, d)
    feed = S.Feed(arrivals, "events")
    left = feed.stream.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), "ts")
    right = feed.stream.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup"), F.col("ts").alias("signed_up"))
    return _run_parts(arrivals, S.Sink(S.joined(left, right, keys=["user_id"], at=("ts", "signed_up"), within="6 HOURS", late="2 hours"), "event-pairs"), feed).select("purchase", "signup", "user_id")


@query(f"""WITH {_ARRIVALS}, m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 HOUR AS mark FROM a GROUP BY part),
k AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM a JOIN m USING (part) WHERE mark IS NULL OR ts > mark), g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w < 3600000 THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM g), x AS (SELECT user_id, min(ms) AS a, max(ms) AS b, count(*) AS n FROM s GROUP BY user_id, s)
SELECT user_id, a AS start_ms, b AS end_ms, n FROM x WHERE b + 3600000 <= (SELECT epoch_us(max(ts)) // 1000 - 7200000 FROM a)""")
def stream_sessions(spark, d):
    """Each user's sessions by state and timers; a session goes out when no row can join it any more."""
    arrivals = _arrivals(spark, d)
    feed = S.Feed(arrivals, "events")
    buckets = max(arrivals.count() >> 14, spark.sparkContext.defaultParallelism)  # about 16,000 events each
    got = _run_parts(arrivals, S.Sink(S.closed_sessions(feed.stream.select("user_id", "ts"), key="user_id", at="ts", gap_ms=3_600_000, late="2 hours", buckets=buckets), "sessions"), feed)
    return got.select("user_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "n")


@query("SELECT user_id, max_by(event_type, struct_pack(t := ts, e := event_id)) AS event_type, max_by(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY 1")
def stream_upsert(spark, d):
    """Each user's last event, kept up to date batch by batch."""
    stream = S.followed(spark, f"{d}/events.parque[t]", table(spark, d, "events")).select("user_id", "event_type", "event_id", "ts")
    return S.Latest(stream, ["user_id"], ["ts", "event_id"], "last-events").run().select("user_id", "event_type", "event_id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, 'a \"b\", ' || chr(10) || c_mktsegment AS note FROM customer")
def csv_round_trip(spark, d):
    """A table written as CSV and read back, every column a string, with quotes and line breaks inside."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.concat(F.lit('a "b", \n'), "c_mktsegment").alias("note"))
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    R.csv_written(rows, path, ["c_custkey", "c_name", "c_nationkey", "note"])
    return R.csv_strings(spark, path)


@query("SELECT event_id % 5 = 0 AS bad, count(*) AS n, CAST(coalesce(sum(CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END), 0) AS BIGINT) AS total FROM events GROUP BY 1")
def jsonl_errors(spark, d):
    """JSON lines with bad ones among them: records and errors are both kept."""
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{bad "), F.col("event_id").cast("string"))).otherwise(F.col("props"))
    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    good, bad = R.jsonl(spark, path, "k bigint")
    return good.agg(F.lit(False).alias("bad"), F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("total")).union(bad.agg(F.lit(True), F.count("*"), F.lit(0).cast("long")))


@query("SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents FROM orders GROUP BY 1")
def columnar_payload(spark, d):
    """Payloads of names and rows as typed records."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.array(F.col("o_orderkey").cast("string"), cents("o_totalprice").cast("string"))).alias("data"))
    records = rows.select("o_custkey", F.explode(R.columnar(F.col("data"), F.array(F.lit("key"), F.lit("cents")), ["cents", "missing"])).alias("x"))
    return records.filter("x.missing is null").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("x.cents").cast("long")).alias("total_cents"))


@query(None)
def sanitised_pages(spark, d):
    """Pages with allowed tags only, all closed, and their first words marked."""
    clean = table(spark, d, "pages").select("page_id", H.sanitised("html").alias("html"))
    words = F.slice(F.filter(F.split(T.clean_html(F.col("html")), " "), lambda w: F.length(w) > 3), 1, 3)
    return clean.select("page_id", F.sha2("html", 256).alias("html_sha256"), H.marked("html", words).alias("marked"))
