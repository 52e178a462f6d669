"""Text, pages and parsers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.plans.registry import query, table

_STRIP = "regexp_replace(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), '^ | $', '', 'g')"
_CLEAN = r"regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '[\s\pZ\x{{85}}]+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"SELECT page_id, sha256(x) AS text_sha256, length(x) AS n_chars FROM (SELECT page_id, {_CLEAN.format('html')} AS x FROM pages)")
def clean_html(spark, d):
    got = table(spark, d, "pages").select("page_id", T.clean_html(F.col("html")).alias("x"))
    return got.select("page_id", F.sha2("x", 256).alias("text_sha256"), F.length("x").cast("long").alias("n_chars"))


@query(f"""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is)<p(?: [^>]*)?>(.*?)</p>', 1) AS ps FROM pages), k AS (SELECT page_id, unnest(range(1, len(ps) + 1)) AS k, ps FROM p)
SELECT page_id, k, sha256({_STRIP.format('ps[k]')}) AS text_sha256 FROM k""")
def p_chunks(spark, d):
    chunks = table(spark, d, "pages").select("page_id", F.posexplode(T.paragraphs(F.col("html"))).alias("k", "p"))
    return chunks.select("page_id", (F.col("k") + 1).cast("long").alias("k"), F.sha2(T.strip_html(F.col("p")), 256).alias("text_sha256"))


@query(r"""SELECT page_id, sha256(regexp_replace(html, 'href="/([^"]*)"', 'href="https://site.example/\1"', 'g')) AS html_sha256, len(regexp_extract_all(html, 'href="/([^"]*)"')) AS n_links FROM pages""")
def links_rewritten(spark, d):
    """Links within the site made whole ones."""
    html = F.col("html")
    out = F.regexp_replace(html, 'href="/([^"]*)"', 'href="https://site.example/$1"')
    return table(spark, d, "pages").select("page_id", F.sha2(out, 256).alias("html_sha256"), T.n_matches(html, 'href="/([^"]*)"').alias("n_links"))


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n[ \t\r\n]*\n'), lambda x: trim(x) <> '')) AS n_paragraphs FROM documents WHERE text IS NOT NULL""")
def paragraph_split(spark, d):
    parts = F.filter(F.split("text", r"\n[ \t\r\n]*\n", -1), lambda x: F.trim(x) != "")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(parts).cast("long").alias("n_paragraphs"))


_LINES = """l AS (SELECT doc_id, k, CASE WHEN k < len(ls) THEN ls[k] || chr(10) ELSE ls[k] END AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, row_number() OVER w - 1 AS pointer, sum(length(line)) OVER w - length(line) AS start, sum(length(line)) OVER w AS past, line FROM l WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY k))"""


def _lines(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", "text", F.posexplode(T.lines(F.col("text"))).alias("pointer", "x"))


@query(f"WITH {_LINES} SELECT doc_id, pointer, CAST(start AS BIGINT) AS start, CAST(past AS BIGINT) AS past, sha256(line) AS line_sha256 FROM s")
def line_pointers(spark, d):
    return _lines(spark, d).select("doc_id", F.col("pointer").cast("long").alias("pointer"), F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("past"), F.sha2("x.text", 256).alias("line_sha256"))


@query(f"WITH {_LINES} SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(whole, '') = d.text AS lossless FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(line, '' ORDER BY pointer) AS whole FROM s GROUP BY 1) USING (doc_id) WHERE d.text IS NOT NULL")
def pointer_lossless(spark, d):
    pieces = T.lines(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(pieces).cast("long").alias("n"), (F.array_join(F.transform(pieces, lambda x: x["text"]), "") == F.col("text")).alias("lossless"))


@query(f"""WITH {_LINES}, r AS (SELECT DISTINCT doc_id, doc_id % 4 AS a, doc_id % 4 + 2 - doc_id % 5 AS b FROM documents WHERE text IS NOT NULL),
q AS (SELECT r.doc_id, a, b, count(s.pointer) AS n, min(start) AS start, max(past) AS past, string_agg(line, '' ORDER BY pointer) AS quote FROM r LEFT JOIN s ON s.doc_id = r.doc_id AND s.pointer BETWEEN a AND b GROUP BY 1, 2, 3)
SELECT doc_id, CASE WHEN a > b THEN 'REVERSED' WHEN n < b - a + 1 THEN 'OUTSIDE' ELSE 'BOUND' END AS state, CASE WHEN a <= b AND n = b - a + 1 THEN CAST(start AS BIGINT) END AS start, CASE WHEN a <= b AND n = b - a + 1 THEN CAST(past AS BIGINT) END AS past, CASE WHEN a <= b AND n = b - a + 1 THEN sha256(quote) END AS quote_sha256 FROM q""")
def pointer_ranges(spark, d):
    """Inclusive ranges of line pointers as exact quotes; reversed and outside ranges are told apart."""
    a, b = (F.col("doc_id") % 4).cast("int"), (F.col("doc_id") % 4 + 2 - F.col("doc_id") % 5).cast("int")
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", "text", a.alias("a"), b.alias("b"), T.lines(F.col("text")).alias("ls"))
    state = F.when(F.col("a") > F.col("b"), "REVERSED").when(F.col("b") >= F.size("ls"), "OUTSIDE").otherwise("BOUND")
    own = rows.withColumn("state", state)
    start = F.when(F.col("state") == "BOUND", F.get("ls", F.col("a"))["start"].cast("long"))
    past = F.when(F.col("state") == "BOUND", F.get("ls", F.col("b"))["end"].cast("long"))
    quote = F.sha2(F.substr("text", start.cast("int") + 1, (past - start).cast("int")), 256)
    return own.select("doc_id", "state", start.alias("start"), past.alias("past"), F.when(F.col("state") == "BOUND", quote).alias("quote_sha256"))


@query("""SELECT doc_id, k * 2000 AS start, least(k * 2000 + 2000, length(text)) AS past, sha256(substr(text, k * 2000 + 1, 2000)) AS part_sha256 FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 2000.0) AS BIGINT))) AS k FROM documents WHERE text IS NOT NULL)""")
def char_windows(spark, d):
    got = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(T.char_windows(F.col("text"), 2000)).alias("w"))
    return got.select("doc_id", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("past"), F.sha2("w.text", 256).alias("part_sha256"))


_QUOTED = "q AS (SELECT doc_id, text, substr(text, 11 + CAST(doc_id % 40 AS INT), CAST(doc_id % 9 AS INT)) AS quote FROM documents WHERE text IS NOT NULL)"


def _quoted(spark, d):
    quote = F.substr("text", (11 + F.col("doc_id") % 40).cast("int"), (F.col("doc_id") % 9).cast("int"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", "text", quote.alias("quote"))


@query(f"""WITH {_QUOTED}, f AS (SELECT *, length(quote) > 0 AS ok, strpos(text, quote) - 1 AS here, CASE WHEN length(quote) > 0 THEN (length(text) - length(replace(text, quote, ''))) // length(quote) ELSE 0 END AS n FROM q)
SELECT doc_id, CASE WHEN ok THEN here END AS start, CASE WHEN ok THEN here + length(quote) END AS past, n, n = 1 AS uniquely FROM f""")
def quote_anchor(spark, d):
    rows = _quoted(spark, d).withColumn("a", T.anchor(F.col("text"), F.col("quote")))
    return rows.select("doc_id", F.col("a.start").cast("long").alias("start"), F.col("a.end").cast("long").alias("past"), T.occurrences(F.col("text"), F.col("quote")).alias("n"), F.col("a.unique").alias("uniquely"))


@query(f"""WITH {_QUOTED} SELECT doc_id, sha256(substr(text, greatest(strpos(text, quote) - 30, 1), strpos(text, quote) + length(quote) + 30 - greatest(strpos(text, quote) - 30, 1))) AS context_sha256 FROM q WHERE length(quote) > 0""")
def quote_context(spark, d):
    """Thirty characters on either side of a quote's first place."""
    at = F.position("quote", "text")
    low = F.greatest(at - 30, F.lit(1))
    return _quoted(spark, d).filter("length(quote) > 0").select("doc_id", F.sha2(F.substr("text", low, at + F.length("quote") + 30 - low), 256).alias("context_sha256"))


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 9 = 0 THEN text || ' ' ELSE text END) = sha256(text) AS bound FROM documents WHERE text IS NOT NULL")
def sha256_binding(spark, d):
    """Whether a stored hash still binds its text."""
    docs = table(spark, d, "documents").filter("text is not null")
    stored = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("stored"))
    return stored.join(docs.select("doc_id", F.sha2("text", 256).alias("now")), "doc_id").select("doc_id", (F.col("stored") == F.col("now")).alias("bound"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP)
_WORDS = f"list_filter(regexp_extract_all(lower(text), '[a-zåäö]{{4,}}'), lambda w: w NOT IN ({_STOP}))"
TOKENS = f"list_distinct(list_concat({_WORDS}, list_transform(list_filter({_WORDS}, lambda w: length(w) > 8), lambda w: substr(w, 1, 6) || '*')))"


@query(f"SELECT doc_id, len(ts) AS n, sha256(array_to_string(list_sort(ts), ' ')) AS tokens_sha256 FROM (SELECT doc_id, {TOKENS} AS ts FROM documents WHERE text IS NOT NULL)")
def token_prefixes(spark, d):
    tokens = T.retrieval_tokens(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(tokens).cast("long").alias("n"), F.sha2(F.array_join(F.array_sort(tokens), " "), 256).alias("tokens_sha256"))


_TERMS = ("and", "the", "und", "die", "les", "des")


@query(f"SELECT doc_id, n, round(10000.0 * n / nullif(length(text), 0), 6) AS per_10k FROM (SELECT doc_id, text, CAST({' + '.join(f'(length(lower(text)) - length(replace(lower(text), {t!r}, {chr(39) * 2}))) // {len(t)}' for t in _TERMS)} AS BIGINT) AS n FROM documents WHERE text IS NOT NULL)")
def zero_vocab_rate(spark, d):
    """How often the words of a vocabulary stand in a text, and that for ten thousand characters."""
    low = F.lower("text")
    n = sum((T.occurrences(low, F.lit(t)) for t in _TERMS), F.lit(0).cast("long"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", n.alias("n"), F.round(F.try_divide(10000.0 * n, F.length("text")), 6).alias("per_10k"))


@query("""WITH y AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?:19|20)[0-9][0-9]'), lambda x: CAST(x AS INT)) AS ys FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(ys) AS n, CAST(2024 - list_max(ys) AS BIGINT) AS newest_gap, CASE WHEN len(ys) = 0 THEN 'UNDATED' WHEN 2024 - list_max(ys) >= 5 THEN 'FROZEN' WHEN 2024 - list_max(ys) >= 2 THEN 'STALE' ELSE 'CURRENT' END AS state FROM y""")
def year_gap(spark, d):
    """How far back the newest year of a text lies."""
    years = F.transform(F.regexp_extract_all("text", F.lit("(?:19|20)[0-9][0-9]"), F.lit(0)), lambda x: x.cast("int"))
    gap = 2024 - F.array_max(years)
    state = F.when(F.size(years) == 0, "UNDATED").when(gap >= 5, "FROZEN").when(gap >= 2, "STALE").otherwise("CURRENT")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(years).cast("long").alias("n"), gap.cast("long").alias("newest_gap"), state.alias("state"))


_CLAUSES = """c AS (SELECT o_orderkey AS id, 'Muutetaan ' || o_custkey % 37 || ' § ja ' || o_orderkey % 11 || 'a § laista ' || o_custkey % 999 || '/' || year(o_orderdate) || ' ja ' || o_custkey % 37 || ' §, ' || CAST(round(o_totalprice) AS BIGINT) % 900 + 1 || ' ' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0')
|| ',5 euroa, ' || o_orderkey % 9 || ' miljoonaa euroa, voimaan ' || day(o_orderdate) || '.' || month(o_orderdate) + CASE WHEN o_orderkey % 13 = 0 THEN 12 ELSE 0 END || '.' || year(o_orderdate) AS text FROM orders)"""


def _clauses(spark, d):
    day = F.col("o_orderdate")
    text = F.concat(
        F.lit("Muutetaan "), F.col("o_custkey") % 37, F.lit(" § ja "), F.col("o_orderkey") % 11, F.lit("a § laista "), F.col("o_custkey") % 999, F.lit("/"), F.year(day), F.lit(" ja "), F.col("o_custkey") % 37, F.lit(" §, "),
        F.round("o_totalprice").cast("long") % 900 + 1, F.lit(" "), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit(",5 euroa, "), F.col("o_orderkey") % 9, F.lit(" miljoonaa euroa, voimaan "),
        F.dayofmonth(day), F.lit("."), F.month(day) + F.when(F.col("o_orderkey") % 13 == 0, 12).otherwise(0), F.lit("."), F.year(day),
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))


@query(f"""WITH {_CLAUSES}, r AS (SELECT id, regexp_extract_all(text, '([0-9]+[a-z]?) §', 1) AS rs FROM c) SELECT id, array_to_string(list_transform(list_sort(list_distinct(list_transform(rs, lambda x: struct_pack(i := list_position(rs, x), x := x)))), lambda y: y.x), ',') AS refs FROM r""")
def section_refs(spark, d):
    return _clauses(spark, d).select("id", F.array_join(T.section_refs(F.col("text")), ",").alias("refs"))


@query(f"""WITH {_CLAUSES} SELECT id, array_to_string(list_transform(regexp_extract_all(text, '[0-9]+/[0-9]{{4}}'), lambda x: split_part(x, '/', 2) || '/' || split_part(x, '/', 1)), ',') AS refs FROM c""")
def law_refs(spark, d):
    return _clauses(spark, d).select("id", F.array_join(T.law_refs(F.col("text")), ",").alias("refs"))


@query(f"""WITH {_CLAUSES}, m AS (SELECT id, regexp_extract_all(text, '[0-9][0-9 ]*(?:,[0-9]+)? (?:miljoonaa |miljardia )?euroa') AS ms FROM c)
SELECT id, len(ms) AS n, round(list_sum(list_transform(ms, lambda x: CAST(replace(replace(trim(regexp_replace(x, '[a-z]+', '', 'g')), ' ', ''), ',', '.') AS DOUBLE) * CASE WHEN contains(x, 'miljoonaa') THEN 1e6 ELSE 1 END)), 2) AS total FROM m""")
def euro_amounts(spark, d):
    found = T.euros(F.col("text"))
    return _clauses(spark, d).select("id", F.size(found).cast("long").alias("n"), F.round(F.aggregate(found, F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query(f"""WITH {_CLAUSES}, p AS (SELECT id, regexp_extract(text, '([0-9]{{1,2}})\\.([0-9]{{1,2}})\\.([0-9]{{4}})', ['d', 'm', 'y']) AS p FROM c)
SELECT id, TRY_CAST(p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') AS DATE) AS day, CASE WHEN TRY_CAST(p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') AS DATE) IS NULL THEN 'NO_SUCH_DAY' ELSE 'EXACT' END AS basis FROM p""")
def finnish_dates(spark, d):
    day = T.finnish_date(F.col("text"))
    return _clauses(spark, d).select("id", day.alias("day"), F.when(day.isNull(), "NO_SUCH_DAY").otherwise("EXACT").alias("basis"))


_PATTERNS = {"A": "the|and", "B": "und|der|die", "C": "les|des", "D": "[0-9]{4}"}


@query("""WITH n AS (SELECT doc_id, [struct_pack(n := len(regexp_extract_all(text, 'the|and')), o := 0, t := 'A'), struct_pack(n := len(regexp_extract_all(text, 'und|der|die')), o := -1, t := 'B'), struct_pack(n := len(regexp_extract_all(text, 'les|des')), o := -2, t := 'C'),
struct_pack(n := len(regexp_extract_all(text, '[0-9]{4}')), o := -3, t := 'D')] AS c FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN list_max(c).n > 0 THEN list_max(c).t END AS topic FROM n""")
def topic_by_hits(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.topic(F.col("text"), _PATTERNS).alias("topic"))


_TAGGED = """g AS (SELECT user_id, string_agg(CASE WHEN event_id % 7 = 0 THEN 'noise' ELSE event_id % 50 || ' ' || event_type || '  Q' || event_id % 3 || ' T' || event_id % 5 END, chr(10) ORDER BY event_id) AS text FROM events GROUP BY 1)"""


def _tagged(spark, d):
    e = F.col("event_id")
    line = F.when(e % 7 == 0, "noise").otherwise(F.concat((e % 50).cast("string"), F.lit(" "), "event_type", F.lit("  Q"), (e % 3).cast("string"), F.lit(" T"), (e % 5).cast("string")))
    got = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("ls"))
    return got.select("user_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))


@query(f"""WITH {_TAGGED}, l AS (SELECT user_id, k, regexp_split_to_array(trim(ls[k]), ' +') AS f FROM (SELECT user_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM g)),
p AS (SELECT user_id, k, CAST(f[1] AS BIGINT) AS id, f[2] AS role, f[3] AS quality, f[4] AS topic FROM l WHERE len(f) = 4 AND regexp_full_match(f[1], '[0-9]+'))
SELECT user_id, id, role, quality, topic FROM p QUALIFY row_number() OVER (PARTITION BY user_id, id ORDER BY k) = 1""")
def tag_line_parse(spark, d):
    """Lines ``ID ROLE QUALITY TOPIC`` of each text; the first line of an id counts."""
    rows = _tagged(spark, d).select("user_id", F.posexplode(T.tag_lines(F.col("text"))).alias("k", "x"))
    return rows.groupBy("user_id", F.col("x.id").alias("id")).agg(F.min_by("x", "k").alias("x")).select("user_id", "id", "x.role", "x.quality", "x.topic")


@query("""WITH s AS (SELECT o_custkey AS id, string_agg(o_orderkey % 20 || CASE WHEN o_orderkey % 3 = 0 THEN '-' || o_orderkey % 20 + o_custkey % 6 - 2 ELSE '' END, ', ' ORDER BY o_orderkey) AS text FROM orders GROUP BY 1),
p AS (SELECT id, unnest(regexp_extract_all(text, '[0-9]+(?:-[0-9]+)?')) AS p FROM s), r AS (SELECT DISTINCT id, unnest(range(CAST(split_part(p, '-', 1) AS BIGINT), CAST(split_part(p, '-', CASE WHEN contains(p, '-') THEN 2 ELSE 1 END) AS BIGINT) + 1)) AS i FROM p)
SELECT s.id, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i), '') AS indexes FROM s LEFT JOIN r USING (id) GROUP BY 1""")
def index_ranges(spark, d):
    o = F.col("o_orderkey")
    part = F.concat((o % 20).cast("string"), F.when(o % 3 == 0, F.concat(F.lit("-"), (o % 20 + F.col("o_custkey") % 6 - 2).cast("string"))).otherwise(""))
    texts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("p")))).alias("ps"))
    text = F.array_join(F.transform("ps", lambda x: x["p"]), ", ")
    return texts.select("id", F.array_join(T.index_ranges(text).cast("array<string>"), ",").alias("indexes"))


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER w AS k, sum(turn % 4 + 1) OVER w AS id FROM conversations WHERE turn IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CAST(id AS BIGINT) AS id, chr(65 + CAST(turn % 3 AS INT)) AS code FROM t""")
def delta_decode(spark, d):
    """Streams of ``<step><code>`` tokens back to ids and codes."""
    token = F.concat((F.col("turn") % 4 + 1).cast("string"), F.char(65 + F.col("turn") % 3))
    rows = table(spark, d, "conversations").filter("turn is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", token.alias("t")))).alias("ts"))
    stream = F.array_join(F.transform("ts", lambda x: x["t"]), " ")
    return rows.select("conv_id", F.explode(T.deltas(stream)).alias("x")).select("conv_id", "x.id", "x.code")


@query(r"""WITH l AS (SELECT doc_id, k, ls[k] AS line, length(ls[k]) < 40 AS noise FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents WHERE text IS NOT NULL)),
g AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM l WHERE noise)
SELECT doc_id, min(k) AS first, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY k)) AS text_sha256 FROM g GROUP BY doc_id, island""")
def noise_islands(spark, d):
    """Runs of short lines."""
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    noise = lines.filter(F.length("line") < 40).withColumn("island", F.col("k") - F.row_number().over(Window.partitionBy("doc_id").orderBy("k")))
    got = noise.groupBy("doc_id", "island").agg(F.min("k").alias("k"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("k", "line"))).alias("ls"))
    return got.select("doc_id", (F.col("k") + 1).cast("long").alias("first"), "n", F.sha2(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), 256).alias("text_sha256"))


@query("""SELECT o_orderkey AS id, sha256('{"customer":' || o_custkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS record_sha256, left(sha256('v1' || chr(10) || o_orderpriority), 16) AS version FROM orders""")
def canonical_hashes(spark, d):
    """Records as JSON with sorted keys and no blanks, hashed; and a version key from a salt and a text."""
    record = F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")))
    version = F.substring(F.sha2(F.concat(F.lit("v1\n"), "o_orderpriority"), 256), 1, 16)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.sha2(record, 256).alias("record_sha256"), version.alias("version"))


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS a, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)
SELECT id, round(len(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: left(a, k) = left(b, k))) / greatest(length(a), length(b)), 6) AS ratio, CASE WHEN contains(a, b) THEN 0.95 WHEN contains(b, a) THEN 0.9 ELSE 0 END::DOUBLE AS substring_confidence FROM p WHERE b IS NOT NULL""")
def prefix_and_substring(spark, d):
    """How alike two names are: by common prefix, and whether one holds the other."""
    before = F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), before.alias("b")).filter("b is not null")
    inside = F.when(F.contains("a", "b"), 0.95).when(F.contains("b", "a"), 0.9).otherwise(0.0)
    return rows.select("id", F.round(T.prefix_ratio(F.col("a"), F.col("b")), 6).alias("ratio"), inside.alias("substring_confidence"))


@query("""WITH q AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WHERE turn IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
k AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')) AS ws, lower(coalesce(t2, '')) AS answer FROM q WHERE role = 'user' AND r2 = 'assistant')
SELECT conv_id, turn, len(ws) AS n_words, round(CASE WHEN len(ws) = 0 THEN 1 ELSE len(list_filter(ws, lambda w: contains(answer, w))) / len(ws) END, 6) AS coverage FROM k""")
def keyword_coverage(spark, d):
    """The share of a question's words that stand in the answer after it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, d, "conversations").filter("turn is not null").withColumn("r2", F.lead("role").over(w)).withColumn("t2", F.lead("text").over(w)).filter("role = 'user' and r2 = 'assistant'")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)))
    rows = rows.withColumn("ws", words)
    return rows.select("conv_id", "turn", F.size("ws").cast("long").alias("n_words"), F.round(T.covered(F.col("ws"), F.lower(F.coalesce("t2", F.lit("")))), 6).alias("coverage"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE len(CAST('[' || CAST(json_extract_string(props, '$.k') AS BIGINT) || ',' || event_id % 9 || '.5]' AS DOUBLE[])) END AS n, CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) + event_id % 9 + 0.5 END::DOUBLE AS total FROM events""")
def safe_json_floats(spark, d):
    """Arrays of numbers from JSON; what is none is empty."""
    text = F.when(F.col("event_id") % 5 == 0, "oops").otherwise(F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(","), (F.col("event_id") % 9).cast("string"), F.lit(".5]")))
    values = F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))
    rows = table(spark, d, "events").select("event_id", values.alias("v"))
    return rows.select("event_id", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))
