"""XML bills and reports, built from the documents, as atoms and as spans of a canonical text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions import markup as X
from ledgerline.plans.registry import query, table

#: What XML 1.0 can't hold, and the carriage return, which a parser turns into a line feed.
ODD = "[\\x00-\\x08\\x0B-\\x1F\\x{FFFE}\\x{FFFF}]"
#: Paragraphs of a section.
PER = 3


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def bills(spark, d):
    """``doc_id, xml, canonical``: a bill with a title and sections of three paragraphs, one for each line of the text. Every fifth one
    ends with a dissent."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("none")).alias("title"), F.regexp_replace("text", ODD, "?").alias("text"))
    lines = F.split("text", "\n", -1)
    paragraphs = F.transform(lines, lambda x, k: F.concat(F.when(k % PER == 0, "<section>").otherwise(""), F.lit("<p>"), _escaped(x), F.lit("</p>"), F.when((k % PER == PER - 1) | (k == F.size(lines) - 1), "</section>").otherwise("")))
    dissent = F.when(F.col("doc_id") % 5 == 0, "<dissent><h>Other view</h><p>No.</p></dissent>").otherwise("")
    xml = F.concat(F.lit("<bill><h>"), _escaped(F.col("title")), F.lit("</h>"), F.array_join(paragraphs, ""), dissent, F.lit("</bill>"))
    words = F.filter(F.split(F.concat_ws(" ", "title", "text", F.when(F.col("doc_id") % 5 == 0, "Other view No.")), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")
    return docs.select("doc_id", xml.alias("xml"), F.array_join(words, "\n").alias("canonical"))


_LINES = rf"""d AS (SELECT doc_id, coalesce(source, 'none') AS title, string_split(regexp_replace(text, '{ODD}', '?', 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, title, len(ls) AS n, unnest(range(len(ls))) AS k, unnest(ls) AS t FROM d),
m AS (SELECT *, length(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 7 AS w, length(trim(regexp_replace(t, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ')) AS c FROM l),
o AS (SELECT *, 13 + length(title) + coalesce(sum(w) OVER p, 0) + (k // 3 + 1) * 9 + (k // 3) * 10 AS a, length(title) + 1 + coalesce(sum(CASE WHEN c > 0 THEN c + 1 ELSE 0 END) OVER p, 0) AS b FROM m WINDOW p AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"""WITH {_LINES} SELECT doc_id, CAST(2 + k // 3 * 4 + 1 + k % 3 AS BIGINT) AS node, CAST(2 + k // 3 * 4 AS BIGINT) AS parent, '/bill/section/p' AS path, CAST(k % 3 + 1 AS INT) AS ordinal, CAST(a AS BIGINT) AS "start", CAST(a + w AS BIGINT) AS "end", sha256(t) AS text_sha256 FROM o""")
def xml_atoms(spark, d):
    """The paragraphs of all bills: number, parent, place among siblings, exact place in the source, text."""
    found = X.atoms(bills(spark, d), id_col="doc_id", xml_col="xml", headings=("h",))
    return found.filter("path = '/bill/section/p'").select("doc_id", "node", "parent", "path", "ordinal", "start", "end", F.sha2("text", 256).alias("text_sha256"))


@query("""WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(2 + n + (n + 2) // 3 + CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END AS BIGINT) AS n_atoms, CAST((n + 2) // 3 AS BIGINT) AS n_sections, CAST(2 AS INT) AS deepest, CAST(0 AS BIGINT) AS n_errors FROM d""")
def xml_census(spark, d):
    """Elements, sections and depth of each bill."""
    found = X.atoms(bills(spark, d), id_col="doc_id", xml_col="xml")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_atoms"), F.count(F.when(F.col("tag") == "section", 1)).alias("n_sections"), F.max("depth").alias("deepest"), F.count("error").alias("n_errors"))


@query(f"""WITH {_LINES} SELECT doc_id, CAST(2 + k // 3 * 4 + 1 + k % 3 AS BIGINT) AS node, title AS heading, 'MAIN' AS scope, CAST(b AS BIGINT) AS "start", CAST(b + c AS BIGINT) AS "end", 'BOUND' AS state FROM o WHERE c > 0""")
def structural_spans(spark, d):
    """Paragraphs bound to their exact characters of the canonical text, in which each word has a line."""
    found = X.structural_spans(bills(spark, d), id_col="doc_id", xml_col="xml", text_col="canonical", headings=("h",), dissent=("dissent",))
    return found.filter("path = '/bill/section/p'").select("doc_id", "node", F.array_join("headings", " / ").alias("heading"), "scope", "start", "end", "state")


@query("SELECT doc_id, 'Other view' AS first_span, coalesce(source, 'none') || ' / Other view' AS headings, CAST(2 AS BIGINT) AS n FROM documents WHERE text IS NOT NULL AND doc_id % 5 = 0")
def dissent_spans(spark, d):
    """What the dissents say, by exact span, with the headings above."""
    docs = bills(spark, d)
    found = X.structural_spans(docs, id_col="doc_id", xml_col="xml", text_col="canonical", headings=("h",), dissent=("dissent",)).filter("scope = 'DISSENT' AND state = 'BOUND'")
    said = found.join(docs.select("doc_id", "canonical"), "doc_id").withColumn("said", F.substring("canonical", F.col("start") + 1, F.col("end") - F.col("start")))
    return said.groupBy("doc_id").agg(F.replace(F.min_by("said", "node"), F.lit("\n"), F.lit(" ")).alias("first_span"), F.array_join(F.max_by("headings", "node"), " / ").alias("headings"), F.count("*").alias("n"))
