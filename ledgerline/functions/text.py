"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_html(html: Column) -> Column:
    """Tags become a space, runs of white space one space, the ends none."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[ \t\n\r]+", " "), "^ | $", "")


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def sentences(text: Column) -> Column:
    """Stretches that end in a mark before white space."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])[ \n\t\r]+", "$1\u0001"), "\u0001"), lambda s: s != "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def n_matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long")


def clean_html(html: Column) -> Column:
    """Tags made blanks, then the entities nbsp, amp, lt and gt decoded in this order, then white space made single blanks."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), "^ | $", "")


def paragraphs(html: Column) -> Column:
    """The contents of the ``<p>`` elements in order."""
    return F.regexp_extract_all(html, F.lit("(?is)<p(?: [^>]*)?>(.*?)</p>"), F.lit(1))


def lines(text: Column) -> Column:
    """(start, end, text) of each line with its line break, in order: together they are the whole text."""
    pieces = F.split(text, "\n", -1)
    whole = F.transform(pieces, lambda x, i: F.when(i < F.size(pieces) - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    return _placed(F.filter(whole, lambda x: x != ""))


def char_windows(text: Column, size: int) -> Column:
    """(start, end, text) of windows of ``size`` characters."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, F.length(text)).alias("end"), F.substr(text, s + 1, F.lit(size)).alias("text")))


def _placed(pieces: Column) -> Column:
    """Pieces with their places, by a running sum; gathered in chunks, so that many pieces cost linear time."""
    item = "struct<start:int,end:int,text:string>"
    state = F.struct(F.array().cast(f"array<array<{item}>>").alias("full"), F.array().cast(f"array<{item}>").alias("some"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        end = s["at"] + F.length(x)
        new = F.array(F.struct(s["at"].alias("start"), end.alias("end"), x.alias("text")))
        over = F.size(s["some"]) >= 256
        return F.struct(F.when(over, F.concat(s["full"], F.array(s["some"]))).otherwise(s["full"]).alias("full"), F.when(over, new).otherwise(F.concat(s["some"], new)).alias("some"), end.alias("at"))

    return F.aggregate(pieces, state, step, lambda s: F.concat(F.flatten(s["full"]), s["some"]))


def occurrences(text: Column, quote: Column) -> Column:
    """How often ``quote`` stands in ``text``, without overlaps; 0 for an empty quote."""
    return F.when(F.length(quote) > 0, ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).cast("long")).otherwise(F.lit(0).cast("long"))


def anchor(text: Column, quote: Column) -> Column:
    """Where a quote stands: start, end (exclusive; null if it doesn't), and whether only there."""
    start = F.position(quote, text) - 1
    found = (F.length(quote) > 0) & (start >= 0)
    return F.struct(F.when(found, start).alias("start"), F.when(found, start + F.length(quote)).alias("end"), (occurrences(text, quote) == 1).alias("unique"))


#: Common words that tell nothing about what a text is about.
STOP = ("that", "this", "with", "from", "have", "und", "oder", "nicht", "eine", "dans", "pour", "avec", "para", "como")


def retrieval_tokens(text: Column) -> Column:
    """The distinct words of four letters or more that are no stop words, and the first six letters of those longer than eight."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-zåäö]{4,}"), F.lit(0))), lambda w: ~w.isin(*STOP))
    return F.array_union(words, F.transform(F.filter(words, lambda w: F.length(w) > 8), lambda w: F.concat(F.substr(w, F.lit(1), F.lit(6)), F.lit("*"))))


def section_refs(text: Column) -> Column:
    """The numbers before a section sign, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([0-9]+[a-z]?) §"), F.lit(1)))


def law_refs(text: Column) -> Column:
    """Law numbers ``number/year`` as ``year/number``, each once, in order."""
    found = F.regexp_extract_all(text, F.lit("[0-9]+/[0-9]{4}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.concat_ws("/", F.split(x, "/")[1], F.split(x, "/")[0])))


def number(text: Column) -> Column:
    """A number with blanks between thousands and a decimal comma; null for anything else."""
    return F.translate(F.replace(text, F.lit(" "), F.lit("")), ",", ".").try_cast("double")


def euros(text: Column) -> Column:
    """The amounts in euros of a text, magnitude words applied, in order."""
    found = F.regexp_extract_all(text, F.lit("[0-9][0-9 ]*(?:,[0-9]+)? (?:miljoonaa |miljardia )?euroa"), F.lit(0))
    size = lambda x: F.when(x.contains("miljoonaa"), 1e6).when(x.contains("miljardia"), 1e9).otherwise(1.0)
    return F.transform(found, lambda x: number(F.trim(F.regexp_replace(x, "[a-z]+", ""))) * size(x))


def finnish_date(text: Column) -> Column:
    """The first ``d.m.yyyy`` of a text as a date (null if there is no such day)."""
    part = lambda k: F.regexp_extract(text, r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})", k)
    return F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")).try_cast("date")


def topic(text: Column, patterns: dict[str, str]) -> Column:
    """The topic whose pattern is found most often, the first one among equals; null if none is."""
    counts = F.array(*(F.struct(n_matches(text, p).alias("n"), F.lit(-k).alias("order"), F.lit(t).alias("topic")) for k, (t, p) in enumerate(patterns.items())))
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["topic"])


def tag_lines(text: Column) -> Column:
    """(id, role, quality, topic) of each line ``ID ROLE QUALITY TOPIC``; lines of another form are left out."""
    fields = F.transform(F.split(text, "\n"), lambda x: F.split(F.trim(x), " +"))
    good = F.filter(fields, lambda f: (F.size(f) == 4) & f[0].rlike("^[0-9]+$"))
    return F.transform(good, lambda f: F.struct(f[0].cast("long").alias("id"), f[1].alias("role"), f[2].alias("quality"), f[3].alias("topic")))


def index_ranges(text: Column) -> Column:
    """The indexes of a list such as ``1-3, 7``, each once, ascending; ranges the wrong way round are empty."""
    parts = F.regexp_extract_all(text, F.lit("[0-9]+(?:-[0-9]+)?"), F.lit(0))

    def spread(x: Column) -> Column:
        ends = F.split(x, "-")
        low, high = ends[0].cast("long"), F.element_at(ends, -1).cast("long")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, spread))))


def deltas(text: Column) -> Column:
    """(id, code) of a stream of ``<step><code>`` tokens between blanks: each step is added to the id before."""
    tokens = F.filter(F.split(text, " +"), lambda x: x.rlike("^[0-9]+[A-Z]+$"))
    steps = F.transform(tokens, lambda x: F.regexp_extract(x, "^[0-9]+", 0).cast("long"))
    id_at = lambda i: F.aggregate(F.slice(steps, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, s: a + s)
    return F.transform(tokens, lambda x, i: F.struct(id_at(i).alias("id"), F.regexp_extract(x, "[A-Z]+$", 0).alias("code")))


def prefix_ratio(left: Column, right: Column) -> Column:
    """The length of the common prefix by that of the longer text; 0 for two empty ones."""
    n = F.least(F.length(left), F.length(right))
    same = F.size(F.filter(F.sequence(F.lit(0), n), lambda k: (k > 0) & (F.substr(left, F.lit(1), k) == F.substr(right, F.lit(1), k))))
    return F.coalesce(F.try_divide(same, F.greatest(F.length(left), F.length(right))), F.lit(0.0))


def covered(words: Column, text: Column) -> Column:
    """The share of ``words`` that stand in ``text``; 1 without words."""
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: F.contains(text, w))), F.size(words)), F.lit(1.0))
