"""License scans: a positional index of rare licence words.

Licence notices and texts are templates of words; the index holds the places of every template word. A file is a candidate for
a template if it has SUPPORT of the template's distinct words. Of the file's words that the template has, those RAREST of the highest inverse
document frequency are looked up: each place of such a word and each of its postings in the template say where the
template would begin, and hits that agree on that within REACH words support one alignment. An alignment holds if SUPPORT of the
template's places of these words are met. It is then verified: every mandatory phrase of the template stands in the
aligned stretch, and the share of all the template's words that stand where the alignment puts them (again within REACH) is
COVERED or more; that share is the file's score. All of it is DataFrame operations; only words of the templates leave the rows of
their texts, and the templates, which are fixed, are all that is sent to the tasks, besides one count for each of their words.

Base labels are given by three phrases alone; a file with such a label and no verified template scores 0.5. Null texts are empty: no
words, no labels, score 0. Repeated rows are scanned alike, of words with equal frequencies the first by letter is the rarer one,
and an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import saved
from ledgerline.llm.license_texts import TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases of the base labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words of a file that are looked up, words within which hits agree, and the shares that an alignment must support and cover.
RAREST, REACH, SUPPORT, COVERED = 8, 8, 0.6, 0.6


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null is empty."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, -1), lambda w: w != "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def phrases() -> list[str]:
    return list(dict.fromkeys([*BASE, *(phrase for *_, ps in TEMPLATES for phrase in ps)]))


def places(terms: Column, phrase: str) -> Column:
    """Where a phrase's words stand consecutively; ``terms`` has (i, w) of all template words in order."""
    first, *rest = phrase.split()

    def at(x: Column, j: Column) -> Column:
        ok = x["w"] == first
        for k, w in enumerate(rest, 1):
            after = F.get(terms, j + k)
            ok = ok & (after["w"] == w) & (after["i"] == x["i"] + k)
        return F.when(ok, x["i"])

    return F.filter(F.transform(terms, at), lambda i: i.isNotNull())


def scanned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, n_words, terms, found``: the template words of each text with their places, and each phrase's places."""
    known = sorted({w for _, t, ps in TEMPLATES for w in template_words(" ".join([t, *ps]))})
    own = docs.select(docs[id_col].alias("id"), words(docs[text_col]).alias("all"))
    marked = own.select("id", F.size("all").cast("long").alias("n_words"), F.filter(F.transform("all", lambda w, i: F.struct(i.cast("long").alias("i"), w.alias("w"))), lambda x: x["w"].isin(known)).alias("terms"))
    table = saved(marked.select(F.monotonically_increasing_id().alias("row"), "id", "n_words", "terms"), "license-words")
    return table.withColumn("found", F.struct(*(places(F.col("terms"), p).alias(p) for p in phrases())))


def candidates(table: DataFrame) -> DataFrame:
    """``row, template, terms, found`` of the templates of which a file has SUPPORT of the distinct words."""
    have = F.array_distinct(F.transform("terms", lambda x: x["w"]))
    of = [sorted(set(template_words(t))) for _, t, _ in TEMPLATES]
    some = F.array_compact(F.array(*(F.when(F.size(F.array_intersect("have", F.array(*map(F.lit, ws)))) >= SUPPORT * len(ws), F.lit(k)) for k, ws in enumerate(of))))
    return table.select("row", "terms", "found", have.alias("have")).filter(F.size("have") > 1).select("row", "terms", "found", F.explode(some).alias("template"))


def verified(table: DataFrame) -> DataFrame:
    """``row, label, score`` of the templates that a file carries."""
    spark = table.sparkSession
    places_of = [(k, w, i) for k, (_, t, _) in enumerate(TEMPLATES) for i, w in enumerate(template_words(t))]
    postings = F.broadcast(spark.createDataFrame(places_of, "template int, w string, at long"))  # the templates' words
    near = saved(candidates(table), "license-candidates")
    counts = table.select(F.explode(F.array_distinct(F.transform("terms", lambda x: x["w"]))).alias("w")).groupBy("w").agg(F.count("*").alias("files"))
    often = F.broadcast(counts)  # one row for each word of the templates at most

    rarest = F.dense_rank().over(Window.partitionBy("row", "template").orderBy("files", "w"))
    own = near.select("row", "terms").dropDuplicates(["row"])
    have = near.select("row", "template", F.explode(F.array_distinct(F.transform("terms", lambda x: x["w"]))).alias("w"))
    asked = have.join(postings, ["template", "w"]).join(often, "w").withColumn("rarity", rarest).filter(F.col("rarity") <= RAREST)
    asked = saved(asked.select("row", "template", "w", "at"), "license-postings")
    expected = asked.groupBy("row", "template").agg(F.count("*").alias("expected"))
    spots = own.select("row", F.inline("terms"))
    starts = asked.join(spots, ["row", "w"]).withColumn("start", F.col("i") - F.col("at"))
    bins = F.explode(F.array(F.floor(F.col("start") / REACH) * 2, F.floor((F.col("start") + REACH // 2) / REACH) * 2 + 1))
    aligned = starts.withColumn("bin", bins).groupBy("row", "template", "bin").agg(F.count_distinct("at").alias("met"), F.min("start").alias("low"), F.max("start").alias("high"))
    aligned = saved(aligned.join(expected, ["row", "template"]).filter(F.col("met") >= SUPPORT * F.col("expected")).select("row", "template", "low", "high"), "license-alignments")

    n_words = [len(template_words(t)) for _, t, _ in TEMPLATES]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("template") + 1)
    inside = lambda p: F.exists(F.col("found")[p], lambda i: (i >= F.col("low") - REACH) & (i <= F.col("high") + F.col("length") + REACH))
    every = lambda ps: F.array(*map(inside, ps))
    must = F.coalesce(*(F.when(F.col("template") == k, F.forall(every(ps), lambda x: x)) for k, (*_, ps) in enumerate(TEMPLATES)))
    keyed = aligned.withColumn("length", pick(n_words)).join(near.select("row", "template", "found"), ["row", "template"]).filter(must).select("row", "template", "low", "high", "length")
    stretch = keyed.join(spots, "row").filter(F.col("i").between(F.col("low") - REACH, F.col("high") + F.col("length") + REACH))
    placed = stretch.join(postings, ["template", "w"]).filter((F.col("i") - F.col("at")).between(F.col("low") - REACH, F.col("high") + REACH))
    share = placed.groupBy("row", "template", "low", "high", "length").agg((F.count_distinct("at") / F.col("length")).alias("score")).filter(F.col("score") >= COVERED)
    return share.select("row", pick([label for label, *_ in TEMPLATES]).alias("label"), "score")


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, places`` (of the base phrases), ``base_labels, method_labels`` (sorted arrays) and ``score`` per row."""
    table = scanned(docs, id_col=id_col, text_col=text_col)
    carried = verified(table).groupBy("row").agg(F.array_sort(F.collect_set("label")).alias("method_labels"), F.max("score").alias("best"))
    own = [F.col("found")[p] for p in BASE]
    base = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.size(c) > 0, F.lit(name)) for c, name in zip(own, BASE.values(), strict=True))), lambda x: x.isNotNull())))
    rows = table.select("row", "id", "n_words", F.array_sort(F.concat(*own)).alias("places"), base.alias("base_labels"))
    out = rows.join(carried, "row", "left").withColumn("method_labels", F.coalesce("method_labels", F.array().cast("array<string>")))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base_labels") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_words", "places", "base_labels", "method_labels", score.alias("score"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", "method_labels")), ",").alias("labels"),
        "score",
    )
