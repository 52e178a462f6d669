"""Retrieval, pair confidence, fusion and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.scratch import saved, spread


def retrieved(documents: DataFrame, queries: DataFrame, *, top: int, scope: list[str] | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank``: the ``top`` documents of each query by the summed weights ln(1 + N / df) of the tokens they
    share (each counted once), by score (9 digits), then by id. ``documents`` (doc_id, tokens) and ``queries`` (query_id, tokens) may
    share ``scope`` columns, within which only documents of the same scope are ranked.

    Postings are restricted to the queries' tokens before anything is counted; N and df cover all documents."""
    scope = scope or []
    n = documents.agg(F.count_distinct("doc_id").alias("n"))  # one row
    asked = queries.select("query_id", *scope, F.explode(F.array_distinct("tokens")).alias("token"))
    posts = documents.select("doc_id", *scope, F.explode(F.array_distinct("tokens")).alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    weights = posts.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("token", F.ln(1 + F.col("n") / F.col("df")).alias("weight"))
    scored = asked.join(weights, "token").join(posts, ["token", *scope]).groupBy("query_id", "doc_id").agg(F.round(F.sum("weight"), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def holding(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """``query_id, doc_id`` of the documents (doc_id, text) whose text holds a passage (query_id, passage).

    A passage's words between its first and last blank stand whole in every text that holds it; documents are looked up by
    the one that the fewest of them have, and searched only then. Passages of fewer words are searched in all documents."""
    words = documents.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    pieces = F.split("passage", " ")
    asked = passages.withColumn("words", F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))))
    inner = asked.select("query_id", F.explode(F.array_distinct("words")).alias("word"))
    posts = words.join(inner.select("word").distinct(), "word", "left_semi")
    often = posts.groupBy("word").agg(F.count("*").alias("n"))
    rarest = inner.join(often, "word", "left").groupBy("query_id").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    met = rarest.join(posts, "word").join(passages, "query_id").join(documents, "doc_id").filter(F.contains("text", "passage")).select("query_id", "doc_id")
    short = asked.filter(F.size("words") == 0)
    return met.union(documents.join(short, F.contains("text", "passage")).select("query_id", "doc_id"))


def recall_at(ranked: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """``k, n_relevant, n_found, recall`` over all pairs of ``relevant`` (query_id, doc_id)."""
    both = relevant.select("query_id", "doc_id").distinct().join(ranked.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    per = both.select("rank", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    found = F.count(F.when(F.col("rank") <= F.col("k"), 1))
    return per.groupBy("k").agg(F.count("*").alias("n_relevant"), found.alias("n_found"), F.round(found / F.count("*"), 6).alias("recall"))


def similar_sets(rows: DataFrame, key: str, member: str, least: float) -> DataFrame:
    """Pairs ``first < second`` of keys whose sets of members have a Jaccard similarity of ``least`` or more, by counting shared
    members from an inverted list; sets are never gathered. Pairs are dealt to tasks before they are counted."""
    own = saved(spread(rows.select(F.col(key).alias("k"), F.col(member).alias("m")), rows.count(), "k", "m").distinct(), "members")
    size = own.groupBy("k").agg(F.count("*").alias("n"))
    dealt = spread(own.filter("m IS NOT NULL"), own.count(), "m")
    pairs = dealt.select("m", F.col("k").alias("first")).join(dealt.select("m", F.col("k").alias("second")), "m").filter("first < second").select("first", "second")
    n = own.filter("m IS NOT NULL").groupBy("m").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    shared = spread(pairs, int(n or 0), "first", "second").groupBy("first", "second").agg(F.count("*").alias("both"))
    sized = shared.join(size.select(F.col("k").alias("first"), F.col("n").alias("na")), "first").join(size.select(F.col("k").alias("second"), F.col("n").alias("nb")), "second")
    jaccard = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return sized.withColumn("jaccard", F.round(jaccard, 6)).filter(jaccard >= least).select("first", "second", "jaccard")


def pair_confidence(topics: tuple[Column, Column], amounts: tuple[Column, Column], refs: tuple[Column, Column], words: tuple[Column, Column]) -> Column:
    """How likely two nodes are about the same: the same topic (not X) 0.35, amounts within a factor of two 0.3, a shared section 0.25,
    words alike by more than a fifth 0.1."""
    same = (topics[0] == topics[1]) & (topics[0] != "X") & (topics[0] != "")
    close = F.exists(amounts[0], lambda a: F.exists(amounts[1], lambda b: (a > 0) & (b > 0) & (a / b > 0.5) & (a / b < 2.0)))
    alike = F.size(F.array_intersect(*words)) / F.greatest(F.size(F.array_union(*words)), F.lit(1)) > 0.2
    some = (F.size(words[0]) > 0) & (F.size(words[1]) > 0)
    point = lambda ok, w: F.when(F.coalesce(ok, F.lit(False)), w).otherwise(0.0)
    return F.least(point(same, 0.35) + point(close, 0.3) + point(F.arrays_overlap(*refs), 0.25) + point(some & alike, 0.1), F.lit(1.0))


def best_match(pairs: DataFrame, target: str, score: str, least: float, *order: Column | str) -> DataFrame:
    """For each target its source of the highest score of ``least`` or more, the first in ``order`` among equals."""
    own = Window.partitionBy(target).orderBy(F.desc(score), *order)
    return pairs.filter(F.col(score) >= least).withColumn("_r", F.row_number().over(own)).filter("_r = 1").drop("_r")


def classification(pairs: DataFrame, classes: list) -> DataFrame:
    """``class, tp, fp, fn, precision, recall, f1`` from ``pairs`` (gold, pred), for every class of a fixed list; 0 where undefined."""
    known = F.array(*map(F.lit, classes))
    counted = pairs.groupBy("gold", "pred").agg(F.count("*").alias("n")).select("gold", "pred", "n", F.explode(known).alias("class"))
    empty = pairs.sparkSession.range(1).select(F.explode(known).alias("class")).select(F.lit(None).cast("string").alias("gold"), F.lit(None).cast("string").alias("pred"), F.lit(0).cast("long").alias("n"), "class")
    rows = counted.select(F.col("gold").cast("string"), F.col("pred").cast("string"), "n", "class").union(empty)
    is_gold, is_pred = (F.coalesce(F.col(c) == F.col("class").cast("string"), F.lit(False)) for c in ("gold", "pred"))
    n = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0))
    s = rows.groupBy("class").agg(n(is_gold & is_pred).alias("tp"), n(~is_gold & is_pred).alias("fp"), n(is_gold & ~is_pred).alias("fn"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("class", "tp", "fp", "fn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))
