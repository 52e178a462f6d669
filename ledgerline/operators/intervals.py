"""Intervals, sequences and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.scratch import spread


def merged(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The union of closed intervals of each key, touching or overlapping ones as one. Keys are dealt to tasks of about a million rows, and
    both windows have one order (of equal intervals the first alone can start a union that the next one stays in), so rows are sorted once."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    dealt = spread(rows, rows.count(), key)
    marked = dealt.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def terms(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Each row as the start of a half-open interval that lasts until the key's next row (null: open)."""
    return rows.withColumn("until", F.lead(at).over(Window.partitionBy(key).orderBy(at)))


def within(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points joined to the intervals of their key that hold them; the range is the residual of an equi-join."""
    i = intervals.alias("i")
    p = points.alias("p")
    return p.join(i, (F.col(f"p.{key}") == F.col(f"i.{key}")) & (F.col(f"p.{at}") >= F.col(f"i.{start}")) & (F.col(f"i.{end}").isNull() | (F.col(f"p.{at}") < F.col(f"i.{end}"))))


def top_n(rows: DataFrame, group: str, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each group with their rank; Spark keeps n rows a group and task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


def latest(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def sessions(rows: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Runs of rows of a key with no pause of ``gap`` or more."""
    return rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def near(rows: DataFrame, group: str, place: str, is_mark: Column, reach: int) -> Column:
    """Whether a row with a mark lies within ``reach`` places before or after, as a window column."""
    around = Window.partitionBy(group).orderBy(place).rangeBetween(-reach, reach)
    return F.max(F.when(is_mark, 1).otherwise(0)).over(around) == 1


def windows_of(n: Column, size: int, overlap: int) -> Column:
    """Windows (k, first, last) of ``size`` units that cover 0 to n - 1, each ``overlap`` units into the one before."""
    step = size - overlap
    count = F.when(n <= size, F.when(n > 0, 1).otherwise(0)).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    each = lambda k: F.struct(k.alias("k"), (k * step).alias("first"), F.least(k * step + size, n).cast("int").alias("end"))
    return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), each)


def round_robin(rows: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """``rows`` with ``place``, their place in their group's seeded order, and ``draw``, the group's own seeded place: ordered by both,
    the rows of all groups take turns."""
    hashed = lambda c: F.md5(F.concat(F.lit(seed), c.cast("string")))
    order = Window.partitionBy(group).orderBy(hashed(F.col(key)), key)
    return rows.withColumn("place", F.row_number().over(order)).withColumn("draw", hashed(F.col(group)))


def resolved(rows: DataFrame, context: DataFrame, windows: DataFrame, default: DataFrame, *, phrase: str, owner: str, at: str) -> DataFrame:
    """``rows`` with ``target`` and ``basis``: what a phrase means by its owner's own alias, else by the alias whose period (start to
    end, both included; the latest start, then the smallest target) holds the date, else by default."""
    both = rows.join(context.select(owner, phrase, F.col("target").alias("_c")), [owner, phrase], "left")
    spans = windows.select(phrase, F.struct((-F.unix_date("start")).alias("s"), "target").alias("_w"), "start", "end")
    dated = both.select(phrase, at).distinct().join(spans, phrase).filter(F.col(at).between(F.col("start"), F.col("end")))
    best = dated.groupBy(phrase, at).agg(F.min("_w")["target"].alias("_t"))
    out = both.join(best, [phrase, at], "left").join(default.select(phrase, F.col("target").alias("_d")), phrase, "left")
    basis = F.when(F.col("_c").isNotNull(), "CONTEXT").when(F.col("_t").isNotNull(), "PERIOD").when(F.col("_d").isNotNull(), "DEFAULT").otherwise("NONE")
    return out.withColumn("target", F.coalesce("_c", "_t", "_d")).withColumn("basis", basis).drop("_c", "_t", "_d")
