"""What is out of date, what replaces what, and what must not be lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.scratch import spread


def stale(keys: DataFrame, stamps: DataFrame, on: list[str], version: str) -> DataFrame:
    """The ``keys`` without a stamp of this version."""
    return keys.join(stamps.filter(F.col("version") == version).select(*on).distinct(), on, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same keys; the last row of a key in ``new`` must be its only one."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def restored(new: DataFrame, old: DataFrame, key: str, hashed: str, column: str) -> DataFrame:
    """``new`` with ``column`` taken from ``old`` where key and hash are the same."""
    before = old.select(key, hashed, F.col(column).alias("_old"))
    return new.join(before, [key, hashed], "left").withColumn(column, F.coalesce("_old", column)).drop("_old")


def repaired(have: DataFrame, more: DataFrame, group: str, member: str, expected: DataFrame) -> DataFrame:
    """Rows of ``have``, and those of ``more`` for the groups that are short of ``expected`` (group, n) and complete with them."""
    g, m = F.col(group), F.col(member)
    both = have.select(group, member, F.lit(1).alias("_had")).union(more.select(group, member, F.lit(0)))
    rows = spread(both, both.count(), group).groupBy(group, member).agg(F.sum("_had").alias("_times"), F.min("_had").alias("_only"))
    sizes = rows.groupBy(group).agg(F.count(F.when(F.col("_times") > 0, m)).alias("had"), F.count(m).alias("got"))
    good = sizes.join(expected, group).filter((F.col("had") < F.col("n")) & (F.col("got") == F.col("n"))).select(group, F.lit(1).alias("_good"))
    new = (F.col("_only") == 0) & ((F.col("_times") == 0) | m.isNull()) & F.col("_good").isNotNull()
    copies = F.array_repeat(F.lit(1), (F.col("_times") + F.when(new, 1).otherwise(0)).cast("int"))
    return rows.join(good, group, "left").select(g, m, F.explode(copies).alias("_copy")).select(group, member)


def contract(tables: dict[str, DataFrame]) -> DataFrame:
    """``name, n, ok`` of tables that must not be empty."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", (F.col("n") > 0).alias("ok")) for name, df in tables.items()]
    return reduce(DataFrame.union, rows)


def must_hold(tables: dict[str, DataFrame]) -> None:
    """Fail if a table is empty; one row a table is looked at."""
    empty = [name for name, df in tables.items() if not df.limit(1).count()]
    if empty:
        raise ValueError(f"empty tables: {', '.join(empty)}")


def media_kind(content_type: Column, url: Column, head: Column) -> Column:
    """PDF, HTML, XML, JSON or OTHER by magic bytes, else by content type, else by the address."""
    by = lambda text, kinds: [F.when(text.rlike(p), k) for k, p in kinds.items()]
    magic = by(head, {"PDF": r"^%PDF", "HTML": r"(?i)^\s*(<!doctype html|<html)", "XML": r"^\s*<\?xml", "JSON": r"^\s*[\[{]"})
    kind = by(F.lower(content_type), {"PDF": "pdf", "HTML": "html", "XML": "xml", "JSON": "json"})
    name = by(F.lower(url), {"PDF": r"\.pdf($|\?)", "HTML": r"\.html?($|\?)", "XML": r"\.xml($|\?)", "JSON": r"\.json($|\?)"})
    return F.coalesce(*magic, *kind, *name, F.lit("OTHER"))
