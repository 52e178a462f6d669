"""Rule detectors: each turns documents into rows (id, detector, severity, evidence), at most one a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text as T


def flagged(docs: DataFrame, id_col: str, detector: str, condition: Column, severity: Column | str, evidence: Column) -> DataFrame:
    """The documents for which ``condition`` holds, as flag rows."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return docs.filter(F.coalesce(condition, F.lit(False))).select(F.col(id_col).alias("id"), F.lit(detector).alias("detector"), level.alias("severity"), evidence.alias("evidence"))


def all_flags(branches: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, branches)


def range_crossing_zero(text: Column) -> Column:
    """The first range ``-a ... b`` of a text whose ends lie on both sides of nothing."""
    return F.regexp_extract(text, r"(-[0-9]+(?:[.,][0-9]+)? ?(?:\.\.\.?|–|to) ?\+?[1-9][0-9]*(?:[.,][0-9]+)?)", 1)


def vocabulary_rate(text: Column, words: tuple[str, ...]) -> Column:
    """How often the words stand in a text, for ten thousand of its characters; null for an empty text."""
    low = F.lower(text)
    return F.try_divide(10000.0 * sum((T.occurrences(low, F.lit(w)) for w in words), F.lit(0).cast("long")), F.length(text))


def share_gap(first: tuple[Column, Column], second: tuple[Column, Column]) -> Column:
    """The difference of two shares (part, whole); null where a whole is nothing."""
    return F.try_divide(*first) - F.try_divide(*second)


def severity(value: Column, medium: float, high: float) -> Column:
    return F.when(value >= high, "HIGH").when(value >= medium, "MEDIUM").otherwise("LOW")
