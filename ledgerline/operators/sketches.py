"""Mergeable sketches: distinct counts and quantiles kept as columns and rolled up without another look at the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the buckets of a distinct sketch, k of a quantile sketch.
LOG_K, K = 14, 800


def sketched(rows: DataFrame, keys: list[str], member: Column, value: Column) -> DataFrame:
    """One row of sketches for each group: ``n, members, spread``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(member, F.lit(LOG_K)).alias("members"), F.kll_sketch_agg_double(value, F.lit(K)).alias("spread"))


def rolled_up(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups (also of old sketches and those of an increment)."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("members").alias("members"), F.kll_merge_agg_double("spread", F.lit(K)).alias("spread"))


def estimates(sketches: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """``*keys, n, distinct, quantiles`` of each group; a null sketch of values has no quantiles."""
    return sketches.select(*keys, "n", F.hll_sketch_estimate("members").alias("distinct"), F.array(*(F.kll_sketch_get_quantile_double("spread", F.lit(q)) for q in at)).alias("quantiles"))
