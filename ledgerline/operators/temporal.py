"""As-of and overlap joins on ordered positions (numbers, days, character offsets)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one side of a cell that one task joins, about.
TILE = 4096


def nearest_preceding(points: DataFrame, marks: DataFrame, *, keys: list[str], at: str, within: int, take: list[str], inclusive: bool = False) -> DataFrame:
    """``points`` with the columns ``take`` of the last of ``marks`` with equal ``keys`` that stands before (or, ``inclusive``, at) its
    place and at most ``within`` before; else nulls. Of marks at one place the greatest by ``take`` counts.

    A key's line is cut into cells of ``within``; a mark is sent to its own cell and the next, where alone it can be the answer. So
    a cell is carried through by one window, and a key with very many rows is spread over its cells."""
    cell = F.floor(F.col(at) / within)
    mark = F.struct(F.col(at).alias("_at"), *take)
    left = points.select(*keys, cell.alias("_cell"), F.col(at).alias("_at"), F.struct(*points.columns).alias("_point"), F.lit(None).alias("_mark"))
    right = marks.select(*keys, F.explode(F.array(cell, cell + 1)).alias("_cell"), F.col(at).alias("_at"), F.lit(None).alias("_point"), mark.alias("_mark"))
    kind = F.col("_mark").isNull() if inclusive else F.col("_mark").isNotNull()
    own = Window.partitionBy(*keys, "_cell").orderBy("_at", kind, "_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = left.union(right).withColumn("_last", F.last("_mark", ignorenulls=True).over(own)).filter("_point IS NOT NULL")
    near = F.when(F.col("_at") - F.col("_last._at") <= within, F.col("_last"))
    return carried.select("_point.*", *(near[c].alias(c) for c in take))


def _celled(rows: DataFrame, keys: list[str], start: str, end: str, width: Column, side: str) -> DataFrame:
    cells = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))
    row = F.struct(*rows.columns)
    return rows.filter(F.col(start) <= F.col(end)).select(*keys, cells.alias("_cell"), row.alias(side), F.floor(F.col(start) / width).alias(f"_first_{side}"), F.xxhash64(row).alias(f"_hash_{side}"))


def overlapping(left: DataFrame, right: DataFrame, *, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], tile: int = TILE) -> DataFrame:
    """Pairs ``l, r`` (structs) of rows with equal ``keys`` whose closed spans have a point in common.

    Both sides are dealt to the cells of a grid that their spans touch, of about the mean length of all spans, and
    joined by key and cell; a pair that meets in several cells is reported in the first of them alone. Cells with more than
    ``tile`` rows of a side are cut into tiles, of which each pair of rows has one. Spans that end before they begin overlap none."""
    spans = left.select((F.col(left_span[1]) - F.col(left_span[0])).alias("n")).union(right.select(F.col(right_span[1]) - F.col(right_span[0])))
    mean = spans.filter("n >= 0").agg(F.avg("n")).first()[0]
    width = F.lit(float(max(1.0, mean or 1.0)))
    a, b = _celled(left, keys, *left_span, width, "l"), _celled(right, keys, *right_span, width, "r")
    cell = [*keys, "_cell"]
    full = a.groupBy(*cell).agg(F.count("*").alias("_na")).join(b.groupBy(*cell).agg(F.count("*").alias("_nb")), cell)
    full = full.filter((F.col("_na") > tile) | (F.col("_nb") > tile)).select(*cell, F.ceil(F.col("_na") / tile).alias("_ta"), F.ceil(F.col("_nb") / tile).alias("_tb"))
    tiles = lambda c: F.coalesce(c, F.lit(1))
    a = a.join(full, cell, "left").withColumn("_i", F.pmod("_hash_l", tiles("_ta"))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), tiles("_tb") - 1))).drop("_ta", "_tb")
    b = b.join(full, cell, "left").withColumn("_j", F.pmod("_hash_r", tiles("_tb"))).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), tiles("_ta") - 1))).drop("_ta", "_tb")
    both = a.join(b, [*cell, "_i", "_j"]).filter(F.col("_cell") == F.greatest("_first_l", "_first_r"))
    meet = (F.col(f"l.{left_span[0]}") <= F.col(f"r.{right_span[1]}")) & (F.col(f"r.{right_span[0]}") <= F.col(f"l.{left_span[1]}"))
    return both.filter(meet).select("l", "r")


def added_cost(held: Column, start: Column, end: Column) -> Column:
    """How much of [start, end) no interval of ``held`` (array of structs start, end) covers."""
    begin = F.struct(F.lit(0).cast("long").alias("covered"), start.cast("long").alias("reach"))

    def step(state: Column, x: Column) -> Column:
        low, high = F.greatest(x["start"].cast("long"), state["reach"]), F.least(x["end"].cast("long"), end.cast("long"))
        return F.struct((state["covered"] + F.greatest(high - low, F.lit(0).cast("long"))).alias("covered"), F.greatest(state["reach"], high).alias("reach"))

    return end - start - F.aggregate(F.array_sort(held), begin, step, lambda s: s["covered"])


def places(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """``id, at, hit`` of each leftmost match of a pattern that matches nothing empty; ``at`` counts characters from 0."""
    text = F.col(text_col)
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pieces = F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("gap"), hits.alias("hit"))
    each = docs.select(F.col(id_col), F.posexplode(pieces).alias("k", "x")).filter("x.hit IS NOT NULL")
    before = F.sum(F.col("x.gap") + F.length("x.hit")).over(Window.partitionBy(id_col).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return each.select(id_col, (before - F.length("x.hit")).alias("at"), F.col("x.hit").alias("hit"))
