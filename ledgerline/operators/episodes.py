"""Decision episodes: a matter's events, in order, run through a small automaton; what doesn't fit stays as residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: State before, kind of event, state after. An event without an entry for the state changes nothing and is a residual.
MOVES = {
    ("OPEN", "QUESTION"): "ASKED",
    ("ASKED", "ANSWER"): "ANSWERED",
    ("ASKED", "WITHDRAWAL"): "WITHDRAWN",
    ("ANSWERED", "DECISION"): "DECIDED",
    ("ANSWERED", "QUESTION"): "ASKED",
    ("DECIDED", "QUESTION"): "ASKED",
}


def _step(before: Column, kind: Column) -> Column:
    return F.coalesce(*(F.when((before == a) & (kind == k), b) for (a, k), b in MOVES.items()))


def walked(events: DataFrame, *, matter: str, order: list[str], kind: str, notes: tuple[str, ...] = ()) -> DataFrame:
    """``matter, state, n_moves, n_notes, residuals``: where each matter ends, and the kinds of events that didn't fit, counted as ``kind at state: n``
    in order of their names, with ANSWER_NOT_LOADED where it ends with an open question. Events of kinds ``notes`` fit everywhere.

    Events are folded in order; a matter's state is one word, so only its events' kinds are gathered, runs of equal kinds as one."""
    own = Window.partitionBy(matter).orderBy(*order)
    fits = events.withColumn("_kind", F.col(kind)).withColumn("_note", F.col(kind).isin(*notes) if notes else F.lit(False))
    told = fits.filter("NOT _note").withColumn("_fresh", F.coalesce(F.lag("_kind").over(own) != F.col("_kind"), F.lit(True)).cast("int"))
    runs = told.withColumn("_run", F.sum("_fresh").over(own)).groupBy(matter, "_run", "_kind").agg(F.count("*").alias("_n"))
    folded = runs.groupBy(matter).agg(F.array_sort(F.collect_list(F.struct("_run", "_kind", "_n"))).alias("_events"))
    odd = "array<struct<what:string,n:bigint>>"
    start = F.struct(F.lit("OPEN").alias("state"), F.lit(0).cast("long").alias("moves"), F.array().cast(odd).alias("odd"))

    def step(s: Column, e: Column) -> Column:
        after = _step(s["state"], e["_kind"])
        again = F.coalesce(after, s["state"])  # the first of a run may move, the others meet the state after it
        left = e["_n"] - F.when(after.isNotNull(), 1).otherwise(0)
        what = F.struct(F.concat(e["_kind"], F.lit(" at "), again).alias("what"), left.alias("n"))
        return F.struct(again.alias("state"), (s["moves"] + F.when(after.isNotNull(), 1).otherwise(0)).alias("moves"), F.when(left > 0, F.concat(s["odd"], F.array(what))).otherwise(s["odd"]).alias("odd"))

    ended = folded.withColumn("_end", F.aggregate("_events", start, step))
    noted = fits.groupBy(matter).agg(F.count(F.when(F.col("_note"), 1)).alias("n_notes"))
    out = noted.join(ended, matter, "left").select(matter, F.coalesce("_end.state", F.lit("OPEN")).alias("state"), F.coalesce("_end.moves", F.lit(0)).alias("n_moves"), "n_notes", "_end.odd")
    names = F.array_sort(F.array_distinct(F.transform("odd", lambda x: x["what"])))
    counted = F.transform(names, lambda w: F.concat(w, F.lit(": "), F.aggregate(F.filter("odd", lambda x: x["what"] == w), F.lit(0).cast("long"), lambda a, x: a + x["n"]).cast("string")))
    residuals = F.array_compact(F.array_append(F.coalesce(counted, F.array().cast("array<string>")), F.when(F.col("state") == "ASKED", "ANSWER_NOT_LOADED")))
    return out.select(matter, "state", "n_moves", "n_notes", F.array_join(residuals, "; ").alias("residuals"))
