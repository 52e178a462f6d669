"""Event streams: windows, joins and sessions whose state a watermark bounds, and keyed upserts.

Every result is a ``Sink``: a folder of results, the checkpoint beside it, and ``run``, which takes in all that has arrived since
the last run and ends. Runs go on where the last one was, also after a crash: the checkpoint says which files a batch had, and what a
batch wrote counts once. In append mode a window, pair or session goes out when the watermark (the greatest time seen before,
less the delay) has passed it, its state is dropped then, and rows that come later still are dropped."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.scratch import shared_dir

#: Batches after which an upsert's deltas are merged.
MERGED = 8


class Sink:
    """The rows of a stream in append mode, written by Spark's file sink."""

    def __init__(self, stream: DataFrame, name: str) -> None:
        self.stream, self.where = stream, f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def run(self) -> list[dict[str, Any]]:
        """Take in what has arrived; the progress of each batch."""
        writer = self.stream.writeStream.format("parquet").outputMode("append").option("path", f"{self.where}/rows")
        query = writer.option("checkpointLocation", f"{self.where}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return list(query.recentProgress)

    def rows(self) -> DataFrame:
        spark = self.stream.sparkSession
        return spark.read.schema(self.stream.schema).parquet(f"{self.where}/rows")


class Feed:
    """A folder into which rows arrive part by part, and the stream of what is in it."""

    def __init__(self, rows: DataFrame, name: str) -> None:
        self.schema, self.where = rows.schema, f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
        rows.limit(0).write.parquet(self.where)
        self.stream = rows.sparkSession.readStream.schema(self.schema).parquet(self.where)

    def arrive(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.where)


def counted(events: DataFrame, *, at: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Rows and sums of ``value`` by tumbling window and keys."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    own = timed.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys)
    return own.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def joined(left: DataFrame, right: DataFrame, *, keys: list[str], at: tuple[str, str], within: str, late: str) -> DataFrame:
    """Rows of both streams with equal keys of which the left one comes at the time of the right one or at most ``within`` after; the
    columns other than the keys must have different names. A row is held only as long as a partner may still come."""
    a = left.withColumn(at[0], F.col(at[0]).cast("timestamp")).withWatermark(at[0], late)
    b = right.withColumn(at[1], F.col(at[1]).cast("timestamp")).withWatermark(at[1], late).select(*(F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    near = (F.col(at[0]) >= F.col(at[1])) & (F.col(at[0]) <= F.col(at[1]) + F.expr(f"INTERVAL {within}"))
    return a.join(b, same & near).drop(*(f"_{k}" for k in keys))


def closed_sessions(events: DataFrame, *, key: str, at: str, gap_ms: int, late: str, buckets: int = 200) -> DataFrame:
    """``key, start, end, n``: sessions of rows less than ``gap_ms`` apart. Keys are hashed to ``buckets``; a bucket has one state with its keys' open
    sessions, and a timer at which the first of them can't grow any more. So a batch costs Python a call a bucket and not one a key.
    Rows out of order join, bridge or begin sessions as long as they aren't late; rows without a time have none. Times are milliseconds."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = name[0] >= 0  # the bucket -1 is that of the null key
        held = [[np.asarray(x) for x in state.get]] if state.exists else []
        if not state.hasTimedOut:
            held += [[part[key].to_numpy(), ms := part["ms"].to_numpy(np.int64), ms, np.ones(len(ms), np.int64)] for part in parts]
        keys, start, end, n = (np.concatenate(x) for x in zip(*(x for x in held if len(x[1])), strict=True))
        code = pd.factorize(keys)[0] if known else np.zeros(len(keys), np.int64)
        order = np.lexsort((end, start, code))
        keys, start, end, n, code = keys[order], start[order], end[order], n[order], code[order]
        reach = pd.Series(end).groupby(code).cummax().to_numpy()
        fresh = np.concatenate(([True], (code[1:] != code[:-1]) | (start[1:] - reach[:-1] >= gap_ms)))
        first = np.flatnonzero(fresh)
        spans = [keys[first], start[first], np.maximum.reduceat(end, first), np.add.reduceat(n, first)]
        over = spans[2] + gap_ms <= state.getCurrentWatermarkMs()
        left = [x[~over] for x in spans]
        if len(left[1]):
            state.update(tuple(x.tolist() if known or k else [None] * len(x) for k, x in enumerate(left)))
            state.setTimeoutTimestamp(int(left[2].min()) + gap_ms)
        elif state.exists:
            state.remove()
        if over.any():
            done = [x[over] for x in spans]
            yield pd.DataFrame({key: done[0] if known else [None] * len(done[0]), "start": done[1], "end": done[2], "n": done[3]})

    kind = events.schema[key].dataType.simpleString()
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.hash(key), F.lit(buckets)))
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).filter(F.col(at).isNotNull())
    rows = timed.select(bucket.alias("_bucket"), key, at, F.unix_millis(at).alias("ms"))
    spans = f"keys array<{kind}>, starts array<bigint>, ends array<bigint>, sizes array<bigint>"
    return rows.groupBy("_bucket").applyInPandasWithState(step, f"{key} {kind}, start long, end long, n long", spans, "append", GroupStateTimeout.EventTimeTimeout)


class Latest:
    """The last row of each key: a batch adds its own last rows as a delta, every MERGED batches the deltas become one table, so a row
    is rewritten once in MERGED batches and not in each. A batch run twice writes its delta again."""

    def __init__(self, stream: DataFrame, keys: list[str], order: list[str], name: str) -> None:
        self.stream, self.keys, self.order = stream, keys, order
        self.where = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        best = F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_best")
        return rows.groupBy(*self.keys).agg(best).select(*self.keys, *(F.col("_best")[c].alias(c) for c in rest)).select(*rows.columns)

    def _parts(self, number: int) -> list[str]:
        """The tables that hold all rows up to a batch: the merged one of the last full round, and the deltas since."""
        full = number - (number + 1) % MERGED
        merged = [f"{self.where}/merged-{full}"] if full >= 0 else []
        return merged + [f"{self.where}/delta-{k}" for k in range(max(full, -1) + 1, number + 1)]

    def _write(self, rows: DataFrame, number: int) -> None:
        self._last(rows).write.mode("overwrite").parquet(f"{self.where}/delta-{number}")
        if (number + 1) % MERGED == 0:
            before = self._parts(number - 1) + [f"{self.where}/delta-{number}"]
            self._last(rows.sparkSession.read.schema(self.stream.schema).parquet(*before)).write.mode("overwrite").parquet(f"{self.where}/merged-{number}")

    def run(self, each: Callable[[int], None] = lambda number: None) -> DataFrame:
        """Take in what has arrived; the last row of every key so far."""
        done = []

        def batch(rows: DataFrame, number: int) -> None:
            self._write(rows, number)
            done.append(number)
            each(number)

        query = self.stream.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", f"{self.where}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        spark = self.stream.sparkSession
        return self._last(spark.read.schema(self.stream.schema).parquet(*self._parts(done[-1]))) if done else spark.createDataFrame([], self.stream.schema)


def followed(spark: SparkSession, path: str, schema: DataFrame) -> DataFrame:
    """The Parquet files of a folder, or those that a pattern matches, as a stream, one file a batch."""
    return spark.readStream.schema(schema.schema).option("maxFilesPerTrigger", 1).parquet(path)
