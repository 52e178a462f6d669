"""Bundles of records imported whole or not at all, into tables whose readers stay on a version.

A version is a manifest that names the folder of every table. An import checks all rows of the bundle, writes the new tables
beside the old ones and at last creates the next manifest, which fails if someone else has made it meanwhile. So a reader sees
all of an import or nothing, whatever dies on the way, and one who holds a version goes on reading its files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path(self.root))

    def latest(self) -> int:
        """The number of the last version, 0 before the first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return max((int(n[9:]) for n in names if n.startswith("manifest-") and self._tables(int(n[9:])) is not None), default=0)

    def _tables(self, version: int) -> dict[str, str] | None:
        if version == 0:
            return {}
        rows = self.spark.read.text(f"{self.root}/manifest-{version}", wholetext=True).collect()
        try:
            return json.loads(rows[0]["value"]) if rows else None
        except json.JSONDecodeError:  # its writer died
            return None

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        where = (self._tables(self.latest() if version is None else version) or {}).get(table)
        return self.spark.read.parquet(where) if where else None

    def commit(self, tables: dict[str, DataFrame], after: int) -> int:
        """Write ``tables`` as the version that follows ``after``; all others stay as they are. Fails if that version exists."""
        named = dict(self._tables(after) or {})
        for name, rows in tables.items():
            named[name] = f"{self.root}/tables/{name}-{uuid.uuid4().hex}"
            rows.write.parquet(named[name])
        try:
            out = self._fs.create(self._path(f"{self.root}/manifest-{after + 1}"), False)
        except Py4JJavaError as error:
            raise RuntimeError(f"version {after + 1} was made by someone else; nothing is imported") from error
        out.write(bytearray(json.dumps(named).encode()))
        out.close()
        return after + 1


def imported(store: Store, bundle: DataFrame, rules: dict[str, Callable[[Column], Column]]) -> dict[str, dict[str, int]]:
    """Import ``bundle`` (place, kind, key, json): of each kind in ``rules`` the rows replace those of equal key, the last in ``place`` winning.

    A rule gives for the json what is wrong with it, or null. If anything is wrong with any row, nothing is imported. Rows of
    other kinds are counted and left alone."""
    before = store.latest()
    known = F.col("kind").isin(*rules)
    wrong = F.coalesce(*(F.when(F.col("kind") == k, rule(F.col("json"))) for k, rule in rules.items()))
    lacking = F.when(F.col("key").isNull() | (F.trim("key") == ""), F.concat("kind", F.lit(" lacks its key"))).when(F.col("json").isNull() | ~F.coalesce(F.expr("try_parse_json(json) IS NOT NULL"), F.lit(False)), F.concat("kind", F.lit(" isn't JSON")))
    errors = bundle.filter(known).withColumn("error", F.coalesce(lacking, wrong)).filter("error IS NOT NULL")
    told = errors.orderBy("place").limit(5).collect()
    if told:
        raise ValueError("; ".join(f"{r['place']}: {r['error']}" for r in told))
    counts = {r["kind"]: r["n"] for r in bundle.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # few kinds
    tables = {}
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("place")))
    for kind in rules:
        if kind in counts:
            new = bundle.filter(F.col("kind") == kind).withColumn("_r", last).filter("_r = 1").select("key", "json")
            old = store.read(kind, before)
            tables[kind] = new if old is None else old.join(new, "key", "left_anti").unionByName(new)
    if tables:
        store.commit(tables, before)
    return {"imported": {k: n for k, n in counts.items() if k in rules}, "ignored": {str(k): n for k, n in counts.items() if k not in rules}}
