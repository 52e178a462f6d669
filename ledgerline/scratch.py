"""Tables in the folder that driver and executors share; what is written there outlives lost executors and ends lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one; a cluster, whose
    machines would each write to their own disk, is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def saved(df: DataFrame, name: str, *, together: int = 0) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back. Spark reads up to 4,096 rows of a row group at once, and writes no
    group of less than 100; rows of some MB each need groups of ``together``."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.option("parquet.block.row.count.limit", together) if together else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, in ``n`` buckets by ``keys``; tasks read buckets where they would else shuffle.
    Its name is out of the catalog again, the files stay."""
    spark, name = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, *keys).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def spread(df: DataFrame, n: int, *keys: Column | str, each: int = 1 << 20) -> DataFrame:
    """``df``, which has ``n`` rows, hashed by ``keys`` to tasks of about ``each`` rows. Spark merges no tasks whose number is given,
    so what a task holds follows neither the table's size nor the session's number of partitions."""
    return df.repartition(max(-(-n // each), df.sparkSession.sparkContext.defaultParallelism), *keys)
