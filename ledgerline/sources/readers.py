"""Readers and writers of records: CSV, JSON lines with their errors, columnar payloads, replace-loads and stored bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_strings(spark: SparkSession, path: str, *, separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header, every column a string, quoted line breaks kept; empty fields are empty, not null."""
    return spark.read.option("header", True).option("sep", separator).option("encoding", encoding).option("multiLine", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000").csv(path)


def csv_written(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns in this order with a header, quotes doubled."""
    rows.select(*columns).write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The records of JSON lines, and the lines (file, text) that aren't records of the schema."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file")).filter(F.trim("line") != "")
    read = lines.withColumn("x", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad = F.col("x").isNull() | F.col("x._bad").isNotNull()
    return read.filter(~bad).select("x.*").drop("_bad"), read.filter(bad).select("file", F.col("line").alias("text"))


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of JSON lines; a line that is none fails the job."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def columnar(payload: Column, names: Column, wanted: list[str]) -> Column:
    """Rows of a payload (array of arrays) under its column names as structs of the wanted columns; null for one it lacks."""
    at = [F.array_position(names, w).cast("int") for w in wanted]
    return F.transform(payload, lambda r: F.struct(*(F.when(k > 0, F.get(r, k - 1)).alias(w) for w, k in zip(wanted, at, strict=True))))


def replaced(rows: DataFrame, path: str, by: str) -> None:
    """Write ``rows`` in partitions of ``by``, replacing those that ``rows`` has and leaving others alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def stored_bodies(rows: DataFrame, body: str, path: str) -> None:
    """Bodies under their hashes: one row a hash, those already there are not written again."""
    new = rows.select(F.sha2(body, 256).alias("sha256"), F.col(body).alias("body")).dropDuplicates(["sha256"])
    spark = rows.sparkSession
    try:
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)
