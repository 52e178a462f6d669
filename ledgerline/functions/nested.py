"""JSON of any shape as rows: a walk level by level with paths, references within, and checks against a declared shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.scratch import saved

#: Levels after which a document is refused.
DEEPEST = 64


def walked(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id, path, key, kind, value, item, lists, general``: every value of every document with its path (``$``, ``.key``, ``[place]``); value is its
    JSON text, kind OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID; text that isn't JSON has kind INVALID. item says
    whether an array holds it directly, lists has the keys of all arrays around it, outermost first ('' for an array in an array),
    general is the path with ``[]`` for every place.

    Each round explodes one level of all documents, so there are as many rounds as the deepest document has levels. Only containers
    are parsed again; the kind of any other value is told by how its text begins, of numbers by the text."""
    spark = rows.sparkSession
    level = rows.filter(F.col(json_col).isNotNull()).select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.col(json_col).alias("text"), F.lit(False).alias("item"), F.array().cast("array<string>").alias("lists"), F.lit("$").alias("general"))
    parsed = "regexp_extract(schema_of_variant(parse_json(text)), '^[A-Z]+', 0)"
    kinds = {"{": "OBJECT", "[": "ARRAY", '"': "STRING", "t": "BOOLEAN", "f": "BOOLEAN", "n": "VOID"}
    kind = F.expr(f"CASE substr(ltrim(' \t\n\r', text), 1, 1) {' '.join(f"WHEN '{c}' THEN '{k}'" for c, k in kinds.items())} ELSE {parsed} END")
    level = level.withColumn("kind", F.when(F.expr("try_parse_json(text) IS NULL"), "INVALID").otherwise(kind))
    found = []
    for _ in range(DEEPEST):
        level = saved(level, "level")
        found.append(level)
        inner = level.filter("kind IN ('OBJECT', 'ARRAY')").withColumnRenamed("key", "name")
        if not inner.limit(1).count():
            break
        step = "CASE WHEN kind = 'ARRAY' THEN concat(path, '[', x.pos, ']') ELSE concat(path, '.', x.key) END"
        general = "CASE WHEN kind = 'ARRAY' THEN concat(general, '[]') ELSE concat(general, '.', x.key) END"
        around = "CASE WHEN kind = 'ARRAY' THEN array_append(lists, name) ELSE lists END"
        level = spark.sql(f"SELECT id, {step} AS path, coalesce(x.key, '') AS key, to_json(x.value) AS text, kind = 'ARRAY' AS item, {around} AS lists, {general} AS general FROM {{inner}}, LATERAL variant_explode(parse_json(text)) AS x", inner=inner)
        level = level.withColumn("kind", kind)
    else:
        raise ValueError(f"a document has more than {DEEPEST} levels")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select(F.col("id").alias(id_col), "path", "key", "kind", F.col("text").alias("value"), "item", "lists", "general")


def references(values: DataFrame, id_col: str, ending: str) -> DataFrame:
    """``id, path, ref`` of every item of an array whose key has this ending, of the outermost ones: what lies within such an array is
    its items alone. ``values`` is the result of ``walked``; each row says itself which arrays it is in, so nothing is joined."""
    named = F.transform("lists", lambda key: F.coalesce(F.endswith(key, F.lit(ending)), F.lit(False)))
    first = F.array_position(named, F.lit(True))
    items = values.filter(F.col("item") & (first > 0) & (first == F.size("lists")))
    return items.select(id_col, "path", F.expr("CASE WHEN kind <> 'STRING' THEN value WHEN instr(value, '\\\\') > 0 THEN parse_json(value)::string ELSE substr(value, 2, length(value) - 2) END").alias("ref"))


def schema_errors(values: DataFrame, id_col: str, shape: dict[str, tuple[str, bool]]) -> DataFrame:
    """``id, path, error`` against ``shape``: path (array places as ``[]``) to kind and whether its container must have it. EXTRA for values
    that the shape doesn't name, KIND for others than it says, MISSING where a container lacks what it must have, INVALID for
    what isn't JSON."""
    spark = values.sparkSession
    parent = lambda p: F.regexp_replace(p, r"(\.[^.\[\]]+|\[[0-9]*\])$", "")
    declared = spark.createDataFrame([(p, k, must) for p, (k, must) in shape.items()], "general string, wanted string, must boolean")
    needed = declared.filter("must").groupBy(parent(F.col("general")).alias("general")).agg(F.collect_list(F.regexp_extract("general", r"\.([^.\[\]]+)$", 1)).alias("fields"))
    checked = values.join(F.broadcast(declared), "general", "left").join(F.broadcast(needed), "general", "left")  # as large as the shape
    error = F.when(F.col("kind") == "INVALID", "INVALID").when(F.col("wanted").isNull() & (F.col("path") != "$"), "EXTRA").when(F.col("wanted") != F.col("kind"), "KIND")
    lacked = F.when((F.col("kind") == "OBJECT") & F.col("fields").isNotNull(), F.array_except("fields", F.json_object_keys("value")))
    own = F.when(error.isNotNull(), F.array(F.struct("path", error.alias("error"))))
    lacking = F.transform(lacked, lambda field: F.struct(F.concat("path", F.lit("."), field).alias("path"), F.lit("MISSING").alias("error")))
    none = F.array().cast("array<struct<path:string,error:string>>")
    return checked.filter(error.isNotNull() | (F.size(lacked) > 0)).select(id_col, F.explode(F.concat(F.coalesce(own, none), F.coalesce(lacking, none))).alias("x")).select(id_col, "x.path", "x.error")
