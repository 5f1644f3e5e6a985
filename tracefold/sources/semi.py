"""Events whose attributes lie in a semi-structured column: their schema, and their attributes as long rows.

The column is parsed once as VARIANT. Its schema over all rows (``schema_of_variant_agg``) says how deep objects nest; then every level of all rows is
unfolded by one lateral pass. Nothing is known of the keys beforehand, and a key's values may be of several types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(events: DataFrame, column: str, out: str = "parsed") -> DataFrame:
    """The JSON text of ``column`` as VARIANT; null where it is absent or isn't JSON."""
    return events.withColumn(out, F.try_parse_json(F.col(column)))


def schema_of(events: DataFrame, column: str = "parsed") -> str:
    """The schema that all rows of a VARIANT column have in common, as a type's text; fields of several types are VARIANT. One aggregate, merged across tasks."""
    return events.agg(F.schema_of_variant_agg(F.col(column)).alias("s")).first()["s"] or "VOID"


def depth_of(schema: str) -> int:
    """How deep objects nest in the schema's text; objects inside of arrays don't count, arrays are values."""
    depth = most = arrays = 0
    open_: list[str] = []
    for i, c in enumerate(schema):
        if c == "<":
            kind = "ARRAY" if schema[:i].endswith("ARRAY") else "OBJECT"
            open_.append(kind)
            arrays += kind == "ARRAY"
            depth += kind == "OBJECT" and not arrays
            most = max(most, depth)
        elif c == ">":
            kind = open_.pop()
            depth -= kind == "OBJECT" and not arrays
            arrays -= kind == "ARRAY"
    return most


def attribute_rows(events: DataFrame, keys: list[str], column: str = "parsed", prefix: str = "") -> DataFrame:
    """``keys, attribute, value, type``: a row for each leaf of each event's object; nested keys are joined by dots, arrays are values as text, JSON nulls are null.

    Objects without fields, and rows whose column is null or no object, give nothing.
    """
    spark = events.sparkSession
    left = events.select(*keys, F.lit(prefix).alias("attribute"), F.col(column).alias("_v"), F.schema_of_variant(F.col(column)).alias("type")).where(F.col("type").startswith("OBJECT"))
    done = None
    deep = depth_of(schema_of(events, column))
    # a field whose type differs from row to row hides what nests in it, so what is left is asked too
    while deep > 0 or not left.isEmpty():
        unfolded = left.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).toDF("_pos", "_key", "_value"))
        name = F.when(F.col("attribute") == "", F.col("_key")).otherwise(F.concat("attribute", F.lit("."), "_key"))
        rows = unfolded.select(*keys, name.alias("attribute"), F.col("_value").alias("_v"), F.schema_of_variant("_value").alias("type"))
        nested = F.coalesce(F.col("type").startswith("OBJECT"), F.lit(False))
        leaves = rows.where(~nested).select(*keys, "attribute", F.col("_v").cast("string").alias("value"), "type")
        done = leaves if done is None else done.unionByName(leaves)
        left, deep = rows.where(nested), deep - 1
    return done if done is not None else left.select(*keys, "attribute", F.lit(None).cast("string").alias("value"), "type")


def first_of_case(rows: DataFrame, case: list[str], order: Column, suffix: str = "__first") -> DataFrame:
    """``case, attribute, level, value``: of each event attribute the first value of the case that isn't missing."""
    first = rows.where("value is not null").groupBy(*case, "attribute").agg(F.min_by("value", order).alias("value"))
    return first.select(*case, F.concat("attribute", F.lit(suffix)).alias("attribute"), F.lit("event").alias("level"), "value")


def with_absent(found: DataFrame, cases: DataFrame, case: list[str], most: int = 10_000) -> DataFrame:
    """A row for each case and attribute, as of a wide table; absent values are null. ``cases``: ``case`` and the variant.

    Attributes of a case table are columns, so more than ``most`` of them (keys that are data themselves) are an error.
    """
    names = found.select("attribute", "level").distinct().limit(most + 1).collect()
    if len(names) > most:
        raise ValueError(f"more than {most} attributes: the keys look like data")
    columns = F.array(*(F.struct(F.lit(r["attribute"]).alias("attribute"), F.lit(r["level"]).alias("level")) for r in names)) if names else F.array().cast("array<struct<attribute:string,level:string>>")
    grid = cases.withColumn("_a", F.explode(columns)).select("*", "_a.attribute", "_a.level").drop("_a")
    return grid.join(found.select(*case, "attribute", "value"), [*case, "attribute"], "left")
