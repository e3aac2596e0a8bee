"""Nested JSON of any depth, as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import saved

#: Ends of the keys whose strings are paths (fixed values).
PATH_KEYS = ("file", "files", "path", "paths", "filename", "filenames")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def strings(rows: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """`id_column`, key, value and place of every string inside the JSON objects of a column, however deep.

    A list's strings have the key of the list.  Objects and lists are opened level by level, all rows at once, until none is
    left, so no depth is fixed.  `place` orders the strings of a row: by key at each level, and by index in lists (VARIANT
    keeps no other order of keys).  Null, invalid JSON and JSON that is no object give no rows.
    """
    spark = rows.sparkSession
    level = rows.select(id_column, F.try_parse_json(json_column).alias("v"), F.lit("").alias("key"), F.array().cast("array<string>").alias("place"))
    level = level.where(_kind(F.col("v")).startswith("OBJECT"))
    found = None
    while True:
        opened = level.select(id_column, F.col("key").alias("above"), "place", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("own"), F.col("value")))
        step = F.coalesce("own", F.lpad(F.col("pos").cast("string"), 12, "0"))
        level = saved(opened.select(id_column, F.coalesce("own", "above").alias("key"), F.col("value").alias("v"), F.concat("place", F.array(step)).alias("place"), _kind(F.col("value")).alias("kind")))
        own = level.where("kind = 'STRING'").select(id_column, "key", F.variant_get("v", "$", "string").alias("value"), "place")
        found = own if found is None else found.unionByName(own)
        level = level.where(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY"))
        if level.isEmpty():
            return found


def path_hints(rows: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """`id_column` and paths: the distinct strings under keys that end like a path's, in order of place; one row for each id.

    Keys are compared in lower case, with `-` as `_`.  Rows without any, with null or invalid JSON have an empty list.
    """
    key = F.translate(F.lower("key"), "-", "_")
    hinted = strings(rows, id_column, json_column).where((F.col("value") != "") & F.regexp_like(key, F.lit(f"({'|'.join(PATH_KEYS)})$")))
    first = hinted.groupBy(id_column, "value").agg(F.min("place").alias("place"))
    listed = first.groupBy(id_column).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("paths"))
    return rows.select(id_column).distinct().join(listed, id_column, "left").select(id_column, F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))
