"""Nested values: JSON with defaults, elements of two types, and trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_value(c: Column, path: str, default=None) -> Column:
    """The value at a path as text, else the default; malformed JSON has none."""
    found = F.get_json_object(F.when(F.try_parse_json(c).isNotNull(), c), path)
    return found if default is None else F.coalesce(found, F.lit(default))


def names_of(c: Column, path: str = "$") -> Column:
    """The names in a JSON array whose elements are strings or objects with a name; others are left out."""
    items = F.from_json(F.get_json_object(c, path), "array<string>")
    name = lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x)
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), name), lambda x: x.isNotNull() & (x != ""))


def flatten_tree(df: DataFrame, key: str, column: str, depth: int = 8) -> DataFrame:
    """key, path, title, level and attachments of every item of a JSON tree (title, children, attachments).

    Every level is an explode of the level above, so the tree is spread like any other rows. Trees deeper than
    ``depth`` raise an error rather than lose items.
    """
    item = "array<struct<title:string,children:string,attachments:array<struct<name:string,url:string>>>>"
    level = df.select(key, F.lit("").alias("path"), F.col(column).alias("__c"))
    found = []
    for n in range(depth + 1):
        rows = level.select(key, "path", F.posexplode(F.from_json("__c", item)).alias("place", "i"))
        title = F.coalesce("i.title", F.lit(""))
        path = F.when(F.col("path") == "", title).otherwise(F.concat_ws(" > ", "path", title))
        here = rows.select(key, path.alias("path"), title.alias("title"), F.lit(n).alias("level"), "i.attachments", F.col("i.children").alias("__c"))
        if n == depth:
            here = here.withColumn("path", F.when(F.lit(True), F.raise_error(F.lit("the tree is deeper than allowed"))).cast("string"))
        found.append(here.drop("__c"))
        level = here.select(key, "path", "__c").where(F.col("__c").isNotNull())
    return reduce(DataFrame.unionByName, found)


def attachments_of(tree: DataFrame, key: str) -> DataFrame:
    """key, path, name, url and kind of the attachments of a flattened tree."""
    rows = tree.select(key, "path", F.explode("attachments").alias("a")).select(key, "path", "a.name", "a.url")
    kind = F.when(F.col("url").ilike("%.pdf"), "pdf").when(F.col("url").rlike("^https?://"), "external").otherwise("file")
    return rows.withColumn("kind", kind)


def last_item(c: Column) -> Column:
    """The last element; null of an empty or null array."""
    return F.try_element_at(c, F.lit(-1))
