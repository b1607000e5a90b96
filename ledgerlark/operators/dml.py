"""Changes of stored tables as DataFrames: what the table is after an insert, upsert, merge or delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``old`` and those rows of ``new`` whose key isn't there; of several new rows the first in ``order``."""
    first = new.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """All keys, each with its whole row of the largest ``version``; new rows win over old ones."""
    rest = [c for c in old.columns if c not in keys]
    tagged = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    best = F.max(F.struct("__new", *version, *[c for c in rest if c not in version])).alias("b")
    rows = tagged.groupBy(*keys).agg(best)
    return rows.select(*[c if c in keys else F.col(f"b.{c}").alias(c) for c in old.columns])


def merge_columns(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """All keys with columns merged by rule: max, old (unless null), new (unless null), text (new unless null or empty),
    if_empty (new where the old is null or empty)."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    pick = {
        "max": lambda x, y: F.greatest(x, y),
        "old": lambda x, y: F.coalesce(x, y),
        "new": lambda x, y: F.coalesce(y, x),
        "text": lambda x, y: F.coalesce(F.nullif(y, F.lit("")), x),
        "if_empty": lambda x, y: F.coalesce(F.nullif(x, F.lit("")), y),
    }
    merged = [pick[rule](F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c, rule in rules.items()]
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *merged)


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` without the rows whose key is listed (tombstones, cascades)."""
    return df.join(gone.select(*keys), keys, "left_anti")


def delete_orphans(df: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` without rows that have no parent."""
    return df.join(parents.select(*keys), keys, "left_semi")


def replace_partitions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with all rows of the keys in ``new`` replaced by those of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def keep_newest(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The ``n`` newest rows of each group."""
    over = Window.partitionBy(group).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(over)).where(F.col("__r") <= n).drop("__r")
