"""Set operations with priorities."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_first_wins(lists: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of the lists, one for each key: that of the earliest list."""
    columns = lists[0].columns
    tagged = [df.select(*columns).withColumn("__list", F.lit(i)) for i, df in enumerate(lists)]
    rest = [c for c in columns if c not in keys]
    first = F.min(F.struct("__list", *rest)).alias("r")
    whole = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(first)
    return whole.select(*[c if c in keys else F.col(f"r.{c}") for c in columns])


def first_not_empty(lists: list[DataFrame]) -> DataFrame:
    """The first list that has rows; an empty one if none has."""
    for df in lists[:-1]:
        if not df.isEmpty():
            return df
    return lists[-1]
