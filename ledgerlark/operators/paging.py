"""Sorted listings: numbered top rows, pages and best-of-group texts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SORTS = {
    "price": lambda: [F.desc("p_retailprice"), F.asc("p_partkey")],
    "name": lambda: [F.asc("p_name"), F.asc("p_partkey")],
    "newest": lambda: [F.desc("p_partkey")],
}


def numbered_top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows with their place; only these rows are numbered."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def page(df: DataFrame, sort: str, page: int, size: int) -> DataFrame:
    """Rows of one page under a sort of the white list (an unknown one: the newest first), with total, pages and
    page, which is clamped to the pages that there are."""
    total = df.count()
    pages = max(1, -(-total // size))
    at = min(max(1, page), pages)
    order = SORTS.get(sort, SORTS["newest"])()
    rows = df.orderBy(*order).offset((at - 1) * size).limit(size)
    told = {"total": total, "pages": pages, "page": at}
    return rows.withColumns({name: F.lit(n).cast("bigint") for name, n in told.items()})


def best_and_rest(df: DataFrame, group: str, score: str, key: str, n: int) -> DataFrame:
    """``group`` and listing: the keys of its ``n`` best rows and how many more there are."""
    ranked = df.select(group, F.struct((-F.col(score)).alias("s"), F.col(key).alias("k")).alias("x"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("x"))
    top = ranked.withColumn("rn", place).where(F.col("rn") <= n).groupBy(group).agg(F.array_sort(F.collect_list("x")).alias("top"))
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform("top", lambda x: x["k"].cast("string")), ",")
    more = F.when(F.col("n") > n, F.concat(F.lit(" plus "), (F.col("n") - n).cast("string"), F.lit(" more"))).otherwise("")
    return sizes.join(top, group).select(group, F.concat(listed, more).alias("listing"))
