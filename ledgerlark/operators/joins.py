"""Joins that Spark has no operator for: nearest in time, bands, overlapping intervals, points in intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.materialise import written


def nearest_in_group(df: DataFrame, group: str, date: str, key: str, k: int) -> DataFrame:
    """For each row the ``k`` rows of its group that are nearest in date: key, other, days, place.

    In a group ordered by (date, key) the k nearest are among the k before and the k after a row, so 2k
    candidates a row are ranked and no pairs of a group are made. Of equal distances the earlier date wins,
    then the row that is nearer in that order.
    """
    order = Window.partitionBy(group).orderBy(date, key)
    near = []
    for step in range(1, k + 1):
        for sign, f in ((0, F.lag), (1, F.lead)):
            near.append(F.struct(F.lit(sign).alias("later"), F.lit(step).alias("step"), f(key, step).over(order).alias("other"), f(date, step).over(order).alias("at")))
    candidates = df.select(key, date, F.filter(F.array(*near), lambda x: x["other"].isNotNull()).alias("near"))
    ranked = F.slice(
        F.array_sort(
            F.transform(
                "near",
                lambda x: F.struct(F.abs(F.datediff(x["at"], F.col(date))).alias("days"), x["later"], x["step"], x["other"]),
            )
        ),
        1,
        k,
    )
    placed = candidates.select(key, F.posexplode(ranked).alias("place", "r"))
    return placed.select(key, F.col("r.other").alias("other"), F.col("r.days").alias("days"), (F.col("place") + 1).alias("place"))


def band_nearest(
    left: DataFrame, right: DataFrame, group: str, left_date: str, right_date: str, left_key: str, right_key: str, days: int
) -> DataFrame:
    """For each left row the nearest right row of its group within ``days``: left_key, right_key, days.

    Dates are cut into slots of ``days``; a left row looks into its own slot and its neighbours, so the join
    is an equi-join with at most three slots a row. Ties go to the smaller right key. Left rows without
    a partner are left out.
    """
    slot = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / F.lit(days + 1))
    a = left.select(group, left_key, F.col(left_date).alias("__a"), F.explode(F.array(*[slot(F.col(left_date)) + i for i in (-1, 0, 1)])).alias("__slot"))
    b = right.select(group, right_key, F.col(right_date).alias("__b"), slot(F.col(right_date)).alias("__slot"))
    gap = F.abs(F.datediff("__a", "__b"))
    near = a.join(b, [group, "__slot"]).where(gap <= days)
    best = near.groupBy(left_key).agg(F.min(F.struct(gap.alias("days"), F.col(right_key))).alias("best"))
    return best.select(left_key, F.col(f"best.{right_key}").alias(right_key), F.col("best.days").alias("days"))


def cascade(*matches: DataFrame, key: str) -> DataFrame:
    """The matches of the first list that has any for a key; each list has the same columns."""
    tagged = [m.withColumn("__tier", F.lit(i)) for i, m in enumerate(matches)]
    whole = tagged[0]
    for m in tagged[1:]:
        whole = whole.unionByName(m)
    rest = [c for c in matches[0].columns if c != key]
    best = whole.groupBy(key).agg(F.min(F.struct("__tier", *rest)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in rest], F.col("b.__tier").alias("tier"))


def overlaps(left: DataFrame, right: DataFrame, group: str, width: float) -> DataFrame:
    """Pairs of intervals (start, end) of a group that overlap: all columns of both sides, and overlap.

    Time is cut into bins of ``width``; each side is present in the bins that it touches and a pair is kept
    in the bin where its overlap begins, so that it comes once and bins of a long group part.
    """
    bins = lambda d: F.sequence(F.floor(d["start"] / width), F.floor(d["end"] / width))
    a = left.select("*", F.explode(bins(left)).alias("__bin"))
    b = right.select(
        group,
        F.col("start").alias("other_start"),
        F.col("end").alias("other_end"),
        *[c for c in right.columns if c not in (group, "start", "end")],
        F.explode(bins(right)).alias("__bin"),
    )
    begin = F.greatest("start", "other_start")
    shared = F.least("end", "other_end") - begin
    pairs = a.join(b, [group, "__bin"]).where((F.col("start") < F.col("other_end")) & (F.col("end") > F.col("other_start")))
    return pairs.where(F.floor(begin / width) == F.col("__bin")).withColumn("overlap", shared).drop("__bin")


def point_in_interval(
    points: DataFrame, intervals: DataFrame, group: str, point_key: str, interval_key: str, pad: float, reach: float
) -> DataFrame:
    """For each point (at) the interval (start, end) of its group that it is of: point_key, interval_key, inside.

    An interval padded by ``pad`` that holds the point wins, the earliest of several; else the interval whose
    nearer end is within ``reach``, the nearest, then the earliest. Points without any are left out. Bins of
    the width of ``reach`` make this an equi-join.
    """
    width = max(pad, reach)
    a = points.select(group, point_key, "at", F.floor(F.col("at") / width).alias("__bin"))
    covered = F.sequence(F.floor((F.col("start") - width) / width), F.floor((F.col("end") + width) / width))
    b = intervals.select(group, interval_key, "start", "end", F.explode(covered).alias("__bin"))
    inside = (F.col("at") >= F.col("start") - pad) & (F.col("at") <= F.col("end") + pad)
    distance = F.least(F.abs(F.col("at") - F.col("start")), F.abs(F.col("at") - F.col("end")))
    near = a.join(b, [group, "__bin"]).where(inside | (distance <= reach))
    rank = F.struct(
        F.when(inside, 0).otherwise(1).alias("outside"),
        F.when(inside, 0.0).otherwise(distance).alias("distance"),
        "start",
        F.col(interval_key).alias("k"),
    )
    best = near.groupBy(point_key).agg(F.min(rank).alias("b"))
    return best.select(point_key, F.col("b.k").alias(interval_key), (F.col("b.outside") == 0).alias("inside"))


def co_occurring(bridge: DataFrame, group: str, member: str, most: int = 2048, pairs: int = 1 << 20) -> DataFrame:
    """Pairs of members of one group with the number of groups that hold both: a, b (a < b), n.

    Repeated members of a group count once. A group of more than ``most`` members is dealt to blocks by their hashes, and its
    pairs are made for each pair of blocks by itself, so no task makes more than about ``most`` squared at once; a smaller
    group is one block. The counts are the same. Pairs hardly repeat within a task, so they are counted after they are dealt to as
    many tasks as it takes for each to have about ``pairs``.
    """
    once = bridge.select(group, member).where(F.col(group).isNotNull()).distinct()
    blocks = once.groupBy(group).agg(F.count("*").alias("__c"))
    dealt = once.join(blocks.withColumn("__n", F.ceil(F.col("__c") / most).cast("int")), group)
    dealt = written(dealt.withColumn("__own", F.pmod(F.xxhash64(member), F.col("__n")).cast("int")))
    in_all = dealt.agg(F.sum((F.col("__c") - 1) / 2)).first()[0] or 0
    every = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    left = dealt.select(group, F.col(member).alias("a"), F.col("__own").alias("__i"), every.alias("__j"))
    right = dealt.select(group, F.col(member).alias("b"), F.col("__own").alias("__j"), every.alias("__i"))
    both = left.join(right, [group, "__i", "__j"]).where("a < b").select("a", "b")
    return both.repartition(int(in_all / pairs) + 1, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


def fallback_lookup(keys: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` from the first store, else from the second: key, value, store."""
    a = first.select(key, F.col(value).alias("__a"))
    b = second.select(key, F.col(value).alias("__b"))
    both = keys.select(key).join(a, key, "left").join(b, key, "left")
    store = F.when(F.col("__a").isNotNull(), "first").when(F.col("__b").isNotNull(), "second")
    return both.select(key, F.coalesce("__a", "__b").alias(value), store.alias("store"))


def same_key_as_text(c: Column) -> Column:
    """A key as text: whole numbers without leading zeros, all else as it is."""
    return F.coalesce(c.try_cast("bigint").cast("string"), c.cast("string"))
