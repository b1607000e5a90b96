"""Ordered computations: islands, gaps, neighbours, carried values and cut-offs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import text
from ledgerlark.operators.materialise import written


def islands(df: DataFrame, group: list[str], order: list, changes: Column, name: str = "island") -> DataFrame:
    """``df`` with the number of each row's island: a row for which ``changes`` holds begins a new one.

    ``changes`` may use lag(...) over ``order_window`` of the same arguments; null counts as a change.
    """
    over = Window.partitionBy(*group).orderBy(*order)
    flagged = df.withColumn("__new", F.when(F.coalesce(changes, F.lit(True)), 1).otherwise(0))
    return flagged.withColumn(name, F.sum("__new").over(over)).drop("__new")


def order_window(group: list[str], order: list) -> Window:
    return Window.partitionBy(*group).orderBy(*order)


def gap(at: str, over: Window) -> Column:
    """Seconds since the row before in ``over``, with their fractions; null at the first row."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return (micros - F.lag(micros).over(over)) / 1e6


def neighbours(df: DataFrame, group: str, order: str, column: str, reach: int, name: str) -> DataFrame:
    """``df`` with the texts of the rows up to ``reach`` before and after, in order, joined by a line feed."""
    over = Window.partitionBy(group).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumn(name, F.array_join(F.collect_list(column).over(over), "\n"))


def every_nth(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first of every ``n`` rows in a total order.

    Rows are range-partitioned by the order; the rows before each range are counted, so that no task numbers
    the whole table.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("__before", before).drop("__n")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before") - 1
    numbered = ranged.join(F.broadcast(starts), "__part").withColumn("__place", place)
    return numbered.where(F.col("__place") % n == 0).drop("__part", "__before", "__place")


def running_sum(df: DataFrame, group: str, order: str, column: str, name: str) -> DataFrame:
    """``df`` with the sum of ``column`` over the rows of its group up to each row; equal places count together.

    Rows are range-partitioned by group and order; each range adds what its group has in the ranges before, so a group may
    be larger than a task.
    """
    ranged = df.repartitionByRange(group, order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged)
    sums = ranged.groupBy(group, "__part").agg(F.sum(column).alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    own = F.sum(column).over(Window.partitionBy("__part", group).orderBy(order))
    joined = ranged.join(sums.select(group, "__part", F.coalesce(before, F.lit(0)).alias("__b")), [group, "__part"])
    return joined.withColumn(name, own + F.col("__b")).drop("__part", "__b")


def carry_forward(df: DataFrame, group: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """``df`` with the last value of ``column`` that isn't null up to each row."""
    over = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(over))


def before_empty_run(df: DataFrame, group: list[str], order: list[str], empty: Column, n: int) -> DataFrame:
    """Rows of each group before its first run of ``n`` rows for which ``empty`` holds (the run is left out)."""
    over = Window.partitionBy(*group).orderBy(*order)
    flagged = df.withColumn("__e", F.coalesce(empty, F.lit(False)).cast("int"))
    # a run of n begins at a row if it and the n - 1 after it are empty
    ahead = F.sum("__e").over(over.rowsBetween(0, n - 1))
    stop = F.max((F.col("__ahead") == n).cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("__ahead", ahead).withColumn("__stop", stop).where("__stop = 0").drop("__e", "__ahead", "__stop")


def _turn_starts(before: np.ndarray, most: int) -> np.ndarray:
    """The number of the turn of each row of a run: a turn takes rows while it has fewer than ``most`` words.

    ``before`` counts the run's words before each row. A turn's next one begins at the first row with ``most`` words between,
    so turns are found by jumps and not row by row.
    """
    first, at = np.zeros(len(before), np.int64), 0
    while at < len(before):
        at = max(at + 1, int(np.searchsorted(before, before[at] + most)))
        first[at : at + 1] = 1
    return first.cumsum()


EXPRESSIVE = ("positive", "negative")


def merge_turns(df: DataFrame, group: str, max_gap: float = 2.0, max_words: int = 300) -> DataFrame:
    """Consecutive utterances (speaker, start, end, text, sentiment) of a speaker as one turn, a row each.

    A turn ends where the speaker changes, after a gap of ``max_gap`` or more, and once it has ``max_words`` words. It has the
    sentiment of its first utterance, or, where that is neutral (or null), the first one that isn't. A null text is empty, the column
    sentiment may be missing. Runs between changes and gaps come from windows; of those with enough words for the cap to
    matter only the counts of words are looked at further, each run by itself.
    """
    sentiment = F.col("sentiment") if "sentiment" in df.columns else F.lit(None).cast("string")
    rows = df.select(group, "speaker", "start", "end", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(sentiment, F.lit("neutral")).alias("sentiment"))
    rows = rows.withColumn("__n", text.word_count(F.col("text")).cast("bigint"))
    order = Window.partitionBy(group).orderBy("start", "end", "text")
    goes_on = F.col("speaker").eqNullSafe(F.lag("speaker").over(order)) & (F.col("start") - F.lag("end").over(order) < max_gap)
    rows = rows.withColumn("__i", F.row_number().over(order)).withColumn("__new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(group, "__run")
    ahead = run.orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).withColumn("__all", F.sum("__n").over(run))
    kind = df.schema[group].dataType.simpleString()

    def cut(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("__i")
        return pd.DataFrame({"__g": batch[group], "__at": batch["__i"], "__turn": _turn_starts(batch["__before"].to_numpy(), max_words)})

    counts = rows.where(F.col("__all") >= max_words).select(group, "__run", "__i", "__before")
    turns = counts.groupBy(group, "__run").applyInPandas(cut, f"__g {kind}, __at int, __turn bigint")
    rows = rows.join(turns, F.col("__g").eqNullSafe(F.col(group)) & (F.col("__at") == F.col("__i")), "left")
    one = F.struct("__i", "start", "end", "text", "sentiment")
    whole = rows.groupBy(group, "__run", F.coalesce("__turn", F.lit(0)).alias("__turn")).agg(F.first("speaker").alias("speaker"), F.array_sort(F.collect_list(one)).alias("__u"))
    number = F.row_number().over(Window.partitionBy(group).orderBy("__run", "__turn")) - 1
    felt = F.filter("__u", lambda x: x["sentiment"].isin(*EXPRESSIVE))
    first = F.col("__u")[0]
    return whole.select(
        group,
        number.alias("turn_no"),
        "speaker",
        first["start"].alias("start"),
        F.element_at("__u", -1)["end"].alias("end"),
        F.array_join(F.transform("__u", lambda x: x["text"]), " ").alias("text"),
        F.size("__u").alias("n_merged"),
        F.when(first["sentiment"] == "neutral", F.coalesce(F.get(felt, F.lit(0))["sentiment"], F.lit("neutral"))).otherwise(first["sentiment"]).alias("sentiment"),
    )


def joined_runs(df: DataFrame, group: str, order: str, speaker: str, column: str, most: int = 3) -> DataFrame:
    """``group``, ``order``, length and joined: each row's text alone, and with those of the next one to ``most - 1`` rows while
    these are of the same speaker; a quote that runs over several rows is in one of them."""
    over = Window.partitionBy(group).orderBy(order)
    ahead = [F.struct(F.lead(speaker, k).over(over).alias("speaker"), F.lead(column, k).over(over).alias("text")) for k in range(1, most)]
    rows = df.select(group, order, F.array(F.struct(F.col(speaker).alias("speaker"), F.col(column).alias("text")), *ahead).alias("__r"))
    found = []
    for k in range(1, most + 1):
        part = F.slice("__r", 1, k)
        same = F.forall(part, lambda x: F.coalesce(x["speaker"] == F.col("__r")[0]["speaker"], F.lit(False)))
        said = F.array_join(F.transform(part, lambda x: x["text"]), " ")
        run = F.struct(F.lit(k).alias("length"), said.alias("joined"))
        found.append(run if k == 1 else F.when(same, run))
    return rows.select(group, order, F.inline(F.array_compact(F.array(*found))))


def caption_overlap(previous: list[str], current: list[str], most: int = 30) -> int:
    """How many words at the end of ``previous`` begin ``current``: the largest number."""
    for n in range(min(len(previous), len(current), most), 0, -1):
        if previous[-n:] == current[:n]:
            return n
    return 0


def drop_caption_overlap(df: DataFrame, group: str, order: str, column: str, kind: str = "long") -> DataFrame:
    """``group``, ``order`` and the text of each caption without the words that rolled over from the one before.

    The words of the caption before are all that a row depends on, so this is a window and a function of two texts.
    """

    @F.pandas_udf(df.schema[column].dataType)
    def fresh(before: pd.Series, now: pd.Series) -> pd.Series:
        def one(a, b):
            b = (b or "").split()
            return " ".join(b[caption_overlap((a or "").split(), b) :])

        return pd.Series([one(a, b) for a, b in zip(before, now, strict=True)])

    over = Window.partitionBy(group).orderBy(order)
    return df.select(group, order, fresh(F.lag(column).over(over), F.col(column)).alias(column))
