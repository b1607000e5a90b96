"""Incremental work: what a scheduled run does with rows that are new since the last one.

The batch forms take the stored state as a DataFrame; the streaming forms keep it in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def above_mark(df: DataFrame, key: str, stored: DataFrame) -> DataFrame:
    """Rows with a key above the largest stored one, and that mark: numeric keys alone count."""
    number = F.col(key).cast("string").try_cast("bigint")
    mark = stored.agg(F.coalesce(F.max(F.col(key).cast("string").try_cast("bigint")), F.lit(-1)).alias("__mark"))
    return df.join(F.broadcast(mark)).where(number > F.col("__mark")).drop("__mark")


def recheck(df: DataFrame, date: str, done: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` before the newest one that aren't done: late updates are looked for there."""
    newest = df.agg(F.max(date).alias("__now"))
    return df.join(F.broadcast(newest)).where((F.datediff("__now", date) <= days) & ~done).drop("__now")


def changed(df: DataFrame, state: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose content digest isn't the stored one: ``df`` with digest and status (new, changed)."""
    digest = F.sha1(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]))
    now = df.withColumn("digest", digest)
    before = state.select(key, F.col("digest").alias("__old"))
    joined = now.join(before, key, "left").where(~F.col("digest").eqNullSafe(F.col("__old")))
    return joined.withColumn("status", F.when(F.col("__old").isNull(), "new").otherwise("changed")).drop("__old")


def attempts(df: DataFrame, log: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Rows tried fewer than ``most`` times, with tried."""
    tried = log.groupBy(key).agg(F.count("*").alias("tried"))
    return df.join(tried, key, "left").withColumn("tried", F.coalesce("tried", F.lit(0))).where(F.col("tried") < most)


def rate_windows(events: DataFrame, key: str, ts: str, width: str, slide: str, limit: int, late: str) -> DataFrame:
    """Windows of a key with at least ``limit`` events; rows later than ``late`` are dropped in a stream."""
    timed = events.withWatermark(ts, late)
    grouped = timed.groupBy(F.window(ts, width, slide), key).agg(F.count("*").alias("n"))
    return grouped.where(F.col("n") >= limit).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key parted by gaps: start, end and n."""
    timed = events.withWatermark(ts, late)
    grouped = timed.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each key once: repeats within the lateness are dropped from the stream's state."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, checkpoint: str, store: Callable[[DataFrame, int], None]) -> None:
    """Process what is there and stop, as a scheduled run: every batch goes to ``store`` (rows, batch number).

    Spark records finished batches in ``checkpoint``; ``store`` may see a batch again after a failure and
    so must be idempotent, as inserts that ignore stored keys are.
    """
    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def insert_new(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``store`` that appends to the Parquet table at ``path`` the rows whose key isn't there yet."""

    def store(batch: DataFrame, number: int) -> None:
        spark, once = batch.sparkSession, batch.dropDuplicates(keys)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            once = once.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        once.write.mode("append").parquet(path)

    return store
