"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the contracts: space and the five controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; all other letters stay."""
    return F.translate(text, UPPER, LOWER)


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The column with null as the empty text."""
    return F.coalesce(docs[column], F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting gets a temporary folder; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Within it, the files of a query's shuffles go as soon as the query has ended, not when the driver next collects garbage.

    It is for steps that are written one by one, as no later query reads what they shuffled.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that was written here and that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Let Arrow batches hold at most ``rows`` rows, as single texts may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def pieces_of(texts: list[str], chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Where to cut a list of texts, so that the texts between two cuts have about ``chars`` characters at most.

    It bounds what numpy holds for a batch; a longer text stands alone.
    """
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > chars:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if texts:
        yield begin, len(texts)


def clear(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that have one of these names in any case; results replace such columns."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


#: A list of at most this many ids is broadcast, so that texts stay where they are; a longer one is joined by a shuffle.
BROADCAST_IDS = 1 << 20


def few(ids: DataFrame) -> bool:
    """Whether a written list of ids is short enough to be broadcast."""
    return ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def of_ids(rows: DataFrame, ids: DataFrame, how: str, key: str = "text_hash") -> DataFrame:
    """Semi or anti join of ``rows`` with the distinct ``ids``: if they are few, rows that none concerns don't travel."""
    ids = cut(ids)
    if not few(ids):
        return rows.join(ids, key, how)
    maybe, others = parted(rows, ids, key)
    found = maybe.join(ids, key, how)
    return found if how == "left_semi" else found.unionByName(others)


def parted(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among few ``ids``, and those whose isn't: by a broadcast of 64-bit hashes."""
    hashes = F.broadcast(ids.select(F.xxhash64(key).alias("__hash")))
    own = rows.withColumn("__hash", F.xxhash64(key))
    return tuple(own.join(hashes, "__hash", how).drop("__hash") for how in ("left_semi", "left_anti"))


def document_key(doc_id: Column, text_hash: Column) -> Column:
    """A row's identity: its doc_id, which may be null, and the hash of its text."""
    return F.struct(F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), doc_id.isNull().alias("none"), text_hash.alias("hash"))


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with its long ``keys`` recomputed, so that Spark shuffles this side for the very join it goes into.

    Adaptive execution splits the partition of a hot key only where both sides were shuffled for the join; a
    side that comes out of an aggregate by the same keys would be joined as it lies, hot key and all.
    """
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("bigint")) for k in keys})
