"""Benchmark decontamination: exact containment of item-sized windows in documents.

Only DataFrame functions are used. It is a prefix-filtered set join: every window of an item needs all of its
shingles, so its rarest shingle over the whole corpus is a sufficient prefix. Documents are probed with those
shingles alone; the positions of both sides fix one alignment, which must leave room for the window
(length and positional bounds) and is verified word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, clear, cut, document_key, of_ids

#: What stands between words: ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A probe table of at most this many bytes is broadcast at a time; a larger one is probed in several blocks.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1), "")


def _shingle(words: Column, pos: Column, word: Column, k: int) -> Column:
    return F.xxhash64(word, *[F.get(words, pos + i) for i in range(1, k)], F.lit(k))


def _probed(docs: DataFrame, table: DataFrame, table_bytes: int, sizes: list[int]) -> DataFrame:
    """Word positions of ``docs`` (words and others) whose shingle is a ``key`` of ``table``.

    Each block of the table is broadcast; the positions are never shuffled. What is done with the positions
    must not filter by words, as Spark would move such a filter into the join and out of generated code.
    """
    blocks = max(1, -(-table_bytes // BROADCAST_BYTES))
    n = F.size("words")
    at = docs.select("*", F.posexplode("words").alias("pos", "word"))
    shingled = [
        at.where(F.col("pos") + k <= n).withColumn("key", _shingle(F.col("words"), F.col("pos"), F.col("word"), k))
        for k in sizes
    ]
    hits = [
        part.drop("word").join(F.broadcast(table.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)), "key")
        for part in shingled
        for b in range(blocks)
    ]
    return reduce(DataFrame.unionByName, hits)


def _run(words: Column, pos: Column, other: Column, at: Column, most: Column, step: int) -> Column:
    """How many words agree from ``pos`` and ``at`` on, going by ``step``, ``most`` at most."""
    same = F.transform(
        F.sequence(F.lit(0), most - 1),
        lambda i: F.coalesce(F.get(words, pos + i * step) == F.get(other, at + i * step), F.lit(False)),
    )
    first_other = F.array_position(same, False)
    return F.when(first_other == 0, most).otherwise(first_other - 1).cast("int")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """``docs`` (doc_id, text and any others) with n_words, n_hit and item_ids.

    ``items`` has item_id and text. A window is ``window`` consecutive words of an item; an item of fewer, but
    at least one, is one window. A word of a document inside any occurrence of a window is hit; item_ids
    are the items with such windows, as strings in order, each once.

    Null or empty text has no words. Rows that repeat a doc_id are judged each by its own text; a null doc_id
    is judged like any other. A null item_id marks words but is not listed. Without items or documents
    nothing is hit. Words may be of any length. Columns of docs that are
    named as a result are replaced.
    """
    docs = clear(docs, "n_words", "n_hit", "item_ids", "__words")
    marks = hits(docs, items, window, shingle)
    # upper and lower case have the same words, so they are counted without lowering
    counted = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), GAP, -1), ""))
    left = docs.withColumn("__words", F.struct(counted.cast("bigint").alias("n"), _text_hash().alias("hash")))
    match = left["doc_id"].eqNullSafe(marks["doc_id"]) & (left["__words.hash"] == marks["text_hash"])
    return left.join(marks, match, "left").select(
        *[left[c] for c in docs.columns],
        left["__words.n"].alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """``docs`` (doc_id, text and any others) without the rows that hold a window of an item; see ``contamination``."""
    docs = clear(docs, "__gone")
    found = hits(docs, items, window, shingle)
    gone = found.select(document_key(F.col("doc_id"), F.col("text_hash")).alias("__gone")).distinct()
    own = docs.withColumn("__gone", document_key(F.col("doc_id"), _text_hash()))
    return of_ids(own, gone, "left_anti", "__gone").drop("__gone")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def hits(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash, n_hit and item_ids of the texts that hold a window of an item; see ``contamination``."""
    parts = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("item"))
    parts = parts.where(F.size("item") > 0).withColumn("item_key", F.xxhash64("item_id", "item")).dropDuplicates(["item_key"])
    k, n = F.least(F.size("item"), F.lit(shingle)), F.size("item")
    at = parts.select("item_id", "item_key", "item", k.alias("k"), n.alias("n"), F.posexplode("item").alias("at", "first"))
    keys = F.coalesce(
        *[F.when(F.col("k") == m, _shingle(F.col("item"), F.col("at"), F.col("first"), m)) for m in range(1, shingle + 1)]
    )
    # of an item, which may be long, a row keeps no more than the windows around its own word
    low = F.greatest(F.lit(0), F.col("at") - (window - 1))
    tokens = cut(
        at.where(F.col("at") + F.col("k") <= F.col("n")).select(
            "item_id",
            "item_key",
            "k",
            "n",
            "at",
            keys.alias("key"),
            F.slice("item", low + 1, F.lit(2 * window - 1)).alias("item"),
            (F.col("at") - low).alias("item_at"),
        )
    )
    sizes = sorted(r.k for r in tokens.select("k").distinct().collect()) or [shingle]

    own = docs.select("doc_id", _text_hash().alias("text_hash"), words_of(F.col("text")).alias("words"))
    vocabulary = tokens.select("key").distinct()
    rarity = _probed(own.select("words"), vocabulary, 16 * tokens.count(), sizes).groupBy("key").count()

    # the rarest shingle of each window; without it the window occurs nowhere
    length = F.least(F.col("n"), F.lit(window))
    per_item = Window.partitionBy("item_key").orderBy("at").rowsBetween(0, window - shingle)
    best = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("at").alias("anchor"))).over(per_item)
    anchors = (
        tokens.join(rarity, "key", "left")
        .select("item_key", "at", (F.col("at") + length <= F.col("n")).alias("begins"), best.alias("best"))
        .where(F.col("begins") & (F.col("best.n") > 0))
        .select("item_key", F.col("best.anchor").alias("at"))
        .distinct()
    )
    probe = cut(
        tokens.join(anchors, ["item_key", "at"]).select(
            "key", "item_id", F.col("item_at").alias("at"), "item", length.alias("least")
        )
    )
    probe_bytes = probe.agg(F.sum(F.octet_length(F.array_join("item", "")) + 200)).first()[0] or 0

    near_low = F.greatest(F.lit(0), F.col("pos") - (window - 1))
    found = _probed(own, probe, probe_bytes, sizes).select(
        "doc_id",
        "text_hash",
        "item_id",
        "item",
        "at",
        "least",
        "pos",
        F.slice("words", near_low + 1, 2 * window - 1).alias("near"),
        (F.col("pos") - near_low).alias("near_at"),
    )
    ahead = F.least(F.size("item") - F.col("at"), F.lit(window))
    found = found.withColumns(
        {
            "back": _run(F.col("near"), F.col("near_at"), F.col("item"), F.col("at"), F.col("at") + 1, -1),
            "ahead": _run(F.col("near"), F.col("near_at"), F.col("item"), F.col("at"), ahead, 1),
        }
    )
    spans = (
        found.select(
            "doc_id",
            "text_hash",
            (F.col("pos") - F.col("back") + 1).alias("start"),
            (F.col("pos") + F.col("ahead")).alias("end"),
            (F.col("back") + F.col("ahead") - 1 >= F.col("least")).alias("whole"),
            "item_id",
        )
        .groupBy("doc_id", "text_hash", "start", "end")
        .agg(F.max("whole").alias("whole"), F.collect_set(F.when(F.col("whole"), F.col("item_id"))).alias("ids"))
        .where("whole")
    )
    reached = F.max("end").over(
        Window.partitionBy("doc_id", "text_hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    )
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(reached, F.lit(0))))
    return (
        spans.withColumn("fresh", fresh)
        .groupBy("doc_id", "text_hash")
        .agg(
            F.sum("fresh").cast("bigint").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"),
        )
    )
