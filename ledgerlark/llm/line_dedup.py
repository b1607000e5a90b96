"""Line dedup: which lines of each document stay, as compressed keep bitmaps.

Only DataFrame functions are used. Line hashes are range-partitioned with a secondary sort by document and
position, so a key held by very many documents is spread over neighbouring ranges and each range streams
the first occurrence of a key in a document. Ranges then send one partial count for each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, clear, cut, dealt_anew, document_key, few, parted, text_of

BITS = 64


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` (doc_id, text and any others) with n_lines, n_dropped and keep_bitmap.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents keeps its lines only
    in the largest doc_id that holds it. keep_bitmap lists the 64-line words that have a dropped line
    as (word, bits), bit 1 for a kept line; a word that isn't listed is kept whole, so most documents
    have an empty bitmap.

    Null or empty text is one empty line. A document is a doc_id: rows that repeat a doc_id count once
    and all lose the same keys. A null doc_id is no document for the count and never the largest.
    An empty table gives an empty result. Columns of docs that are named as a result are replaced.
    """
    docs = clear(docs, "n_lines", "n_dropped", "keep_bitmap", "__key")
    keyed = docs.select(
        F.col("doc_id").alias("doc_id"),
        text_of(docs).alias("text"),
    ).select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"),
    )
    keyed = keyed.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    # two independent 64-bit hashes, as keys of a large corpus outnumber one; written, as ranges are drawn from a sample first
    hashed = cut(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos"))
    # ranges end between documents of a key, never inside one, so both groupings below need no other shuffle
    ranged = hashed.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "text_hash", "pos")
    held = ranged.groupBy("h1", "h2", "doc_id", "text_hash").agg(F.collect_list("pos").alias("positions"))
    # the number of positions is asked for so that both uses of ``held`` read the same columns and share its shuffle
    common = (
        held.groupBy("h1", "h2", "doc_id")
        .agg(F.max(F.size("positions")).alias("n_lines"))
        .groupBy("h1", "h2")
        .agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"), F.sum("n_lines").alias("n_lines"))
        .where((F.col("n_docs") >= min_docs) & (F.col("n_lines") >= min_docs))
        .drop("n_lines")
    )
    dropped = (
        held.join(dealt_anew(common, "h1", "h2"), ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .select("doc_id", "text_hash", F.explode("positions").alias("pos"))
    )
    bits = (
        dropped.repartition("doc_id", "text_hash")
        .groupBy("doc_id", "text_hash", (F.col("pos") / BITS).cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {BITS})")).alias("gone"), F.count_distinct("pos").alias("n"))
        .groupBy("doc_id", "text_hash")
        .agg(
            F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep_bitmap"),
            F.sum("n").alias("n_dropped"),
        )
    )
    bits = cut(bits.select(document_key(F.col("doc_id"), F.col("text_hash")).alias("__key"), "keep_bitmap", "n_dropped"))
    left = docs.withColumn("__key", document_key(docs["doc_id"], F.xxhash64(text_of(docs))))
    ids = bits.select("__key")
    if few(ids):  # documents that lose nothing stay where they are
        maybe, others = parted(left, ids, "__key")
        joined = maybe.join(bits, "__key", "left").unionByName(others, allowMissingColumns=True)
    else:
        joined = left.join(bits, "__key", "left")
    return joined.select(
        *docs.columns,
        F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce("keep_bitmap", F.array().cast("array<struct<word:int,bits:bigint>>")).alias("keep_bitmap"),
    )


def kept_text(text: Column, keep_bitmap: Column) -> Column:
    """The lines of ``text`` that the bitmap keeps, joined by a line feed; null stays null."""
    # all words up to the last one that is listed, those between listed ones filled in
    words = F.flatten(
        F.transform(
            keep_bitmap,
            lambda w, i: F.concat(
                F.array_repeat(F.lit(-1).cast("bigint"), w["word"] - F.coalesce(F.get(keep_bitmap, i - 1)["word"], F.lit(-1)) - 1),
                F.array(w["bits"]),
            ),
        )
    )
    # both arrays are bound to a variable, so that they are built once and not for every line
    bound = F.array(F.struct(F.split(text, "\n", -1).alias("lines"), words.alias("words")))
    bit = lambda words, i: F.getbit(F.coalesce(F.get(words, (i / BITS).cast("int")), F.lit(-1).cast("bigint")), i % BITS)
    kept = F.transform(bound, lambda b: F.array_join(F.filter(b["lines"], lambda line, i: bit(b["words"], i) == 1), "\n"))[0]
    return F.when(F.size(keep_bitmap) == 0, text).otherwise(kept)
