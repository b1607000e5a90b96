"""A versioned inverted index in segments that follows its table.

An index is a folder. Each change of the table is one batch: the postings of new and changed documents become a segment,
the keys of changed and vanished ones tombstones, and a manifest names all segments that make up the new version. A
manifest is written last, so a batch that fails leaves the version before it as it was, and readers of an older version
keep their files. A posting is alive unless a later segment has a tombstone for its document. Many
segments are merged into one, without the dead postings. All files are tables of Spark in the index's folder.

Inside a segment postings lie in folders by hash of the term, whose number follows from the size of the texts, sorted by
term; each document has a row with null term besides, which holds its length and the digest that tells changed texts.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import stems
from ledgerlark.operators.materialise import shared_folder, small_batches, written

#: Text of a bucket, about, and bounds of the number of buckets.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 64 << 20, 8, 4096
#: How many texts are cut into terms before their postings leave Python.
SLICE = 64
#: A version of more segments than this is merged.
SEGMENTS = 8
#: Where this application's indexes are, by what they are of; with the state of the files that they were made of.
_STORED: dict[tuple, tuple[str, str | None]] = {}


@dataclass
class Index:
    """A version: live rows key, term, tf, dl, digest, bucket and segment, and the number of buckets of its postings."""

    rows: DataFrame
    key: str
    buckets: int
    version: int

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The postings of ``terms``; only their folders are read."""
        numbers = [zlib.crc32(t.encode()) % self.buckets for t in terms]
        return self.rows.where(F.col("bucket").isin(numbers) & F.col("term").isin(terms))

    def lengths(self) -> DataFrame:
        """A row for each document: key, dl and digest."""
        return self.rows.where("bucket = -1").select(self.key, "dl", "digest")

    def postings(self) -> DataFrame:
        return self.rows.where("bucket >= 0")


def bucket(term: Column, buckets: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(term), F.lit(buckets)).cast("int"), F.lit(-1))


def postings(docs: DataFrame, key: str, column: str) -> DataFrame:
    """The inverted index: key, term, tf (number of the term in the document), dl (terms of the document) and digest.

    Terms are folded and stemmed. Each document has a row with null term and tf 0 as well, so that its length is
    known if it has no terms; only there the digest of its text isn't null. A document's terms are counted inside its row;
    nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            place, words, number, length, digests = [], [], [], [], []
            for i, (whole, digest) in enumerate(zip(batch["__text"].to_pylist(), batch["__digest"].to_pylist(), strict=True)):
                found = stems.terms(whole)
                counted = {None: 0, **Counter(found)}
                place += [i] * len(counted)
                words += counted.keys()
                number += counted.values()
                length += [len(found)] * len(counted)
                digests += [digest] + [None] * (len(counted) - 1)
            columns = [batch[key].take(pa.array(place, pa.int64())), pa.array(words, pa.string())]
            columns += [pa.array(number, pa.int32()), pa.array(length, pa.int32()), pa.array(digests, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [key, "term", "tf", "dl", "digest"])

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(key, F.col(column).alias("__text"), F.xxhash64(column).alias("__digest"))
    return source.mapInArrow(count, f"{key} {kind}, term string, tf int, dl int, digest bigint")


def _write(rows: DataFrame, key: str, buckets: int, path: str) -> None:
    """Postings by bucket and term; a frequent term's rows are written by several tasks."""
    rows = rows.withColumn("bucket", bucket(F.col("term"), buckets))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8)))
    dealt.sortWithinPartitions("bucket", "term", key).write.partitionBy("bucket").parquet(path)


MANIFEST = "segment int, postings string, gone string, buckets int, v int"


def _publish(spark: SparkSession, folder: str, version: int, segments: list[tuple]) -> None:
    """The manifest of a version: (segment, postings, tombstones or null, buckets) of each segment."""
    spark.createDataFrame(segments, MANIFEST.removesuffix(", v int")).coalesce(1).write.parquet(f"{folder}/manifest/v={version}")


def _manifest(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, list[tuple]]:
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()
    version = max(r.v for r in rows) if version is None else version
    return version, sorted((r.segment, r.postings, r.gone, r.buckets) for r in rows if r.v == version)


def create(docs: DataFrame, key: str, column: str, folder: str) -> None:
    """Version 0 of the index of ``docs`` in a new ``folder``."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length()))
    path = f"{folder}/segment-{uuid.uuid4().hex}"
    _write(postings(docs, key, column), key, buckets, path)
    _publish(docs.sparkSession, folder, 0, [(0, path, None, buckets)])


def opened(spark: SparkSession, folder: str, key: str, kind: str, version: int | None = None) -> Index:
    """A version of an index, the newest one if none is named; ``kind`` is the type of its key."""
    version, segments = _manifest(spark, folder, version)
    schema = f"{key} {kind}, term string, tf int, dl int, digest bigint, bucket int"
    parts = [spark.read.schema(schema).parquet(path).withColumn("segment", F.lit(n)) for n, path, _, _ in segments]
    rows = reduce(DataFrame.unionByName, parts)
    gone = [spark.read.schema(f"{key} {kind}").parquet(path).withColumn("__before", F.lit(n)) for n, _, path, _ in segments if path]
    if gone:
        dead = reduce(DataFrame.unionByName, gone).groupBy(F.col(key).alias("__key")).agg(F.max("__before").alias("__before"))
        rows = rows.join(dead, rows[key].eqNullSafe(dead["__key"]) & (rows["segment"] < dead["__before"]), "left_anti")
    return Index(rows, key, segments[-1][3], version)


def refresh(docs: DataFrame, key: str, column: str, folder: str) -> int:
    """The next version, which equals an index of ``docs`` built anew; the number of changed keys.

    Only documents whose key is new, or whose text isn't the one indexed, are cut into terms. A key may have several rows:
    it counts as changed if their number or the sum of their digests differs, and then all its rows are indexed again.
    Nothing is written if nothing has changed.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    version, segments = _manifest(spark, folder)
    of_key = [F.count("*").alias("n"), F.sum(F.col("digest").cast("decimal(38,0)")).alias("sum")]
    now = docs.select(key, F.xxhash64(column).alias("digest")).groupBy(F.col(key).alias("__new")).agg(F.struct(*of_key).alias("new"))
    old = opened(spark, folder, key, kind).lengths().groupBy(F.col(key).alias("__old")).agg(F.struct(*of_key).alias("old"))
    differ = now.join(old, F.col("__new").eqNullSafe(F.col("__old")), "full").where(~F.col("new").eqNullSafe(F.col("old")))
    # a null key is a key, so what a side lacks shows in its sums
    differ = written(differ.select(F.when(F.col("new").isNull(), F.col("__old")).otherwise(F.col("__new")).alias("__key"), F.col("new").isNotNull().alias("here"), F.col("old").isNotNull().alias("was")))
    changed = differ.count()
    if changed:
        number, path = segments[-1][0] + 1, f"{folder}/segment-{uuid.uuid4().hex}"
        fresh = docs.join(differ.where("here"), docs[key].eqNullSafe(F.col("__key")), "left_semi")
        _write(postings(fresh, key, column), key, segments[-1][3], f"{path}/postings")
        differ.where("was").select(F.col("__key").alias(key)).write.parquet(f"{path}/gone")
        _publish(spark, folder, version + 1, [*segments, (number, f"{path}/postings", f"{path}/gone", segments[-1][3])])
        if len(segments) + 1 > SEGMENTS:
            merge(spark, folder, key, kind)
    return changed


def merge(spark: SparkSession, folder: str, key: str, kind: str) -> None:
    """A new version with the live postings of all segments in one; files of older versions stay for their readers."""
    version, segments = _manifest(spark, folder)
    index = opened(spark, folder, key, kind, version)
    path = f"{folder}/segment-{uuid.uuid4().hex}"
    _write(index.rows.select(key, "term", "tf", "dl", "digest"), key, index.buckets, path)
    _publish(spark, folder, version + 1, [(segments[-1][0] + 1, path, None, index.buckets)])


def files_state(docs: DataFrame) -> str | None:
    """A digest of the names, sizes and times of the files that ``docs`` reads; null if it reads none."""
    paths = docs.inputFiles()
    if not paths:
        return None
    files = docs.sparkSession.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    return str(files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")), F.count("*")).first())


def index_of(docs: DataFrame, key: str, column: str) -> Index:
    """The index of ``docs``: created at its first use in an application, refreshed where its files are others since.

    It goes to the shared checkpoint folder.
    """
    spark = docs.sparkSession
    of = (spark.sparkContext.applicationId, docs.select(key, column).semanticHash(), key, column)
    folder, before = _STORED.get(of, (None, None))
    state = files_state(docs)
    if folder is None:
        folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        create(docs, key, column, folder)
    elif state != before:
        refresh(docs, key, column, folder)
    _STORED[of] = (folder, state)
    return opened(spark, folder, key, docs.schema[key].dataType.simpleString())
