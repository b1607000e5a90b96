"""How far the sources of a language differ: count vectors, group sums, and pairs evaluated where something is.

A document becomes an exact sparse vector, its terms with their counts. Group sums add the vectors of a source up in
the tasks before they travel, and once more by language and term after one shuffle; the same pass counts in how many
documents a term is. That gives each language its vocabulary, the terms of enough documents. It stays a distributed
table: sums are restricted to it instead of the vectors, which is the same as sums are linear, and neither the
driver nor a task holds it whole, as a broadcast vocabulary would ask for. It has no limit but the largest integer.

Two sources are compared over the whole vocabulary, but most terms miss in one or both. As a missing term has one share
in all of a source, the value of a pair is that of two empty sources, plus what each source's own terms change against
an empty one (by its distinct counts alone), plus what terms of both change beyond that. Only the last walks over terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clear, cut, small_batches

TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Entries of vectors that a task adds up at once, which bounds what it holds.
ENTRIES = 1 << 19
#: No vocabulary may be larger: indices and sizes are signed 32-bit integers.
LARGEST = (1 << 31) - 1
SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])


def count_vectors(docs: DataFrame) -> DataFrame:
    """``docs`` (text and any others) with terms and counts: each term of the text once, and how often it is there.

    Terms are runs of ASCII letters and of all characters beyond ASCII; A-Z are lower-cased, nothing else. Null text is
    empty and has none. Columns of docs named as a result are replaced; no rows give none.
    """
    docs = clear(docs, "terms", "counts")
    names, at = docs.columns, docs.columns.index("text")
    added = [F.array().cast("array<string>").alias("terms"), F.array().cast("array<int>").alias("counts")]
    schema = docs.select("*", *added).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [Counter(TERM.findall((t or "").encode().lower())) for t in batch.column(at).to_pylist()]
            ends = [0]
            for c in each:
                ends.append(ends[-1] + len(c))
            terms = pa.array([t for c in each for t in c], pa.binary()).cast(pa.string())
            counts = pa.array([n for c in each for n in c.values()], pa.int32())
            offsets = pa.array(ends, pa.int32())
            columns = [batch.column(i) for i in range(len(names))]
            columns += [pa.ListArray.from_arrays(offsets, x) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    small_batches(docs.sparkSession, 256)
    return docs.mapInArrow(run, schema)


def _added(parts: list[pa.Table]) -> pa.Table:
    """The rows of ``parts`` with equal lang, source and term as one."""
    whole = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("count", "sum"), ("docs", "sum")])
    return whole.rename_columns(["lang", "source", "term", "count", "docs"]).cast(SUMS)


def group_sums(vectors: DataFrame) -> DataFrame:
    """lang, source, term, count and docs: the sums of ``vectors`` (lang, source, terms, counts) of each group.

    docs is in how many of the group's vectors the term is. Null lang and source are ''. Tasks add up their own rows
    first; rows of a language and term end up in one partition, in which other sums by them need no shuffle.
    """
    own = vectors.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], "terms", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            terms = table["terms"].combine_chunks()
            row = pc.list_parent_indices(terms)
            counts = table["counts"].combine_chunks().flatten().cast(pa.int64())
            ones = pa.array(np.ones(len(row), np.int64))
            parts.append(pa.table([table["lang"].take(row), table["source"].take(row), terms.flatten(), counts, ones], schema=SUMS))
            if sum(p.num_rows for p in parts) >= ENTRIES:
                parts = [_added(parts)]
                if parts[0].num_rows >= ENTRIES // 2:
                    yield from parts.pop().to_batches(1 << 16)
        if parts:
            yield from _added(parts).to_batches(1 << 16)

    sums = own.mapInArrow(run, "lang string, source string, term string, count bigint, docs bigint").repartition("lang", "term")
    return sums.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def vocabulary(sums: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, n_docs, total and held (source and count of each source with the term), of terms in enough documents."""
    each = sums.groupBy("lang", "term").agg(
        F.sum("docs").alias("n_docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("held")
    )
    return each.where(F.col("n_docs") >= min_docs)


def share(count: Column | int, tokens: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (tokens + 2 terms)), exact for any 64-bit counts."""
    wide = (F.lit(count) if isinstance(count, int) else count).cast("decimal(20,0)")
    return F.call_function("div", (wide + 2) * 1_000_000_000, (tokens + 2 * terms).cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source of a language is from the others, and by which terms.

    Of ``docs`` (text, lang, source; null is '') each language keeps the terms in at least ``min_docs`` of its documents;
    ``share`` gives each kept term its smoothed share of a source or of the language, ``apart`` compares two shares. Part
    ``pair`` lists for every source all other ones of the language with the sum over all kept terms (0 without any), part
    ``term`` its first ``top`` terms whose share exceeds that in the language. Both rank by value, largest first, then by
    item in UTF-8 order. Repeated rows count each. A source without terms is compared like others; a language of
    one source has no pairs. No rows give none. Other columns are ignored.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = cut(vocabulary(group_sums(count_vectors(docs)), min_docs))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_tokens"))
    if largest := langs.agg(F.max("v")).first()[0] or 0:
        if largest > LARGEST:
            raise ValueError(f"a language has {largest} terms, more than {LARGEST}")
    entries = kept.select("lang", "term", "total", F.explode("held").alias("h")).select("lang", "term", "total", "h.*")
    tokens = entries.groupBy("lang", "source").agg(F.sum("count").alias("tokens"))
    # a number for each source of a language, in its order; there are as many rows as sources
    groups = (
        docs.select("lang", "source").distinct().join(tokens, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tokens", "v", "lang_tokens")])
        .withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
        .withColumn("z", F.when(F.col("v") > 0, share(0, F.col("tokens"), F.col("v"))).otherwise(0))
    )
    groups = cut(groups)
    shares = entries.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("tokens"), F.col("v")))
    shares = cut(shares.select("lang", "source", "g", "term", "p", "z", share(F.col("total"), F.col("lang_tokens"), F.col("v")).alias("q")))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # both directions of every pair of sources: their number is that of the rows asked for
    other = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("g2"), F.col("z").alias("z2"))
    pairs = groups.select("lang", "source", "g", "z", "v").join(other, "lang").where("g <> g2")
    nothing = apart(F.col("z"), F.col("z2"))
    # what a source's terms change against an empty other one: by share, of which a source has few different ones
    alike = shares.groupBy("lang", "g", "z", "p").agg(F.count("*").alias("n"))
    alone = (
        alike.join(other, "lang").where("g <> g2")
        .groupBy("lang", "g", "g2").agg(F.sum(F.col("n") * (apart(F.col("p"), F.col("z2")) - nothing)).alias("own"))
    )
    both = (
        shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("g", "p", "z"))).alias("held"))
        .select("lang", "held", F.posexplode("held").alias("i", "a"))
        .select("lang", "a", F.explode(F.slice("held", F.col("i") + 2, F.size("held"))).alias("b"))
        .groupBy("lang", F.col("a.g").alias("g"), F.col("b.g").alias("g2"))
        .agg(F.sum(apart(F.col("a.p"), F.col("b.p")) - apart(F.col("a.p"), F.col("b.z")) - apart(F.col("a.z"), F.col("b.p")) + apart(F.col("a.z"), F.col("b.z"))).alias("more"))
    )
    back = {"g": "g2", "g2": "g"}
    swapped = lambda df: df.select(*[F.col(c).alias(back.get(c, c)) for c in df.columns])
    changes = (
        alone.withColumnRenamed("own", "change").unionByName(swapped(alone).withColumnRenamed("own", "change"))
        .unionByName(both.withColumnRenamed("more", "change")).unionByName(swapped(both).withColumnRenamed("more", "change"))
        .groupBy("lang", "g", "g2").agg(F.sum("change").alias("change"))
    )
    value = F.when(F.col("v") > 0, F.col("v") * nothing + F.coalesce("change", F.lit(0))).otherwise(0)
    pairs = pairs.join(changes, ["lang", "g", "g2"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)
