"""Search: keyword ranking over a stored index, vector similarity, rank fusion and snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import stems, text
from ledgerlark.operators.index import Index

K1, B = 1.2, 0.75
FUSION = 60


def query_terms(q: str, limit: int | None = None) -> list[str]:
    """The terms of a query, each once; operators and quotes are cut off like any other mark."""
    terms = list(dict.fromkeys(stems.terms(q)))
    return terms[:limit] if limit else terms


def quoted_query(c: Column) -> Column:
    """A query text with its operators cut off and each word quoted; null if no word is left."""
    words = F.filter(F.split(F.regexp_replace(c, r"[()*:^\"]", " "), r"\s+"), lambda w: w != "")
    quoted = F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ")
    return F.when(F.size(words) > 0, quoted)


def word_query(c: Column) -> Column:
    """A query text of which words, quotes and wildcards are left; null if nothing is."""
    kept = F.trim(F.regexp_replace(F.regexp_replace(c, r'[^\w\s"*]', " "), r"\s+", " "))
    return F.when(kept != "", kept)


def bm25(index: Index, q: str, require_all: bool = True) -> DataFrame:
    """key and score of every document of an index that has all (or any) terms of the query; none for an empty query.

    score is the published BM25 sum with idf ln(1 + (N - df + 0.5) / (df + 0.5)), over all documents of the
    index. Only the folders of the query's terms and of the lengths are read.
    """
    terms, key = query_terms(q), index.key
    if not terms:
        return index.lengths().select(key, F.lit(0.0).alias("score")).limit(0)
    mine = index.of_terms(terms)
    whole = index.lengths().agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    # one row for each term of the query
    each = mine.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(whole))
    n, df, tf = F.col("n"), F.col("df"), F.col("tf")
    part = F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    found = mine.join(F.broadcast(each), "term").groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("__has"))
    return (found.where(F.col("__has") == len(terms)) if require_all else found).select(key, "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def vector_hits(vectors: DataFrame, key: str, column: str, q: DataFrame, least: float | None = None) -> DataFrame:
    """key and score of the vectors whose cosine with the query's is at least ``least``; zero vectors are left out.

    ``q`` is a DataFrame of one column; its first row is the query's vector. Without a row there are no hits.
    """
    asked = q.toDF("__q").where("__q is not null").limit(1)
    rows = vectors.where(norm(F.col(column)) > 0).join(F.broadcast(asked))
    found = rows.select(key, cosine(F.col(column), F.col("__q")).alias("score"))
    return found if least is None else found.where(F.col("score") >= least)


def top(hits: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` best hits; ties go to the smaller key."""
    return hits.orderBy(F.desc("score"), key).limit(n)


def ranked(hits: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` best hits with their rank from 1."""
    best = top(hits, key, n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fuse(lists: list[DataFrame], key: str) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists: key and score, the sum of 1 / (60 + rank)."""
    whole = reduce(DataFrame.unionByName, [x.select(key, "rank") for x in lists])
    return whole.groupBy(key).agg(F.sum(1.0 / (FUSION + F.col("rank"))).alias("score"))


def hybrid(keyword: DataFrame, vector: DataFrame | None, key: str, limit: int, pool: int = 50) -> DataFrame:
    """Both searches fused: the best ``2 * limit`` hits, to be filtered and cut to ``limit`` afterwards.

    Without a vector search (no vector of the query) the keyword hits alone count.
    """
    lists = [ranked(keyword, key, pool)] + ([ranked(vector, key, pool)] if vector is not None else [])
    return top(fuse(lists, key), key, 2 * limit)


def snippet(c: Column, q: str, width: int = 25) -> Column:
    """``width`` words around the first word that has a term of the query or begins with its stem, such words marked, with
    dots where text is left out."""
    words = text.words(c)
    parts = [*(f"{t}\\w*" for t in query_terms(q)), *(w for w in stems.WORD.findall(q.lower()))]
    pattern = rf"(?iu)\b({'|'.join(dict.fromkeys(parts))})\b"
    first = F.array_position(F.transform(words, lambda w: w.rlike(pattern)), True).cast("int")
    start = F.greatest(F.lit(1), first - width // 2)
    shown = F.regexp_replace(F.array_join(F.slice(words, start, width), " "), pattern, "<mark>$1</mark>")
    before, after = F.when(start > 1, "...").otherwise(""), F.when(start + width <= F.size(words), "...").otherwise("")
    return F.concat(before, shown, after)


def assembled(parts: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """The whole text of each key: its parts in order, parted by empty lines."""
    whole = F.array_sort(F.collect_list(F.struct(order, column)))
    return parts.groupBy(key).agg(F.array_join(F.transform(whole, lambda p: p[column]), "\n\n").alias("whole"))
