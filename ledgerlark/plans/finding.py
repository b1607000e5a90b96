"""Search queries."""

from pyspark.sql import functions as F

from ledgerlark.functions import stems, text
from ledgerlark.operators import index, search

from .registry import query

TERMS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def _bm25_sql(words: list[str], require_all: bool = True) -> str:
    """DuckDB SQL of a relation (doc_id, score) for the words."""
    asked = ", ".join(f"('{w}')" for w in words)
    whole = "HAVING count(*) = (SELECT count(DISTINCT term) FROM q)" if require_all else ""
    return f"""(WITH raw AS (SELECT doc_id, unnest({TERMS}) AS word FROM documents), st AS ({stems.stem_sql('SELECT DISTINCT word FROM raw')}),
    q AS ({stems.stem_sql(f'SELECT word FROM (VALUES {asked}) v(word)')}),
    d AS (SELECT doc_id, len({TERMS}) AS dl FROM documents), s AS (SELECT count(*) AS n, avg(dl) AS mean FROM d),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM raw JOIN st USING (word) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
    SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
    FROM tf JOIN df USING (term) JOIN d USING (doc_id), s GROUP BY 1 {whole})"""


def _keyword(documents, q, require_all=True):
    """Keyword hits from the stored index of the documents, scores rounded so that ties are ties."""
    found = search.bm25(index.index_of(documents, "doc_id", "text"), q, require_all)
    return found.withColumn("score", F.round("score", 9))


@query("documents", sql=f"SELECT doc_id, round(score, 6) AS score FROM {_bm25_sql(['the', 'licenses'])}")
def bm25_and(documents):
    """Documents that have all words of a query in any form, scored (SCH1, STR33)."""
    return _keyword(documents, "the Licenses").select("doc_id", F.round("score", 6).alias("score"))


@query("documents", sql=f"SELECT doc_id, round(score, 6) AS score FROM {_bm25_sql(['licensed', 'idiots', 'apache', 'terms', 'réunion'], False)}")
def bm25_or(documents):
    """Documents that have any of up to five words of a title (SCH5)."""
    return _keyword(documents, "Licensed: idiots (Apache) terms réunion", False).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "documents",
    sql=f"SELECT doc_id, round(score, 6) AS score FROM {_bm25_sql(['the', 'of'])} JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY round(score, 9) DESC, doc_id LIMIT 20",
)
def bm25_filtered(documents):
    """The best hits among documents of one kind (SCH2)."""
    found = _keyword(documents, "the of").join(documents.where("lang = 'en'").select("doc_id"), "doc_id", "left_semi")
    return search.top(found, "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "documents",
    sql=f"""SELECT source, max(round(score, 6)) AS best, count(*) AS n FROM {_bm25_sql(['license'])} JOIN documents USING (doc_id) GROUP BY 1""",
)
def fts_distinct_docs(documents):
    """Hits gathered by what they belong to, best score first (SCH3, SCH11)."""
    found = _keyword(documents, "license").join(documents.select("doc_id", "source"), "doc_id")
    return found.groupBy("source").agg(F.max(F.round("score", 6)).alias("best"), F.count("*").alias("n"))


@query(
    "documents",
    sql=f"""SELECT doc_id, total FROM (SELECT *, count(*) OVER () AS total FROM {_bm25_sql(['the'])}) ORDER BY round(score, 9) DESC, doc_id LIMIT 10 OFFSET 10""",
)
def search_page(documents):
    """The second page of hits with their total (SCH4)."""
    found = _keyword(documents, "the")
    total = found.agg(F.count("*").alias("total"))
    rows = found.orderBy(F.desc("score"), "doc_id").offset(10).limit(10)
    return rows.join(F.broadcast(total)).select("doc_id", "total")


@query(
    "documents",
    sql=f"""WITH raw AS (SELECT doc_id, unnest({TERMS}) AS word FROM documents), st AS ({stems.stem_sql('SELECT DISTINCT word FROM raw')})
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM raw JOIN st USING (word) GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5""",
)
def term_stats(documents):
    """Document and collection frequency of the index's terms (SNK13, SNK14, STR33)."""
    return index.index_of(documents, "doc_id", "text").postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("cf")).where("df >= 5")


@query(
    "embeddings",
    sql="""SELECT vec_id, round(score, 6) AS score FROM (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY score DESC, vec_id LIMIT 5""",
)
def vector_topk(embeddings):
    """The five vectors nearest to a given one (SCH8, MTH1, MTH2)."""
    q = embeddings.where("vec_id = 0").select("embedding")
    found = search.vector_hits(embeddings, "vec_id", "embedding", q)
    return search.top(found, "vec_id", 5).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "embeddings",
    sql="""SELECT vec_id, round(score, 6) AS score FROM (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE score >= 0.15 ORDER BY score DESC, vec_id LIMIT 50""",
)
def vector_topk_threshold(embeddings):
    """The nearest vectors of at least some similarity (SCH6, SCH7)."""
    q = embeddings.where("vec_id = 0").select("embedding")
    found = search.vector_hits(embeddings, "vec_id", "embedding", q, 0.15)
    return search.top(found, "vec_id", 50).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "embeddings",
    sql="""WITH h AS (SELECT e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), b AS (SELECT * FROM h ORDER BY score DESC, vec_id LIMIT 20)
    SELECT vec_id, label FROM b WHERE label <> 0 ORDER BY score DESC, vec_id LIMIT 10""",
)
def overfetch_then_filter(embeddings):
    """Twice as many hits as wanted, then a filter, then the cut (SRT8)."""
    q = embeddings.where("vec_id = 0").select("embedding")
    best = search.top(search.vector_hits(embeddings, "vec_id", "embedding", q), "vec_id", 20)
    kept = best.join(embeddings.select("vec_id", "label"), "vec_id").where("label <> 0")
    return search.top(kept, "vec_id", 10).select("vec_id", "label")


_VECTOR_SQL = """(SELECT e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q)"""
_FUSED_SQL = f"""WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM {_bm25_sql(['the', 'of'])} ORDER BY r LIMIT 50),
    v AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM {_VECTOR_SQL} WHERE score >= 0.1 ORDER BY r LIMIT 50),
    f AS (SELECT doc_id, sum(1.0 / (60 + r)) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM v) GROUP BY 1)"""


def _two_searches(documents, embeddings):
    q = embeddings.where("vec_id = 3").select("embedding")
    keyword = _keyword(documents, "the of")
    vectors = search.vector_hits(embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", q, 0.1)
    return keyword, vectors.withColumn("score", F.round("score", 9))


@query("documents", "embeddings", sql=f"{_FUSED_SQL} SELECT doc_id, round(score, 9) AS score FROM f")
def rrf_fusion(documents, embeddings):
    """Two ranked lists fused by reciprocal ranks (SCH9)."""
    keyword, vectors = _two_searches(documents, embeddings)
    fused = search.fuse([search.ranked(keyword, "doc_id", 50), search.ranked(vectors, "doc_id", 50)], "doc_id")
    return fused.select("doc_id", F.round("score", 9).alias("score"))


@query(
    "documents",
    "embeddings",
    sql=f"""{_FUSED_SQL}, b AS (SELECT * FROM f ORDER BY round(score, 9) DESC, doc_id LIMIT 40)
    SELECT doc_id, lang, source, round(score, 9) AS score FROM b JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr')
    ORDER BY round(score, 9) DESC, doc_id LIMIT 20""",
)
def hybrid_search(documents, embeddings):
    """Keyword and vector search fused, enriched, filtered and cut, in this order (SCH10, SCH16, JN21)."""
    keyword, vectors = _two_searches(documents, embeddings)
    fused = search.fuse([search.ranked(keyword, "doc_id", 50), search.ranked(vectors, "doc_id", 50)], "doc_id")
    pool = search.top(fused.withColumn("score", F.round("score", 9)), "doc_id", 40)
    rows = pool.join(documents.select("doc_id", "lang", "source"), "doc_id").where(F.col("lang").isin("en", "fr"))
    return search.top(rows, "doc_id", 20).select("doc_id", "lang", "source", "score")


@query(
    "documents",
    sql=f"""SELECT doc_id, round(1.0 / (60 + r), 9) AS score FROM (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM {_bm25_sql(['releases'])})
    WHERE r <= 20""",
)
def keyword_only_search(documents):
    """The hybrid search where the query has no vector (SCH16)."""
    found = search.hybrid(_keyword(documents, "releases"), None, "doc_id", 10)
    return found.select("doc_id", F.round("score", 9).alias("score"))


@query(
    "conversations",
    sql=r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(text, '[()*:^"]', ' ', 'g'), '\s+'), lambda x: x <> '') AS w,
    trim(regexp_replace(regexp_replace(text, '[^\w\s"*]', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM (SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS text FROM conversations))
    SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN array_to_string(list_transform(w, lambda x: '"' || x || '"'), ' ') END AS quoted, nullif(k, '') AS words FROM w""",
)
def query_forms(conversations):
    """Texts as queries: operators cut off and words quoted, or words, quotes and wildcards alone (STR17)."""
    c = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    return conversations.select("conv_id", "turn", search.quoted_query(c).alias("quoted"), search.word_query(c).alias("words"))


@query(
    "conversations",
    sql="SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY 1",
)
def full_document_assembly(conversations):
    """All parts of a document in order (SCH12)."""
    return search.assembled(conversations, "conv_id", "turn", "text")


@query("documents")
def search_snippets(documents):
    """Hits with a marked extract (STR18)."""
    found = _keyword(documents, "license").join(documents.select("doc_id", "text"), "doc_id")
    return found.select("doc_id", search.snippet(F.col("text"), "license").alias("snippet"))


@query(
    "documents",
    sql=f"""WITH b AS (SELECT * FROM {_bm25_sql(['license'])} ORDER BY round(score, 9) DESC, doc_id LIMIT 8)
    SELECT string_agg('[' || lang || ' ' || doc_id || ']' || chr(10) || substr(text, 1, 200), chr(10) || '---' || chr(10) ORDER BY round(score, 9) DESC, doc_id) AS context
    FROM b JOIN documents USING (doc_id)""",
)
def packed_context(documents):
    """The best eight hits as one labelled text (SCH17, STR19)."""
    found = _keyword(documents, "license")
    rows = search.top(found, "doc_id", 8).join(documents.select("doc_id", "lang", "text"), "doc_id")
    label = F.format_string("[%s %d]\n%s", F.col("lang"), F.col("doc_id"), F.substring("text", 1, 200))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", label.alias("x"))))
    return rows.agg(F.array_join(F.transform(ordered, lambda r: r["x"]), "\n---\n").alias("context"))


@query(
    "documents",
    "orders",
    sql=f"""WITH b AS (SELECT doc_id, round(score, 9) AS score FROM {_bm25_sql(['the', 'of'])}),
    m AS (SELECT o_custkey AS doc_id, max(o_orderkey) AS meeting FROM orders GROUP BY 1)
    SELECT doc_id, meeting FROM b JOIN m USING (doc_id) ORDER BY score DESC, doc_id LIMIT 15""",
)
def reference_search(documents, orders):
    """Hits with what they refer to, one each, cut to a limit (SCH14)."""
    found = _keyword(documents, "the of")
    meetings = orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.max("o_orderkey").alias("meeting"))
    return search.top(found.join(meetings, "doc_id"), "doc_id", 15).select("doc_id", "meeting")


@query(
    "documents",
    sql=rf"""SELECT source, count(*) AS n, sum(len({TERMS}))::BIGINT AS terms, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1""",
)
def corpus_statistics(documents):
    """Documents, terms and characters of each corpus (EXT26, EXT32)."""
    sized = documents.select("source", F.size(text.search_terms(F.col("text"))).alias("t"), F.length("text").alias("c"))
    return sized.groupBy("source").agg(
        F.count("*").alias("n"), F.sum("t").cast("bigint").alias("terms"), F.sum("c").cast("bigint").alias("chars")
    )
