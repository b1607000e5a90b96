import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlark.llm import queries

TABLES = "/root/testdata/sf0.001"


def test_stages_on_edge_rows(docs, no_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, no_docs):
            found = stage(df.sparkSession, df, TABLES)
            assert found.columns == df.columns
            assert found.count() <= df.count()
    last = corpus_pipeline.STAGES[-1][1]
    assert last(docs.sparkSession, docs, TABLES).count() == docs.count()
    assert last(no_docs.sparkSession, no_docs, TABLES).count() == 0


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    good = {r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, TABLES).collect()}
    judged = [i for i in labels]
    assert sum((i in good) == bool(labels[i]) for i in judged) >= 0.97 * len(judged)

    lines = corpus_pipeline.drop_repeated_lines(spark, docs, TABLES).collect()
    holders = {}
    for r in lines:
        assert r.n_chars == len(r.text)
        for line in r.text.split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            if len(k) >= 40:
                holders.setdefault(k, set()).add(r.doc_id)
    assert all(len(h) < 5 for h in holders.values())

    items = [r.text for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    clean = corpus_pipeline.drop_contaminated(spark, docs, TABLES).collect()
    assert not any(item in r.text for item in items for r in clean)
    assert len(clean) < docs.count()


def test_run(spark):
    found = corpus_pipeline.run(spark, TABLES)
    rows = found.collect()
    assert rows and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)


def test_run_against_brute_force(spark):
    """The whole chain in plain Python; the classifier's decisions are taken from its scores, which have tests of their own."""
    import sentencepiece

    from .test_decontaminate import brute as contaminated
    from .test_simhash import groups, shingles

    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in corpus_pipeline.keep_quality(spark, docs, TABLES).select("doc_id", "text").collect()}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = {}
    for i, t in texts.items():
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(i)
    gone = {k: max(h) for k, h in holders.items() if len(k) >= 40 and len(h) >= 5}
    texts = {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in texts.items()}
    sets = {i: shingles(t) for i, t in texts.items()}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = groups(list(texts), alike)
    texts = {i: t for i, t in texts.items() if root[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    texts = {d: texts[d] for d, _, hit, _ in contaminated(list(texts.items()), items) if not hit}
    library = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_PATH)
    found = {r.doc_id: (r.text, list(r.ids), r.n_chars) for r in corpus_pipeline.run(spark, TABLES).collect()}
    assert found == {i: (t, library.encode(t), len(t)) for i, t in texts.items()}


@pytest.mark.parametrize("name", ["op5_line_dedup", "op7_decontamination", "op8_chat_format"])
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from ledgerlark.llm import oracles

    base = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    want = base.sql(oracles.SQL[name])
    found = getattr(queries, name)(spark, TABLES).select(*want.columns).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted(want.fetchall(), key=str)


def test_folds(spark):
    from zlib import crc32

    docs = spark.range(50).withColumnRenamed("id", "doc_id")
    found = docs.select("doc_id", (queries._fold(7) == 2).alias("h")).collect()
    assert all(r.h == (crc32(str(r.doc_id).encode()) % 7 == 2) for r in found)
    assert docs.where(F.lit(True)).count() == 50
