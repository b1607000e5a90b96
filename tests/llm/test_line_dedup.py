import hashlib

from pyspark.sql import functions as F

from ledgerlark.llm import line_dedup

from .conftest import rows

BLANKS = " \t\n\x0b\x0c\r"


def brute(texts, min_chars=40, min_docs=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(BLANKS).translate(lower)
    holders = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders.setdefault(key(line), set()).add(i)
    found = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or i == max(holders[key(x)])]
        found.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return found


def run(docs):
    kept = line_dedup.keep_bitmaps(docs)
    text = line_dedup.kept_text(F.coalesce("text", F.lit("")), F.col("keep_bitmap"))
    found = kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text.cast("binary"), 256)).collect()
    return [tuple(r) for r in found]


def test_against_brute_force(docs):
    want = brute([(r[0], r[1]) for r in rows()])
    assert sorted(run(docs), key=str) == sorted(want, key=str)
    assert any(w[2] for w in want)


def test_long_document_bitmaps(spark):
    shared = [f"line number {i} that several of the documents have in common" for i in range(300)]
    texts = [(d, "\n".join(x for i, x in enumerate(shared) if i % (d + 2))) for d in range(8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(run(docs)) == sorted(brute(texts))


def test_keeps_columns_and_empty_table(docs, no_docs):
    found = line_dedup.keep_bitmaps(docs)
    assert set(docs.columns) - {"keep_bitmap"} <= set(found.columns)
    assert len(found.columns) == len(set(found.columns))
    assert line_dedup.keep_bitmaps(no_docs).count() == 0


def test_many_lines_with_a_dropped_one_in_each_word(spark):
    """Putting a text together takes time linear in its lines."""
    shared = [f"this is the shared line number {i} of a very long list" for i in range(2000)]
    own = [line for i in range(2000) for line in (*(f"own {i} {k}" for k in range(99)), shared[i])]
    texts = ["\n".join(own), *["\n".join(shared)] * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = line_dedup.keep_bitmaps(docs).withColumn("text", line_dedup.kept_text(F.col("text"), F.col("keep_bitmap")))
    first = kept.where("doc_id = 0").first()
    assert first.n_lines == 200_000 and first.n_dropped == 2000
    assert first.text == "\n".join(line for line in own if line.startswith("own"))


def test_bitmaps_with_gaps(spark):
    text = "\n".join(map(str, range(400)))
    gone = {3: [70, 71], 5: [350]}
    words = {1: (1 << 6) | (1 << 7), 5: 1 << 30}
    rows = [(text, [(w, ~bits) for w, bits in words.items()]), (text, []), (None, []), ("a", [(0, ~1)])]
    df = spark.createDataFrame(rows, "t string, b array<struct<word:int,bits:bigint>>")
    got = [r[0] for r in df.select(line_dedup.kept_text(F.col("t"), F.col("b"))).collect()]
    left = {x for some in gone.values() for x in some}
    assert got == ["\n".join(str(i) for i in range(400) if i not in left), text, None, ""]
