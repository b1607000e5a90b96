import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that results and helpers use
        T.StructField("score", T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("ids", T.StringType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("keep_bitmap", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("key", T.StringType()),
    ]
)
LINE = "A shared line of more than forty characters, as notices are."
LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(60_000))


def rows():
    texts = [
        (1, f"{LINE}\nown one\n  {LINE.upper()}  "),
        (2, f"own two\n{LINE}"),
        (3, f"{LINE}\t\nown three"),
        (4, f"{LINE}"),
        (5, f"\n{LINE}\n"),
        (5, f"\n{LINE}\n"),  # a repeated row
        (6, None),
        (7, ""),
        (8, " \n\t "),
        (None, f"{LINE}\nno id"),
        (None, None),
        (9, LONG),
        (10, LONG),
        (11, "Étude ÀÉ  日本 😀 \u0000 x"),
        (12, "a b c d e f g h i j k l"),
        (13, "A B C D E F G H I J K L"),
    ]
    return [(i, t, None, "s", None if t is None else len(t), "x", 7, "y", 1, "z", 2, "k") for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
