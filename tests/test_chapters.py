"""Chapters of a code: hand-made pages, and a long one."""

import time

from ledgerlark.operators import chapters

PAGE = """Chapter 12
§ 12-1. Purpose.      § 12-2. Fees.
[HISTORY: Adopted by the Board
5-1-1990 by L.L. No. 3-1990.]
GENERAL REFERENCES
Zoning — See Ch. 230.      Dogs — See
Chapter on animals.
§ 12-1          NOISE

ARTICLE IV
General
provisions

§ 12-1. Purpose. [Amended 3-2-2001]
The purpose is quiet.
    17
It is kept.
3. Editor's Note: see the
next page.

More text.
§ 12-2.1A. Fees and other
charges to be paid
A. First fee.
§ 12-3. Very long open title
A. An item."""


def lines_of(spark, *texts):
    df = spark.createDataFrame([(i, t, "Noise") for i, t in enumerate(texts)], "id int, text string, title string")
    return chapters.chapter_lines(df, "id", "text", "title")


def test_each_line_has_a_kind(spark):
    rows = lines_of(spark, PAGE).orderBy("line").collect()
    assert [r.content for r in rows] == PAGE.split("\n")
    want = "contents,contents,history,history,references,reference,reference,page mark,blank,article,article title,article title,blank"
    want += ",section,text,page mark,text,note,note,blank,text,section,section title,text,section,text"
    assert [r.kind for r in rows] == want.split(",")
    assert [r.item for r in rows] == [0] * 9 + [1] * 4 + [2] * 8 + [3] * 3 + [4] * 2


def test_items_and_references(spark):
    lines = lines_of(spark, PAGE)
    got = [tuple(r)[1:] for r in chapters.chapter_items(lines, "id").orderBy("item").collect()]
    assert got == [
        (1, "article", "IV", "General provisions", None, "", "", "IV"),
        (2, "section", "12-1", "Purpose.", "Amended 3-2-2001", "The purpose is quiet.\nIt is kept.\nMore text.", "3. Editor's Note: see the next page.", "IV"),
        (3, "section", "12-2.1A", "Fees and other charges to be paid", None, "A. First fee.", "", "IV"),
        (4, "section", "12-3", "Very long open title", None, "A. An item.", "", "IV"),
    ]
    refs = [tuple(r) for r in chapters.chapter_references(lines, "id").orderBy("place").collect()]
    assert refs == [(0, 1, "Zoning", "Ch. 230", 230), (0, 2, "Dogs", "Chapter on animals", None)]


def test_null_empty_and_no_front_matter(spark):
    got = lines_of(spark, None, "", "NOISE\n§ 1-1. A.\nb").orderBy("id", "line").collect()
    assert [(r.id, r.kind, r.item) for r in got] == [(1, "blank", 0), (2, "page mark", 0), (2, "section", 1), (2, "text", 1)]
    assert chapters.chapter_items(lines_of(spark, None, ""), "id").count() == 0


def test_long_chapter_in_linear_time(spark):
    long = "\n".join(f"§ 1-{i}. Title {i}.\nText {i}" for i in range(100_000))
    at = time.time()
    assert chapters.chapter_items(lines_of(spark, long), "id").where("content like 'Text %'").count() == 100_000
    assert time.time() - at < 90
