"""Chapters of a printed code: what each line is, and the articles, sections, notes and references that the lines make up."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: What stands before: front matter, a history note, the references, a section's text, a note, an article's or a section's title.
FRONT, HISTORY, REFERENCES, BODY, NOTE, ARTICLE, TITLE = range(7)
#: What a line is by itself, by letter. Plain lines: whether they end a bracket, and whether a title can go on in them.
CLASSES = {"blank": "b", "mark": "m", "history": "h", "history, whole": "H", "references": "r", "article": "a", "section": "s", "section, open": "S", "note": "n", "plain": "p", "closes": "c", "short": "t", "short, closes": "u"}
KINDS = ["blank", "page mark", "contents", "history", "references", "reference", "article", "article title", "section", "section title", "text", "note"]
BLANK, MARK, CONTENTS, STORY, REFERRED, REFERENCE, HEAD, HEAD_TITLE, SECTION, SECTION_TITLE, TEXT, NOTED = range(len(KINDS))

NUMBERED = r"^\s*§\s*([\dA-Za-z.-]*\d[A-Za-z]?)\.\s*(.*?)\s*$"
ARTICLE_LINE = r"^\s*ARTICLE\s+([IVXLC]+[A-Z]*)\s*$"
NOTE_LINE = r"(?i)^\s*\d{1,3}\.\s+editor'?s?\s+note"
#: A page number, or a running head: section numbers and capitals with a wide gap between them.
MARK_LINE = r"^\s*\d{1,4}\s*$|^\s*§\s*\S+\s{6,}([A-Z][A-Z ,'&-]+|\S.*§\s*\S+)\s*$"
ITEM_LINE = r"^\s*[(\[]?[0-9A-Za-z]{1,4}[.)\]]\s"
AMENDED = r"\[((?:Amended|Added|Repealed)[^\]]*)\]"


def _step(state: int, c: str) -> tuple[int, int]:
    """The kind of a line of class ``c`` after ``state``, and the state after it."""
    front = state in (FRONT, HISTORY, REFERENCES)
    if c == "b":
        return BLANK, BODY if state in (NOTE, ARTICLE, TITLE) else state
    if c == "m":
        return MARK, state
    if c == "a":
        return HEAD, ARTICLE
    if c in "sS":
        return SECTION, TITLE if c == "S" else BODY
    if c in "hH" and front:
        return STORY, FRONT if c == "H" else HISTORY
    if c == "r" and front:
        return REFERRED, REFERENCES
    if c == "n" and not front:
        return NOTED, NOTE
    if state == HISTORY:
        return STORY, FRONT if c in "cuH" else HISTORY
    if state == TITLE:
        return (SECTION_TITLE if c in "tu" else TEXT), BODY
    return {FRONT: CONTENTS, REFERENCES: REFERENCE, BODY: TEXT, NOTE: NOTED, ARTICLE: HEAD_TITLE}[state], state


STEPS = {c: [_step(s, c) for s in range(7)] for c in CLASSES.values()}


@F.pandas_udf(StructType([StructField("kind", ArrayType(IntegerType())), StructField("item", ArrayType(IntegerType()))]))
def followed(classes: pd.Series) -> pd.DataFrame:
    """The kinds of the lines whose classes a text's letters are, and the running number of articles and sections."""
    kinds, items = [], []
    for letters in classes:
        state, own = FRONT, np.empty(len(letters), np.int32)
        for i, c in enumerate(letters):
            own[i], state = STEPS[c][state]
        kinds.append(own)
        items.append(np.cumsum((own == HEAD) | (own == SECTION), dtype=np.int32))
    return pd.DataFrame({"kind": kinds, "item": items})


def _class(line: Column, in_front: Column, chapter: Column) -> Column:
    """The letter of a line; ``in_front`` says that a history note or references are still to come, so headings are contents."""
    bare, code = F.trim(line), CLASSES
    title = F.regexp_extract(line, NUMBERED, 2)
    closes, short = F.contains(line, F.lit("]")), (F.length(bare) < 60) & ~line.rlike(ITEM_LINE)
    plain = F.when(closes & short, code["short, closes"]).when(closes, code["closes"]).when(short, code["short"]).otherwise(code["plain"])
    return (
        F.when(~line.rlike(r"\S"), code["blank"])
        .when(line.rlike(MARK_LINE) | (F.length(bare).between(1, 59) & (bare == F.upper(chapter))), code["mark"])
        .when(F.contains(line, F.lit("[HISTORY")), F.when(closes, code["history, whole"]).otherwise(code["history"]))
        .when(bare == "GENERAL REFERENCES", code["references"])
        .when(~in_front & line.rlike(ARTICLE_LINE), code["article"])
        .when(~in_front & line.rlike(NUMBERED), F.when((title == "") | title.rlike(r"[.\])]$"), code["section"]).otherwise(code["section, open"]))
        .when(line.rlike(NOTE_LINE), code["note"])
        .otherwise(plain)
    )


def chapter_lines(df: DataFrame, key: str, column: str, title: str) -> DataFrame:
    """key, line, kind, item and content of each line of the chapters in ``column``; ``title`` is the column of their titles.

    Kinds are ``KINDS``. Before the first history note and the line GENERAL REFERENCES, headings are contents. A history
    note ends with its bracket, a note of the editor and an article's title with a blank line; a section's title that has no end
    goes on in the next line, if that is short and no item of a list. Page numbers and running heads interrupt nothing. item numbers
    articles and sections from 1 on; lines before them have 0. A null text has no lines; a null title no running head.

    A line's class is Spark's work; what it is depends on those before it, so the classes of a chapter, a letter a line, are
    followed by a table of states. Texts don't leave the JVM and nothing is shuffled.
    """
    rows = df.select(key, F.split(column, "\n", -1).alias("__l"), F.coalesce(title, F.lit("")).alias("__t")).where("__l is not null")
    first = lambda f: F.array_position(F.transform("__l", f), True)
    last = F.greatest(first(lambda x: F.contains(x, F.lit("[HISTORY"))), first(lambda x: F.trim(x) == "GENERAL REFERENCES"))
    rows = rows.withColumn("__f", last)
    letters = F.array_join(F.transform("__l", lambda x, i: _class(x, i < F.col("__f"), F.col("__t"))), "")
    rows = rows.withColumn("__s", followed(letters))
    each = rows.select(key, F.posexplode(F.arrays_zip("__l", F.col("__s.kind").alias("kind"), F.col("__s.item").alias("item"))).alias("line", "x"))
    names = F.array(*[F.lit(k) for k in KINDS])
    return each.select(key, "line", names[F.col("x.kind")].alias("kind"), F.col("x.item").alias("item"), F.col("x.__l").alias("content"))


def _gathered(kinds: list[str], glue: str, bare: bool = True) -> Column:
    """The lines of some kinds, in order, put together."""
    line = F.struct("line", (F.trim("content") if bare else F.col("content")).alias("c"))
    listed = F.array_sort(F.collect_list(F.when(F.col("kind").isin(kinds), line)))
    return F.array_join(F.transform(listed, lambda x: x["c"]), glue)


def chapter_items(lines: DataFrame, key: str) -> DataFrame:
    """key, item, kind, label, title, amended, content, notes and article of the articles and sections in ``chapter_lines``.

    label is the article's or section's number, article the number of the article it stands in, amended what a heading says of
    changes in brackets, which then isn't part of the title. Empty ones stay.
    """
    parts = lines.where("item > 0").groupBy(key, "item").agg(
        F.min(F.when(F.col("kind").isin("article", "section"), F.col("kind"))).alias("kind"),
        _gathered(["article", "section"], "").alias("__head"),
        _gathered(["article title", "section title"], " ").alias("__more"),
        _gathered(["text"], "\n", bare=False).alias("content"),
        _gathered(["note"], " ").alias("notes"),
    )
    section = F.col("kind") == "section"
    whole = F.trim(F.concat_ws(" ", F.when(section, F.regexp_extract("__head", NUMBERED, 2)), "__more"))
    labelled = parts.select(
        key,
        "item",
        "kind",
        F.when(section, F.regexp_extract("__head", NUMBERED, 1)).otherwise(F.regexp_extract("__head", ARTICLE_LINE, 1)).alias("label"),
        F.trim(F.regexp_replace(whole, AMENDED, "")).alias("title"),
        F.nullif(F.regexp_extract(whole, AMENDED, 1), F.lit("")).alias("amended"),
        "content",
        "notes",
    )
    before = Window.partitionBy(key).orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    return labelled.withColumn("article", F.last(F.when(~section, F.col("label")), ignorenulls=True).over(before))


def chapter_references(lines: DataFrame, key: str) -> DataFrame:
    """key, place, label, ref and chapter of the entries ``label — See ref`` under GENERAL REFERENCES, two columns a line or more.

    An entry without a dash goes on with the entry before. chapter is the number in ``Ch. n``, if there is one.
    """
    cells = F.filter(F.split(F.trim("content"), r"\s{3,}"), lambda x: x != "")
    each = lines.where("kind = 'reference'").select(key, "line", F.posexplode(cells).alias("cell", "part"))
    over = Window.partitionBy(key).orderBy("line", "cell").rowsBetween(Window.unboundedPreceding, 0)
    # the first cell begins an entry in any case
    begun = each.withColumn("place", F.greatest(F.lit(1), F.sum(F.contains("part", F.lit("—")).cast("int")).over(over) + F.lit(0)))
    joined = begun.groupBy(key, "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "cell", "part"))), lambda x: x["part"]), " ").alias("e"))
    form = r"^(.*?)\s*—\s*See\s+(.*?)\.?$"
    ref = F.regexp_extract("e", form, 2)
    return joined.where(F.col("e").rlike(form)).select(
        key, F.col("place").cast("int").alias("place"), F.regexp_extract("e", form, 1).alias("label"), ref.alias("ref"), F.nullif(F.regexp_extract(ref, r"Ch\.\s*(\d+)", 1), F.lit("")).cast("int").alias("chapter")
    )
