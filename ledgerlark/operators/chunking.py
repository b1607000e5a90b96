"""Chunking: texts to overlapping windows, packed paragraphs, turns and sections."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ledgerlark.functions import text
from ledgerlark.operators.materialise import small_batches


def word_windows(df: DataFrame, key: str, column: str, size: int, overlap: int, least: int = 10) -> DataFrame:
    """Windows of ``size`` words that share ``overlap`` words: key, chunk_index, content, word_count.

    A text of at most ``size`` words is one chunk, as it is. Else windows begin every ``size - overlap`` words
    while words are left, so a last window may lie within the overlap of the one before. Chunks of fewer
    than ``least`` words are dropped; the others keep their place in the numbering.
    """
    words = df.select(key, F.coalesce(F.col(column), F.lit("")).alias("raw"), text.words(F.col(column)).alias("w"))
    n = F.size("w")
    starts = F.when(n > size, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array(F.lit(0)))
    content = F.when(F.col("n") <= size, F.col("raw")).otherwise(F.array_join("part", " "))
    at = words.select(key, "raw", "w", n.alias("n"), F.posexplode(starts).alias("chunk_index", "start"))
    cut = at.select(key, "raw", "n", "chunk_index", F.slice("w", F.col("start") + 1, size).alias("part"))
    return cut.select(key, "chunk_index", content.alias("content"), F.size("part").alias("word_count")).where(F.col("word_count") >= least)


SENTENCE = re.compile(r"(?<=[.!?])\s+")


def pack(pieces: list[str], most: int, glue: str, slack: int) -> list[str]:
    """Pieces joined in order while the sum of lengths stays within ``most`` (``slack`` for each joint)."""
    found, current = [], ""
    for piece in pieces:
        if current and len(current) + len(piece) + slack <= most:
            current += glue + piece
        else:
            if current:
                found.append(current)
            current = piece
    if current:
        found.append(current)
    return found


def split_long(piece: str, most: int) -> list[str]:
    """A paragraph over the limit as packs of its sentences; a longer sentence stays whole."""
    return [piece] if len(piece) <= most else pack(SENTENCE.split(piece), most, " ", 1)


def paragraphs_of(whole: str, most: int, parted: str, least: int = 0) -> list[str]:
    """Chunks of a text's paragraphs: joined up to ``most`` characters, long ones split at sentences.

    Chunks under ``least`` characters are dropped; if nothing is left, a text with words is one chunk.
    """
    pieces = [p.strip() for p in whole.split(parted)]
    pieces = [s for p in pieces if p for s in split_long(p, most)]
    found = [c for c in pack(pieces, most, "\n", 1) if len(c) >= least]
    return found or ([whole.strip()] if whole.strip() else [])


def _chunks(f):
    """A column function from a text to its chunks; a text is a row of its own, so nothing is shuffled."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda t: f(t or ""))

    return run


def paragraph_chunks(df: DataFrame, key: str, column: str, most: int = 800, parted: str = "\n\n", least: int = 0) -> DataFrame:
    """key, chunk_index and content of packed paragraphs (see ``paragraphs_of``)."""
    small_batches(df.sparkSession)
    cut = _chunks(lambda t: paragraphs_of(t, most, parted, least))
    return df.select(key, F.posexplode(cut(F.col(column))).alias("chunk_index", "content"))


HEADING = re.compile(r"(§\s*[\d.-]+[A-Z]?)\.?\s+(.+?)(?:\.|\[|$)")


def sections_of(whole: str, small: int = 300, large: int = 2000, least: int = 100) -> list[dict[str, str]]:
    """Chunks of a code text with their content, section and title; parts begin at lines with a section sign and a number.

    A small part joins the chunk before, unless that is large already; a chunk keeps the number and title of its first part that
    has them, and one that follows a large chunk takes over what it lacks. Chunks of fewer than ``least`` characters are
    dropped.
    """
    found: list[dict[str, str]] = []
    for part in re.split(r"(?m)(?=^\s*§\s*\d)", whole):
        part = part.strip()
        if not part:
            continue
        m = HEADING.match(part)
        new = {"content": part, "section": m[1].strip() if m else "", "title": m[2].strip().rstrip(".") if m else ""}
        last = found[-1] if found else None
        if last and len(last["content"]) > large:
            found.append({k: v or last[k] for k, v in new.items()})
        elif last and len(part) < small:
            last["content"] += "\n\n" + part
            if new["section"] and not last["section"]:
                last |= {k: new[k] for k in ("section", "title")}
        else:
            found.append(new)
    return [c for c in found if len(c["content"].strip()) >= least]


def section_chunks(df: DataFrame, key: str, column: str, **limits: int) -> DataFrame:
    """key, chunk_index, content, section and title of ``sections_of``."""
    small_batches(df.sparkSession)

    @F.pandas_udf("array<struct<content:string,section:string,title:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sections_of(t or "", **limits))

    return df.select(key, F.posexplode(cut(F.col(column))).alias("chunk_index", "c")).select(key, "chunk_index", "c.*")


def timed_pieces(df: DataFrame, most: int = 1500) -> DataFrame:
    """Turns (start, end, text) cut at sentences to pieces of at most ``most`` characters, with the share of the
    turn's time that a piece's characters have."""
    small_batches(df.sparkSession)
    cut = _chunks(lambda t: split_long(t, most))
    others = [c for c in df.columns if c not in ("start", "end", "text")]
    parts = df.select(*others, "start", "end", F.length("text").alias("n"), F.explode(F.array(cut(F.col("text")))).alias("parts"))
    before = F.transform("parts", lambda _, i: F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda s, p: s + F.length(p)))
    placed = parts.withColumn("before", before).select(*others, "start", "end", "n", F.posexplode(F.arrays_zip("parts", "before")).alias("piece", "p"))
    share = lambda chars: F.col("start") + (F.col("end") - F.col("start")) * F.coalesce(F.try_divide(chars, F.col("n")), F.lit(0.0))
    return placed.select(
        *others,
        "piece",
        share(F.col("p.before")).alias("start"),
        F.least("end", share(F.col("p.before") + F.length("p.parts"))).alias("end"),
        F.col("p.parts").alias("text"),
    )


def chunk_numbers(chars: np.ndarray, most: int) -> np.ndarray:
    """The number of the chunk of each utterance: a chunk takes utterances, each with a space, until ``most`` would be passed."""
    before = np.cumsum(chars + 1) - (chars + 1)
    first, at = np.zeros(len(chars), np.int64), 0
    while at < len(chars):
        # the first one that doesn't fit any more
        at = max(at + 1, int(np.searchsorted(before + chars, before[at] + most, "right")))
        first[at : at + 1] = 1
    return first.cumsum()


def accumulated(df: DataFrame, key: str, most: int) -> DataFrame:
    """key, chunk_index, start, end, content and chars of utterances (start, end, text) gathered in order until ``most``
    characters would be passed; a longer one is a chunk of its own. Empty texts are left out.

    Where a chunk begins depends on all before it, so the lengths of a transcript's utterances, and these alone, are followed in
    one place, by jumps from chunk to chunk.
    """
    said = df.where("text is not null and text <> ''").select(key, "start", "end", "text")
    rows = said.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy("start", "end", "text"))).withColumn("__n", F.length("text"))
    kind = df.schema[key].dataType.simpleString()

    def cut(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("__i")
        return pd.DataFrame({"__g": batch[key], "__at": batch["__i"], "chunk_index": chunk_numbers(batch["__n"].to_numpy().astype(np.int64), most)})

    placed = rows.select(key, "__i", "__n").groupBy(key).applyInPandas(cut, f"__g {kind}, __at int, chunk_index int")
    whole = rows.join(placed, F.col("__g").eqNullSafe(F.col(key)) & (F.col("__at") == F.col("__i")))
    chunks = whole.groupBy(key, "chunk_index").agg(F.array_sort(F.collect_list(F.struct("__i", "start", "end", "text"))).alias("__u"))
    content = F.array_join(F.transform("__u", lambda x: x["text"]), " ")
    return chunks.select(
        key,
        "chunk_index",
        F.col("__u")[0]["start"].alias("start"),
        F.element_at("__u", -1)["end"].alias("end"),
        F.trim(content).alias("content"),
        (F.length(content) + 1).cast("bigint").alias("chars"),
    )


def incidents(df: DataFrame, key: str, column: str, kinds: list[tuple[str, list[str]]], parted: str = "\n", most: int = 20) -> DataFrame:
    """Paragraphs of at least 30 characters as incidents with kind, street and date; the first ``most`` of a text."""
    from ledgerlark.operators.filters import first_category

    parts = F.slice(F.filter(F.split(column, parted), lambda p: F.length(F.trim(p)) >= 30), 1, most)
    rows = df.select(key, F.posexplode(parts).alias("place", "content"))
    return rows.select(
        key,
        "place",
        first_category("content", kinds, "other").alias("kind"),
        F.regexp_extract("content", text.STREET, 0).alias("street"),
        F.regexp_extract("content", text.DATE, 0).alias("day"),
    )


def transcript_stats(df: DataFrame, key: str, speaker: str, column: str, end: str | None = None) -> DataFrame:
    """Utterances, speakers and words of each transcript, and its duration where times are given."""
    found = [
        F.count("*").alias("utterances"),
        F.count_distinct(speaker).alias("speakers"),
        F.sum(text.word_count(F.col(column))).cast("bigint").alias("words"),
    ]
    return df.groupBy(key).agg(*found, *([F.max(end).alias("duration")] if end else []))


def line_of(speaker: Column, start: Column, said: Column) -> Column:
    """``[m:ss] speaker: text``."""
    return F.concat(F.lit("["), text.clock(start), F.lit("] "), speaker, F.lit(": "), said)
