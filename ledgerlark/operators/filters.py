"""Predicates and filters."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_text(column: str) -> Column:
    """Neither null nor empty."""
    return F.col(column).isNotNull() & (F.col(column) != "")


def any_contains(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows that hold ``needle``, whatever its case, in any of the columns."""
    return df.where(reduce(Column.__or__, [F.col(c).ilike(f"%{needle}%") for c in columns]))


def build(min_size=None, below_price=None, contains=None, brand=None) -> Column:
    """A condition from those arguments that are given; true if none is."""
    parts = [
        None if min_size is None else F.col("p_size") >= min_size,
        None if below_price is None else F.col("p_retailprice") < below_price,
        None if contains is None else F.col("p_name").ilike(f"%{contains}%"),
        None if brand is None else F.col("p_brand") == brand,
    ]
    return reduce(Column.__and__, [p for p in parts if p is not None], F.lit(True))


def days_before(df: DataFrame, column: str, first: int, last: int, as_of=None) -> DataFrame:
    """Rows from ``first`` to ``last`` days before ``as_of`` (the newest date of the table unless given)."""
    newest = F.lit(as_of) if as_of is not None else F.max(column)
    limits = df.agg(newest.cast("date").alias("__as_of"))
    day = F.col(column).cast("date")
    inside = day.between(F.date_sub("__as_of", first), F.date_sub("__as_of", last))
    return df.join(F.broadcast(limits)).where(inside).drop("__as_of")


def is_junk_name(column: str) -> Column:
    """Too short, a stop word, or a single word."""
    c = F.col(column)
    return (F.length(c) < 3) | F.lower(c).isin("unknown", "n/a") | ~c.contains(" ")


# fixed values: what short utterances of a vote say
VOTES = "abstain, abstained, all in favor, aye, motion carries, nay, oppose, opposed, second, seconded, so moved".split(", ")
VOTE_PARTS = "abstain, all in favor, aye, motion carries, nay, opposed, second, so moved".split(", ")


def spoken(df: DataFrame, column: str, min_chars: int = 30, whole_words: bool = True) -> DataFrame:
    """Utterances with text of some length, and short ones that say a vote: in whole words, or in any part of a word."""
    said = F.trim(column)
    vote = said.rlike(rf"(?i)\b({'|'.join(VOTES)})\b" if whole_words else f"(?i)({'|'.join(VOTE_PARTS)})")
    return df.where((said != "") & ((F.length(said) >= min_chars) | vote))


def contains_any(column: str, words: list[str]) -> Column:
    return reduce(Column.__or__, [F.col(column).ilike(f"%{w}%") for w in words])


def first_category(column: str, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The name of the first rule with a keyword that the text has."""
    found = F.when(contains_any(column, rules[0][1]), rules[0][0])
    for name, words in rules[1:]:
        found = found.when(contains_any(column, words), name)
    return found.otherwise(default)


def level(column: str, steps: list[tuple[float, str]], above: str) -> Column:
    """The name of the first step whose bound is larger than the value."""
    found = F.when(F.col(column) < steps[0][0], steps[0][1])
    for bound, name in steps[1:]:
        found = found.when(F.col(column) < bound, name)
    return found.otherwise(above)


ROLES = "chair clerk mayor speaker resident".split()


def is_person_name(column: str) -> Column:
    """Two or more capitalised words, none of which is a role."""
    c = F.col(column)
    return c.rlike("^[A-Z][a-z'-]+( [A-Z][a-z'.-]*)+$") & ~F.lower(c).rlike(rf"\b({'|'.join(ROLES)})\b")


def lines_in_many(df: DataFrame, key: str, column: str, min_docs: int, min_chars: int) -> DataFrame:
    """Lines of at least ``min_chars`` found in at least ``min_docs`` documents: line and n_docs.

    A document's repeats are dropped inside its row, so only one row a line and document is shuffled, and
    the counts are added up before that.
    """
    lines = F.array_distinct(F.filter(F.split(column, "\n", -1), lambda x: F.length(x) >= min_chars))
    held = df.select(key, F.explode(lines).alias("line"))
    return held.groupBy("line").agg(F.count(key).alias("n_docs")).where(F.col("n_docs") >= min_docs)


PAGE_NUMBER = r"(?i)^(?:page\s+\d+(?:\s+of\s+\d+)?|\d+)$"


def without_lines(df: DataFrame, key: str, column: str, lines: DataFrame, line: str) -> DataFrame:
    """key, text and n_dropped: texts without page numbers and without the lines that ``lines`` lists, as they are between blanks; of
    empty lines that follow one another the first stays, none at the ends. A key is a text; null texts are empty."""
    rows = df.select(key, F.posexplode(F.split(F.coalesce(column, F.lit("")), "\n", -1)).alias("__i", "__line"))
    rows = rows.withColumn("__bare", F.btrim("__line", F.lit(" \t\r\x0b\x0c")))
    listed = lines.select(F.col(line).alias("__bare")).where("__bare <> ''").distinct().withColumn("__listed", F.lit(True))
    marked = rows.join(listed, "__bare", "left").withColumn("__gone", F.col("__bare").rlike(PAGE_NUMBER) | F.coalesce("__listed", F.lit(False)))
    kept = F.array_sort(F.collect_list(F.when(~F.col("__gone"), F.struct("__i", "__line", "__bare"))))
    whole = marked.groupBy(key).agg(kept.alias("__kept"), F.count_if("__gone").alias("n_dropped"))
    empty = lambda x: x["__bare"] == ""
    once = F.filter("__kept", lambda x, i: ~(empty(x) & F.coalesce(empty(F.get("__kept", i - 1)), F.lit(False))))
    text = F.btrim(F.array_join(F.transform(once, lambda x: x["__line"]), "\n"), F.lit(" \t\n\r\x0b\x0c"))
    return whole.select(key, text.alias("text"), "n_dropped")
