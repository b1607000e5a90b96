"""Records of web pages and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import text


def title_of(page: Column) -> Column:
    """A page's title, references decoded and spaces squeezed."""
    return text.strip_tags(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links_of(page: Column) -> Column:
    """The (href, label) of a page's links, in order."""
    whole = F.regexp_extract_all(page, F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(0))
    href = lambda x: F.regexp_extract(x, r'(?is)href="([^"]*)"', 1)
    return F.transform(whole, lambda x: F.struct(href(x).alias("href"), text.strip_tags(x).alias("label")))


def absolute(base: Column, href: Column) -> Column:
    """A link against its page's address."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^?#]*/)", 1)
    return (
        F.when(href.rlike("^https?://"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(F.when(folder.rlike("^https?://[^/]+/"), folder).otherwise(F.concat(root, F.lit("/"))), href))
    )


def listing(pages: DataFrame, key: str, url: str, page: str, least: int = 5, most: int = 30) -> DataFrame:
    """The first ``most`` links of a page whose label has ``least`` characters or more, each address once."""
    rows = pages.select(key, F.col(url).alias("__url"), F.posexplode(links_of(F.col(page))).alias("place", "a"))
    rows = rows.where(F.length("a.label") >= least)
    once = rows.groupBy(key, absolute(F.col("__url"), F.col("a.href")).alias("href")).agg(F.min(F.struct("place", "a.label")).alias("m"))
    whole = once.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("m.place", "m.label", "href"))), 1, most).alias("x"))
    return whole.select(key, F.explode("x").alias("x")).select(key, "x.label", "x.href")


def scraped(df: DataFrame, source: str, category: str, title: str, url: str, summary: str) -> DataFrame:
    """Rows in the form of stored articles: id, title, url, source, category, summary, defaults for what is missing."""
    return df.select(
        text.short_id(F.concat_ws("|", F.lit(source), F.col(title), F.col(url))).alias("id"),
        F.trim(title).alias("title"),
        F.coalesce(url, F.lit("")).alias("url"),
        F.lit(source).alias("source"),
        F.coalesce(F.lit(category), F.lit("news")).alias("category"),
        F.substring(F.coalesce(summary, F.lit("")), 1, 500).alias("summary"),
    )


def feed_items(c: Column) -> Column:
    """The (title, link, description, published) of a feed's items or entries."""
    items = F.regexp_extract_all(c, F.lit(r"(?is)<(item|entry)[\s>].*?</\1>"), F.lit(0))
    inner = lambda x, tag: text.strip_tags(
        F.regexp_replace(F.regexp_extract(x, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    )
    link = lambda x: F.coalesce(F.nullif(inner(x, "link"), F.lit("")), F.regexp_extract(x, r'(?is)<link[^>]*href="([^"]*)"', 1))
    return F.transform(
        items,
        lambda x: F.struct(
            inner(x, "title").alias("title"),
            link(x).alias("link"),
            F.coalesce(F.nullif(inner(x, "description"), F.lit("")), inner(x, "summary")).alias("description"),
            F.coalesce(F.nullif(inner(x, "pubDate"), F.lit("")), inner(x, "updated")).alias("published"),
        ),
    )


def relevant(title: Column, description: Column, places: list[str], topics: list[str] | None = None) -> Column:
    """Whether title or description has a place and, if given, a topic as well."""
    both = F.concat_ws(" ", title, description)
    some = lambda words: both.rlike(f"(?i)\\b({'|'.join(words)})\\b")
    return some(places) & some(topics) if topics else some(places)


def calendar_lines(c: Column, most: int = 20) -> Column:
    """The first (day, title) of lines like ``March 3 – Concert``."""
    pattern = rf"(?m)^\s*({text.MONTH} \d{{1,2}})\s*[-–:]\s*(.{{3,}})$"
    day, title = (F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.slice(F.zip_with(day, title, lambda d, t: F.struct(d.alias("day"), F.trim(t).alias("title"))), 1, most)


def agenda_items(page: Column) -> Column:
    """The (kind, title) of an agenda's list items, cut at the first `` - ``."""
    items = F.regexp_extract_all(page, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1))
    plain = F.transform(items, text.strip_tags)
    return F.transform(
        plain,
        lambda x: F.struct(
            F.when(x.contains(" - "), F.substring_index(x, " - ", 1)).otherwise("").alias("kind"),
            F.when(x.contains(" - "), F.regexp_replace(x, r"^.*? - ", "")).otherwise(x).alias("title"),
        ),
    )


def minutes(page: Column) -> Column:
    """attendees, absent, motions (moved_by, seconded_by, result), speakers, text and word_count of minutes."""
    plain = text.strip_tags(page)
    names = lambda label: F.array_distinct(
        F.filter(
            F.transform(F.split(F.regexp_extract(plain, rf"(?i)\b{label}:\s*([^.;]*)", 1), r",|\band\b"), lambda x: F.trim(x)),
            lambda x: x != "",
        )
    )
    motion = r"(?i)motion (?:made )?by ([A-Z][\w.'-]+(?: [A-Z][\w.'-]+)*),? (?:and )?seconded by ([A-Z][\w.'-]+(?: [A-Z][\w.'-]+)*)(?:[^.]*?\b(carried|passed|failed|approved)\b)?"
    group = lambda i: F.regexp_extract_all(plain, F.lit(motion), F.lit(i))
    motions = F.transform(
        F.arrays_zip(group(1).alias("moved_by"), group(2).alias("seconded_by"), group(3).alias("result")),
        lambda m: m,
    )
    speakers = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"\b([A-Z][a-z]+ [A-Z][a-z]+) (?:stated|said|asked|noted)\b"), F.lit(1)))
    return F.struct(
        names("present").alias("attendees"),
        names("absent").alias("absent"),
        motions.alias("motions"),
        speakers.alias("speakers"),
        plain.alias("text"),
        text.word_count(plain).alias("word_count"),
    )
