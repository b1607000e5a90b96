"""Entities and topics: nodes, links, merging of names, and what is related."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import text
from ledgerlark.operators.materialise import written


def entity_states(mentions: DataFrame, name: str, seen: str, known: DataFrame | None = None) -> DataFrame:
    """One row for each slug: slug, name, n, first_seen, last_seen; added to the ``known`` rows of this form.

    Of several spellings of a slug the most frequent counts, then the least; a known name stays.
    """
    spelled = mentions.select(text.slug(F.col(name)).alias("slug"), F.col(name).alias("name"), F.col(seen).alias("seen")).where("slug <> ''")
    each = spelled.groupBy("slug", "name").agg(F.count("*").alias("n"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    best = F.min(F.struct((-F.col("n")).alias("r"), "name"))
    new = each.groupBy("slug").agg(best.alias("b"), F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    new = new.select("slug", F.col("b.name").alias("name"), "n", "first_seen", "last_seen")
    if known is None:
        return new
    both = known.select(new.columns).withColumn("known", F.lit(0)).unionByName(new.withColumn("known", F.lit(1)))
    return both.groupBy("slug").agg(
        F.min(F.struct("known", "name")).getField("name").alias("name"),
        F.sum("n").alias("n"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def spoke_at(turns: DataFrame, event: str, speaker: str) -> DataFrame:
    """Edges from speakers to events with the number of turns."""
    return turns.where(F.col(speaker).isNotNull()).groupBy(speaker, event).agg(F.count("*").alias("weight"))


def merge_aliases(df: DataFrame, name: str, aliases: list[tuple[str, str]]) -> DataFrame:
    """``df`` with each alias of a configured list replaced by its canonical name."""
    table = df.sparkSession.createDataFrame(aliases, f"{name} string, __canonical string")
    joined = df.join(F.broadcast(table.dropDuplicates([name])), name, "left")
    return joined.select(*[F.coalesce("__canonical", name).alias(c) if c == name else F.col(c) for c in df.columns])


def alias_survivors(df: DataFrame, key: str, name: str, canonical: dict[str, list[str]]) -> DataFrame:
    """key, name, slug, survivor (the key of the row that a row is merged into) and renamed, of all rows.

    Rows of a canonical name or one of its aliases become one: the row that has the canonical name, or else that of the first alias
    in the list that there is, which is renamed. Of several rows of one name the one with the least key stays.
    """
    rows = [(alias, own, i) for own, aliases in canonical.items() for i, alias in enumerate([own, *aliases])]
    table = df.sparkSession.createDataFrame(rows, f"{name} string, __own string, __place int").dropDuplicates([name])
    found = df.select(key, name).join(F.broadcast(table), name, "left")
    stays = found.where("__own is not null").groupBy("__own").agg(F.min(F.struct("__place", key)).getField(key).alias("__stays"))
    merged = found.join(stays, "__own", "left")
    own = F.coalesce("__own", name)
    return merged.select(
        key,
        own.alias(name),
        F.replace(F.replace(F.lower(own), F.lit(" "), F.lit("-")), F.lit("'"), F.lit("")).alias("slug"),
        F.coalesce("__stays", key).alias("survivor"),
        (F.col(key).eqNullSafe(F.col("__stays")) & (F.col(name) != own)).alias("renamed"),
    )


#: What no name of a person has.
NOISE = ["every ", "meeting", "order", "the ", "time", "who "]


def bare_name(c: Column) -> Column:
    """A name without what stands in brackets, without a form of address, and with single spaces."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), r"\s+", " "))
    return F.regexp_replace(plain, r"^(?:Dr|Mr|Mrs|Ms)\.\s*", "")


def names_of_minutes(minutes: DataFrame, key: str, member: str, titles: dict[str, str]) -> DataFrame:
    """name, n, role and source of the people in all minutes (attendees, also_present, movers: arrays; text), in order of ``key``.

    Attendees and others present are ``name`` or ``name, role``; without one they are a ``member`` or ``Staff``. A name counts once
    for each place in these lists. Its role is the one in which it is first found, unless a text names it after one of
    ``titles`` (words to a role): then the last of these.
    """
    at = lambda part: F.struct(F.col(key).alias("k"), F.lit(part).alias("part"), "pos").alias("at")
    found = []
    for part, (column, default, source, least) in enumerate([("attendees", member, "attendance", 4), ("also_present", "Staff", "staff", 4), ("movers", member, "motion", 3)]):
        said = F.split("x", ",", 2)
        role = F.coalesce(F.trim(F.get(said, F.lit(1))), F.lit(default)) if column != "movers" else F.lit(default)
        name = bare_name(said[0] if column != "movers" else F.col("x"))
        rows = minutes.select(key, F.posexplode(column).alias("pos", "x")).select(at(part), name.alias("name"), role.alias("role"), F.lit(source).alias("source"), F.lit(1).alias("counted"))
        rows = rows.where(F.length("name") >= least)
        if column == "also_present":
            rows = rows.where((F.length("name") <= 40) & ~F.exists(F.array(*map(F.lit, NOISE)), lambda w: F.contains(F.lower("name"), w)))
        found.append(rows)
    for i, (words, role) in enumerate(titles.items()):
        named = F.regexp_extract_all("text", F.lit(rf"\b{words} (?:Dr\. )?([A-Z][a-z]+ [A-Z][a-z]+)"), F.lit(1))
        rows = minutes.select(key, F.posexplode(named).alias("pos", "name"))
        found.append(rows.select(at(3 + i), "name", F.lit(role).alias("role"), F.lit("title").alias("source"), F.lit(0).alias("counted")).where(F.length("name").between(5, 34)))
    each = reduce(DataFrame.unionByName, found).groupBy("name").agg(
        F.sum("counted").alias("n"),
        F.min(F.struct("at", "role", "source", "counted")).alias("first"),
        F.max(F.when(F.col("counted") == 0, F.struct("at", "role"))).alias("said"),
    )
    n = F.col("n") + F.when(F.col("first.counted") == 0, 1).otherwise(0)
    return each.select("name", n.alias("n"), F.coalesce("said.role", "first.role").alias("role"), "first.source")


def canonical_names(df: DataFrame, name: str) -> DataFrame:
    """name and canonical: names that differ by titles alone have one name, which has two words or more if any has,
    no title, and is the shortest of these."""
    names = df.select(F.col(name).alias("name")).distinct().withColumn("bare", F.lower(text.without_title(F.col("name"))))
    rank = F.struct(
        F.when(text.word_count(F.col("name")) >= 2, 0).otherwise(1).alias("single"),
        F.when(text.title_of(F.col("name")) == "", 0).otherwise(1).alias("titled"),
        F.length("name").alias("n"),
        "name",
    )
    best = names.groupBy("bare").agg(F.min(rank).getField("name").alias("canonical"))
    return names.join(best, "bare").select("name", "canonical")


def single_match(df: DataFrame, name: str) -> DataFrame:
    """name and canonical: names of one word that are the last word of exactly one longer name."""
    names = df.select(F.col(name).alias("name")).distinct().withColumn("last", text.surname(F.col("name")))
    short = names.where(text.word_count(F.col("name")) == 1)
    long = names.where(text.word_count(F.col("name")) > 1)
    only = long.groupBy("last").agg(F.count("*").alias("n"), F.min("name").alias("canonical")).where("n = 1")
    return short.join(only, "last").select("name", "canonical")


def rekey(links: DataFrame, key: str, map_: DataFrame, old: str, new: str) -> DataFrame:
    """Distinct ``links`` with ``key`` replaced where ``map_`` (old, new) has it."""
    renamed = map_.select(F.col(old).alias(key), F.col(new).alias("__new"))
    joined = links.join(renamed, key, "left")
    return joined.select(*[F.coalesce("__new", key).alias(c) if c == key else F.col(c) for c in links.columns]).distinct()


def role_of(name: Column, curated: Column, default: str = "Resident") -> Column:
    """The curated role, else the title in the name, else the default."""
    title = text.title_of(name)
    return F.coalesce(curated, F.when(title != "", title), F.lit(default))


def topic_links(docs: DataFrame, key: str, column: str, topics: dict[str, list[str]]) -> DataFrame:
    """topic and key for every document that has any term of a topic, whatever the case.

    The terms are a configured list, so they are literals of one expression over each text.
    """
    lowered = F.lower(F.coalesce(F.col(column), F.lit("")))
    found = F.array_compact(
        F.array(*[F.when(F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains("__t", t)), F.lit(name)) for name, terms in topics.items()])
    )
    return docs.select(key, lowered.alias("__t")).select(key, F.explode(found).alias("topic"))


def ranked_sections(df: DataFrame, group: str, order: list) -> DataFrame:
    """``df`` with the place of each row in its group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def linked_groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the least node that links lead to) for every node of ``links``.

    Each round every node takes the least root among its neighbours and then its root's root, so the rounds grow slowly with the
    length of chains; each is written, and the last changes nothing.
    """
    ends = F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("other")), F.struct(F.col(b).alias("node"), F.col(a).alias("other"))))
    edges = written(links.select(ends.alias("e")).select("e.node", "e.other").distinct())
    roots = written(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("root")))
    while True:
        near = edges.join(roots.select(F.col("node").alias("other"), F.col("root").alias("r")), "other").groupBy("node").agg(F.min("r").alias("r"))
        lower = roots.join(near, "node").select("node", F.least("root", "r").alias("root"), F.col("root").alias("before"))
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = written(lower.join(above, "root", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "before"))
        if new.where("root <> before").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")
