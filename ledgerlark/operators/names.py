"""Names: who speaks, which spelling is right, what is worth listening for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import text
from ledgerlark.operators.graph import linked_groups
from ledgerlark.operators.materialise import written
from ledgerlark.operators.sets import union_first_wins

#: Ways in which speech shows who is there: the name is the group.
EVIDENCE = {
    "title": r"(?:President|Superintendent|Trustee|Mayor|Board [Mm]ember|Mr\.|Mrs\.|Ms\.|Dr\.) ([A-Z][\w'-]{2,})",
    "handoff": r"(?:[Tt]hank you|[Oo]ver to you|[Tt]urn it over to),? ([A-Z][\w'-]{2,})",
    "roll call": r"(?:Mr\.|Mrs\.|Ms\.|Dr\.) ([A-Z][\w'-]{2,})[.?,]? (?i:here|present|aye|yes|absent)\b",
    "self": r"(?:I'm|I am|[Mm]y name is) ([A-Z][\w'-]{2,})",
}


def evident_speakers(turns: DataFrame, key: str, column: str, known: DataFrame, name: str) -> DataFrame:
    """key, name and kinds for the known names of which a transcript's words give evidence, and of what kinds.

    Only words that are part of a known name count; nothing is guessed.
    """
    found = F.flatten(F.array(*[_tagged(text.all_matches(F.col(column), p, 1), kind) for kind, p in EVIDENCE.items()]))
    words = turns.select(key, F.explode(found).alias("e")).select(key, F.lower("e.word").alias("__word"), "e.kind")
    parts = known.select(name, F.explode(F.split(F.lower(name), " ")).alias("__word")).where(F.length("__word") >= 3).distinct()
    joined = words.distinct().join(parts, "__word")
    return joined.groupBy(key, name).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def _tagged(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda w: F.struct(w.alias("word"), F.lit(kind).alias("kind")))


def similar_pairs(a: DataFrame, b: DataFrame, left: str, right: str, least: float) -> DataFrame:
    """left, right and score for the distinct texts of ``a`` and ``b`` whose similarity by matching blocks is ``least`` or more.

    ``least`` is over 2/3. Of two texts of m and n letters that are so similar, all but u = (1 - least)(m + n) letters match, in
    u + 1 blocks at most; so they share as many pairs of letters as that leaves, and one of the first few pairs of each, rare
    pairs first. Only such texts of fitting lengths are compared, and of these only the ones that few edits part.
    """

    lengths = [df.select(F.length(name).alias("n")).distinct() for df, name in ((a, left), (b, right))]

    def pairs_of(df: DataFrame, name: str, others: DataFrame) -> DataFrame:
        n = F.length(name)
        # texts of lengths that none of the other side's fit don't come in
        fit = 2 * F.least(n, F.col("__m")) >= least * (n + F.col("__m")) - 1e-9
        some = df.select(name).where(n > 0).distinct().join(F.broadcast(others.select(F.col("n").alias("__m"))), fit, "left_semi")
        starts = F.when(n > 1, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.array(F.lit(1)))
        pairs = F.transform(starts, lambda i: F.substring(F.col(name), i, F.lit(2)))
        # the k-th of equal pairs is a pair of its own
        counted = F.transform(pairs, lambda x, i: F.concat(x, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda y: y == x)).cast("string")))
        return some.select(name, F.explode(counted).alias("pair"), n.alias("n"))

    one, two = pairs_of(a, left, lengths[1]), pairs_of(b, right, lengths[0])
    number = two.groupBy("pair").agg(F.count("*").alias("number"))

    def first_of(rows: DataFrame, name: str) -> DataFrame:
        rare = Window.partitionBy(name).orderBy("number", "pair")
        # pairs that only the left side has are the rarest
        rows = rows.join(number, "pair", "left").withColumn("number", F.coalesce("number", F.lit(0)))
        ranked = rows.withColumns({"rank": F.row_number().over(rare), "of": F.count("*").over(Window.partitionBy(name))})
        shared = F.greatest(F.lit(1), F.ceil((3 * least - 2) / (2 - least) * F.col("n") - 1 - 1e-9))
        return ranked.where((F.col("rank") <= F.col("of") - shared + 1) & (F.col("number") > 0)).select(name, "pair", F.col("n").alias(f"__{name}"))

    x, y = first_of(one, left), first_of(two, right)
    m, n = F.col(f"__{left}"), F.col(f"__{right}")
    fit = 2 * F.least(m, n) >= least * (m + n) - 1e-9
    # letters that don't match are as many as m + n less an even number, and no fewer than the edits between the texts
    most = F.floor((1 - least) * (m + n) + 1e-9).cast("int")
    edits = most - (m + n - most) % 2
    few = F.call_function("levenshtein", F.col(left), F.col(right), edits).between(0, edits)
    near = x.join(y, "pair").where(fit & (edits >= 0) & few).select(left, right).distinct()
    return near.withColumn("score", text.edit_ratio(F.col(left), F.col(right))).where(F.col("score") >= least)


def majority_spelling(counts: list[tuple[str, int]], alike: set[tuple[str, str]]) -> dict[str, str]:
    """For each name the spelling that absorbs it: names are taken by number, and each takes the rarer ones alike."""
    ordered, found = sorted(counts, key=lambda c: (-c[1], c[0])), {}
    for i, (name, _) in enumerate(ordered):
        if name in found:
            continue
        found[name] = name
        for other, _ in ordered[i + 1 :]:
            if other not in found and (name, other) in alike:
                found[other] = name
    return found


def majority_spellings(df: DataFrame, name: str, similar: float = 0.85) -> DataFrame:
    """name, spelling, n: rarer spellings mapped to the most frequent similar one.

    Names are counted before they meet. Names that are alike in steps are one group, in which the choice is made in order of
    frequency; a group holds the spellings of a name or two.
    """
    counts = written(df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")))
    lower = counts.select("name", F.lower("name").alias("low"))
    forms = similar_pairs(lower.select(F.col("low").alias("x")), lower.select(F.col("low").alias("y")), "x", "y", similar)
    either = lower.select(F.col("name").alias("a"), F.col("low").alias("x")).join(forms, "x").join(lower.select(F.col("name").alias("b"), F.col("low").alias("y")), "y")
    alike = written(either.where("a <> b").select("a", "b"))
    groups = written(linked_groups(alike, "a", "b").select(F.col("node").alias("name"), F.col("root").alias("group")))

    def choose(key: tuple, rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        pairs = set(zip(links["a"], links["b"], strict=True))
        found = majority_spelling(list(zip(rows["name"], rows["n"], strict=True)), pairs | {(y, x) for x, y in pairs})
        return rows.assign(spelling=rows["name"].map(found))[["name", "spelling", "n"]]

    grouped = counts.join(groups, "name")
    links = alike.join(groups.select(F.col("name").alias("a"), F.col("group").alias("of")), "a").select("of", "a", "b")
    chosen = grouped.groupBy("group").cogroup(links.groupBy("of")).applyInPandas(choose, "name string, spelling string, n long")
    alone = counts.join(groups, "name", "left_anti").select("name", F.col("name").alias("spelling"), "n")
    return chosen.unionByName(alone)


def corrected_names(names: DataFrame, canonical: DataFrame, name: str, official: str, least: float = 0.82) -> DataFrame:
    """name, best, score and method: each name with the canonical one that it most likely means.

    Titles are stripped first. Whole names are compared where the numbers of words differ by one at most; below
    ``least`` the last names alone decide. Of equal scores an ``official`` spelling (from minutes) wins, then the
    least. Names without a match are left out.
    """
    asked = names.select(F.col(name).alias("name")).distinct().withColumn("bare", text.without_title(F.col("name")))
    asked = asked.withColumns({"n": text.word_count(F.col("bare")), "a": F.lower("bare")}).withColumn("p", text.surname(F.col("bare")))
    right = canonical.select(F.col(name).alias("best"), F.col(official).alias("official")).distinct()
    right = right.withColumns({"m": text.word_count(F.col("best")), "b": F.lower("best"), "q": text.surname(F.col("best"))})
    asked, right = written(asked), written(right)
    whole = asked.join(similar_pairs(asked, right, "a", "b", least), "a").join(right, "b").where(F.abs(F.col("n") - F.col("m")) <= 1)
    long = lambda df, size: df.where(F.col(size) >= 2)
    last = long(asked, "n").join(similar_pairs(long(asked, "n"), long(right, "m"), "p", "q", least), "p").join(long(right, "m"), "q")
    columns = ["name", "bare", "best", "official", "score"]
    scored = whole.select(*columns, F.lit(True).alias("whole")).union(last.select(*columns, F.lit(False).alias("whole")))
    ordered = Window.partitionBy("name").orderBy(F.desc("whole"), F.desc("score"), F.desc(F.col("official").cast("int")), "best")
    top = scored.withColumn("r", F.row_number().over(ordered)).where("r = 1")
    method = (
        F.when(F.col("name") == F.col("best"), "exact")
        .when(F.col("bare") == F.col("best"), "title-stripped")
        .when(~F.col("whole"), "last name")
        .when(F.col("official"), "minutes")
        .otherwise("fuzzy")
    )
    return top.select("name", "best", "score", method.alias("method"))


NAME = r"\b[A-Z][a-z]{2,} [A-Z][a-z]{2,}\b"


def key_terms(curated: list[str], docs: DataFrame, key: str, date: str, column: str, entities: DataFrame, name: str, mentions: str, most: int = 100) -> DataFrame:
    """term and place: curated terms, names in the newest eight documents' heads, frequent names, known entities.

    The list is cut to ``most``; a term has the place of the first list that has it.
    """
    newest = docs.orderBy(F.desc(date), key).limit(8)
    heads = newest.select(F.explode(text.all_matches(F.substring(column, 1, 1500), NAME)).alias("term")).distinct().withColumn("r", F.lit(0))
    counted = docs.select(F.explode(text.all_matches(F.col(column), NAME)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    frequent = counted.where("n >= 2").orderBy(F.desc("n"), "term").limit(60).select("term", (-F.col("n")).cast("int").alias("r"))
    known = entities.where(F.col(mentions) >= 2).select(F.col(name).alias("term"), (-F.col(mentions)).cast("int").alias("r"))
    spark = docs.sparkSession
    first = spark.createDataFrame([(t, i) for i, t in enumerate(curated)], "term string, r int")
    tagged = [df.withColumn("tier", F.lit(i)) for i, df in enumerate([first, heads, frequent, known])]
    whole = union_first_wins([t.select("term", "tier", "r") for t in tagged], ["term"])
    top = whole.orderBy("tier", "r", "term").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy("tier", "r", "term"))).select("term", "place")


def verified(entities: DataFrame, name: str, sources: DataFrame, column: str) -> DataFrame:
    """``entities`` with verified: whether an authoritative text has the name as whole words."""
    from ledgerlark.operators.dictionary import mentions

    texts = sources.select(F.xxhash64(column).alias("__k"), F.col(column).alias("__t")).dropDuplicates(["__k"])
    seen = mentions(texts, entities, "__k", "__t", name).select(name).distinct().withColumn("__v", F.lit(True))
    return entities.join(seen, name, "left").withColumn("verified", F.coalesce("__v", F.lit(False))).drop("__v")


#: Small words that hold a proper name together where a capitalised word follows.
JOINTS = "a and at by de del for from in la le of on the to van von".split()
_WORD = r"\p{Lu}[\p{L}'-]+"
#: A run of capitalised words, with at most two small words between neighbours.
PROPER = rf"\b{_WORD}(?:\s+(?:(?:{'|'.join(JOINTS)})\s+){{0,2}}{_WORD})*"
SINGLE = r"\b\p{Lu}[\p{L}'-]{3,}"


def phrase_spellings(df: DataFrame, column: str, least: int) -> DataFrame:
    """phrase and n: proper names of several words that are there at least ``least`` times, of those that differ in case, spaces
    and hyphens alone the commonest, then the least."""
    runs = df.select(F.explode(text.all_matches(F.col(column), PROPER)).alias("phrase"))
    spelled = runs.select(F.regexp_replace("phrase", r"\s+", " ").alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    flat = F.trim(text.spaces_for_hyphens(F.col("phrase")))
    kinds = spelled.withColumn("__flat", flat).where(F.col("__flat").contains(" ")).groupBy("__flat")
    best = kinds.agg(F.min(F.struct((-F.col("n")).alias("n"), "phrase")).alias("b"))
    return best.select("b.phrase", (-F.col("b.n")).alias("n"))


def corrections(df: DataFrame, key: str, column: str, vocabulary: DataFrame, word: str, least: float = 0.87, least_single: float = 0.9) -> DataFrame:
    """key, wrong and right: proper names of a text that no vocabulary entry has but one is much like.

    Phrases meet entries of several words, of a word more or less at most, both in lower case with spaces for hyphens; a phrase that
    differs from an entry in these alone is mended to it. Single words of four letters or more that are not entries meet
    entries of one word as they are. The most similar entry wins, then the least. Phrases and words are counted once for
    the whole corpus.
    """
    flat = lambda c: F.trim(text.spaces_for_hyphens(F.col(c)))
    found = lambda pattern: df.select(key, F.explode(F.array_distinct(text.all_matches(F.col(column), pattern))).alias("wrong"))
    entries = written(vocabulary.select(F.col(word).alias("right")).where("right is not null").distinct().withColumn("b", flat("right")))
    several = entries.where(F.col("right").rlike("[ -]"))
    phrases = found(PROPER).where(F.length("wrong") >= 6).withColumn("a", flat("wrong"))
    kinds = written(phrases.select("wrong", "a").distinct())
    same = kinds.join(entries, F.col("a") == F.col("b")).groupBy("wrong", "a").agg(F.min("right").alias("right"))
    unlike = kinds.join(entries, F.col("a") == F.col("b"), "left_anti")
    near = unlike.join(similar_pairs(unlike, several, "a", "b", least), "a").join(several, "b")
    near = near.where(F.abs(text.word_count(F.col("a")) - text.word_count(F.col("b"))) <= 1)
    best = lambda rows: rows.groupBy("wrong").agg(F.min(F.struct(-F.col("score"), "right")).getField("right").alias("right"))
    # asked for by phrases and by words
    mended = written(same.select("wrong", "right").union(best(near)).where("wrong <> right"))
    plain = entries.where(~F.col("right").rlike("[ -]")).select("right")
    words = found(SINGLE)
    unknown = written(words.select("wrong").distinct().join(plain, F.col("wrong") == F.col("right"), "left_anti").join(mended, "wrong", "left_anti"))
    single = best(similar_pairs(unknown, plain, "wrong", "right", least_single))
    return phrases.join(mended, "wrong").select(key, "wrong", "right").union(words.join(single, "wrong").select(key, "wrong", "right"))


def corrected_text(df: DataFrame, key: str, column: str, found: DataFrame) -> DataFrame:
    """``df`` with the ``corrections`` (key, wrong, right) of its texts made, long ones first, as whole words."""
    order = F.struct((-F.length("wrong")).alias("n"), "wrong", "right")
    listed = found.groupBy(key).agg(F.array_sort(F.collect_set(order)).alias("__fixes"))
    word = lambda fix: F.concat(F.lit(r"\b\Q"), fix["wrong"], F.lit(r"\E\b"))
    literal = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
    mended = F.aggregate("__fixes", F.col(column), lambda t, fix: F.regexp_replace(t, word(fix), literal(fix["right"])))
    return df.join(listed, key, "left").withColumn(column, F.coalesce(mended, F.col(column))).drop("__fixes")
