"""Quality gates: quotes, names, figures, limits and freshness."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ledgerlark.functions import text
from ledgerlark.operators.dictionary import held, phrases_held
from ledgerlark.operators.materialise import written


def verbatim(quotes: DataFrame, texts: DataFrame, quote_key: str, quote: str, text_key: str, column: str, least: int = 6) -> DataFrame:
    """quote_key, text_key for every quote of at least ``least`` words that a text holds after both are loosened.

    Quotes are a dictionary, of which one pass over the texts finds all.
    """
    spaced = lambda c: F.concat(F.lit(" "), text.loose(F.coalesce(F.col(c), F.lit(""))), F.lit(" "))
    asked = quotes.select(quote_key, spaced(quote).alias("__q")).where(F.size(F.split("__q", " ")) >= least + 2)
    asked = written(asked)
    found = held(texts.select(text_key, F.col(column).alias("__c")), spaced("__c"), asked, "__q").select(text_key, "__entry").distinct()
    return found.join(asked, F.col("__entry") == F.col("__q")).select(quote_key, text_key).distinct()


def quotes_in(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, place, seconds and following (the text up to the next marker) of each quote marker."""
    parts = F.split(column, r"(?=\{\{quote:)")
    rows = df.select(key, F.posexplode(parts).alias("place", "part")).where(F.col("part").startswith("{{quote:"))
    seconds = F.regexp_extract("part", r"^\{\{quote:(\d+)", 1).try_cast("int")
    return rows.select(key, "place", seconds.alias("seconds"), F.regexp_replace("part", r"^\{\{[^}]*\}\}", "").alias("following"))


def out_of_range(marks: DataFrame, spans: DataFrame, key: str, at: str, end: str, slack: float = 180.0) -> DataFrame:
    """Marks later than the end of what they refer to, by more than ``slack``."""
    last = spans.groupBy(key).agg(F.max(end).alias("__end"))
    return marks.join(last, key).where(F.col(at) > F.col("__end") + slack).drop("__end")


def previous_hits(df: DataFrame, key: str, seconds: Column, window: int) -> DataFrame:
    """``df`` with hits: rows of the same key in the ``window`` seconds before a row, the bound left out.

    Time is cut into spans of the window's length, and a span also gets the rows of the one before, which is all that its rows
    look back to; so a key with very many rows is spread over its spans. A row without a time has no hits.
    """
    timed = df.withColumn("__s", seconds.cast("bigint"))
    span = F.floor(F.col("__s") / window)
    spread = timed.withColumn("__b", F.explode(F.when(span.isNull(), F.array(span)).otherwise(F.array(span, span + 1))))
    over = Window.partitionBy(key, "__b").orderBy("__s").rangeBetween(-(window - 1), 0)
    counted = spread.withColumn("hits", F.when(F.col("__s").isNull(), 0).otherwise(F.count("*").over(over) - 1))
    return counted.where(F.coalesce(F.col("__b") == span, F.col("__b").isNull())).drop("__s", "__b")


def freshness(df: DataFrame, key: str, date: str, days: int, as_of: Column | None = None) -> DataFrame:
    """key, last and stale: whether the newest row is more than ``days`` old."""
    newest = df.agg(F.max(date).alias("__now"))
    each = df.groupBy(key).agg(F.max(date).alias("last")).join(F.broadcast(newest))
    age = F.datediff(as_of if as_of is not None else F.col("__now"), "last")
    return each.select(key, "last", age.alias("age_days"), (age > days).alias("stale"))


SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9}


def money_in(c: Column) -> Column:
    """The values of all dollar figures of a text, scale words applied."""
    value = lambda m: F.regexp_replace(F.regexp_extract(m, r"[\d,]+(?:\.\d+)?", 0), ",", "").try_cast("double")

    def scaled(m: Column) -> Column:
        factor = F.lit(1.0)
        for word, size in SCALES.items():
            factor = F.when(m.ilike(f"%{word}%"), size).otherwise(factor)
        return value(m) * factor

    return F.filter(F.transform(text.all_matches(c, text.MONEY), scaled), lambda v: v.isNotNull())


def near_value(values: Column, wanted: Column, tolerance: float = 0.01) -> Column:
    """Whether any value is within a share of the wanted one."""
    return F.exists(values, lambda v: F.abs(v - wanted) / F.greatest(F.abs(wanted), F.lit(1.0)) <= tolerance)


def _pairs_below(v: np.ndarray, end: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which ``i`` below ``end`` have partners below them so that both add up to ``low`` or more but less than ``high``: i, the
    first partner and how many there are."""
    i = np.arange(1, end)
    first = np.minimum(np.searchsorted(v, low - v[1:end]), i)
    return i, first, np.minimum(np.searchsorted(v, high - v[1:end]), i) - first


def _sums_below(v: np.ndarray, parts: int, end: int, low: int, high: int) -> Iterator[np.ndarray]:
    """The sums, from ``low`` on and less than ``high``, of ``parts`` different members of the sorted ``v[:end]``."""
    if parts == 0:
        yield np.zeros(int(low <= 0 < high), np.int64)
    elif parts == 1:
        yield v[np.searchsorted(v[:end], low) : np.searchsorted(v[:end], high)]
    elif parts == 2:
        i, first, n = _pairs_below(v, end, low, high)
        partner = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        yield np.repeat(v[i], n) + v[partner]
    else:
        for j in range(parts - 1, end):
            for some in _sums_below(v, parts - 1, j, low - v[j], high - v[j]):
                yield v[j] + some


def _many_sums(v: np.ndarray, parts: int, low: int, high: int, room: int) -> bool:
    """Whether ``_sums_below`` gives more than ``room``, repeats included."""
    if parts <= 2:
        return parts == 2 and int(_pairs_below(v, len(v), low, high)[2].sum()) > room

    def count(parts: int, end: int, low: int, high: int) -> Iterator[int]:
        for j in range(parts - 1, end):
            if parts > 3:
                yield from count(parts - 1, j, low - v[j], high - v[j])
            else:
                yield int(_pairs_below(v, j, low - v[j], high - v[j])[2].sum())

    n = 0
    return any((n := n + some) > room for some in count(parts, len(v), low, high))


def _sums(v: np.ndarray, parts: int, low: int, high: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The different sums, from ``low`` on and less than ``high``, of ``parts`` different members of the sorted ``v``, each with the
    least place that the last member of such a selection has. More than ``room`` are only held while they repeat."""
    sums, last = np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh, places, held = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        # of equal sums the first, as places grow
        different, at = np.unique(np.concatenate([sums, *fresh]), return_index=True)
        return different, np.concatenate([last, *places])[at]

    for j in range(parts - 1, len(v)):
        for some in _sums_below(v, parts - 1, j, low - v[j], high - v[j]):
            fresh.append(v[j] + some)
            places.append(np.full(len(some), j))
            held += len(some)
            if held > room:
                sums, last = merged()
                fresh, places, held = [], [], 0
    return merged()


def _parts_meet(v: np.ndarray, lower: int, upper: int, goal: int, near: int, room: int) -> bool:
    """Whether some ``lower`` members of the sorted ``v`` and ``upper`` ones behind them add up to ``goal``, within ``near``.

    The sums of the lower ones are looked at by ranges, each with the range that the upper ones must be in; a range in which either has
    more than ``room`` sums is parted.
    """
    if lower + upper > len(v):
        return False
    total = lambda some: sum(some.tolist())
    # the upper ones are lower ones from the other end
    turned = -v[::-1]
    ranges = [(max(total(v[:lower]), goal - near - total(v[-upper:])), min(total(v[-lower:]), goal + near - total(v[:upper])) + 1)]
    while ranges:
        low, high = ranges.pop()
        if low >= high:
            continue
        turned_low, turned_high = low - goal - near, high - goal + near
        if high - low > room and (_many_sums(v, lower, low, high, room) or _many_sums(turned, upper, turned_low, turned_high, room)):
            ranges += [(low, (low + high) // 2), ((low + high) // 2, high)]
            continue
        sums, last = _sums(v, lower, low, high, room)
        lacks, first = _sums(turned, upper, turned_low, turned_high, room)
        # sums that are near what a sum lacks follow one another; of these one whose upper members begin behind the lower ones
        at, end = np.searchsorted(lacks, sums - goal - near), np.searchsorted(lacks, sums - goal + near, "right")
        while (open_ := at < end).any():
            at, end, last = at[open_], end[open_], last[open_]
            if (last + first[at] < len(v) - 1).any():
                return True
            at = at + 1
    return False


def sums_to(values: list[float], wanted: float, most: int = 6, slack: float = 0.01, room: int = 2_000_000) -> bool:
    """Whether two to ``most`` of the distinct positive values add up to ``wanted``, within ``slack``.

    In whole cents. Of a selection the lower half of its members and the upper half meet: sums of up to half as many are made, and a sum of
    lower members is looked up by what it lacks among those of members behind them. ``room`` bounds the sums that are held at
    a time; with more the same is done for one range of sums after another, so the time grows with the number of sums (the cube
    of the values, for six) and memory doesn't.
    """
    goal, near = round(wanted * 100), round(slack * 100)
    cents = np.unique(np.round(np.array([v for v in values if v is not None and 0 < v <= wanted + slack], float) * 100).astype(np.int64))
    return any(_parts_meet(cents, parts - parts // 2, parts // 2, goal, near, room) for parts in range(2, most + 1))


#: Of so many values at most, all selections are added up at once for many rows; and sums that are held for it.
FEW_VALUES, SUMS_AT_ONCE = 10, 1 << 20


@lru_cache(maxsize=None)
def _selections(n: int, most: int) -> np.ndarray:
    """A column of zeros and ones for each way to take two to ``most`` of ``n`` values."""
    taken = np.arange(1 << n)[None, :] >> np.arange(n)[:, None] & 1
    parts = taken.sum(axis=0)
    return taken[:, (parts >= 2) & (parts <= most)]


def all_sums_to(values: list, wanted: np.ndarray, most: int = 6, slack: float = 0.01) -> np.ndarray:
    """``sums_to`` of many rows; rows of few values go together, those of more by themselves."""
    size = np.array([0 if v is None else len(v) for v in values], np.int64)
    # beyond this whole cents aren't exact in a float
    large, found = np.abs(wanted) > 1e13, np.zeros(len(values), bool)
    size[np.isnan(wanted)] = 0
    held = [v for v, n in zip(values, size, strict=True) if n]
    flat = np.concatenate([np.array(v, float) for v in held]) if held else np.zeros(0)
    row = np.repeat(np.arange(len(values)), size)
    fits = (flat > 0) & (flat <= wanted[row] + slack) & ~large[row]  # not so for NaN, which stands for null
    row, cents = row[fits], np.round(flat[fits] * 100).astype(np.int64)
    order = np.lexsort((cents, row))
    row, cents = row[order], cents[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (cents[1:] != cents[:-1])
    row, cents = row[first], cents[first]
    count = np.bincount(row, minlength=len(values))
    start, near = np.cumsum(count) - count, round(slack * 100)
    for n in range(2, FEW_VALUES + 1):
        some, ways = np.flatnonzero(count == n), _selections(n, most)
        step = max(1, SUMS_AT_ONCE // ways.shape[1])
        for at in range(0, len(some), step):
            own = some[at : at + step]
            sums = cents[start[own][:, None] + np.arange(n)] @ ways
            found[own] = (np.abs(sums - np.round(wanted[own] * 100).astype(np.int64)[:, None]) <= near).any(axis=1)
    for i in np.flatnonzero((count > FEW_VALUES) | (large & (size > 0))):
        found[i] = sums_to(list(values[i]), float(wanted[i]), most, slack)
    return found


@F.pandas_udf(BooleanType())
def subset_sum(values: pd.Series, wanted: pd.Series) -> pd.Series:
    """``sums_to`` of array and number columns; null counts as no values, and a null sum has no parts."""
    return pd.Series(all_sums_to(values.tolist(), wanted.to_numpy(float, na_value=np.nan)), dtype=bool)


def figures_backed(df: DataFrame, claims: str, sources: str) -> DataFrame:
    """``df`` with a row for each claimed figure: claim and backed, whether the row's sources have it exactly or
    within one percent, or some of them add up to it."""
    rows = df.select("*", F.explode(claims).alias("claim"))
    near = near_value(F.coalesce(F.col(sources), F.array().cast("array<double>")), F.col("claim"))
    # what is near needs no sums
    rows = rows.withColumn("__near", near)
    return rows.withColumn("backed", F.col("__near") | subset_sum(F.when(F.col("__near"), None).otherwise(F.col(sources)), F.col("claim"))).drop("__near")


def sent_of(times: np.ndarray, cooldown: float) -> np.ndarray:
    """Which of the sorted times of a run are sent, found by jumps from one to the next."""
    sent, at = np.zeros(len(times), bool), 0
    while at < len(times):
        sent[at], last = True, times[at]
        at = max(at + 1, int(np.searchsorted(times, last + cooldown)) - 1)
        # the sum may be rounded, the difference decides
        while at < len(times) and times[at] - last < cooldown:
            at += 1
    return sent


def sent_in_runs(times: np.ndarray, begin: np.ndarray, end: np.ndarray, cooldown: float, few: int = 64) -> np.ndarray:
    """``sent_of`` of many runs of sorted times at once, a jump of all runs together; the last ``few`` runs by themselves."""
    sent = np.zeros(len(times), bool)
    while len(begin) > few:
        sent[begin] = True
        last, low, high = times[begin], begin + 1, end
        while (apart := low < high).any():
            mid = np.minimum((low + high) // 2, len(times) - 1)
            soon = times[mid] - last < cooldown
            low, high = np.where(apart & soon, mid + 1, low), np.where(apart & ~soon, mid, high)
        begin, end = low[low < end], end[low < end]
    for i, j in zip(begin, end, strict=True):
        sent[i:j] = sent_of(times[i:j], cooldown)
    return sent


def suppressed(df: DataFrame, key: str | list[str], at: str, cooldown: float) -> DataFrame:
    """The key columns, ``at`` and sent: an alert is sent unless one of its key was sent within ``cooldown`` before.

    Which alerts count depends on which were sent, but never across a pause of ``cooldown``: the first alert after one
    is sent in any case. So sorted alerts are runs that begin with a key or after a pause, and those of a batch are followed
    together. From one batch to the next only the time last sent is kept, so a run may be of any length. Rows
    without a time are left out.
    """
    keys = [key] if isinstance(key, str) else key
    timed = df.select(*keys, F.col(at).cast("double").alias(at)).where(F.col(at).isNotNull())
    over = Window.partitionBy(*keys).orderBy(at)
    begins = F.coalesce(F.col(at) - F.lag(at).over(over) >= cooldown, F.lit(True))
    runs = timed.withColumn("__new", begins).sortWithinPartitions(*keys, at)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0.0
        for batch in batches:
            times, new = (batch[c].to_numpy(zero_copy_only=False) for c in (at, "__new"))
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(times))[: len(begin)]
            # what the batch before left of its last run
            rest = int(begin[0]) if len(begin) else len(times)
            first = int(np.count_nonzero(times[:rest] - last < cooldown))
            if first < rest:
                begin, end = np.insert(begin, 0, first), np.insert(end, 0, rest)
            sent = sent_in_runs(times, begin, end, cooldown)
            if sent.any():
                last = float(times[np.flatnonzero(sent)[-1]])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sent)], [*names, "sent"])

    names = timed.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in timed.schema) + ", sent boolean"
    return runs.mapInArrow(follow, schema)


def corroborated(names: DataFrame, sources: DataFrame, key: str, name: str, column: str) -> DataFrame:
    """``names`` with backed: whether a source of the same key has the name's last word as a word."""
    joined = names.join(sources.select(key, F.col(column).alias("__s")), key, "left")
    word = F.concat(F.lit(r"(?i)(?<![\p{L}])\Q"), text.surname(F.col(name)), F.lit(r"\E(?![\p{L}])"))
    hit = F.coalesce(F.regexp_like(F.col("__s"), word), F.lit(False))
    return joined.groupBy(*names.columns).agg(F.max(hit).alias("backed"))



def attributed(quotes: DataFrame, turns: DataFrame, key: str, reach: int = 2, pad: float = 5.0, within: float = 45.0) -> DataFrame:
    """``quotes`` (key, q, at, attrib) with ok and speakers: whether the attributed surname speaks near the quote.

    ``turns`` has key, n (order), speaker, start and end. The turn that holds the time, or is nearest, and
    ``reach`` turns on each side count; without a turn in reach, or with unnamed speakers alone, nothing is
    held against the quote. Speakers of one word have no surname, so a quote near them is left open (null).
    """
    from ledgerlark.operators.joins import point_in_interval

    near = point_in_interval(quotes.select(key, "q", "at"), turns.select(key, "n", "start", "end"), key, "q", "n", pad, within)
    names = turns.select(key, F.col("n").alias("m"), "speaker").where(F.col("speaker").isNotNull() & ~F.col("speaker").rlike("^(?i)(speaker|unknown)"))
    spread = quotes.select(key, "q").join(near, "q").select(key, "q", F.explode(F.sequence(F.col("n") - reach, F.col("n") + reach)).alias("m"))
    said = spread.join(names, [key, "m"]).groupBy("q").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))
    joined = quotes.join(said, "q", "left")
    same = F.exists("speakers", lambda s: text.surname(s) == text.surname(F.col("attrib")))
    lone = F.exists("speakers", lambda s: ~s.contains(" "))
    ok = F.when(F.col("speakers").isNull() | same, True).when(lone, None).otherwise(False)
    return joined.withColumn("ok", ok)


def name_provenance(names: DataFrame, own: DataFrame, labels: DataFrame, wider: DataFrame, key: str) -> DataFrame:
    """``names`` (key, name) with verdict: own record, label without minutes, attendance, wider source, or none.

    ``own`` has key, text (what was said, minutes, agenda) and has_minutes; ``labels`` key and label; ``wider`` a text.
    A name counts in either order of its words. One that only a speaker label has must be in the minutes where
    there are any.
    """
    flat = lambda c: F.concat(F.lit(" "), text.loose(F.coalesce(c, F.lit(""))), F.lit(" "))
    turned = lambda c: F.concat(F.lit(" "), F.array_join(F.reverse(F.split(F.trim(c), " ")), " "), F.lit(" "))
    asked = names.select(key, "name").distinct().withColumn("f", flat(F.col("name")))
    has = lambda t: F.coalesce(F.contains(t, F.col("f")) | F.contains(t, turned(F.col("f"))), F.lit(False))
    mine = own.groupBy(key).agg(F.array_join(F.collect_list("text"), " ").alias("t"), F.max("has_minutes").alias("has_minutes"))
    # a key's text goes no further than here
    joined = asked.join(mine.withColumn("t", flat(F.col("t"))).hint("merge"), key, "left").select(key, "name", "f", "has_minutes", has(F.col("t")).alias("mine"))
    told = labels.select(key, F.col("label").alias("__l")).distinct()
    by_label = F.coalesce(F.array_contains("ls", F.trim("f")) | F.array_contains("ls", F.trim(turned(F.col("f")))), F.lit(False))
    labelled = joined.join(told.groupBy(key).agg(F.collect_set(text.loose(F.col("__l"))).alias("ls")), key, "left")
    labelled = labelled.select(key, "name", "has_minutes", "mine", by_label.alias("label"))
    # names are phrases, of which one pass over the wider texts finds all, however many there are
    forms = written(asked.select("name", F.explode(F.array("f", turned(F.col("f")))).alias("form")).distinct())
    seen = phrases_held(wider, "text", forms, "form")
    out = forms.join(seen, F.col("form") == F.col("__entry")).select("name").distinct().withColumn("outside", F.lit(True))
    verdict = (
        F.when(F.col("mine"), "own record")
        .when(F.col("label") & F.coalesce("has_minutes", F.lit(False)), "attendance")
        .when(F.col("label"), "label")
        .when(F.col("outside"), "wider source")
        .otherwise("none")
    )
    return labelled.join(out, "name", "left").select(key, "name", verdict.alias("verdict"))


def corroborated_labels(
    labels: DataFrame, meetings: DataFrame, spoken: DataFrame, verified: DataFrame, key: str, days: int = 120
) -> DataFrame:
    """The speaker labels (key, name) that nothing bears out, with the kind of violation.

    ``meetings`` has key, committee, date, minutes and agenda; ``spoken`` key and text; ``verified`` names of persons. Where
    a meeting has minutes, the surname must be a word of its minutes, agenda or speech; else of its agenda or speech, of
    minutes of its committee in the ``days`` before it, or the name must be a verified one.
    """
    named = labels.select(key, "name").where(F.trim("name").contains(" ")).distinct()
    asked = named.withColumn("__s", text.surname(F.col("name"))).join(meetings, key)
    words = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_'-]+")
    said = spoken.select(key, F.explode(words(F.col("text"))).alias("__s")).distinct().withColumn("__said", F.lit(True))
    has = lambda c: F.array_contains(words(F.col(c)), F.col("__s"))
    own = asked.join(said, [key, "__s"], "left").withColumn("__own", has("minutes") | has("agenda") | F.coalesce("__said", F.lit(False)))
    # words of a committee's minutes by date; a name asks for the days before its meeting
    told = meetings.where("minutes is not null and minutes <> ''").select("committee", F.col("date").alias("__d"), F.explode(words(F.col("minutes"))).alias("__s")).distinct()
    bare = own.where("not __own and (minutes is null or minutes = '')")
    in_reach = (F.col("__d") >= F.date_sub("date", days)) & (F.col("__d") <= F.col("date"))
    recent = bare.join(told, ["committee", "__s"]).where(in_reach).select(key, "name").distinct().withColumn("__recent", F.lit(True))
    known = verified.select(F.lower("name").alias("__n")).distinct().withColumn("__known", F.lit(True))
    whole = own.join(recent, [key, "name"], "left").join(known, F.lower("name") == F.col("__n"), "left")
    minuted = F.coalesce(F.col("minutes") != "", F.lit(False))
    ok = F.col("__own") | (~minuted & (F.coalesce("__recent", F.lit(False)) | F.coalesce("__known", F.lit(False))))
    kind = F.when(minuted, "attendance-mismatch").otherwise("unverifiable-name")
    return whole.where(~ok).select(key, "name", kind.alias("kind"))


def quote_at(quotes: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """``quotes`` (key, at, quote) with ok and reason: whether the pool's text (key, at, text) at that time agrees, as a
    part of either, after repeated words are collapsed as well."""
    joined = quotes.join(pool.select(key, "at", F.col("text").alias("pool_text")).dropDuplicates([key, "at"]), [key, "at"], "left")
    plain = lambda c: text.no_punctuation(c)
    a, b = plain(F.col("quote")), plain(F.col("pool_text"))
    pairs = [(a, b), (text.deflutter(a), text.deflutter(b))]
    match = F.lit(False)
    for x, y in pairs:
        match = match | F.contains(x, y) | F.contains(y, x)
    reason = F.when(F.col("pool_text").isNull(), "not in pool").when(match, "match").otherwise("text differs")
    return joined.withColumn("reason", reason).withColumn("ok", reason == "match")


def repaired_times(quotes: DataFrame, turns: DataFrame, key: str, least: float = 0.7, off: float = 30.0, most: int = 2048) -> DataFrame:
    """``quotes`` (key, q, at, quote) with fixed: the time of the turn (key, start, text) that the quote is from, where it
    is more than ``off`` seconds away; else the time given.

    A turn with the quote's first six words wins, then one with the first four, then the most similar of those
    that share a word of four letters with the quote, if similar enough; the earliest of equals. Quotes meet the turns of their
    key where these lie, so no pair is moved or sent to all; the turns of a key are dealt to blocks of about ``most``. Only texts whose lengths let them be similar
    enough are compared.
    """
    flat = text.no_punctuation
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) >= 4))
    blocks = turns.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("__n"))
    dealt = lambda df: df.join(blocks.hint("merge"), key)
    every = F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__i")
    asked = dealt(quotes.select(key, "q", flat(F.col("quote")).alias("f"))).select(key, every, "q", "f", words(F.col("f")).alias("fw"))
    own = F.pmod(F.xxhash64("start", "t"), F.col("__n")).cast("int").alias("__i")
    said = dealt(turns.select(key, "start", flat(F.col("text")).alias("t"))).select(key, own, "start", "t", words(F.col("t")).alias("tw"))
    pairs = asked.join(said.hint("merge"), [key, "__i"]).where(F.arrays_overlap("fw", "tw"))
    lead = lambda n: F.array_join(F.slice(F.split("f", " "), 1, n), " ")
    tier = F.when(F.contains("t", lead(6)), 0).when(F.contains("t", lead(4)), 1).otherwise(2)
    # what matches is no longer than the shorter text
    fits = 2 * F.least(F.length("f"), F.length("t")) >= least * (F.length("f") + F.length("t")) - 1e-9
    near = pairs.select("q", "start", "f", "t", tier.alias("tier")).where((F.col("tier") < 2) | fits)
    # a text that has the words isn't compared
    scored = near.withColumn("ratio", text.edit_ratio(F.when(F.col("tier") == 2, F.col("f")), F.col("t")))
    good = scored.where((F.col("tier") < 2) | (F.col("ratio") >= least))
    best = good.groupBy("q").agg(F.min(F.struct("tier", F.when(F.col("tier") < 2, 0.0).otherwise(-F.col("ratio")).alias("r"), "start")).alias("b"))
    joined = quotes.join(best.hint("merge"), "q", "left")
    found = F.col("b.start")
    return joined.withColumn("fixed", F.when(F.abs(found - F.col("at")) > off, found).otherwise(F.col("at"))).drop("b")


def dead_references(docs: DataFrame, key: str, column: str, files: DataFrame, name: str) -> DataFrame:
    """key and reference of the photo markers whose file isn't there."""
    marks = F.filter(text.shortcodes(F.col(column)), lambda m: m["kind"] == "photo")
    used = docs.select(key, F.explode(F.transform(marks, lambda m: F.array_join(F.slice(F.split(m["argument"], ":"), 1, 2), ":"))).alias("reference"))
    return used.distinct().join(files.select(F.col(name).alias("reference")), "reference", "left_anti").select(key, "reference")


def shared_addresses(docs: DataFrame, key: str, column: str, most: int = 5) -> DataFrame:
    """key, address and others: up to ``most`` other documents that have an address of the document."""
    held = docs.select(key, F.explode(F.array_distinct(text.all_matches(F.col(column), text.STREET))).alias("address"))
    order = Window.partitionBy("address").orderBy(key)
    # neighbours in the address's own order, so that a common address makes no pairs
    near = [F.lag(key, i).over(order) for i in range(most, 0, -1)] + [F.lead(key, i).over(order) for i in range(1, most + 1)]
    others = F.slice(F.array_compact(F.array(*near)), 1, most)
    return held.withColumn("others", others).where(F.size("others") > 0)
