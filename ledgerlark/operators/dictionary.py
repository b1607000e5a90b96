"""Dictionaries on texts: one Aho-Corasick automaton finds all entries of a block in one pass over a text.

A dictionary may be of any size. It is dealt into blocks of bounded size; of each block in turn the entries go to the driver
and with the tasks, so texts are read once for a block and never travel. Entries are found as whole words
or anywhere. Replacement equals one ``replace`` of the whole text for each entry in order: the automaton says which
entries a text has at all, and after a replacement looks only at the changed places for entries that are new there.

Phrases of a few whole words need no blocks: runs of words whose hash is that of an entry are taken out of the texts in one pass,
however many entries there are, and joined with the entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.text import loose
from ledgerlark.operators.materialise import small_batches, written

#: What the entries of a block take, in bytes.
BLOCK_BYTES = 8 << 20


@lru_cache(maxsize=2)
def automaton(entries: tuple[str, ...]):
    """Finds each of the entries, which are different and not empty, by its number."""
    made = ahocorasick.Automaton()
    for i, entry in enumerate(entries):
        made.add_word(entry, i)
    made.make_automaton()
    return made


def blocks_of(entries: DataFrame, column: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[str, ...]]:
    """The different entries of a column, neither null nor empty, in blocks of about ``block_bytes`` at most.

    Which block an entry is in follows from its hash alone.
    """
    distinct = written(entries.select(F.col(column).alias("e")).where("e <> ''").distinct())
    size = distinct.agg(F.sum(F.octet_length("e") + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    numbered = distinct.withColumn("b", F.pmod(F.xxhash64("e"), F.lit(n)))
    for b in range(n):
        found = tuple(sorted(r.e for r in numbered.where(F.col("b") == b).select("e").collect()))
        if found:
            yield found


def flat(c: Column) -> Column:
    """Lower-case words parted and surrounded by one space."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def held(docs: DataFrame, text: Column, entries: DataFrame, entry: str, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with a row for each different entry that ``text`` contains: __entry. Null texts
    hold none."""
    small_batches(docs.sparkSession)
    names = docs.columns if keep is None else keep
    source = docs.select(*names, text.alias("__text"))
    schema = docs.select(*names, F.lit("").alias("__entry")).schema
    parts = []
    for block in blocks_of(entries, entry, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            words = sent.value
            find = automaton(words)
            for batch in batches:
                rows, found = [], []
                for i, whole in enumerate(batch["__text"].to_pylist()):
                    own = {k for _, k in find.iter(whole)} if whole else ()
                    rows += [i] * len(own)
                    found += [words[k] for k in own]
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in names), pa.array(found, pa.string())], schema.names)

        parts.append(source.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts) if parts else docs.select(*names, F.lit("").alias("__entry")).limit(0)


#: Never in a text's bytes.
END = b"\xff"
_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789'" + END
#: What each byte is in a loosened text: a small letter, a digit, an apostrophe, or a space for what parts words.
PLAIN = bytes(b if b in _KEPT else 32 for b in bytes(range(256)).lower())
#: The other characters that become one of these.
ODD = [(a.encode(), b) for a, b in (("\u2018", b"'"), ("\u2019", b"'"), ("\u212a", b"k"), ("\u0130", b"i "))]
#: Entries of more words are left to the automaton.
MOST_WORDS = 8
#: Bits of a bitmap of hashes: for each entry, and at most; and what a hash is multiplied by for each of an entry's places in it.
BITS_EACH, MOST_BITS = 32, 1 << 28
PLACES = [np.uint64(x) for x in (1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUE = np.random.default_rng(20261201).integers(1, 1 << 63, 256, dtype=np.uint64)


class Run:
    """The words of some loosened bytes, of texts that end in ``END``: where each begins and ends, its text and a hash."""

    def __init__(self, raw: bytes):
        self.raw, data = raw, np.frombuffer(raw, np.uint8)
        edge = np.diff((data != 32) & (data != END[0]), prepend=False, append=False)
        self.begin, self.end = np.flatnonzero(edge).reshape(-1, 2).T
        self.text = np.searchsorted(np.flatnonzero(data == END[0]), self.begin)
        power = np.cumprod(np.full(len(data) + 1, _BASE))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * power[:-1])])
        back = np.cumprod(np.full(len(data) + 1, _INVERSE))
        self.hash = (total[self.end] - total[self.begin]) * back[self.begin]

    def phrases(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each run of so many words of a text, and a hash of the run."""
        n = max(len(self.begin) - words + 1, 0)
        h = self.hash[:n].copy()
        for i in range(1, words):
            h = h * _BASE + self.hash[i : i + n]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        at = np.flatnonzero(self.text[:n] == self.text[words - 1 :][:n])
        return at, (h ^ (h >> np.uint64(29)))[at]

    def said(self, first: int, words: int) -> str:
        return f" {self.raw[self.begin[first] : self.end[first + words - 1]].decode()} "


def runs_of(texts: list[str], size: int = 1 << 20) -> Iterator[Run]:
    """The words of ``texts``, loosened, in parts of about ``size`` bytes; a part begins with the last words of the one before, so that
    each run of ``MOST_WORDS`` words is in one."""
    raw = b"".join(t.encode() + END for t in texts)
    for old, new in ODD:
        raw = raw.replace(old, new)
    raw = b" ".join(raw.translate(PLAIN).replace(END, b" " + END + b" ").split())
    at, room = 0, size
    while at < len(raw):
        end = raw.find(b" ", at + room)
        run = Run(raw[at:] if end < 0 else raw[at:end])
        if end >= 0 and len(run.begin) < MOST_WORDS:
            room *= 2
            continue
        yield run
        if end < 0:
            return
        at, room = at + int(run.begin[1 - MOST_WORDS]), size


def phrases_held(docs: DataFrame, column: str, entries: DataFrame, entry: str) -> DataFrame:
    """__entry: the different entries that a text of ``column``, loosened and with a space at both ends, contains.

    Entries are loosened phrases with a space at both ends. A bitmap of the hashes of those of up to ``MOST_WORDS`` words goes with the
    tasks; what the texts have of these hashes is joined with the entries, so another phrase on the same bits does no harm. Null texts
    are empty.
    """
    small_batches(docs.sparkSession)
    bare = F.trim(entry)
    size = F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))
    asked = entries.select(F.col(entry).alias("__entry"), F.least(size, F.lit(MOST_WORDS + 1)).alias("__n")).where(F.col(entry).isNotNull())
    number = {r["__n"]: r["count"] for r in asked.groupBy("__n").count().collect()}
    fit = F.col("__n").between(1, MOST_WORDS)
    sizes = sorted(n for n in number if 0 < n <= MOST_WORDS)
    texts = docs.select(F.coalesce(F.col(column), F.lit("")).alias("__text"))
    few = asked.where(fit).select("__entry").distinct()
    found = few.limit(0)
    if sizes:
        wanted = BITS_EACH * sum(number[n] for n in sizes)
        bits = min(1 << max(16, wanted.bit_length()), MOST_BITS)
        shift = np.uint64(64 - (bits.bit_length() - 1))

        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = [np.zeros(0, np.uint64)]
                for run in runs_of(batch["__entry"].to_pylist(), 1 << 40):
                    count = np.bincount(run.text)[run.text] if len(run.text) else run.text
                    for n in sizes:
                        at, h = run.phrases(n)
                        places += [h[count[at] == n] * x >> shift for x in PLACES]
                place = np.unique(np.concatenate(places))
                bit = np.uint64(1) << (place & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], ["at", "bits"])

        rows = asked.where(fit).select("__entry").mapInArrow(marks, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        bitmap = np.zeros(bits >> 6, np.uint64)
        bitmap[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        sent = docs.sparkSession.sparkContext.broadcast(bitmap)

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marked, seen = sent.value, set()
            for batch in batches:
                said = []
                for run in runs_of(batch["__text"].to_pylist()):
                    for n in sizes:
                        at, h = run.phrases(n)
                        hit = np.arange(len(h))
                        for x in PLACES:
                            place = h[hit] * x >> shift
                            hit = hit[(marked[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)]
                        different, first = np.unique(h[hit], return_index=True)
                        for key, i in zip(different.tolist(), at[hit[first]].tolist(), strict=True):
                            if (key, n) not in seen:
                                seen.add((key, n))
                                said.append(run.said(i, n))
                if len(seen) > 1 << 17:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(said, pa.string())], ["__entry"])

        found = texts.mapInArrow(take, "__entry string").distinct().join(few, "__entry", "left_semi")
    if len(sizes) < len(number):
        spaced = F.concat(F.lit(" "), loose(F.col("__text")), F.lit(" "))
        found = found.union(held(texts, spaced, asked.where(~fit), "__entry", keep=[]).distinct())
    return found


def mentions(docs: DataFrame, names: DataFrame, key: str, column: str, name: str, least: int = 0) -> DataFrame:
    """key and name for every document that has a name of ``least`` characters or more as whole words, whatever the case."""
    wanted = written(names.select(F.col(name).alias("__name"), flat(F.col(name)).alias("__flat")).where((F.length(name) >= least) & (F.col("__flat") != "  ")).distinct())
    found = held(docs.select(key, F.col(column).alias("__c")), flat(F.col("__c")), wanted, "__flat").select(key, "__entry").distinct()
    return found.join(wanted, F.col("__entry") == F.col("__flat")).select(key, F.col("__name").alias(name))


def linked(docs: DataFrame, names: DataFrame, key: str, speaker: str, column: str, name: str, least: int = 6) -> DataFrame:
    """key, name and relation of every document that has a name of ``least`` characters or more in its speaker (``spoke``) or else
    in its text (``mentioned``), anywhere and whatever the case; a name that spoke isn't mentioned as well."""
    wanted = written(names.select(F.col(name).alias("__name"), F.lower(name).alias("__low")).where(F.length(name) >= least).distinct())
    said = docs.select(key, F.lower(speaker).alias("__s"), F.lower(column).alias("__t"))
    spoke = held(said.select(key, "__s"), F.col("__s"), wanted, "__low").select(key, "__entry", F.lit(0).alias("__r"))
    told = held(said.select(key, "__t"), F.col("__t"), wanted, "__low").select(key, "__entry", F.lit(1).alias("__r"))
    best = spoke.unionByName(told).groupBy(key, "__entry").agg(F.min("__r").alias("__r"))
    relation = F.when(F.col("__r") == 0, "spoke").otherwise("mentioned")
    return best.join(wanted, F.col("__entry") == F.col("__low")).select(key, F.col("__name").alias(name), relation.alias("relation"))


def replace_in_order(whole: str, pairs: tuple[tuple[str, str], ...], find, longest: int) -> str:
    """``whole`` after ``replace`` of each pair in order; ``find`` is the automaton of the first parts."""
    waiting = list({k for _, k in find.iter(whole)})
    heapify(waiting)
    done = -1
    while waiting:
        k = heappop(waiting)
        if k == done:
            continue
        done = k
        old, new = pairs[k]
        parts = whole.split(old)
        if len(parts) == 1:
            continue  # another replacement has taken it away
        whole = new.join(parts)
        # what is new overlaps a changed place, so it lies within this distance of it
        at, reach, fresh = 0, longest - 1, set()
        for part in parts[:-1]:
            at += len(part)
            fresh |= {n for _, n in find.iter(whole[max(0, at - reach) : at + len(new) + reach])}
            at += len(new)
        for n in fresh:
            if n > k:
                heappush(waiting, n)
    return whole


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """A text after the replacements of a configured dictionary, each of all places, in order; of equal first parts the first
    pair counts. Null stays null."""
    first: dict[str, str] = {}
    for old, new in pairs:
        if old:
            first.setdefault(old, new)
    own, longest = tuple(first.items()), max(map(len, first), default=0)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        find = automaton(tuple(first))
        return texts.map(lambda t: t if t is None or not own else replace_in_order(t, own, find, longest))

    return run(c)
