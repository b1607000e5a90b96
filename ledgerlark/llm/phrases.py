"""Phrase collocations by dynamic itemset counting.

Words are counted first; then texts are cut again, and words that have reached the threshold and stand beside another one
that has are kept as arrays of hashes. Each task deals its arrays to all shards in turn. Scans then go round the shards, one a
step, and count phrases of all lengths at the same time; a scan has as many tasks as there are cores, as each task gives a
row for each active phrase it has met, and more tasks mean more rows. A phrase is active from the first step before which both its first and its
last part (all words but one) have reached the threshold in what has been counted so far; it is counted for one full cycle
from there, so its count is exact, and counts for no longer. Longer phrases start while shorter ones are still under
way. It ends when no phrase is active any more.

Most pairs of frequent words are rare, and so are most phrases of two frequent pairs. So before the first step these are counted
by 40 bits of their hashes alone (after Park, Chen and Yu), two numbers a row instead of all words, and only those whose bits
have reached the threshold become active. Phrases that share bits are counted too high there, never too low, and those that
become active are counted exactly.

Tasks learn which phrases have reached the threshold from a bitmap of their hashes, whose size is set beforehand by the
number of words and bounded. The bitmap before a step tells what is active, the one a cycle earlier what has been counted
already. A hash that meets another one's bit only makes a phrase active that wouldn't be: it is counted
over a full cycle as well, and exactly. So a bitmap too small for a corpus costs time, not results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .common import cut, pieces_of, remove, shared_folder, shuffles_let_go, small_batches

LONGEST = 5
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
_KIND = np.zeros(256, np.int8)
_KIND[list(BLANKS)], _KIND[list(BREAKS)] = 1, 2
#: Words of a stored array, about; it ends where a piece of text does.
ARRAY_WORDS = 1 << 13
#: Rows of a task's counts that are added up at once, characters that are cut and words that are scanned at once.
ROWS, CUT_CHARS, SCAN_WORDS = 1 << 18, 1 << 19, 1 << 17
#: Different phrases that a task of a scan holds at most before it gives their counts away.
HELD = 1 << 18
#: Lengths that are counted by bits of hashes first, rows of a task's counts of these that are added up at once, and which bits those are.
SIFTED, SIFTED_ROWS, SIFTED_BITS = (2, 3), 1 << 20, np.uint64(2**64 - 2**24)
#: Logarithms of the least and the largest number of bits.
BITS = (16, 29)
W = [f"w{i}" for i in range(1, LONGEST + 1)]
#: The columns of a phrase beyond its first word, of one that has no more.
NO_WORDS = [f"bigint(0) as {w}" for w in W[1:]]
WORDS = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("word", pa.string()), ("high", pa.string()), ("n", pa.int64())])
COUNTED = "lang string, h bigint, word string, high string, n bigint"
TOKENS = pa.schema([("shard", pa.int32()), ("tokens", pa.list_(pa.int64()))])
STORED = "shard int, tokens array<bigint>"
#: Bytes of different words that a file of arrays may write once and number.
DICTIONARY = 1 << 22
COUNTS = pa.schema([(w, pa.int64()) for w in W] + [("n", pa.int64())])


def _mixed(seed: int, lang: str) -> np.uint64:
    own = flat.words([lang.replace(" ", "_") or "_"]).hashes()
    return flat.mix(own[:1] + np.uint64(seed) * flat.BASE + np.uint64(1))[0]


def cut_words(texts: list[str], salt: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, A-Z lower-cased; where each word begins and ends, its hash, and whether it is the first of a piece."""
    raw = flat.LOWERED[np.frombuffer("".join(f"{t}\n" for t in texts).encode(), np.uint8)]
    kind = _KIND[raw]
    edge = np.diff(np.concatenate([[0], (kind == 0).view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    w = flat.Words(raw, np.zeros(0, np.int64), start, end - start, np.zeros(0, np.int64))
    h = flat.mix(w.hashes() ^ salt)
    h[h == 0] = 1
    piece = np.cumsum(kind == 2)[start] if len(start) else start
    return raw, start, end, h, np.diff(piece, prepend=-1) != 0


def distinct_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> pa.Table:
    """The distinct words as h, word, n."""
    keys, at, n = np.unique(h, return_index=True, return_counts=True)
    data = raw.tobytes()
    words = pa.array([data[i:j] for i, j in zip(start[at].tolist(), end[at].tolist(), strict=True)], pa.binary()).cast(pa.string())
    return pa.table({"h": keys.view(np.int64), "word": words, "n": n})


def beside_each_other(h: np.ndarray, first: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Hashes of the words with a bit in ``often`` that stand beside another one in their piece, with a 0 before each run of them."""
    if not len(h):
        return h
    kept = _has(often, h)
    joined = np.zeros(len(h) + 1, bool)  # whether a word belongs to the one before
    joined[1:-1] = kept[1:] & kept[:-1] & ~first[1:]
    at = np.flatnonzero(joined[:-1] | joined[1:])
    return np.insert(h[at], np.flatnonzero(~joined[at]), 0)


def _arrays(tokens: np.ndarray) -> Iterator[np.ndarray]:
    """``tokens`` in parts that begin with a 0."""
    begins = np.flatnonzero(tokens == 0)
    at = 0
    while at < len(tokens):
        k = np.searchsorted(begins, at + ARRAY_WORDS)
        stop = int(begins[k]) if k < len(begins) else len(tokens)
        yield tokens[at:stop]
        at = stop


def _added(tables: list[pa.Table], keys: list[str], how: list[tuple[str, str]], schema: pa.Schema) -> pa.Table:
    # neighbours with the same first word take less room in shuffles
    whole = pa.concat_tables(tables).group_by(keys).aggregate(how).sort_by(keys[0])
    return whole.rename_columns([*keys, *(c for c, _ in how)]).select(schema.names).cast(schema)


SUMS = [("word", "min"), ("high", "max"), ("n", "sum")]


def _cut(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[str, tuple[np.ndarray, ...]]]:
    """What ``cut_words`` gives for some texts of a language at a time, of batches of lang and text."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives memory back that a pool of its own would keep
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            own = [t for x, t in zip(langs, texts, strict=True) if x == lang and t]
            for i, j in pieces_of(own, CUT_CHARS):
                yield lang, cut_words(own[i:j], _mixed(seed, lang))


def count_words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``WORDS`` from batches of lang and text; ``high``, the last of the words with a hash, is null if all are the same."""
    held, size = [], 0

    def rows(words: pa.Table) -> Iterator[pa.RecordBatch]:
        same = pc.equal(words["word"], words["high"])
        yield from words.set_column(3, "high", pc.if_else(same, pa.scalar(None, pa.string()), words["high"])).to_batches(1 << 16)

    for lang, (raw, start, end, h, _) in _cut(batches, seed):
        words = distinct_words(raw, start, end, h)
        words = words.append_column("high", words["word"]).append_column("lang", pa.array([lang] * len(words), pa.string()))
        held.append(words.select(WORDS.names).cast(WORDS))
        size += len(words)
        if size >= ROWS:
            held = [_added(held, ["lang", "h"], SUMS, WORDS)]
            if (size := len(held[0])) >= ROWS // 2:
                yield from rows(held.pop())
                size = 0
    if held:
        yield from rows(_added(held, ["lang", "h"], SUMS, WORDS))


def store_words(docs: DataFrame, folder: str, shards: int, seed: int) -> DataFrame:
    """The words of ``docs`` (lang, text), each task's with their counts, written to ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from count_words(batches, seed)

    docs.mapInArrow(run, COUNTED).write.parquet(folder)
    return docs.sparkSession.read.schema(COUNTED).parquet(folder)


def store_tokens(docs: DataFrame, folder: str, shards: int, seed: int, often: np.ndarray) -> DataFrame:
    """Arrays of the hashes of words of ``docs`` (lang, text) that have a bit in ``often``, written to ``folder`` by shard."""
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        for _, (_, _, _, h, first) in _cut(batches, seed):
            for part in _arrays(beside_each_other(h, first, sent.value)):
                shard = (shard + 1) % shards
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part.view(np.int64)], TOKENS.field(1).type)], schema=TOKENS)

    # a folder holds one shard, and each task's files are in all of them, so every step has work for all cores
    docs.mapInArrow(run, STORED).write.partitionBy("shard").option("parquet.dictionary.page.size", DICTIONARY).parquet(folder)
    return docs.sparkSession.read.schema(STORED).parquet(folder)


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = h >> np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def active(tokens: np.ndarray, now: np.ndarray, before: np.ndarray, sifted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, hashes) of the phrases that are active under the bitmap ``now`` and were not under ``before``.

    Of the lengths ``SIFTED`` only those with a bit in ``sifted`` can be.
    """
    h = tokens
    places = np.arange(len(tokens))
    reached = (tokens != 0) & _has(now, h)
    known = reached & _has(before, h)
    for k in range(2, LONGEST + 1):
        both = reached[:-1] & reached[1:]
        places = np.flatnonzero(both)
        hash_of = np.zeros(len(tokens), np.uint64)
        h = flat.mix(h[places] * flat.BASE + tokens[places + k - 1])
        if k in SIFTED and sifted is not None:
            can = _has(sifted, h)
            places, h = places[can], h[can]
        counted = known[places] & known[places + 1]
        yield k, places[~counted], h[~counted]
        reached, known = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
        reached[places] = _has(now, h)
        known[places] = counted & _has(before, h)
        hash_of[places] = h
        h = hash_of


def _parts(arrays: pa.ListArray) -> Iterator[np.ndarray]:
    """The words of some of the arrays at a time."""
    words, ends = arrays.flatten().to_numpy(zero_copy_only=False).view(np.uint64), arrays.offsets.to_numpy() - arrays.offsets[0].as_py()
    at = 0
    while at < len(arrays):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + SCAN_WORDS, "right")) - 1)
        yield words[ends[at] : ends[stop]]
        at = stop


def count_batches(batches: Iterator[pa.RecordBatch], now: np.ndarray, before: np.ndarray, sifted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``COUNTS`` from batches of arrays of words."""
    pa.set_memory_pool(pa.system_memory_pool())
    held, size, limit = [], 0, ROWS
    for tokens in (part for batch in batches for part in _parts(batch.column(0))):
        for k, places, h in active(tokens, now, before, sifted):
            if len(places):
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                at = places[first]
                words = [tokens[at + i] if i < k else np.zeros(len(at), np.uint64) for i in range(LONGEST)]
                held.append(pa.table([*(pa.array(x.view(np.int64)) for x in words), pa.array(n)], schema=COUNTS))
                size += len(at)
        if size >= limit:
            held = [_added(held, W, [("n", "sum")], COUNTS)]
            if (size := len(held[0])) >= HELD:
                yield from held.pop().to_batches(1 << 16)
                size = 0
            limit = size + ROWS
    if held:
        yield from _added(held, W, [("n", "sum")], COUNTS).to_batches(1 << 16)


def scan(stored: DataFrame, now: np.ndarray, before: np.ndarray, sifted: np.ndarray) -> DataFrame:
    """How often each active phrase is in ``stored`` (tokens), as w1 to w5 (0 beyond its length) and n."""
    spark = stored.sparkSession
    sent = spark.sparkContext.broadcast((now, before, sifted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from count_batches(batches, *sent.value)

    small_batches(spark, 64)
    # a task for each core: a phrase has a row for each task that meets it, so tasks that grow with the input would
    # multiply the phrases, which grow with it as well
    dealt = stored.select("tokens").coalesce(spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, ", ".join(f"{w} bigint" for w in W) + ", n bigint")


def with_bits(phrases: DataFrame, bitmap: np.ndarray) -> np.ndarray:
    """``bitmap`` with the bits of ``phrases`` (w1 to w5). The driver gets a number for each 64 bits at most."""
    width = len(bitmap) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            h = words[0]
            for w in words[1:]:
                h = np.where(w != 0, flat.mix(h * flat.BASE + w), h)
            at = h >> np.uint64(64 - width.bit_length() + 1)
            bit = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(bit.view(np.int64))], ["slot", "bits"])

    rows = phrases.select(W).mapInArrow(run, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    found = bitmap.view(np.uint64).copy()
    found[rows["slot"].to_numpy()] |= rows["bits"].to_numpy().view(np.uint64)
    return found.view(np.uint8)


def sift_batches(batches: Iterator[pa.RecordBatch], length: int, now: np.ndarray) -> Iterator[pa.RecordBatch]:
    """h (its first bits) and n of the phrases of ``length`` words whose parts have bits in ``now``, from batches of arrays of words."""
    none = np.zeros_like(now)
    pa.set_memory_pool(pa.system_memory_pool())
    held, size = [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        return h[first], np.add.reduceat(n, first)

    def rows(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from pa.table({"h": h.view(np.int64), "n": n}).to_batches(1 << 16)

    for tokens in (part for batch in batches for part in _parts(batch.column(0))):
        h = next(h for k, _, h in active(tokens, now, none) if k == length)
        if len(h):
            held.append(np.unique(h & SIFTED_BITS, return_counts=True))
            size += len(held[-1][0])
        if size >= SIFTED_ROWS:
            held = [added()]
            if (size := len(held[0][0])) >= SIFTED_ROWS // 2:
                yield from rows(*held.pop())
                size = 0
    if held:
        yield from rows(*added())


def sift(stored: DataFrame, ones: np.ndarray, least: int) -> np.ndarray:
    """``ones`` with the bits of the phrases of the lengths ``SIFTED`` in ``stored`` (tokens) that can be found ``least`` times."""
    spark = stored.sparkSession
    small_batches(spark, 64)
    now = ones
    for length in SIFTED:
        sent = spark.sparkContext.broadcast((length, now))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            yield from sift_batches(batches, *sent.value)

        found = stored.select("tokens").mapInArrow(run, "h bigint, n bigint")
        # tasks have added up their own counts before
        sums = found.repartition("h").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        now = with_bits(sums.selectExpr("h as w1", *NO_WORDS), now)
    return now


def count_phrases(stored: DataFrame, ones: np.ndarray, folder: str, least: int, shards: int) -> DataFrame | None:
    """w1 to w5 and n of all phrases of two words or more that are found ``least`` times, in the shards of ``stored``.

    ``ones`` is the bitmap of the words found so often; without any there is no result. Counts of phrases under way are a table
    of their own after each step, so a lost executor costs one step at most; the table before is deleted then.
    """
    spark = stored.sparkSession
    if not ones.any():
        return None
    none = np.zeros_like(ones)
    sifted = sift(stored, ones, least)
    # the bitmaps before each step of the last cycle and before the next step
    bitmaps = [none] * shards + [ones]
    state, step = None, 0
    while not np.array_equal(now := bitmaps[-1], before := bitmaps[0]):
        # all words are known from the start, so pairs that can reach the threshold are active since step 0; of longer
        # phrases the first step that finds them isn't before the one since which they are active
        since = F.when(F.col("w3") == 0, 0).otherwise(F.lit(step)).alias("since")
        found = scan(stored.where(F.col("shard") == step % shards), now, before, sifted).select("*", since)
        state = found if state is None else state.unionByName(found)
        # tasks have added up their own counts before; whoever has had a full cycle and not reached the threshold can go
        sums = state.repartition(*W).groupBy(W).agg(F.sum("n").alias("n"), F.min("since").alias("since"))
        sums = sums.where((F.col("n") >= least) | (F.col("since") > step - shards + 1))
        sums.sortWithinPartitions(*W[:2]).write.parquet(f"{folder}/{step}")
        state = spark.read.parquet(f"{folder}/{step}")
        remove(spark, f"{folder}/{step - 1}")
        # the longest phrases are no part of others
        bitmaps = [*bitmaps[1:], with_bits(state.where((F.col("n") >= least) & (F.col(W[-1]) == 0)), now)]
        step += 1
    return state.where(F.col("n") >= least).drop("since")


def _exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) in decimals of 38 digits."""
    wide = [c.cast("decimal(17,0)") for c in (a, n, left, right)]
    return F.call_function("div", wide[0] * wide[1] * 1000, wide[2] * wide[3])


def counted(docs: DataFrame, least: int, shards: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The words found ``least`` times (h, lang, word, n), each language's words (lang, n_lang), and the phrases (w, a)."""
    spark = docs.sparkSession
    for seed in range(16):
        folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
        stored = store_words(docs, f"{folder}/words", shards, seed)
        # tasks have added up their own words before, so rows are dealt as they are
        each = stored.where("h is not null").repartition("h").groupBy("h").agg(
            F.min("lang").alias("lang"), F.max("lang").alias("other"), F.min("word").alias("word"), F.max(F.coalesce("high", "word")).alias("high"), F.sum("n").alias("n")
        )
        each = each.withColumn("clash", (F.col("word") != F.col("high")) | (F.col("lang") != F.col("other")))
        each.where((F.col("n") >= least) | F.col("clash")).write.parquet(f"{folder}/often")
        words = spark.read.parquet(f"{folder}/often")
        if words.where("clash").isEmpty():
            break
        remove(spark, folder)
    else:
        raise ValueError("hashes of words clash under every seed")
    totals = cut(stored.where("h is not null").groupBy("lang").agg(F.sum("n").alias("n_lang")))
    n_words = totals.agg(F.sum("n_lang")).first()[0] or 0
    remove(spark, f"{folder}/words")
    bits = int(np.clip(int(4 * LONGEST * n_words / least).bit_length(), *BITS))
    ones = with_bits(words.selectExpr("h as w1", *NO_WORDS), np.zeros(1 << bits >> 3, np.uint8))
    tokens = store_tokens(docs, f"{folder}/tokens", shards, seed, ones)
    phrases = count_phrases(tokens, ones, f"{folder}/counts", least, shards)
    if phrases is None:
        phrases = words.selectExpr("h as w1", *NO_WORDS, "n").limit(0)
    w = F.filter(F.array(*W), lambda x: x != 0)
    found = cut(phrases.select(w.alias("w"), F.col("n").alias("a")))
    remove(spark, f"{folder}/tokens")
    remove(spark, f"{folder}/counts")
    return words, totals, found


def collocations(docs: DataFrame, least: int = 100, first: int = 2000, inside: int = 100, shards: int = 3) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the ``first`` phrases of each language whose words belong together most.

    Texts of ``docs`` (text, lang), A-Z lower-cased, are cut into pieces at ``.,;:!?`` and line ends, pieces at spaces
    and tabs into words. Candidates are the phrases of 2 to 5 words of a piece that are found ``least`` times in
    a language (a, overlaps included). Of the cuts in two parts, found l and r times, the one with the lowest
    floor(1000 a n / (l r)) counts, the first among equal ones; n are the language's words. A candidate inside a longer one
    that is found in ``inside`` percent of its places or more is left out. Order: score, a (both descending), phrase
    in UTF-8 order.

    Null text is empty, null lang is ``und``. Repeated rows count each. No rows, or no candidates, give none. Other
    columns are ignored. Texts are read twice. Words are told apart by 64-bit hashes; if two words of a language share one, all is done again
    with other hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    small_batches(spark, 256)
    with shuffles_let_go(spark):
        words, totals, found = counted(docs, least, shards)
    counts = found.unionByName(words.select(F.array("h").alias("w"), F.col("n").alias("a")))

    size = F.size("w")
    parts = found.select("w", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "w", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("head"), F.slice("w", F.col("k") + 1, size - F.col("k")).alias("tail")
    )
    parts = parts.join(counts.toDF("head", "l"), "head").join(counts.toDF("tail", "r"), "tail")
    langs = words.select(F.col("h").alias("w1"), "lang").join(totals, "lang")
    parts = parts.withColumn("w1", F.col("w")[0]).join(langs, "w1")
    scored = parts.withColumn("score", _exact_score(F.col("a"), F.col("n_lang"), F.col("l"), F.col("r")))
    scored = scored.groupBy("w", "a", "lang", "n_lang").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    lengths = F.sequence(F.lit(2), size - 1)
    inner = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("w", i, n))))
    longer = found.where(size > 2).select(F.explode(inner).alias("w"), "a").groupBy("w").agg(F.max("a").alias("longest"))
    kept = scored.join(longer, "w", "left").where(F.coalesce(100 * F.col("longest") < inside * F.col("a"), F.lit(True)))
    kept = kept.select("w", "lang", "a", F.col("n_lang").alias("n"), "best.score", "best.l", "best.r")

    # phrases that rank by numbers alone, ties included; only these need their words
    order = [F.desc("score"), F.desc("a")]
    kept = kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= first)
    spelled = (
        kept.select("w", F.posexplode("w").alias("i", "h")).join(words.select("h", "word"), "h")
        .groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    ranked = kept.join(spelled, "w").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")))
    whole = ranked.where(F.col("rank") <= first)
    return whole.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
