"""SimHash near-dedup by covering locality-sensitive hashing, and groups as connected components.

Every bit position gets one of seven nonzero 3-bit labels, and table v keeps the positions whose label has an
odd product with v. Any two differing positions have labels that span at most two dimensions, so some
nonzero v is orthogonal to both: in that table the pair's masked fingerprints are equal. Seven tables
therefore find every pair at distance 2 or less. Inside a shared bucket, pairs aren't enumerated: two
fingerprints are within distance 2 exactly if flipping at most one bit of each can give the same value,
so each member sends its one-bit variants and meets its partners there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .common import clear, cut, dealt_anew, document_key, of_ids, pieces_of, shuffles_let_go, small_batches, text_of

RADIUS = 2
LABELS = [1 + i % 7 for i in range(64)]
#: The covering masks: table v keeps the positions whose label has an odd product with v.
MASKS = [sum(1 << i for i, m in enumerate(LABELS) if bin(m & v).count("1") % 2) for v in range(1, 8)]
CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles, repeats included; of the whole sequence if it is shorter."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - k + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(words[i : i + k]), 42) for i in range(n)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit majority of the hashes, unsigned; of none, zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and the fingerprint (signed long) of every row's whole text; a text without words has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(shingle_hashes(t, shingle))) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.int64())], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def covering_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) with a > b that join all distinct values ``fp`` within distance 2, directly or in steps.

    A set of values that meet at one variant is pairwise within distance 2; it is linked through its least
    member, so a group of any size gives as many links as members.
    """
    tables = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(_signed(m)).alias("mask")) for v, m in enumerate(MASKS)])
    keyed = fps.select("fp", F.explode(tables).alias("t")).select(
        "fp", "t.v", F.col("fp").bitwiseAND(F.col("t.mask")).alias("key")
    )
    full = keyed.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1").select("v", "key")
    hidden = F.array(
        *[
            F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1])
            for m in MASKS
        ]
    )
    variants = (
        keyed.join(full, ["v", "key"])
        .select("fp", F.explode(F.get(hidden, F.col("v"))).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    )
    least = variants.groupBy("variant").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("top > b")
    return variants.join(least, "variant").where("fp > b").select(F.col("fp").alias("a"), "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every value in ``links`` (a, b): root is the least value of its connected component.

    Alternates large-star and small-star steps, each a minimum per node and a join, and writes the links to
    the checkpoint folder after each round; stars shrink the depth of a component at every round, so the
    rounds grow with the logarithm of its size.
    """
    edges, before = cut(links.select("a", "b").where("a <> b").distinct()), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        edges = cut(small)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state


def near_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable) for every row of ``docs`` (doc_id, text).

    Fingerprints within distance 2 are linked, equal ones are one node from the start, so a group of copies is
    one node however large it is. Null or empty text has fingerprint 0 and is linked like any other.
    A row without a doc_id is a member, but is never the name of a component unless no other is in it
    (component_id is then null). Repeated rows are repeated in the result. No rows give no rows. Other
    columns are ignored.
    """
    own = cut(fingerprints(docs, shingle))
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(covering_links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return own.join(named.select("fp", "root").join(dealt_anew(names, "root"), "root").select("fp", "component_id"), "fp")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---- texts alike by their word shingles -------------------------------------------------------------------

#: How many members of a bucket one part of it holds, about.
PART = 1024


def _distinct_texts(batch: pa.RecordBatch, seen: set[int], shingle: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, shingles (sorted within each text), the text of each shingle and sizes of the texts that this task didn't meet."""
    fresh = []
    for i, key in enumerate(batch["text_hash"].to_pylist()):
        if key not in seen:
            seen.add(key)
            fresh.append(i)
    part = batch.take(pa.array(fresh, pa.int64()))
    texts, ids = part["text"].to_pylist(), part["text_hash"].to_numpy()
    for i, j in pieces_of(texts):
        shingles, text = flat.shingle_sets(texts[i:j], shingle)
        yield ids[i:j], shingles, text, np.bincount(text, minlength=j - i)


def _shingled(texts: DataFrame, shingle: int, schema: str, rows: Callable[..., list[np.ndarray | pa.Array]]) -> DataFrame:
    """``rows`` of the different texts of each task, as columns of ``schema``; a text of several tasks gives repeated rows."""
    names = [column.split()[0] for column in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for some in _distinct_texts(batch, seen, shingle):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows(*some)], names)

    return texts.select("text_hash", "text").mapInArrow(run, schema)


def _common_shingles(texts: DataFrame, shingle: int, most: int, every: int) -> tuple[np.ndarray, np.ndarray]:
    """About ``most`` of the commonest shingles (sorted) and their counts, in one text of ``every``.

    Of shingles as common as the last ones those with low hashes are taken. A text of several tasks counts as often. They only order shingles and split buckets: with any others the same
    pairs are found.
    """
    some = texts.where(F.pmod("text_hash", F.lit(every)) == 0)
    rows = _shingled(some, shingle, "key bigint", lambda _ids, shingles, _text, _size: [shingles.view(np.int64)])
    counts = cut(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    # counts to three digits, so that few different ones are told to the driver
    level = F.col("c") - F.col("c") % F.pow(F.lit(10.0), F.greatest(F.length(F.col("c").cast("string")) - 3, F.lit(0))).cast("bigint")
    counts = counts.withColumn("level", level)
    least, room = 0, most
    for c, n in sorted((tuple(r) for r in counts.groupBy("level").count().collect()), reverse=True):
        least = c
        if n > room:
            break
        room -= n
    else:
        least -= 1  # all of them
    # of the level that isn't wanted whole, those with low hashes; a tenth less than there is room for, as hashes vary
    last = counts.where(F.col("level") == least).count()
    share = int((1 << 30) * 0.9 * room / last) if last else 0
    wanted = (F.col("level") > least) | ((F.col("level") == least) & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share))
    found = counts.where(wanted).select("key", "c").toPandas()
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["c"].to_numpy(np.int64)[order]


def _prefixes(
    shingles: np.ndarray, text: np.ndarray, size: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the first shingles in one global order: uncommon ones by value, then ``common`` ones by ``rank``.

    A set that is alike shares one of them, as it has at least ``similarity`` of these shingles. Returns which shingles
    they are, how many of the set are left from each on, and their ranks (0: uncommon).
    """
    place = np.zeros(len(shingles), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        place = np.where(common[at] == shingles, rank[at], 0)
    order = np.lexsort((place, text))  # stable: by value within a place
    left = size[text] - (np.arange(len(text)) - (np.cumsum(size) - size)[text])
    first = left >= np.ceil(similarity * size - 1e-6)[text]
    return order[first], left[first], place[order[first]]


def _bitmaps(shingles: np.ndarray, text: np.ndarray, size: np.ndarray) -> pa.Array:
    """For each text a bitmap of parities: a shingle turns one of a power of two, twice as many as shingles at least."""
    bits = 64 << np.ceil(np.log2(np.maximum(size / 32, 1))).astype(np.int64)
    first = np.cumsum(bits) - bits
    at = first[text] + (shingles & (bits[text] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(bits.sum())).astype(np.uint8) & 1
    longs = np.packbits(odd, bitorder="little").view("<i8")
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(bits >> 6)), pa.int32()), pa.array(longs))


def _majorities(shingles: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each text the fingerprint of its set of shingles, signed."""
    ones = np.zeros((len(size), 64), np.int64)
    for at in range(0, len(shingles), CHUNK):
        part, owner = shingles[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), text[at : at + CHUNK]
        start = np.flatnonzero(np.diff(owner, prepend=-1))
        ones[owner[start]] += np.add.reduceat(np.unpackbits(part, axis=1, bitorder="little"), start, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<i8").ravel()


def _turned(a: str, b: str) -> Column:
    """In how many bits two bitmaps differ, once the longer one is folded to the length of the other."""
    one, two = (F.when(F.size(a) >= F.size(b), F.col(x)).otherwise(F.col(y)) for x, y in ((a, b), (b, a)))
    n = F.size(two)
    pick = lambda i, k: F.coalesce(F.get(one, i + n * k), F.lit(0).cast("bigint"))
    # of sets of a similarity in reach one is never four times as long as the other
    differing = F.transform(two, lambda x, i: F.bit_count(x.bitwiseXOR(pick(i, 0)).bitwiseXOR(pick(i, 1))))
    return F.aggregate(differing, F.lit(0), lambda total, x: total + x)


def near_duplicates(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, small: int = 16, most_common: int = 1 << 17, sample: int = 16
) -> DataFrame:
    """doc_id and group_id (the least doc_id of its group) for every distinct (doc_id, text) of ``docs``.

    Texts are alike if the Jaccard similarity of their sets of ``shingle``-word shingles is at least
    ``similarity`` (over 0.5); groups are exactly the connected components of that. First the SimHash fingerprints of
    the sets are linked at two differing bits or fewer, and what they link is verified. At 0.8, fingerprints
    differ in some ten bits, beyond any covering code of useful size; so texts that are still in different groups meet at shingles: in one order of all
    shingles, alike sets share one of their first few (a fifth, at 0.8), at places that leave room for as many in common
    as the similarity needs. Candidates are compared by bitmaps first, which differ in no more bits than the sets in
    shingles; what is left is verified on the whole sets. The order puts the ``most_common`` shingles, counted in one
    text of ``sample``, last, so that texts meet at rare ones. Equal texts are one node from the start.

    In buckets of up to ``small`` different texts all pairs are candidates. In a larger one each text first meets the
    bucket's center, the member with the most company; then members that are still in different groups
    meet each other. So a large group of copies is not paired with itself, and no pair that could join groups is left out.
    Buckets of shingles that are common in the sample are dealt to several tasks.

    Null text is empty; texts without words are alike. Null doc_ids don't name a group that has others.
    """
    small_batches(docs.sparkSession)
    text = text_of(docs)
    hashed = docs.select("doc_id", F.xxhash64(text, F.lit(7)).alias("text_hash"), text.alias("text"))
    nodes = hashed.groupBy("text_hash").agg(F.min("doc_id").alias("least_id"))
    # each step is written, so what it shuffled needn't wait for the end
    with shuffles_let_go(docs.sparkSession):
        members = _members(hashed, shingle, similarity, small, most_common, sample)
        sketch = lambda ids, s, text, size: [ids, size.astype(np.int32), _bitmaps(s, text, size), _majorities(s, text, size)]
        sketches = _shingled(hashed, shingle, "text_hash bigint, size int, bits array<bigint>, fp bigint", sketch)
        sketches = cut(sketches.dropDuplicates(["text_hash"]))
        bitmaps = sketches.drop("fp")
        near = cut(_alike(hashed, bitmaps, _fingerprint_pairs(sketches.select("text_hash", "fp")), shingle, similarity))
        roots = cut(components(near).withColumnRenamed("node", "text_hash"))
        links = cut(near.union(_alike(hashed, bitmaps, _apart(_first_pairs(members, similarity), roots), shingle, similarity)))
        roots = cut(components(links).withColumnRenamed("node", "text_hash"))
        rest = cut(_pairs_apart(members.where("large"), roots, similarity))
        if not rest.isEmpty():
            links = links.union(_alike(hashed, bitmaps, rest, shingle, similarity))
            roots = cut(components(links).withColumnRenamed("node", "text_hash"))
    named = nodes.join(roots, "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash"))
    names = named.groupBy("root").agg(F.min("least_id").alias("group_id"))
    return (
        hashed.select("doc_id", "text_hash")
        .distinct()
        .join(dealt_anew(named.select("text_hash", "root"), "text_hash"), "text_hash")
        .join(dealt_anew(names, "root"), "root")
        .select("doc_id", "text_hash", "group_id")
    )


def _members(hashed: DataFrame, shingle: int, similarity: float, small: int, most_common: int, sample: int) -> DataFrame:
    """The texts of each bucket (key) that has several, and which buckets are large."""
    common, rank = _common_shingles(hashed, shingle, most_common, sample)

    def prefix_rows(ids: np.ndarray, shingles: np.ndarray, text: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        first, left, place = _prefixes(shingles, text, size, similarity, common, rank)
        owner = text[first]
        # a shingle of a common rank has about so many texts
        parts = np.maximum(place * sample // PART, 1)
        part = (flat.mix(ids.view(np.uint64))[owner] % parts.astype(np.uint64)).astype(np.int32)
        key = shingles[first].view(np.int64)
        return [key, part, ids[owner], size[owner].astype(np.int32), left.astype(np.int32), parts.astype(np.int32)]

    schema = "key bigint, part int, text_hash bigint, size int, left int, parts int"
    keyed = _shingled(hashed, shingle, schema, prefix_rows).repartition("key", "part")
    bucket = Window.partitionBy("key", "part")
    shared = keyed.withColumn("n", F.count("*").over(bucket)).where("n > 1 or parts > 1")
    # a text that several tasks had is counted as often, which at most makes a bucket pass for a large one
    members = shared.groupBy("key", "part", "text_hash").agg(*[F.first(c).alias(c) for c in ("size", "left", "parts", "n")])
    return cut(members.withColumn("large", (F.col("parts") > 1) | (F.col("n") > small)))


def _first_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """All pairs of the members of small buckets, and of each member of a large one with its center, that have room to be alike."""
    one = F.struct("size", "text_hash", "left")
    few = members.where("not large").groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("m")).where(F.size("m") > 1)
    both = F.explode(
        F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", F.lit(1), i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    )
    fits = _room("a.size", "b.size", "a.left", "b.left", similarity)
    pairs = few.select(both.alias("p")).select("p.a", "p.b").where(fits).select(F.col("a.text_hash").alias("a"), F.col("b.text_hash").alias("b"))

    many = members.where("large").select("key", "text_hash", "size", "left")
    company = members.groupBy("text_hash").agg(F.sum("n").alias("company"))
    best = F.max(F.struct("company", "text_hash", "size", "left"))
    centers = many.join(dealt_anew(company, "text_hash"), "text_hash").groupBy("key").agg(best.alias("c"))
    to_center = (
        many.join(dealt_anew(centers, "key"), "key")
        .where(_room("size", "c.size", "left", "c.left", similarity) & (F.col("text_hash") != F.col("c.text_hash")))
        .select(F.col("text_hash").alias("a"), F.col("c.text_hash").alias("b"))
    )
    return _ordered(pairs.union(to_center))


def _fingerprint_pairs(fps: DataFrame) -> DataFrame:
    """The pairs of texts that SimHash links: each with the first text of its fingerprint (text_hash, fp), and the first ones of
    fingerprints that are within distance 2."""
    firsts = cut(fps.groupBy("fp").agg(F.min("text_hash").alias("first")))
    same = fps.join(dealt_anew(firsts, "fp"), "fp").where("text_hash <> first").select(F.col("text_hash").alias("a"), F.col("first").alias("b"))
    close = covering_links(firsts.select("fp")).join(firsts.toDF("a", "x"), "a").join(firsts.toDF("b", "y"), "b")
    return _ordered(same.union(close.select("x", "y")))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose texts aren't in one group yet."""
    of = lambda end: roots.select(F.col("text_hash").alias(end), F.col("root").alias(f"{end}_root"))
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return known.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _room(a_size: str, b_size: str, a_left: str, b_left: str, similarity: float) -> Column:
    """Whether two sets of these sizes, with these numbers of shingles from a shared one on, can be alike."""
    sizes = F.least(a_size, b_size) >= similarity * F.greatest(a_size, b_size) - 1e-6
    return sizes & (F.least(a_left, b_left) * (1 + similarity) >= similarity * (F.col(a_size) + F.col(b_size)) - 1e-6)


def _alike(hashed: DataFrame, bitmaps: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts whose sets are alike."""
    side = lambda df, x: df.select(*[F.col(c).alias(x if c == "text_hash" else f"{x}_{c}") for c in df.columns])
    close = _turned("a_bits", "b_bits") * (1 + similarity) <= (1 - similarity) * (F.col("a_size") + F.col("b_size")) + 1e-6
    left = cut(pairs.join(side(bitmaps, "a"), "a").join(side(bitmaps, "b"), "b").where(close).select("a", "b"))

    def whole(end: str) -> DataFrame:
        texts = of_ids(hashed, left.select(F.col(end).alias("text_hash")).distinct(), "left_semi")
        lists = lambda ids, s, _, size: [ids, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(s.view(np.int64)))]
        sets = _shingled(texts, shingle, "text_hash bigint, shingles array<bigint>", lists).dropDuplicates(["text_hash"])
        return side(dealt_anew(sets, "text_hash"), end)

    shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
    alike = shared >= similarity * (F.size("a_shingles") + F.size("b_shingles") - shared) - 1e-9
    return left.join(whole("b"), "b").join(whole("a"), "a").where(alike).select("a", "b")


def _pairs_apart(many: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """What the centers didn't join: pairs of large buckets' members in different groups, of sets with room to be alike.

    The smaller of two sets goes to all parts of a bucket, the larger one to its own.
    """
    grouped = many.join(dealt_anew(roots, "text_hash"), "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash"))
    several = grouped.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("in_all"))
    apart = cut(grouped.join(dealt_anew(several.where("lo < hi"), "key"), "key"))
    parts = F.ceil(F.col("in_all") / PART).cast("int")
    side = lambda df, x: df.select("key", "part", *[F.col(c).alias(f"{x}_{c}") for c in ("text_hash", "size", "left", "root")])
    one = side(apart.withColumn("part", F.pmod(F.xxhash64("text_hash"), parts).cast("int")), "a")
    smaller = F.col("left") * (1 + similarity) >= 2 * similarity * F.col("size") - 1e-6
    every = side(apart.where(smaller).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), "b")
    fits = (F.struct("a_size", "a_text_hash") > F.struct("b_size", "b_text_hash")) & (F.col("a_root") != F.col("b_root"))
    fits &= _room("a_size", "b_size", "a_left", "b_left", similarity)
    return _ordered(one.join(every, ["key", "part"]).where(fits).select(F.col("a_text_hash").alias("a"), F.col("b_text_hash").alias("b")))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the least doc_id.

    Rows that repeat a kept document stay; a group without doc_ids keeps its rows.
    """
    docs = clear(docs, "__gone")
    groups = near_duplicates(docs, **how).where(~F.col("doc_id").eqNullSafe(F.col("group_id")))
    gone = groups.select(document_key(F.col("doc_id"), F.col("text_hash")).alias("__gone")).distinct()
    own = docs.withColumn("__gone", document_key(F.col("doc_id"), F.xxhash64(text_of(docs), F.lit(7))))
    return of_ids(own, gone, "left_anti", "__gone").drop("__gone")
