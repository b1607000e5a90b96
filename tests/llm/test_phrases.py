"""Phrase mining against plain counting, for several numbers of shards."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import phrases


def plain(rows, least, first, inside=100):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(w[i : i + k] for i in range(len(w) - k + 1))
    found = set()
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in often.items():
            holders = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= inside * a for b in holders):
                continue
            cuts = [(1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(rows)[:first]):
            found.add((lang, i + 1, p.decode(), -a, left, right, total[lang], -score))
    return found


def texts(seed, n=300):
    r = random.Random(seed)
    words = ["a", "B", "ça", "d", "日本", "e-f", "g"]
    for _ in range(n):
        said = []
        for _ in range(r.randint(0, 30)):
            said.append(r.choice(words) if r.random() < 0.6 else "a B ça d g e-f")
            said.append(r.choice([" ", "  ", "\t", ". ", "\n", ",", " "]))
        yield r.choice(["en", "en", "fr", None, "und", ""]), "".join(said)


@pytest.fixture(scope="module")
def rows():
    return [*texts(1), ("en", None), (None, ""), ("fr", " \n\t ."), *[("en", "x y z x y z")] * 40, ("late", ". q r s " * 50)]


@pytest.mark.parametrize("shards,parts", [(1, 1), (2, 5)])
def test_equals_plain_counting(spark, rows, shards, parts):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
    found = phrases.collocations(docs, least=20, first=25, shards=shards)
    assert {tuple(r) for r in found.collect()} == plain(rows, 20, 25)


def test_part_of_the_places(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = phrases.collocations(docs, least=10, first=1000, inside=60)
    assert {tuple(r) for r in found.collect()} == plain(rows, 10, 1000, 60)


def test_a_bitmap_that_is_too_small_makes_no_difference(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "BITS", (7, 7))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert {tuple(r) for r in phrases.collocations(docs, least=20, first=30, shards=2).collect()} == plain(rows, 20, 30)


def test_small_messages_and_arrays(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "ROWS", 8)
    monkeypatch.setattr(phrases, "ARRAY_WORDS", 4)
    monkeypatch.setattr(phrases, "SCAN_WORDS", 9)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert {tuple(r) for r in phrases.collocations(docs, least=20, first=30).collect()} == plain(rows, 20, 30)


def test_edges(spark, docs, no_docs):
    assert phrases.collocations(no_docs).count() == 0
    assert phrases.collocations(docs.select("text", "lang", "score", "key"), least=1000).count() == 0
    found = phrases.collocations(docs, least=3, first=5)  # extra columns, nulls, a text of 60,000 words
    assert {tuple(r) for r in found.collect()} == plain([(r.lang, r.text) for r in docs.collect()], 3, 5)


def test_clashing_words_get_other_hashes(spark, monkeypatch):
    seen, own = [], phrases.store_words

    def first_without_hashes(docs, folder, shards, seed):
        stored = own(docs, folder, shards, seed)
        seen.append(seed)
        return stored.withColumn("h", F.when(stored.h.isNotNull(), F.lit(5).cast("bigint"))) if seed == 0 else stored

    monkeypatch.setattr(phrases, "store_words", first_without_hashes)
    rows = [("en", "a b c d")] * 5
    found = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5)
    assert {tuple(r) for r in found.collect()} == plain(rows, 5, 2000)
    assert seen == [0, 1]


def test_activation_needs_both_parts():
    tokens = np.array([0, 1, 2, 3, 0, 1, 2], np.uint64)
    full, none = np.full(1 << 13, 255, np.uint8), np.zeros(1 << 13, np.uint8)
    assert [(k, p.tolist()) for k, p, _ in phrases.active(tokens, full, none)][:3] == [(2, [1, 2, 5]), (3, [1]), (4, [])]
    assert all(not len(p) for _, p, _ in phrases.active(tokens, full, full))
    assert all(not len(p) for _, p, _ in phrases.active(tokens, none, none))


def test_rare_words_are_not_kept_nor_rare_pairs_of_frequent_words_scanned(spark, monkeypatch):
    said = "\n".join(f"w{i} w{j}" for i in range(20) for j in range(20)) + "\nx y rare" * 30 + "".join(f"\nonce{i} z" for i in range(30))
    kept, scanned, store, scan = [], [], phrases.store_tokens, phrases.scan

    def stored(*args):
        found = store(*args)
        kept.extend(h for r in found.collect() for h in r.tokens if h)
        return found

    def counted(*args):
        found = scan(*args)
        scanned.extend(tuple(r)[:5] for r in found.collect())
        return found

    monkeypatch.setattr(phrases, "store_tokens", stored)
    monkeypatch.setattr(phrases, "scan", counted)
    docs = spark.createDataFrame([("en", said)], "lang string, text string")
    assert {tuple(r) for r in phrases.collocations(docs, least=30).collect()} == plain([("en", said)], 30, 2000)
    assert len(set(kept)) <= 24 and len(kept) <= 800 + 90  # z stands beside rare words alone
    assert len(set(scanned)) < 10  # not the 400 pairs that are found once


def test_only_words_beside_another_one_stay():
    h, first = np.array([1, 2, 3, 4, 5], np.uint64), np.array([True, False, False, True, False])
    full, none = np.full(1 << 13, 255, np.uint8), np.zeros(1 << 13, np.uint8)
    assert phrases.beside_each_other(h, first, full).tolist() == [0, 1, 2, 3, 0, 4, 5]
    assert phrases.beside_each_other(h, np.array([True, False, True, True, False]), full).tolist() == [0, 1, 2, 0, 4, 5]
    assert phrases.beside_each_other(h, first, none).tolist() == []
    assert phrases.beside_each_other(h[:0], first[:0], full).tolist() == []


def test_each_phrase_is_given_once_by_each_core_in_a_step(spark, monkeypatch):
    steps, scan = [], phrases.scan

    def counted(*args):
        found = scan(*args)
        steps.append([tuple(r)[:5] for r in found.collect()])
        return found

    monkeypatch.setattr(phrases, "scan", counted)
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = [("en", f"x y z, one{i}, p q") for i in range(10 * cores)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # no two files in a task
    try:
        docs = spark.createDataFrame(rows, "lang string, text string").repartition(5 * cores)
        found = {tuple(r) for r in phrases.collocations(docs, least=20, shards=2).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == plain(rows, 20, 2000)
    assert max(n for step in steps for n in Counter(step).values()) <= cores


def test_a_task_deals_its_words_to_all_shards(spark, monkeypatch):
    monkeypatch.setattr(phrases, "ARRAY_WORDS", 4)
    dealt, store = [], phrases.store_tokens

    def stored(*args):
        found = store(*args)
        dealt.extend(r.shard for r in found.collect())
        return found

    monkeypatch.setattr(phrases, "store_tokens", stored)
    rows = [("en", "a b. c d. a b. c d. " * 10)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(1)
    assert {tuple(r) for r in phrases.collocations(docs, least=20).collect()} == plain(rows, 20, 2000)
    assert set(dealt) == {0, 1, 2}


def test_often_words_that_never_stand_together(spark):
    docs = spark.createDataFrame([("en", "a. b. " * 30)], "lang string, text string")
    assert phrases.collocations(docs, least=20).count() == 0


@pytest.mark.parametrize("held,rows_out", [(8, 2), (1 << 19, 1)])
def test_counts_of_a_task_stay_until_it_holds_many(monkeypatch, held, rows_out):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "ROWS", 8)
    monkeypatch.setattr(phrases, "HELD", held)
    tokens = [0, *range(1, 12)]
    batch = pa.RecordBatch.from_arrays([pa.array([tokens], pa.list_(pa.int64()))], ["tokens"])
    full, none = np.full(1 << 13, 255, np.uint8), np.zeros(1 << 13, np.uint8)
    given = [tuple(r.values()) for b in phrases.count_batches(iter([batch, batch]), full, none, full) for r in b.to_pylist()]
    expected = Counter(tuple(tokens[i : i + k]) + (0,) * (5 - k) for k in range(2, 6) for i in range(1, 13 - k))
    assert max(Counter(r[:5] for r in given).values()) == rows_out
    summed = Counter()
    for *w, n in given:
        summed[tuple(w)] += n
    assert summed == Counter({w: 2 * n for w, n in expected.items()})


def plain_by_index(rows, least, first):
    """What ``plain`` gives, each phrase looked up from the longer ones, so that it is done with many phrases as well."""
    f, total, found = defaultdict(Counter), Counter(), set()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(w[i : i + k] for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for q, b in often.items():
            for p in {q[i : i + n] for n in range(2, len(q)) for i in range(len(q) - n + 1)}:
                longest[p] = max(longest[p], b)
        ranked = []
        for p, a in often.items():
            if longest[p] < a:
                score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:first]):
            found.add((lang, i + 1, p.decode(), -a, left, right, total[lang], -score))
    return found


def test_many_phrases_of_long_texts(spark, docs):
    own = [(r.lang, r.text) for r in docs.collect()]
    found = phrases.collocations(docs, least=3, first=5)  # extra columns, nulls, texts of 60,000 words
    assert {tuple(r) for r in found.collect()} == plain_by_index(own, 3, 5)


def test_both_plain_ways_agree(rows):
    assert plain_by_index(rows, 20, 25) == plain(rows, 20, 25)
