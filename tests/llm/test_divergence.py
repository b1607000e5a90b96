"""The source audit against plain arithmetic over whole vocabularies."""

import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerlark.llm import divergence


def plain(rows, min_docs, top):
    rows = [tuple(v or "" for v in r) for r in rows]
    df, sums, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        df[lang].update(set(terms))
        sums[lang, source].update(terms)
        total[lang].update(terms)
        groups[lang].add(source)
    found = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: shares(sums[lang, s]) for s in sources}
        q = shares(total[lang])
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-apart(p[s][t], q[t]), t.encode()) for t in kept if sums[lang, s][t] and p[s][t] > q[t]]
            for part, some in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                found |= {(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(some)}
    return found


def texts(seed, n):
    r = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["Été", "日本", "x-y", "don't", "ß", "😀"]
    for _ in range(n):
        source = r.choice(["s1", "s2", "s3", "S3", None, "é"])
        some = r.sample(words, 8) + ([source] * 3 if source else [])
        yield " ".join(r.choice(some) for _ in range(r.randint(0, 40))), r.choice(["en", "fr", None]), source


@pytest.mark.parametrize("min_docs", [1, 10, 10_000])
def test_equals_plain_arithmetic(spark, min_docs):
    rows = [*texts(5, 200), (None, "en", "none"), ("", "en", "none"), ("1 2 3", "en", "digits"), ("alone", "xx", "only"), (None, None, None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    found = divergence.audit(docs, min_docs, 3).collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {tuple(r) for r in found} == plain(rows, min_docs, 3)


def test_small_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 10)
    rows = list(texts(6, 60))
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert {tuple(r) for r in divergence.audit(docs, 2, 5).collect()} == plain(rows, 2, 5)


def test_vectors(spark):
    docs = spark.createDataFrame([(1, "B a b c-b", 0), (2, None, 0), (3, " 7", 0)], "id int, text string, counts int")
    rows = divergence.count_vectors(docs).orderBy("id").collect()
    assert [(r.id, dict(zip(r.terms, r.counts, strict=True))) for r in rows] == [(1, {"b": 3, "a": 1, "c": 1}), (2, {}), (3, {})]


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000, 9_000_000_000_000_123, 7)], "c bigint, n bigint, v bigint")
    got = df.select(divergence.share(df.c, df.n, df.v)).first()[0]
    assert got == 1 + 10**9 * (9_000_000_000_000_000 + 2) // (9_000_000_000_000_123 + 14)


def test_edges(spark, docs, no_docs):
    assert divergence.audit(no_docs).count() == 0
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert {tuple(r) for r in divergence.audit(docs, 1).collect()} == plain(rows, 1, 10)
