import itertools
import random
import re

import numpy as np
import xxhash

from ledgerlark.llm import simhash

from .conftest import rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_every_pair_in_reach_shares_a_table():
    for a, b in itertools.combinations(range(64), 2):
        assert any(not (m >> a & 1 or m >> b & 1) for m in simhash.MASKS)


def test_links_are_exact(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    values = set(base)
    for x in base:
        for _ in range(6):
            y = x
            for bit in r.sample(range(64), r.choice([1, 2, 3, 4])):
                y ^= 1 << bit
            values.add(y)
    near = [(a, b) for a, b in itertools.combinations(sorted(values), 2) if bin(a ^ b).count("1") <= 2]
    fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.covering_links(fps).collect()]
    assert all(bin(a ^ b).count("1") <= 2 for a, b in links)
    want = groups(values, near)
    assert groups(values, links) == want
    found = simhash.components(simhash.covering_links(fps)).collect()
    signed = groups([simhash._signed(v) for v in values], [(simhash._signed(a), simhash._signed(b)) for a, b in near])
    assert {r.node: r.root for r in found} == {k: v for k, v in signed.items() if list(signed.values()).count(v) > 1}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(500)] + [(1000, 999)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(links).collect()}
    assert found == {i: 0 for i in range(501)} | {1000: 999, 999: 999}


def test_documents_against_brute_force(docs):
    found = {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in simhash.near_components(docs).collect()}
    wanted = [(r[0], brute_fingerprint(r[1])) for r in rows()]
    assert set(found) == set(wanted)
    fps = {f for _, f in wanted}
    near = [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if bin(a ^ b).count("1") <= 2]
    root = groups(fps, near)
    least = {}
    for i, f in wanted:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    assert found == {(i, f): least.get(root[f]) for i, f in wanted}
    assert simhash.near_components(docs).count() == docs.count()


def test_empty_table(no_docs):
    assert simhash.near_components(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0


def shingles(text, k=5):
    w = (text or "").translate(LOWER).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(r.choice([8, 30, 120, 400]))]
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for at in r.sample(range(len(base)), r.choice([0, 1, 1, 3])):
                copy[at] = word()
            texts.append(copy)
    rows_ = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingles(t) for _, t in rows_]
    near = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = groups(range(len(sets)), near)
    found = {x.doc_id: x.group_id for x in simhash.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert all(want[i] == want[found[i]] for i in found)  # nothing else is joined
    hit = sum(found[a] == found[b] for a, b in near)
    assert hit >= 0.97 * len(near)


def test_large_group_of_edited_copies(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    texts = [base]
    for _ in range(400):
        copy = list(base)
        for at in r.sample(range(len(base)), 3):
            copy[at] = word()
        texts.append(copy)
    rows_ = [(i, " ".join(t)) for i, t in enumerate(texts)]
    alike = {i for i, t in rows_ if len(shingles(t) & shingles(rows_[0][1])) >= 0.8 * len(shingles(t) | shingles(rows_[0][1]))}
    found = {x.doc_id: x.group_id for x in simhash.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert len(alike) > 300 and sum(found[i] == 0 for i in alike) >= 0.99 * len(alike)


def grouped(spark, texts, **how):
    """Groups found and groups of the brute-force comparison."""
    rows_ = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingles(t) for _, t in rows_]
    near = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    found = {x.doc_id: x.group_id for x in simhash.near_duplicates(docs, **how).collect()}
    return found, groups(range(len(sets)), near), near


def test_large_groups_without_an_original(spark):
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = []
    for size in (236,):  # copies of a text that isn't there, some of them alike
        base = [word() for _ in range(size)]
        for _ in range(150):
            copy = list(base)
            for at in r.sample(range(len(base)), 3):
                copy[at] = word()
            texts.append(copy)
    template = [word() for _ in range(172)]
    for _ in range(250):  # a template of which texts keep too little to be alike, and near-copies among them
        own = template + [word() for _ in range(22)]
        copy = list(own)
        for at in r.sample(range(len(template)), 4):
            copy[at] = word()
        texts += [own, copy]
    found, want, near = grouped(spark, texts)
    assert len(near) > 300 and len(set(want.values())) > 200
    assert found == want


def test_pairs_within_a_family_on_one_template(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    shared, texts = [word() for _ in range(300)], []
    for _ in range(60):
        pair = [word() for _ in range(10)]
        texts += [shared + pair + [word() for _ in range(30)] for _ in range(2)]
    found, want, near = grouped(spark, texts, sample=1)
    assert len(near) >= 55 and len(set(want.values())) > 50 and found == want
    found, _, _ = grouped(spark, texts, sample=1, most_common=0)  # without an order by frequency the same is found
    assert found == want


def test_bitmaps_differ_in_no_more_bits_than_sets(spark):
    r = random.Random(13)
    sets = [sorted({r.getrandbits(64) for _ in range(n)}) for n in (1, 30, 33, 40, 400, 410)]
    sets += [sorted({*s[: len(s) - len(s) // 8], *(r.getrandbits(64) for _ in range(len(s) // 9))}) for s in sets]
    size = np.array([len(s) for s in sets])
    flat_ = np.array([x for s in sets for x in s], np.uint64)
    maps = simhash._bitmaps(flat_, np.repeat(np.arange(len(sets)), size), size).to_pylist()
    assert all(len(m) * 64 >= 2 * len(s) for m, s in zip(maps, sets, strict=True))
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if 0.6 < len(sets[i]) / len(sets[j]) < 1.6]
    frame = spark.createDataFrame([(i, j, maps[i], maps[j]) for i, j in pairs], "i int, j int, a array<long>, b array<long>")
    for x in frame.select("i", "j", simhash._turned("a", "b").alias("n")).collect():
        assert x.n <= len(set(sets[x.i]) ^ set(sets[x.j])) and (x.n == 0) == (x.i == x.j or sets[x.i] == sets[x.j])


def test_short_pairs(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = []
    for short, long in [(8, 9), (9, 10), (12, 14), (20, 24), (34, 41)]:
        for _ in range(40):
            text = [word() for _ in range(long)]
            texts += [text[:short], text]
    found, want, near = grouped(spark, texts)
    assert len(near) == 200 and found == want


def test_keep_first(docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted(x.doc_id for x in kept.collect() if x.doc_id is not None)
    assert 9 in ids and 10 not in ids  # equal texts
    assert 12 in ids and 13 not in ids  # equal but for case
    assert ids.count(6) == 1 and 7 not in ids and 8 not in ids  # no words


def test_fingerprints_of_sets():
    texts = ["", "one", "a b c d e f g h", "lorem ipsum " * 9 + "dolor", " ".join(str(i) for i in range(70_000))]
    hashes, text = simhash.flat.shingle_sets(texts, 5)
    size = np.bincount(text, minlength=len(texts))
    want = [simhash._signed(simhash.fingerprint(hashes[text == i])) for i in range(len(texts))]
    assert simhash._majorities(hashes, text, size).tolist() == want


def test_near_duplicates_are_linked_by_fingerprints_first(spark, monkeypatch):
    """What SimHash links isn't compared again, and what it can't reach is found by shingles."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(600)]
    far = [r.choice(words) for _ in range(60)]
    texts = [base, [*base[:-1], "end"], [*base[:300], *base[301:]], far, [*far, *"a b c d e f g h".split()], [r.choice(words) for _ in range(60)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    asked, alike = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda h, b, pairs, *how: asked.append({tuple(p) for p in pairs.collect()}) or alike(h, b, pairs, *how))
    found = {x.doc_id: x.group_id for x in simhash.near_duplicates(docs).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert asked[0] and not asked[0] & asked[1] and asked[1]
