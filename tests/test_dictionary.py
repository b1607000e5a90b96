"""Dictionaries on texts against plain string functions."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.operators import dictionary


def plain(text, pairs):
    seen = set()
    for old, new in pairs:
        if old and old not in seen:
            seen.add(old)
            text = text.replace(old, new)
    return text


def own(text, pairs):
    first = {}
    for old, new in pairs:
        if old:
            first.setdefault(old, new)
    if not first:
        return text
    return dictionary.replace_in_order(text, tuple(first.items()), dictionary.automaton(tuple(first)), max(map(len, first)))


@settings(max_examples=400, deadline=None)
@given(text=st.text("abc ", max_size=40), pairs=st.lists(st.tuples(st.text("abc ", max_size=4), st.text("abc ", max_size=3)), max_size=8))
def test_equals_replace_in_order(text, pairs):
    assert own(text, pairs) == plain(text, pairs)


@pytest.mark.parametrize(
    "text,pairs,want",
    [
        ("abcd", [("abc", "x"), ("bcd", "y"), ("xd", "z")], "z"),  # overlapping, and made by a replacement
        ("aaaa", [("aa", "a")], "aa"),
        ("new york", [("york", "jersey"), ("new jersey", "nj"), ("nj", "NJ")], "NJ"),
        ("ab", [("b", ""), ("ab", "no"), ("a", "yes")], "yes"),
        ("éè", [("é", "e"), ("eè", "ee")], "ee"),
    ],
)
def test_examples(text, pairs, want):
    assert own(text, pairs) == plain(text, pairs) == want


def test_time_follows_the_text_not_the_dictionary():
    pairs = [(f"entry number {i}", f"e{i}") for i in range(20_000)]
    text = "some words of no entry at all, entry number 77 among them. " * 20_000
    dictionary.automaton(tuple(a for a, _ in pairs))
    began = time.process_time()
    assert own(text, pairs) == text.replace("entry number 77", "e77").replace("entry number 7", "e7")
    assert time.process_time() - began < 10


def rows(seed):
    r = random.Random(seed)
    words = ["Ann", "Lee", "Bo", "annual", "town", "hall", "O'Neil", "é"]
    for i in range(80):
        yield i, r.choice(["Ann Lee", "Chair Bo", None, "x"]), " ".join(r.choice(words) for _ in range(r.randint(0, 12))) or None


NAMES = ["Ann Lee", "ann", "Town Hall", "O'Neil", "Bo", "", "Lee Bo town", "Chair Bo"]


@pytest.mark.parametrize("block_bytes", [1, 100, 1 << 20])
def test_held_in_blocks_of_any_size(spark, block_bytes):
    docs = spark.createDataFrame(list(rows(1)), "k int, s string, t string")
    names = spark.createDataFrame([(n,) for n in NAMES] + [(None,), ("Bo",)], "n string")
    found = dictionary.held(docs, docs.t, names, "n", block_bytes)
    want = {(k, n) for k, _, t in rows(1) for n in NAMES if n and t and n in t}
    got = [(r.k, r["__entry"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_mentions_are_whole_words(spark):
    docs = spark.createDataFrame(list(rows(2)), "k int, s string, t string")
    names = spark.createDataFrame([(n,) for n in NAMES], "n string")
    flat = lambda x: f" {' '.join(x.lower().replace(chr(39), ' ').split())} "
    want = {(k, n) for k, _, t in rows(2) for n in NAMES if n and t and flat(n) in flat(t)}
    assert {tuple(r) for r in dictionary.mentions(docs, names, "k", "t", "n").collect()} == want


def test_who_spoke_is_not_mentioned(spark):
    docs = spark.createDataFrame(list(rows(3)), "k int, s string, t string")
    names = spark.createDataFrame([(n,) for n in NAMES], "n string")
    want = set()
    for k, s, t in rows(3):
        for n in NAMES:
            if len(n) >= 6:
                if s and n.lower() in s.lower():
                    want.add((k, n, "spoke"))
                elif t and n.lower() in t.lower():
                    want.add((k, n, "mentioned"))
    assert {tuple(r) for r in dictionary.linked(docs, names, "k", "s", "t", "n").collect()} == want
    assert {w[2] for w in want} == {"spoke", "mentioned"}


def test_columns_and_empty(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    assert [r[0] for r in df.select(dictionary.replaced(df.t, [("a", "b"), ("b b", "c"), ("a", "no")])).collect()] == ["c", None]
    assert [r[0] for r in df.select(dictionary.replaced(df.t, [])).collect()] == ["a b", None]
    none = spark.createDataFrame([], "n string")
    assert dictionary.mentions(df.withColumn("k", df.t), none, "k", "t", "n").count() == 0
