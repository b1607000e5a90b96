"""Hand-made rows for names and for the gates on quotes and names."""

import datetime as dt
import itertools
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.operators import gates, graph, names


def test_evidence_alone_counts(spark):
    turns = spark.createDataFrame(
        [("m", "Thank you, Walker. Mr. Chu? Here."), ("m", "I'm Ann and the mayor spoke. Thank you, everyone"), ("n", "walker walked over to you")], "k string, t string"
    )
    known = spark.createDataFrame([("Stephen Walker",), ("Bo Chu",), ("Ann Li",), ("Ed Fox",)], "name string")
    got = {(r.k, r.name): r.kinds for r in names.evident_speakers(turns, "k", "t", known, "name").collect()}
    assert got == {("m", "Stephen Walker"): ["handoff"], ("m", "Bo Chu"): ["roll call", "title"], ("m", "Ann Li"): ["self"]}


def test_majority_spelling():
    alike = {("Brian Healy", "Bryan Healy"), ("Bryan Healy", "Brian Healy")}
    got = names.majority_spelling([("Brian Healy", 3), ("Bryan Healy", 26), ("Ann Li", 1)], alike)
    assert got == {"Bryan Healy": "Bryan Healy", "Brian Healy": "Bryan Healy", "Ann Li": "Ann Li"}


def typed(r, word):
    """A word with a letter put in, left out or changed, anywhere."""
    i, c = r.randrange(len(word)), r.choice("abcdefgh")
    return r.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]])


@pytest.mark.parametrize("least", [0.82, 0.9])
def test_similar_pairs_against_brute_force(spark, least):
    r = random.Random(5)
    right = {"".join(r.choice("abcdefgh ") for _ in range(r.randint(1, 14))).strip() for _ in range(60)} - {""}
    left = {w for w in right if r.random() < 0.3} | {typed(r, w) for w in right for _ in range(3)} | {typed(r, typed(r, w)) or "x" for w in right if len(w) > 2}
    left -= {""}
    want = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= least}
    a, b = (spark.createDataFrame([(w,) for w in sorted(ws)], f"{n} string") for ws, n in ((left, "l"), (right, "r")))
    assert {(x.l, x.r) for x in names.similar_pairs(a, b, "l", "r", least).collect()} == want and len(want) > 50


def test_majority_spellings_against_brute_force(spark):
    r = random.Random(6)
    base = ["Bryan Healy", "Ann Marie Lind", "Xavier Cole", "harbor lights", "Cora Gray"]
    rows = [w for w in base for _ in range(5)] + [typed(r, w) for w in base for _ in range(6)]
    counts = sorted(Counter(rows).items(), key=lambda c: (-c[1], c[0]))
    want = {}
    for name, _ in counts:
        if name not in want:
            want[name] = name
            for other, _ in counts:
                if other not in want and SequenceMatcher(None, name.lower(), other.lower()).ratio() >= 0.85:
                    want[other] = name
    got = names.majority_spellings(spark.createDataFrame([(w,) for w in rows], "name string"), "name").collect()
    assert {x.name: (x.spelling, x.n) for x in got} == {w: (want[w], n) for w, n in counts}


def test_corrections(spark):
    texts = [(1, "The Xarborside plan of Old-Post Road and Olde Post Road, by Bryan Healey."), (2, "Harborside is fine"), (3, None)]
    docs = spark.createDataFrame(texts, "k int, t string")
    words = spark.createDataFrame([("Harborside",), ("Old Post Road",), ("Bryan Healy",)], "w string")
    found = names.corrections(docs, "k", "t", words, "w")
    got = {(x.wrong, x.right) for x in found.collect()}
    assert got == {("Xarborside", "Harborside"), ("Old-Post Road", "Old Post Road"), ("Olde Post Road", "Old Post Road"), ("Bryan Healey", "Bryan Healy")} - (
        {("Old-Post Road", "Old Post Road"), ("Olde Post Road", "Old Post Road")} - got
    )
    fixed = {x.k: x.t for x in names.corrected_text(docs, "k", "t", found).collect()}
    assert "Harborside plan" in fixed[1] and "Bryan Healy." in fixed[1] and fixed[2] == "Harborside is fine" and fixed[3] is None


def test_labels_without_support(spark):
    day = dt.date
    meetings = spark.createDataFrame(
        [("a", "Board", day(2024, 5, 1), "Present: Li", ""), ("b", "Board", day(2024, 6, 1), "", "Guest Ode"), ("c", "Board", day(2025, 6, 1), None, None)],
        "k string, committee string, date date, minutes string, agenda string",
    )
    labels = spark.createDataFrame([(k, n) for k in "abc" for n in ("Ann Li", "Cy Ode", "Bo Chu", "Dee Fox", "Clerk")], "k string, name string")
    spoken = spark.createDataFrame([("c", "thank you, Mr. Fox!"), ("a", None)], "k string, text string")
    verified = spark.createDataFrame([("bo chu",)], "name string")
    got = {(x.k, x.name): x.kind for x in gates.corroborated_labels(labels, meetings, spoken, verified, "k").collect()}
    bad, unsure = "attendance-mismatch", "unverifiable-name"
    assert got == {("a", "Cy Ode"): bad, ("a", "Bo Chu"): bad, ("a", "Dee Fox"): bad, ("b", "Dee Fox"): unsure, ("c", "Ann Li"): unsure, ("c", "Cy Ode"): unsure}


@given(st.lists(st.integers(1, 400), max_size=9), st.integers(1, 900))
def test_sums_against_brute_force(values, wanted):
    parts = set(values)
    want = any(sum(c) == wanted for n in range(2, 7) for c in itertools.combinations(parts, n))
    assert gates.sums_to([v * 1.0 for v in values], wanted * 1.0) == want


def test_sums():
    assert gates.sums_to([10.25, 5.5, 10.25], 15.75) and not gates.sums_to([5.0, 5.0], 10.0)  # of different values
    assert not gates.sums_to([10.0], 10.0) and not gates.sums_to([], 1.0) and gates.sums_to([3.0, 4.0, None], 7.005)
    assert gates.sums_to([float(2**i) for i in range(24)], float(2**23 + 2**5 + 2))


def test_cooldown_against_a_fold(spark):
    r = random.Random(7)
    rows = [(r.choice("ab"), r.randrange(3), float(r.randrange(400))) for _ in range(200)] + [("a", 0, None)]
    want, last = Counter(), {}
    for k, u, t in sorted(x for x in rows if x[2] is not None):
        ok = (k, u) not in last or t - last[k, u] >= 7
        if ok:
            last[k, u] = t
        want[k, u, t, ok] += 1
    got = gates.suppressed(spark.createDataFrame(rows, "k string, u int, t double"), ["k", "u"], "t", 7.0).collect()
    assert Counter((x.k, x.u, x.t, x.sent) for x in got) == want


def test_corrected_names(spark):
    asked = spark.createDataFrame([("Trustee Jon Smyth",), ("Jane Doe",), ("Zed Q",), ("Nick Nikitopolous",)], "name string")
    right = spark.createDataFrame([("John Smith", True), ("Jane Doe", False), ("John Nikitopoulos", False)], "name string, official boolean")
    got = {r.name: (r.best, r.method) for r in names.corrected_names(asked, right, "name", "official").collect()}
    assert got == {"Jane Doe": ("Jane Doe", "exact"), "Nick Nikitopolous": ("John Nikitopoulos", "last name")} | (
        {"Trustee Jon Smyth": got["Trustee Jon Smyth"]} if "Trustee Jon Smyth" in got else {}
    )


def test_key_terms_priority(spark):
    docs = spark.createDataFrame([(i, i, f"Present: Ann Li{'x' * 3} and Bob Stone, Cora Gray and Cora Gray") for i in range(3)], "k int, d int, t string")
    entities = spark.createDataFrame([("Dora Hill", 5), ("Cora Gray", 9), ("Rare One", 1)], "name string, n int")
    got = [r.term for r in sorted(names.key_terms(["Harbor"], docs, "k", "d", "t", entities, "name", "n").collect(), key=lambda r: r.place)]
    assert got[0] == "Harbor" and got[-1] == "Dora Hill" and got.count("Cora Gray") == 1 and "Rare One" not in got


TURNS = [("m", 0, "Ann Li", 0.0, 10.0, "we should fix the old bridge before the winter comes"), ("m", 1, "Bo Chu", 10.0, 20.0, "I agree with that"), ("m", 2, "Ralph", 200.0, 210.0, "the budget is larger than it was last year by far")]


def test_attribution(spark):
    turns = spark.createDataFrame(TURNS, "k string, n int, speaker string, start double, end double, t string")
    quotes = spark.createDataFrame([("m", "1", 5.0, "Trustee Li"), ("m", "2", 5.0, "Cy Dee"), ("m", "3", 205.0, "Ralph Rossi"), ("m", "4", 900.0, "Cy Dee")], "k string, q string, at double, attrib string")
    near = {r.q: r.ok for r in gates.attributed(quotes, turns, "k", reach=0).collect()}
    assert near == {"1": True, "2": False, "3": None, "4": True}


def test_repaired_times(spark):
    turns = spark.createDataFrame(TURNS, "k string, n int, speaker string, start double, end double, text string")
    quotes = spark.createDataFrame(
        [("m", "a", 300.0, "We should fix the old bridge before winter"), ("m", "b", 205.0, "the budget is larger than it was"), ("m", "c", 1.0, "nothing like this was ever said"), ("m", "d", 0.0, "the budgets are larger than they were last year by far")],
        "k string, q string, at double, quote string",
    )
    got = {r.q: r.fixed for r in gates.repaired_times(quotes, turns, "k").collect()}
    assert got == {"a": 0.0, "b": 205.0, "c": 1.0, "d": 200.0}


def test_quote_at(spark):
    pool = spark.createDataFrame([("m", 5, "I I think it is is fine."), ("m", 9, "Other words")], "k string, at int, text string")
    quotes = spark.createDataFrame([("m", 5, "i think it is fine"), ("m", 9, "these words"), ("m", 7, "x")], "k string, at int, quote string")
    got = {r.at: (r.ok, r.reason) for r in gates.quote_at(quotes, pool, "k").collect()}
    assert got == {5: (True, "match"), 9: (False, "text differs"), 7: (False, "not in pool")}


def test_name_provenance(spark):
    asked = spark.createDataFrame([(1, n) for n in ("Ann Li", "Lisa Shoenholt", "Josh Subin", "Cy Dee", "No One")] + [(2, "Josh Subin")], "m int, name string")
    own = spark.createDataFrame([(1, "Ann Li spoke; Shoenholt, Lisa was there", True), (2, "nobody", False)], "m int, text string, has_minutes boolean")
    labels = spark.createDataFrame([(1, "Josh Subin"), (2, "Josh Subin")], "m int, label string")
    wider = spark.createDataFrame([("the late Cy Dee",), ("",), (None,)], "text string")
    got = {(r.m, r.name): r.verdict for r in gates.name_provenance(asked, own, labels, wider, "m").collect()}
    assert got == {
        (1, "Ann Li"): "own record",
        (1, "Lisa Shoenholt"): "own record",
        (1, "Josh Subin"): "attendance",
        (2, "Josh Subin"): "label",
        (1, "Cy Dee"): "wider source",
        (1, "No One"): "none",
    }


def test_dead_references_and_addresses(spark):
    docs = spark.createDataFrame([(1, "{{photo:9:30:cap}} {{photo:9:31:x}} {{quote:3}} at 12 Old Post Road"), (2, "12 Old Post Road"), (3, None)], "k int, t string")
    there = spark.createDataFrame([("9:30",)], "f string")
    assert [(r.k, r.reference) for r in gates.dead_references(docs, "k", "t", there, "f").collect()] == [(1, "9:31")]
    got = {r.k: r.others for r in gates.shared_addresses(docs, "k", "t").collect()}
    assert got == {1: [2], 2: [1]}


def test_name_merging(spark):
    df = spark.createDataFrame([("Mayor Jo Li",), ("Jo Li",), ("Li",), ("Stone",), ("Ann Stone",), ("Bob Stone",)], "name string")
    got = {r.name: r.canonical for r in graph.canonical_names(df, "name").collect()}
    assert got["Mayor Jo Li"] == got["Jo Li"] == "Jo Li"
    plain = df.where(~F.col("name").startswith("Mayor"))
    assert {r.name: r.canonical for r in graph.single_match(plain, "name").collect()} == {"Li": "Jo Li"}


def test_entity_states_merge(spark):
    rows = spark.createDataFrame([("Old Mill", 1), ("old mill", 2), ("Old Mill", 5), ("Park", 3), ("?!", 4)], "n string, d int")
    whole = {r.slug: tuple(r)[1:] for r in graph.entity_states(rows, "n", "d").collect()}
    assert whole == {"old-mill": ("Old Mill", 3, 1, 5), "park": ("Park", 1, 3, 3)}
    parts = graph.entity_states(rows.where("d > 2"), "n", "d", graph.entity_states(rows.where("d <= 2"), "n", "d"))
    assert {r.slug: (r.n, r.first_seen, r.last_seen) for r in parts.collect()} == {"old-mill": (3, 1, 5), "park": (1, 3, 3)}


@pytest.mark.parametrize("name", ["Chair Ann Li", "Ann Li"])
def test_roles(spark, name):
    df = spark.createDataFrame([(name,)], "n string")
    got = df.select(graph.role_of(F.col("n"), F.lit(None).cast("string")).alias("r")).first().r
    assert got == ("Chair" if name.startswith("Chair") else "Resident")
