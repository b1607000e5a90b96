"""Cases that queries of the library got wrong or couldn't do at size in round 3."""

import hashlib
import os
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import text
from ledgerlark.operators import gates, joins
from ledgerlark.plans import catalog
from ledgerlark.sources import files


@pytest.fixture
def folder(tmp_path):
    """A folder of tables: name -> DataFrame."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_gap_islands_counts_fractions_of_seconds(spark, folder):
    times = [datetime(2024, 1, 1, 0, 0, 0, 900000), datetime(2024, 1, 1, 7, 20, 0, 100000), datetime(2024, 1, 1, 14, 40, 0, 100000)]
    sf = folder(events=_events(spark, [(i, t, 1, "view", 1.0, "{}") for i, t in enumerate(times)]))
    assert sorted((r.island, r.n) for r in catalog.QUERIES["gap_islands"](spark, sf).collect()) == [(1, 2), (2, 1)]


def test_rapid_switch_counts_fractions_of_seconds(spark, folder):
    rows = [(0, datetime(2024, 1, 1, 0, 0, 0, 900000), 1, "view", 1.0, "{}"), (1, datetime(2024, 1, 1, 0, 30, 0, 100000), 1, "click", 1.0, "{}")]
    rows += [(2, datetime(2024, 1, 1, 1, 0, 0, 100000), 1, "view", 1.0, "{}")]
    assert [r.event_id for r in catalog.QUERIES["rapid_switch"](spark, folder(events=_events(spark, rows))).collect()] == [1]


def test_selected_headlines_decodes_whole_references_alone(spark, folder):
    heads = ["Cut off &amp", "Whole &amp; &quot;well&quot;", "Plain &lt;one&gt; &copy"]
    html = [f"<html><body><nav><a href='/x'>x</a></nav><article><h1>{h}</h1><p>text</p></article></body></html>" for h in heads]
    sf = folder(pages=spark.createDataFrame([(i, "http://a.b/c", h) for i, h in enumerate(html)], "page_id long, url string, html string"))
    found = {r.page_id: r.title for r in catalog.QUERIES["selected_headlines"](spark, sf).collect()}
    assert found == {0: "Cut off &amp", 1: 'Whole & "well"', 2: "Plain &lt;one&gt; &copy"}


def test_without_fillers_takes_both_commas(spark, folder):
    part = spark.createDataFrame([(0, "red ring"), (1, "red ring"), (2, "red ring")], "p_partkey long, p_name string")
    found = {r.p_partkey: r.said for r in catalog.QUERIES["without_fillers"](spark, folder(part=part)).collect()}
    assert found == {0: "so it is red ring", 1: "you know when red ring came", 2: "it was fine red ring"}


def test_repaired_times_broadcasts_no_turns(spark, folder):
    said = "alpha bravo charlie delta echoes foxtrot golfing hotel number"
    rows = [(1, i, "user", f"{said} {i}") for i in range(300)] + [(2, 0, "user", None)]
    sf = folder(conversations=spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    found = catalog.QUERIES["repaired_times"](spark, sf)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    # every turn has the words, the earliest wins
    assert {r.q: r.fixed for r in found.where("q in ('1-0', '1-1', '1-7', '2-0')").collect()} == {"1-0": 4.0, "1-1": 0.0, "1-7": 0.0, "2-0": 4.0}


def test_repaired_times_in_blocks(spark):
    from ledgerlark.operators import gates

    turns = spark.createDataFrame([("m", 20.0 * i, f"turn number {i} speaks of alpha{i} and bravo{i} and charlie{i} today") for i in range(40)], "k string, start double, text string")
    quotes = spark.createDataFrame([("m", str(i), 0.0, f"turn number {i} speaks of alpha{i} and bravo{i}") for i in range(40)], "k string, q string, at double, quote string")
    got = {r.q: r.fixed for r in gates.repaired_times(quotes, turns, "k", most=7).collect()}
    assert got == {str(i): 20.0 * i if i > 1 else 0.0 for i in range(40)}


def test_name_provenance_sends_no_wider_text(spark):
    from ledgerlark.operators import gates

    asked = spark.createDataFrame([(1, f"Common N{i}") for i in range(200)], "m int, name string")
    own = spark.createDataFrame([(1, "nobody", True)], "m int, text string, has_minutes boolean")
    labels = spark.createDataFrame([], "m int, label string")
    wider = spark.createDataFrame([(f"common word {i}, then n{i} common",) for i in range(0, 200, 2)], "text string")
    found = gates.name_provenance(asked, own, labels, wider, "m")
    # each text shares a word with each name; neither words nor texts are paired with names
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "xxhash64" not in plan
    assert {r.name: r.verdict for r in found.collect()} == {f"Common N{i}": "none" if i % 2 else "wider source" for i in range(200)}


def test_postings_leave_python_in_small_batches(spark, monkeypatch):
    from ledgerlark.operators import index

    docs = spark.range(1000).selectExpr("id AS doc_id", "concat('licenses of ', id) AS text").coalesce(1)
    taken = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema: taken.append((df, f)))
    index.postings(docs, "doc_id", "text")
    source, count = taken[0]
    sizes = [b.num_rows for b in count(iter(source.toArrow().combine_chunks().to_batches()))]
    # a row for each of three terms and one for the document
    assert sum(sizes) == 4000 and max(sizes) <= 4 * 64


def test_large_paragraph_chunks_takes_small_batches(spark, folder):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    sf = folder(documents=spark.createDataFrame([(1, "One line.\n" * 400)], "doc_id long, text string"))
    assert all(len(r.content) <= 1500 for r in catalog.QUERIES["large_paragraph_chunks"](spark, sf).collect())
    assert int(spark.conf.get(key)) <= 512


def test_similar_pairs_leaves_out_unfitting_lengths(spark):
    from ledgerlark.operators import names

    a = spark.createDataFrame([("word " * 20000,), ("Schtzen",), ("Schutzen",), ("Schützen",)], "x string")
    b = spark.createDataFrame([("Schützen",), ("Schutze",)], "y string")
    found = names.similar_pairs(a, b, "x", "y", 0.9)
    assert {(r.x, r.y) for r in found.collect()} == {("Schtzen", "Schützen"), ("Schutzen", "Schutze"), ("Schützen", "Schützen")}


@pytest.mark.parametrize("few", [0, 64])
def test_sent_in_runs_equals_following_each(few):
    r = np.random.default_rng(4)
    runs = [np.cumsum(r.choice([0.0, 0.3, 0.5, 2.0], n)) for n in r.integers(1, 60, 200)]
    end = np.cumsum([len(x) for x in runs])
    found = gates.sent_in_runs(np.concatenate(runs), np.append(0, end[:-1]), end, 2.0, few)
    assert found.tolist() == np.concatenate([gates.sent_of(x, 2.0) for x in runs]).tolist()


def test_alert_cooldown_follows_runs_over_batches(spark):
    """Keys share batches, whose number doesn't grow with that of the keys, and a run goes on in the next batch."""
    r = np.random.default_rng(5)
    rows = [(k, float(t)) for k in (None, "a", "b") for t in np.cumsum(r.choice([0.0, 0.3, 0.5, 4.0], 300))] + [(f"k{i}", float(i)) for i in range(300)]
    want, last = [], {}
    for k, t in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        sent = k not in last or t - last[k] >= 2.0
        last[k] = t if sent else last[k]
        want.append((k, t, sent))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        found = gates.suppressed(spark.createDataFrame(rows, "k string, t double"), "k", "t", 2.0)
        assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    finally:
        spark.conf.set(size, before)


def test_ids_in_lists_passes_empty_places_by(spark):
    """A place without a number takes no longer than one with a number."""

    def seconds(place: str) -> float:
        began = time.perf_counter()
        lists = spark.range(20_000).select(text.ids_of(F.concat(F.col("id").cast("string"), F.repeat(F.lit(f",{place}"), 200))).alias("ids"))
        assert lists.agg(F.sum(F.size("ids"))).first()[0] >= 20_000
        return time.perf_counter() - began

    seconds("7")
    assert seconds(" ") < 3 * seconds("7") + 1
    odd = spark.createDataFrame([("3, ,3,\t4 , +5,x,6.5,,-1, 99999999999999999999",), (None,), ("",)], "c string")
    assert [r.ids for r in odd.select(text.ids_of(F.col("c")).alias("ids")).collect()] == [[3, 4, 5, -1], [], []]


def test_all_sums_equal_those_of_each_row():
    r = np.random.default_rng(6)
    values = [r.choice([0.5, 1.25, 3.0, 7.0, 7.0, 10.01, -2.0, 19.99, 64.0, np.nan], n) * (1 + r.integers(0, 3)) for n in r.integers(0, 14, 400)]
    values += [None, np.array([2.0**i for i in range(13)]), np.array([1e14, 2e14]), np.array([3.0, 4.0]), np.array([1.0, 2.0])]
    wanted = np.append([r.choice(v) + r.choice(v) + r.choice([0.0, 0.01, 0.02]) if len(v) else 5.0 for v in values[:400]], [5.0, 4097.0, 3e14, np.nan, 3.01])
    want = [v is not None and not np.isnan(w) and gates.sums_to([None if np.isnan(x) else x for x in v], w) for v, w in zip(values, wanted, strict=True)]
    assert gates.all_sums_to(values, wanted).tolist() == want and 50 < sum(want) < 350


def test_figures_that_are_near_are_not_added_up(spark, monkeypatch):
    """Neither do rows of few values go through the sums one by one."""
    calls = []
    monkeypatch.setattr(gates, "sums_to", lambda *a: calls.append(a) or False)
    assert gates.all_sums_to([np.array([1.0, 2.0])] * 3, np.array([3.0, 4.0, np.nan])).tolist() == [True, False, False] and not calls


def test_cooccurrence_counts_pairs_where_they_are_dealt_to(spark):
    """More pairs are dealt to more tasks, and the counts are the same."""
    rows = [(g, m) for g in range(40) for m in range(g % 9)] + [(0, None), (None, 1), (3, 1), (3, 1)]
    bridge = spark.createDataFrame(rows, "g int, m int")
    want = {}
    for g in range(40):
        for a in range(g % 9):
            for b in range(a + 1, g % 9):
                want[a, b] = want.get((a, b), 0) + 1
    for pairs, most, parts in ((1 << 20, 2048, 1), (50, 2048, 6), (50, 3, 6)):
        found = joins.co_occurring(bridge, "g", "m", most, pairs)
        assert {(x.a, x.b): x.n for x in found.collect()} == want
        assert found.rdd.getNumPartitions() >= parts
    assert joins.co_occurring(bridge.limit(0), "g", "m").count() == 0


def test_text_folder_keeps_every_row_in_few_files(spark, folder, monkeypatch):
    said = "\ufeffA text\r\nof \x1d1 more \x1e than \x1d fifty characters, \x1d\x1e and odd ones among them\n"
    rows = [(i, f"{said}{i}") for i in range(40)] + [(3, said), (3, said), (None, said), (50, "x" * 48), (51, "é" * 49), (52, None), (53, "\n" * 49)]
    sf = folder(documents=spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    seen, own = [], files.write_texts
    monkeypatch.setattr(files, "write_texts", lambda df: seen.append(own(df)) or seen[0])
    found = [(r.stem, r.digest) for r in catalog.QUERIES["text_folder"](spark, sf).collect()]
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    wanted = [(None if i is None else f"d{i}", digest(t)) for i, t in rows if t is not None and len(t) >= 49]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    written = [f for _, _, names in os.walk(seen[0]) for f in names if f.endswith(".txt")]
    assert 0 < len(written) <= 3  # a file for each task, not for each text


def test_packed_texts_come_back_as_they_were(spark):
    stems = ["a", "\ufeff", "b\nc", "", "\x1d-", "\x1d2\x1e", None]
    rows = [(s, f"{i}{t}") for i, s in enumerate(stems) for t in ("", "\x1e\x1e", "\x1d0\x1d1\x1d", "\r\n\n", "one\ntwo")] + [("none", None)]
    packed = files.write_texts(spark.createDataFrame(rows, "stem string, text string").repartition(2))
    found = [(r.stem, r.text) for r in files.text_files(spark, packed, least=0, packed=True).collect()]
    assert sorted(found, key=str) == sorted(((s, f"{t or ''}\n") for s, t in rows), key=str)
