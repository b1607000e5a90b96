import random
import re

from ledgerlark.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        windows += [(i, w[s : s + n]) for s in range(len(w) - n + 1)] if n else []
    found = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in windows:
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit |= set(range(p, p + len(x)))
                    ids |= {str(i)} if i is not None else set()
        found.append((d, len(w), len(hit), sorted(ids)))
    return found


def compare(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    i = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(d, i).select("doc_id", "n_words", "n_hit", "item_ids").collect()
    want = brute([x[:2] for x in docs], items)
    assert sorted((tuple(r) for r in found), key=str) == sorted(want, key=str)
    return want


def test_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["the", "of", "a", "to", "x1", "Über", "naïve", "w2", "w3"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 3, 5, 9, 10, 11, 25, 40]))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "..."), (None, say(12)), (103, items[3][1]), (103, items[3][1])]
    docs = [(d, say(60) + " " + r.choice(items[:30])[1].upper() + ", " + say(30), "x") for d in range(40)]
    docs += [(90, None, None), (91, "", None), (None, items[7][1], None), (92, items[5][1], None), (92, items[5][1], None)]
    want = compare(spark, docs, items)
    assert sum(1 for w in want if w[2]) > 20


def test_blocks_of_the_probe_table(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 64)
    text = " ".join(f"w{i}" for i in range(30))
    compare(spark, [(1, "a " + text + " b", None), (2, "other words", None)], [(1, text), (2, "words")])


def test_empty_tables(spark, no_docs, docs):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert decontaminate.contamination(no_docs, items).count() == 0
    found = decontaminate.contamination(docs, items.limit(0))
    assert found.count() == docs.count() and found.where("n_hit > 0").count() == 0


def test_long_item_and_long_document(spark):
    r = random.Random(6)
    item = [f"w{r.randrange(5000)}" for _ in range(20_000)]
    text = " ".join([f"v{i}" for i in range(50_000)] + item[7000:7040] + [f"v{i}" for i in range(50_000)])
    d = spark.createDataFrame([(1, text), (2, " ".join(item[:9]))], "doc_id long, text string")
    i = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    found = {x.doc_id: (x.n_words, x.n_hit) for x in decontaminate.contamination(d, i).collect()}
    assert found == {1: (100_040, 40), 2: (9, 0)}


def test_long_words_and_ties(spark):
    long = "z" * 100_000
    text = " ".join(["same"] * 40)
    compare(spark, [(1, f"{long} one {long}", None), (2, text, None)], [(1, f"{long} one"), (2, " ".join(["same"] * 12))])
