import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlark.llm import linear, quality


def sample(n=160, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiounrst") for _ in range(r.randint(2, 7)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randint(20, 80))]
        kind = i % 4
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        elif kind == 3:
            words = [w for w in words[:6] for _ in range(12)]
        rows.append((i, " ".join(words), int(kind in (0, 2))))
    return rows


def test_held_out_accuracy(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").select("doc_id", "text", "score")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.train(docs, labels, F.col("doc_id") % 3 != 1)
    found = {r.doc_id: r for r in quality.quality_scores(docs, model).collect()}
    held = [i for i, _, _ in rows if i % 3 == 1]
    assert np.mean([found[i].predicted == rows[i][2] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())


def test_edge_rows_and_equal_texts(docs, no_docs, spark):
    rows = sample(40)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string, q int"), labels, F.lit(True))
    found = quality.quality_scores(docs, model)
    assert found.count() == docs.count() and dict(found.dtypes)["score"] == "double"
    by_text = {}
    for r in found.collect():
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert quality.quality_scores(no_docs, model).count() == 0


def test_without_labels_of_both_classes(docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.lit(True))
    assert model is None
    assert {r.score for r in quality.quality_scores(docs, model).collect()} == {0.5}
    assert quality.train(docs, labels.limit(0), F.lit(True)) is None


def test_hinge_solver_reaches_the_optimum():
    r = np.random.default_rng(0)
    x, w = r.normal(size=(200, 5)), np.array([1.0, -2, 0.5, 0, 3])
    y = np.where(x @ w + 0.3 + r.normal(scale=0.3, size=200) > 0, 1.0, -1.0)
    found = linear.fit_hinge([(np.arange(5), v) for v in x], y, 5, np.full(200, 1.0), epochs=500)

    def loss(v):
        return 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v[:5] + v[5])).sum()

    for _ in range(200):
        assert loss(found) <= loss(found + r.normal(scale=0.02, size=6)) + 1e-3


def test_indicators_against_their_definition():
    texts = ["Ab ab, AB! 12 ab", "", "x", "one\ttwo  two one"]
    for text, found in zip(texts, quality.indicators(texts), strict=True):
        data = [b + 32 if 65 <= b <= 90 else b for b in text.encode() + b"\n"]
        shapes, before = [], []
        for word in text.split():
            kinds = 0
            for b in word.encode():
                kinds |= 64 if b in b",." else 2 if 65 <= b <= 90 else 4 if 48 <= b <= 57 else 8 if 33 <= b <= 47 else 16 if b in b":;<=>?@[]^_`\\" else 32 if b in b"{|}~" else 1
            low = word.lower()
            for back in (1, 2):
                kinds |= (len(before) >= back and before[-back] == low) << (7 + back)
            shapes.append(kinds)
            before.append(low)
        want = {0}
        for salt, values, most in ((1, data, 4), (5, shapes, 3)):
            for n in range(most):
                for i in range(len(values) - n):
                    gram = 0
                    for v in values[i : i + n + 1]:
                        gram = (gram * 2048 + v + 1) % 2**64
                    want.add((gram * int(quality.flat.BASE) + ((salt + n) << 48)) % 2**64 >> (64 - quality.BITS))
        assert set(found.tolist()) == want


def test_ratios_and_scores_against_their_definition():
    r = np.random.default_rng(3)
    label = np.array([0, 1] * 12)
    grams = [np.unique(np.append(r.choice(40, 8), 50 + y)).astype(np.int32) for y in label]
    model = quality.fit(grams, label)
    counts = [[1 + sum(k in g for g, y in zip(grams, label, strict=True) if y == c) for k in range(60)] for c in (0, 1)]
    whole = [sum(c) + quality.SIZE - 60 for c in counts]
    want = [np.log(counts[1][k] / whole[1]) - np.log(counts[0][k] / whole[0]) for k in range(60)]
    assert np.allclose(model["ratio"][:60], want, atol=1e-5)
    for g, m in zip(grams, quality.margins(iter(grams), model), strict=True):
        v = np.array([want[k] for k in g])
        assert abs(m - (sum(model["weight"][k] * x for k, x in zip(g, v / np.sqrt((v * v).sum()), strict=True)) + model["weight"][-1])) < 1e-4
