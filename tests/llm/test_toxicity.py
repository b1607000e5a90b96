import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlark.llm import toxicity

INSULTS = ["blarghead", "snotwaffle", "crumbface", "dunderpuff"]


def sample(n=200, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiou") + r.choice("lmnrst") for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(60)]
        if i % 3 == 0:
            for _ in range(3):
                words.insert(r.randrange(60), r.choice(INSULTS))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def brute_vector(w):
    """The weights of a word's subsequences from their definition, at unit length."""
    s, found = [0, *w, 0], {}
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, min(len(s), i + 6)):
                if j - i <= 4:
                    found[s[i], s[j], s[k]] = found.get((s[i], s[j], s[k]), 0) + toxicity.DECAY ** (k - i - 2)
    size = sum(v * v for v in found.values()) ** 0.5
    return {k: v / size for k, v in found.items()}


def brute_kernel(a, b):
    y = brute_vector(b)
    return sum(v * y.get(k, 0) for k, v in brute_vector(a).items())


WORDS = [w.encode() for w in ("idiot", "idxiot", "moron", "aaaaaaa", "abababab", "clean", "x", "an", "clown")]


def listed():
    return toxicity.Listed([bytes(c - 96 for c in w) for w in WORDS])


def test_subsequence_kernel():
    spelled, found = listed(), {}
    for part, row, key, value in toxicity.vectors(spelled, np.arange(len(WORDS))):
        for r, k, v in zip(part[row], key, value, strict=True):
            found.setdefault(r, {})[int(k)] = v
    for i in range(len(WORDS)):
        for j in range(len(WORDS)):
            kernel = sum(v * found[j].get(k, 0) for k, v in found[i].items())
            assert abs(kernel - brute_kernel(spelled.spelling(i), spelled.spelling(j))) < 1e-9


def test_values_are_the_machine_on_the_landmarks_kernels():
    spelled, marks = listed(), np.array([0, 2, 3, 5])
    landmarks = toxicity.Landmarks(spelled, marks)
    w = np.random.default_rng(0).normal(size=landmarks.root.shape[1])
    kernels = np.array([[brute_kernel(spelled.spelling(i), spelled.spelling(m)) for m in marks] for i in range(len(WORDS))])
    wanted = kernels @ landmarks.root @ w
    assert np.allclose(landmarks.features(spelled, np.arange(len(WORDS))) @ w, wanted, atol=1e-5)
    weight = toxicity._dense(landmarks.keys, landmarks.weights(w))
    assert np.allclose(toxicity.word_values(spelled, np.arange(len(WORDS)), weight), wanted, atol=1e-5)


def test_words_and_sentences():
    spelled = toxicity.Spelled(["  You clown. Moved on!\np.l-a*n", "", " \n", "a b c Ёж ёж"])
    words = [spelled.spelling(i) for i in range(len(spelled.start))]
    letters = lambda w: bytes(ord(c) - 96 for c in w)
    assert words[:5] == [letters(w) for w in ("you", "clown", "moved", "on", "plan")]
    assert words[5] == letters("abc") and words[6] == words[7] and len(set(words[6])) == 2
    assert list(spelled.sentence) == [0, 0, 1, 1, 2, 3, 3, 3] and list(spelled.text) == [0] * 5 + [3] * 3
    first, kind = spelled.distinct()
    assert [words[i] for i in first[kind]] == words
    alphabets = ["абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "abcdefghijklmnopqrstuvwxyzäöüßéèêçñ"]
    for a in alphabets:  # letters of one alphabet stay apart
        assert len({toxicity._symbol(ord(c)) for c in a}) == len(a)


def test_held_out_accuracy_and_obfuscation(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string, t int")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 5 != 0)
    found = {r.doc_id: r for r in toxicity.toxicity_scores(docs, model).collect()}
    held = [i for i, _, _ in rows if i % 5 == 0]
    assert np.mean([found[i].predicted == rows[i][2] for i in held]) >= 0.95
    clean = rows[1][1]
    hidden = ["s-n-o-t-w-a-f-f-l-e", "crumb.face", "blarrghead", "dunderxpuff", "s n o t w a f f l e"]
    base = toxicity.text_scores([clean], model)[0]
    scores = toxicity.text_scores([" ".join([clean, *[h] * 3]) for h in hidden], model)
    assert (scores > max(0.5, base)).all(), scores


def test_edge_rows(docs, no_docs, spark):
    rows = sample(40)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, t int"), labels, F.lit(True))
    found = toxicity.toxicity_scores(docs, model)
    assert found.count() == docs.count()
    by_text = {}
    for r in found.collect():
        assert 0 <= r.score <= 1
        by_text.setdefault(r.text or "", set()).add(round(r.score, 12))
    assert all(len(s) == 1 for s in by_text.values())
    assert toxicity.toxicity_scores(no_docs, model).count() == 0
    texts = [r.text or "" for r in docs.collect()] + ["  a text ", " "]
    together = toxicity.text_scores(texts, model)
    assert np.allclose(together, [toxicity.text_scores([t], model)[0] for t in texts])  # a text's neighbours don't matter
    none = toxicity.fit(["", " "], np.array([0, 1]))
    assert (toxicity.text_scores(["", "word"], none) <= 0.5).all()
    assert toxicity.train(docs, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in toxicity.toxicity_scores(docs, None).collect()} == {0.0}
