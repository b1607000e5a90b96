import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import ngram_lm

from .conftest import rows


def brute(texts, trains, order=2):
    tokens = [(t or "").encode().lower().split() + [None] for _, t in texts]
    counts = [Counter() for _ in range(order + 1)]
    for (i, _), t in zip(texts, tokens, strict=True):
        if trains(i):
            whole = [b"<", *t]
            counts[1].update((w,) for w in t)
            for n in range(2, order + 1):
                counts[n].update(tuple(whole[k : k + n]) for k in range(len(whole) - n + 1))
    n, v = sum(counts[1].values()), len(counts[1])
    exponents, discounts = {}, {}
    for k in range(2, order + 1):
        sizes = np.array(list(counts[k - 1].values()), float)
        exponents[k] = float(np.interp(len(counts[k]), [(sizes**e).sum() for e in ngram_lm.EXPONENTS], ngram_lm.EXPONENTS))
        once, twice = (sum(c == j for c in counts[k].values()) for j in (1, 2))
        discounts[k] = min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5

    def p(h, w):
        if not h:
            return (counts[1][w,] + 1) / (n + v + 1)
        k = len(h) + 1
        seen = counts[1][None,] if h == (b"<",) else counts[k - 1][h]
        if not seen:
            return p(h[1:], w)
        share = discounts[k] * seen ** (exponents[k] - 1)
        return (1 - share) * counts[k][(*h, w)] / seen + share * p(h[1:], w)

    found = []
    for (i, _), t in zip(texts, tokens, strict=True):
        base = sum(math.log10((counts[1][w,] + 1) / (n + v + 1)) for w in t)
        whole = [b"<", *t]
        score = sum(math.log10(p(tuple(whole[max(0, k - order + 1) : k]), whole[k])) for k in range(1, len(whole)))
        found.append((i, not trains(i), len(t), sum((w,) in counts[1] for w in t), n, round(base, 5), round(score, 5)))
    return found


def run(docs, trains, **how):
    found = ngram_lm.score(docs, trains, **how).collect()
    return sorted(((*r[:5], round(r.base_score, 5), round(r.score, 5)) for r in found), key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force_at_any_numbers_of_blocks_and_shards(docs, order):
    texts = [(r[0], r[1]) for r in rows()]
    trains = lambda i: i is not None and i % 3 != 0
    want = sorted(brute(texts, trains, order), key=str)
    for block, shard in ((1 << 30, 1 << 30), (200_000, 1 << 30), (300_000, 90_000)):
        assert run(docs, F.col("doc_id") % 3 != 0, order=order, block_bytes=block, shard_bytes=shard) == want


def local(texts, n_train, order, shards=3, blocks=1, scale=1):
    """The automaton over some texts and their tokens, from messages made and answered here."""
    sent = []
    for b in range(blocks):
        table = pa.table({"text": texts, "trains": [i < n_train for i in range(len(texts))], "block": [b] * len(texts)})
        sent += ngram_lm._send(table, shards, order).to_pylist()
    for row in sent:
        row["counts"] = [ngram_lm._packed(ngram_lm._unpacked(c, n) * np.uint64(scale)) for c, n in zip(row["counts"], row["sizes"], strict=True)]
    schema = ngram_lm._schema(ngram_lm.SENT)
    answers = [
        r
        for s in sorted({x["shard"] for x in sent})
        for r in ngram_lm._answer(pa.Table.from_pylist([x for x in sent if x["shard"] == s], schema)).to_pylist()
    ]
    t = ngram_lm.tokens(texts, order)
    own = sorted((r for r in answers if r["block"] == 0), key=lambda r: r["shard"])
    counts = [np.concatenate([ngram_lm._unpacked(r["counts"][k], r["sizes"][k]) for r in own]) for k in range(order)]
    return t, counts, answers


def test_probabilities_of_a_context_add_up(spark):
    texts = ["a b c a b d", "b a c c", "a a b", "a b", "d"]
    words = ["a", "b", "c", "d"]
    for order, heads in ((2, words), (3, ["a b", "b c", "a a", "c d"])):
        probes = [f"{h} {w}".strip() for h in heads for w in [*words, "unseen", ""]]
        t, counts, answers = local(texts + probes, len(texts), order)
        frame = spark.createDataFrame([(r["told"],) for r in answers if r["told"]], f"told {ngram_lm.TOLD}")
        known = ngram_lm.Statistics.of([r.asDict() for r in ngram_lm.totals(frame).first().known])
        weight = 10 ** ngram_lm.Automaton.build(t, counts, known).traverse(t)
        length = len(heads[0].split())
        for k in range(len(heads)):
            own = [weight[t.text == len(texts) + k * 6 + j][length] for j in range(6)]
            assert abs(sum(own) - 1.0) < 1e-9 and min(own) > 0


def test_counts_beyond_32_bits_and_messages():
    texts = ["a b a b", "c", ""]
    _, counts, answers = local(texts, 3, 2, shards=50, blocks=4, scale=3_000_000_000)
    words = ngram_lm.tokens(texts).grams[0]
    assert sorted(counts[0]) == [12_000_000_000 * k for k in (1, 2, 2, 3)] and len(words.keys) == 4
    assert sum(r["told"][0]["tokens"] for r in answers if r["told"]) == 8 * 12_000_000_000
    kinds = len(words.keys) + len(ngram_lm.tokens(texts).grams[1].keys)
    assert len(answers) <= 4 * kinds  # none for an empty shard
    numbers = np.array([0, 1, 255, 256, 1 << 40, (1 << 64) - 1], np.uint64)
    for part in (numbers, numbers[:3], numbers[:0]):
        assert (ngram_lm._unpacked(ngram_lm._packed(part), len(part)) == part).all()


def test_nothing_to_learn_or_score(docs, no_docs):
    assert ngram_lm.score(no_docs, F.lit(True)).count() == 0
    found = ngram_lm.score(docs, F.lit(False)).collect()
    assert len(found) == docs.count()
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in found} == {(0, 0, 0.0, 0.0)}
