"""Byte-level BPE against the tiktoken library, ids and bytes."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import byte_pairs

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    data = byte_pairs.read_ranks(P.path(request.param))
    ranks = {s: i for i, s in enumerate(byte_pairs.parse(data))}
    return data, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def same(both, texts):
    data, library = both
    found = byte_pairs.encode_texts(data, P.PATTERN, texts)
    assert [ids(f) for f in found] == [library.encode_ordinary(t) for t in texts]
    assert byte_pairs.decode_ids(data, found) == [t.encode() for t in texts]


def test_random_texts(both):
    r = random.Random(3)
    alphabet = "ab 'stremvld\n\t  0123é日😀\x00\x1c\x1f\x85\xa0 　ªⅣ²؀"
    same(both, ["".join(r.choice(alphabet) for _ in range(r.randint(0, 90))) for _ in range(4000)])


@settings(max_examples=60, deadline=None)
@given(text=st.text(max_size=200))
def test_any_text(text):
    data = byte_pairs.read_ranks(P.path(FILES[0]))
    ranks = {s: i for i, s in enumerate(byte_pairs.parse(data))}
    same((data, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})), [text])


def test_matches_of_every_length(both):
    same(both, ["a" * n for n in range(140)] + ["ab" * 2500, "zqxj" * 999, "word" * 77, "=" * 5000, " " * 3000 + "x"])


def test_equal_ranks_merge_from_the_left(both):
    data, _ = both
    made = byte_pairs.merger(data)
    for word in (b"aaaaaaa", b"abababa", b"the the the", b"\xff\xfe\xfd" * 9):
        assert made.merge_many([word], 32) == [made.merge_long(word)] == [_slow(made, word)]


def _slow(made, word):
    parts = [bytes([b]) for b in word]
    while True:
        ranks = [made.ids.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
        if not ranks or min(ranks) == 1 << 60:
            return np.array([made.ids[p] for p in parts], "<u4").tobytes()
        i = ranks.index(min(ranks))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_few_kept_words_and_small_holds(both, monkeypatch):
    monkeypatch.setattr(byte_pairs, "KEPT", 5)
    monkeypatch.setattr(byte_pairs, "HELD", 50)
    byte_pairs._kept.cache_clear()
    same(both, ["one two three four five six seven " * 20, "eight nine", "one two", ""])
    byte_pairs._kept.cache_clear()


def test_documents(spark, both, docs, no_docs):
    data, library = both
    coded = byte_pairs.encode(docs, data, P.PATTERN)
    assert coded.columns == [c for c in docs.columns if c != "ids"] + ["ids", "n_tokens", "decoded"]
    rows = coded.collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = library.encode_ordinary(r.text or "")
        assert ids(bytes(r.ids)) == want and r.n_tokens == len(want) and bytes(r.decoded) == (r.text or "").encode()
    again = byte_pairs.decode(coded.select("ids", "text"), data)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again.collect())
    assert byte_pairs.encode(no_docs, data, P.PATTERN).count() == 0
    assert byte_pairs.decode(spark.createDataFrame([(None,)], "ids binary"), data).first().decoded == b""


def test_a_broken_file_is_refused(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="ids"):
        byte_pairs.read_ranks(str(path))
    path.write_bytes(b"YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError, match="single byte"):
        byte_pairs.read_ranks(str(path))


def test_query(spark):
    from ledgerlark.llm.queries import op12_byte_bpe

    rows = op12_byte_bpe(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    import hashlib

    data = byte_pairs.read_ranks(P.path(FILES[0]))
    ranks = {s: i for i, s in enumerate(byte_pairs.parse(data))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows.collect():
        want = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
