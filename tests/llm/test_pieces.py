import os

import pytest
import sentencepiece

from ledgerlark.llm import pieces
from ledgerlark.llm.queries import MODEL_PATH

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL_PATH), reason="no public model here")
TEXTS = ["", " ", "  a  b ", "<s> </s> <unk> <0x0A>", "\n\n x\ty", "日本語😀 é\u0000", "Hello world", "x" * 5000, "ÀÉ ß  ﬁ", "a▁b", "tab\tand  two"]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(MODEL_PATH)


def test_parity_and_round_trip(model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = pieces.encode_texts(model, TEXTS)
    assert ids == library.encode(TEXTS)
    assert pieces.decode_ids(model, ids) == [library.decode(i) for i in ids]
    for text, back in zip(TEXTS, pieces.decode_ids(model, ids), strict=True):
        assert back == text.replace("▁", " ")
    # the decoder of the tokenizers library says the same
    assert [pieces.tokenizer(model).decode(i, skip_special_tokens=False) for i in ids] == pieces.decode_ids(model, ids)


def test_parity_on_documents(model, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = pieces.encode_texts(model, texts)
    assert ids == library.encode(texts) and pieces.decode_ids(model, ids) == texts


def test_other_ids(model):
    found = pieces.parse(model)
    assert len(found.pieces) == 32000 and found.kind == pieces.BPE and found.byte_fallback
    assert pieces.decode_ids(model, [[1, 2, 0], [3 + 0xFF]]) == [" ⁇ "[1:], "�"]


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3]) if number < 16 else bytes([number << 3 & 127 | 128, number >> 4])
            out += bytes([value])
        else:
            out += bytes([number << 3 | (5 if len(value) == 4 and number == 2 and isinstance(value, bytearray) else 2)])
            out += value if isinstance(value, bytearray) else bytes([len(value)]) + value
    return out


def test_unigram_model():
    import struct

    piece = lambda text, score, kind: _message((1, text.encode()), (2, bytearray(struct.pack("<f", score))), (3, kind))
    vocabulary = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("▁ab", -1.0, 1), ("ab", -1.5, 1), ("▁a", -2.5, 1)]
    data = b"".join(_message((1, piece(*v))) for v in vocabulary) + _message((2, _message((3, 1)))) + _message((3, _message((3, 1), (4, 1), (5, 1))))
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["ab", "a b", "  abab   ba ", "", "b"]
    assert pieces.encode_texts(data, texts) == library.encode(texts)
    assert pieces.decode_ids(data, library.encode(texts)) == [library.decode(i) for i in library.encode(texts)]


def test_frame(docs, no_docs, model):
    found = pieces.encode(docs, model, verify_every=1).collect()
    assert len(found) == docs.count()
    assert all(r.parity and r.decoded == (r.text or "") and r.n_tokens == len(r.ids) for r in found)
    assert pieces.encode(no_docs, model).count() == 0
    with pytest.raises(ValueError):
        pieces.parse(b"\x0f\x01")


def test_every_text_is_verified(spark, model):
    texts = spark.createDataFrame([(i, f"text {i} \u00c0\ufb01  {i * i}") for i in range(50)], "doc_id long, text string")
    assert [r.parity for r in pieces.encode(texts, model).collect()] == [True] * 50


def test_unigram_model_of_real_size(model, spark):
    import math
    import struct

    def number(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)

    field = lambda n, data: number(n << 3 | 2) + number(len(data)) + data
    parsed = pieces.parse(model)
    made, scores = b"", []
    for rank, (piece, _, kind) in enumerate(parsed.pieces):
        score = struct.pack("<f", -math.log(2 + rank) - 0.1 * len(piece) ** 0.5)
        scores.append(struct.unpack("<f", score)[0])
        made += field(1, field(1, piece.encode()) + number(2 << 3 | 5) + score + number(3 << 3) + number(kind))
    made += field(2, number(3 << 3) + b"\x01" + number(35 << 3) + b"\x01")  # a unigram model with byte fallback
    made += b"".join(field(3, value) for n, value in pieces._fields(model) if n == 3)  # the normaliser as it is
    library = sentencepiece.SentencePieceProcessor(model_proto=made)
    plain = [t for t in TEXTS if len(t) < 1000]  # a long run of one letter has many best paths
    texts = plain + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    ids, right = pieces.encode_texts(made, texts), library.encode(texts)
    # of paths of equal score either is right, and of nearly equal ones the library, in single precision, may take the worse
    assert sum(a == b for a, b in zip(ids, right, strict=True)) >= 0.95 * len(texts)
    total = lambda one: math.fsum(scores[i] for i in one)
    assert all(total(a) >= total(b) - 1e-6 for a, b in zip(ids, right, strict=True))
    assert pieces.decode_ids(made, ids) == [library.decode(i) for i in ids]


def test_threads_do_not_follow_the_machine():
    """Each thread of the library keeps memory, and an executor's share doesn't grow with the machine's cores."""
    import subprocess
    import sys

    code = f"""
from ledgerlark.llm import pieces
data = pieces.read_model({MODEL_PATH!r})
count = lambda: int(open('/proc/self/status').read().split('Threads:')[1].split()[0])
pieces.tokenizer(data)
before = count()
pieces.encode_texts(data, ['some words of a text'] * 999)
print(count() - before)
"""
    own = {k: v for k, v in os.environ.items() if k not in ("RAYON_NUM_THREADS", "TOKENIZERS_PARALLELISM", "RAYON_RS_NUM_CPUS")}
    done = subprocess.run([sys.executable, "-c", code], env=own, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))), capture_output=True, text=True, timeout=120)
    assert int(done.stdout) == 2, done.stderr
