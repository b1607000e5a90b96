"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is parsed here; from it the normaliser, the metaspace marker, the scores (of a unigram
model, or as merge ranks of a BPE model) and byte fallback are rebuilt as a tokenizers pipeline. The model is
read by the driver alone and travels with the tasks as bytes; a model file is some megabytes at most.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from .common import clear, small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Characters that one call to the library gets, which bounds its memory.
CALL_CHARS = 1 << 19
#: Threads of the library in a process, as each keeps memory of its own; it would start one for each core of the machine.
THREADS = 2


@dataclass
class Model:
    """What the protobuf says. pieces: (piece, score, type) by id."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk: int = 0
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; fixed-width values are bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        elif wire in (1, 2, 5):
            size = varint() if wire == 2 else 8 if wire == 1 else 4
            if at + size > len(data):
                raise ValueError("the model file is cut off")
            at += size
            yield tag >> 3, data[at - size : at]
        else:
            raise ValueError(f"not a protobuf message (wire type {wire})")


def parse(data: bytes) -> Model:
    """The model in a serialised protobuf."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            if kind == UNKNOWN:
                model.unk = len(model.pieces)
            model.pieces.append((piece, score, kind))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind = spec.get(3, UNIGRAM)
            model.suffix_mark = bool(spec.get(24, 0))
            model.byte_fallback = bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.trim, model.escape = (bool(spec.get(i, 1)) for i in (3, 4, 5))
    if not model.pieces:
        raise ValueError("the model has no pieces")
    return model


def _merges(model: Model, vocab: dict[str, int]) -> list[tuple[str, str]]:
    """The pairs that join to a piece, best score first, as the ranks of a BPE model."""
    usable = {p for p, _, kind in model.pieces if kind == NORMAL}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            for i in range(1, len(piece)):
                if piece[:i] in usable and piece[i:] in usable:
                    found.append((-score, vocab[piece[:i]], vocab[piece[i:]], piece[:i], piece[i:]))
    return [pair[3:] for pair in sorted(found)]


def build(model: Model) -> Tokenizer:
    """The tokenizers pipeline of a unigram or BPE model."""
    if model.suffix_mark or model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with the marker before words are supported")
    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unk = model.pieces[model.unk][0]
    if model.kind == UNIGRAM:
        # control, unused and byte pieces must not match text; they keep their ids at a hopeless score
        scores = [(p, s if kind in (NORMAL, USER) else -1e4) for p, s, kind in model.pieces]
        core = models.Unigram(scores, unk_id=model.unk, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE(
            vocab, _merges(model, vocab), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback
        )
    made = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    made.normalizer = normalizers.Sequence(steps)
    ends = [decoders.Replace(MARK, " ")] if model.escape else []
    ends += [decoders.ByteFallback()] if model.byte_fallback else []
    ends += [decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])
    made.decoder = decoders.Sequence(ends)
    own = [AddedToken(p, normalized=True, special=False) for p, _, kind in model.pieces if kind == USER]
    if own:
        made.add_tokens(own)
    return made


@lru_cache(maxsize=2)
def tokenizer(data: bytes) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read when the first texts are coded
    return build(parse(data))


@lru_cache(maxsize=2)
def _library(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def _calls(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CALL_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_texts(data: bytes, texts: list[str]) -> list[list[int]]:
    """The ids of each text; the library codes the texts of a call on several threads."""
    made = tokenizer(data)
    return [e.ids for part in _calls(texts) for e in made.encode_batch_fast(part, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _spelled(data: bytes) -> tuple[list[bytes], bool]:
    """The bytes of each piece in a text, and whether the first space of a text is the model's own."""
    model, found = parse(data), []
    for piece, _, kind in model.pieces:
        if kind == BYTE:
            found.append(bytes([int(piece[3:5], 16)]))
        elif kind == CONTROL:
            found.append(b"")
        else:
            text = " \u2047 " if kind == UNKNOWN else piece
            found.append((text.replace(MARK, " ") if model.escape else text).encode())
    return found, model.dummy_prefix


def decode_ids(data: bytes, ids: list[list[int]]) -> list[str]:
    """The text of each list of ids; bytes that aren't UTF-8 become the replacement character.

    Pieces are joined by a table, at half the time of the pipeline's decoder; ``encode`` compares the result with
    that of the SentencePiece library.
    """
    table, prefixed = _spelled(data)
    whole = [b"".join(map(table.__getitem__, one)) for one in ids]
    return [(w[1:] if prefixed and w[:1] == b" " else w).decode(errors="replace") for w in whole]


def read_model(path: str) -> bytes:
    """The bytes of a model file, read by the driver."""
    with open(path, "rb") as f:
        data = f.read()
    parse(data)
    return data


def encode(docs: DataFrame, model: bytes, verify_every: int = 1) -> DataFrame:
    """``docs`` (text and any others) with ids, n_tokens, decoded and parity.

    ``decoded`` is the text that the ids give back. parity tells whether the SentencePiece library gives the
    same ids and the same text for them; this is verified for every text, or for one in ``verify_every``, by the text's checksum, and null for the others (0: for none). Null text is empty and has no ids. Texts of any length are
    coded whole. Columns of docs named as a result are replaced; no rows give none.
    """
    docs = clear(docs, "ids", "n_tokens", "decoded", "parity")
    names = docs.columns
    added = [F.array().cast("array<int>").alias("ids"), F.lit(0).cast("bigint").alias("n_tokens")]
    added += [F.lit("").alias("decoded"), F.when(F.rand() < 2, F.lit(True)).alias("parity")]
    schema, at = docs.select("*", *added).schema, names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            ids = encode_texts(model, texts)
            same, decoded = [None] * len(texts), decode_ids(model, ids)
            own = [i for i, t in enumerate(texts) if verify_every and zlib.crc32(t.encode()) % verify_every == 0]
            if own:
                library = _library(model)
                for some in _calls([texts[i] for i in own]):
                    part, own = own[: len(some)], own[len(some) :]
                    right = library.encode(some, num_threads=THREADS)
                    for i, r, back in zip(part, right, library.decode(right, num_threads=THREADS), strict=True):
                        same[i] = ids[i] == r and decoded[i] == back
            columns = [batch.column(i) for i in range(len(names))]
            columns += [
                pa.array(ids, pa.list_(pa.int32())),
                pa.array(map(len, ids), pa.int64()),
                pa.array(decoded, pa.string()),
                pa.array(same, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    small_batches(docs.sparkSession, 256)
    return docs.mapInArrow(run, schema)
