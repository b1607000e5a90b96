import hashlib
import random
import zlib

import pytest

from ledgerlark.llm import flac


def payloads():
    r = random.Random(4)
    walk, x = [], 128
    for _ in range(576 * 5):
        x = min(255, max(0, x + r.randint(-2, 2)))
        walk.append(x)
    whole = [b"", b"a", b"\x00" * 576, r.randbytes(576 * 3), bytes(i % 256 for i in range(1152)), bytes([0, 255] * 576), bytes(walk)]
    return [flac.pad(p) for p in [*whole, ("Étude 日本 " * 5000).encode()]]


def test_round_trip():
    files = flac.encode(payloads())
    assert flac.decode(files) == payloads()
    assert flac.encode(payloads()) == files
    assert len(files[6]) < len(payloads()[6]) * 0.6  # predictors pay
    assert all(f[:4] == b"fLaC" for f in files)


def test_known_checksums():
    import numpy as np

    data = np.frombuffer(b"123456789", np.uint8)
    at, size = np.array([0]), np.array([9])
    assert flac._crc(data, at, size, flac.CRC8, 8)[0] == 0xF4
    assert flac._crc(data, at, size, flac.CRC16, 16)[0] == 0xFEE8


def test_frame_numbers_are_extended_utf8():
    for n in [0, 127, 128, 2047, 2048, 65535, 65536, 1 << 20, 1 << 21, 1 << 26, 1 << 31]:
        coded = flac._number(n)
        assert flac._read_number(coded, 0) == (n, len(coded))
        if n < 0x110000:
            assert coded == chr(n).encode("utf-8", "surrogatepass")


def test_frames_are_found_without_a_seek_table(monkeypatch):
    file = flac.encode([payloads()[3]])[0]
    info = 4 + 4 + 34
    table = 4 + int.from_bytes(file[info + 1 : info + 4])
    bare = file[:4] + b"\x80" + file[5:info] + file[info + table :]
    assert flac.decode([bare]) == [payloads()[3]]


def test_damage_is_noticed():
    file = flac.encode([payloads()[7]])[0]
    for at in (len(file) - 1, len(file) - 200, len(file) // 2, 30, 100):
        bad = bytearray(file)
        bad[at] ^= 16
        try:
            same = flac.decode([bytes(bad)])
        except flac.FlacError:
            continue
        assert same == [payloads()[7]] and at == 100  # a seek point's sample number isn't needed
    with pytest.raises(flac.FlacError):
        flac.decode([b"RIFF"])
    with pytest.raises(flac.FlacError):
        flac.encode([b"short"])


def test_documents(docs, no_docs, spark):
    found = flac.read_back(flac.to_media(docs)).collect()
    assert len(found) == docs.count()
    for r, t in zip(sorted(found, key=str), sorted(docs.collect(), key=str), strict=True):
        assert r.error is None
    by_id = {r.doc_id: r for r in found}
    for row in docs.collect():
        p, r = flac.pad((row.text or "").encode()), by_id[row.doc_id]
        if row.doc_id is not None:
            assert (r.n_bytes, r.payload_bytes) == (len((row.text or "").encode()), len(p))
            assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-32:])
    assert by_id[9].media_sha256 == by_id[10].media_sha256
    assert flac.read_back(flac.to_media(no_docs)).count() == 0


def test_bad_files_do_not_stop_others(spark):
    good = flac.encode([flac.pad(b"x")])[0]
    rows = spark.createDataFrame([(1, good), (2, b"nonsense"), (3, None), (4, good[:-3])], "id int, media binary")
    found = {r.id: r for r in flac.read_back(rows).collect()}
    assert found[1].error is None and found[1].payload_bytes == 576
    assert all(found[i].error and found[i].payload_sha256 is None for i in (2, 3, 4))


def test_seekable_blocks(spark):
    payload = payloads()[4]
    rows = spark.createDataFrame([(1, flac.encode([payload])[0])], "id int, media binary")
    found = flac.pcm_blocks(rows, "id").where("first_sample >= 576").collect()
    assert [(r.first_sample, r.n_samples, bytes(r.pcm)) for r in found] == [(576, 576, payload[576:])]
