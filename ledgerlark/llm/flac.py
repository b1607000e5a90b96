"""Media columns: byte payloads stored as FLAC, read back with checks, and cut into seekable PCM blocks.

The format is the public one: a STREAMINFO block, a SEEKTABLE with a point for every frame, and frames of 576
mono 8-bit samples with constant, verbatim, fixed or linear-predictor subframes and Rice-coded residuals.
Frames don't depend on each other, so many frames of many files are coded at once as rows of arrays; each
step of a loop below does the same bit or sample position of thousands of frames.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear, small_batches

BLOCK = 576  # block size code 2
RATE = 8000
CHUNK = 4096  # frames coded at once, which bounds memory for files of any length
LPC_ORDER, LPC_BITS, LPC_SHIFT = 4, 8, 5


class FlacError(ValueError):
    """The bytes aren't a FLAC file of this kind, or a checksum or count in them is wrong."""


def _crc_table(width: int, poly: int) -> np.ndarray:
    value = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        value = ((value << 1) ^ np.where(value >> (width - 1) & 1, poly, 0)) & ((1 << width) - 1)
    return value


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """The checksums of many spans of ``data``."""
    crc = np.zeros(len(start), np.int64)
    order = np.argsort(-length, kind="stable")
    start, sizes = start[order], -length[order]
    got = np.zeros(len(start), np.int64)
    for j in range(int(length.max(initial=0))):
        n = int(np.searchsorted(sizes, -j, side="left"))  # spans longer than j
        top = (got[:n] >> (width - 8)) ^ data[start[:n] + j]
        got[:n] = ((got[:n] << 8) ^ table[top]) & ((1 << width) - 1)
    crc[order] = got
    return crc


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 of frame headers (up to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail) if len(tail) else 6):
        tail.insert(0, 0x80 | n & 0x3F)
        n >>= 6
        if n < 1 << (6 - len(tail)):
            break
    return bytes([(0xFF << (7 - len(tail)) & 0xFF) | n, *tail])


def _fixed_residuals(x: np.ndarray) -> list[np.ndarray]:
    """Residuals of the fixed predictors of order 0 to 4; the first samples stand in place as warm-up."""
    found, step = [x], x
    for order in range(1, 5):
        step = np.diff(step, axis=1)
        found.append(np.concatenate([x[:, :order], step], axis=1))
    return found


def _predictors(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients of a linear predictor for each row, by autocorrelation and Levinson's recursion."""
    f = x.astype(np.float32)
    r = np.stack([(f[:, k:] * f[:, : BLOCK - k]).sum(axis=1, dtype=np.float64) for k in range(LPC_ORDER + 1)], axis=1)
    a, error = np.zeros((len(x), LPC_ORDER)), np.maximum(r[:, 0], 1e-9)
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -most - 1, most).astype(np.int32)


def _lpc_residuals(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    d, total = x.copy(), np.zeros((len(x), BLOCK - LPC_ORDER), np.int32)
    for j in range(LPC_ORDER):
        total += a[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : BLOCK - 1 - j]
    d[:, LPC_ORDER:] = x[:, LPC_ORDER:] - (total >> LPC_SHIFT)
    return d


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for b in range(width):
        bits[at + b] = value >> (width - 1 - b) & 1


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The coded frames of rows of samples (-128 to 127), and where each begins (and the last ends)."""
    x = x.astype(np.int32)
    n = len(x)
    coefficients = _predictors(x)
    choices = [*_fixed_residuals(x), _lpc_residuals(x, coefficients)]
    orders = np.array([0, 1, 2, 3, 4, LPC_ORDER])
    cost = np.stack([np.abs(d[:, o:]).sum(axis=1) + 4 * o for d, o in zip(choices, orders, strict=True)])
    cost[5] += 12 * LPC_ORDER
    pick = cost.argmin(axis=0)
    residual = np.stack(choices)[pick, np.arange(n)]
    order = orders[pick]
    coded = np.arange(BLOCK)[None, :] >= order[:, None]
    z = np.where(coded, (residual << 1) ^ (residual >> 31), 0)
    count = BLOCK - order
    guess = np.floor(np.log2(np.maximum(z.sum(axis=1) / count, 1.0))).astype(np.int32)
    tries = np.clip(np.stack([guess - 1, guess, guess + 1]), 0, 14)
    rice = np.stack([(z >> t[:, None]).sum(axis=1) + (t + 1) * count for t in tries])
    k = tries[rice.argmin(axis=0), np.arange(n)]
    lpc = pick == 5
    body = 8 + 8 * order + np.where(lpc, 9 + LPC_BITS * LPC_ORDER, 0) + 10 + rice.min(axis=0)
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (body >= 8 + 8 * BLOCK)
    predicted = ~constant & ~verbatim
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * BLOCK, body))

    heads = [b"\xff\xf8\x20\x02" + _number(int(i)) for i in numbers]
    head = np.array([len(h) for h in heads])
    size = head + 1 + -(-body // 8) + 2
    begin = np.concatenate([[0], np.cumsum(size)])
    start = begin[:-1]
    bits = np.zeros(int(begin[-1]) * 8, np.uint8)
    at = (start + head + 1) * 8
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 32 + LPC_ORDER - 1, 8 + order)))
    _put(bits, at, kind << 1, 8)
    at = at + 8
    _put(bits, at[constant], x[constant, 0] & 255, 8)
    for j in range(BLOCK if verbatim.any() else 0):
        _put(bits, at[verbatim] + 8 * j, x[verbatim, j] & 255, 8)
    for j in range(4):
        some = predicted & (order > j)
        _put(bits, at[some] + 8 * j, x[some, j] & 255, 8)
    at = at + 8 * np.where(predicted, order, 0)
    some = predicted & lpc
    _put(bits, at[some], np.full(int(some.sum()), (LPC_BITS - 1) << 5 | LPC_SHIFT), 9)
    for j in range(LPC_ORDER):
        _put(bits, at[some] + 9 + LPC_BITS * j, coefficients[some, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
    at = at + np.where(some, 9 + LPC_BITS * LPC_ORDER, 0)
    _put(bits, at[predicted], k[predicted], 10)  # method 0, one partition, its parameter
    # a residual is quotient zeros, a one and k bits; only what follows the zeros is written
    z, coded, k, at = z[predicted], coded[predicted], k[predicted], at[predicted] + 10
    width = np.where(coded, (z >> k[:, None]) + 1 + k[:, None], 0)
    end = at[:, None] + np.cumsum(width, axis=1)
    bits[(end - k[:, None] - 1)[coded]] = 1
    for b in range(int(k.max(initial=0))):
        some = k > b
        use = coded[some]
        bits[(end[some] - b - 1)[use]] = (z[some] >> b & 1)[use]

    data = np.packbits(bits)
    flat = np.frombuffer(b"".join(heads), np.uint8)
    first = np.cumsum(head) - head
    where = np.arange(len(flat)) + np.repeat(start - first, head)
    data[where] = flat
    data[start + head] = _crc(data, start, head, CRC8, 8)
    crc = _crc(data, start, size - 2, CRC16, 16)
    data[start + size - 2], data[start + size - 1] = crc >> 8, crc & 255
    return data.tobytes(), begin


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file for each payload, whose length must be a positive multiple of 576."""
    counts = [len(p) // BLOCK for p in payloads]
    if any(len(p) % BLOCK or not p for p in payloads):
        raise FlacError("a payload's length must be a positive multiple of 576")
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    parts, sizes = [], []
    for at in range(0, len(samples), CHUNK):
        data, begin = encode_frames(samples[at : at + CHUNK], numbers[at : at + CHUNK])
        parts.append(data)
        sizes.append(np.diff(begin))
    data, sizes = b"".join(parts), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    begin, found, frame = np.concatenate([[0], np.cumsum(sizes)]), [], 0
    for payload, count in zip(payloads, counts, strict=True):
        own = sizes[frame : frame + count]
        points = np.zeros(count, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["n"] = np.arange(count) * BLOCK, BLOCK
        points["offset"] = np.cumsum(own) - own
        table = points.tobytes()
        sound = (np.frombuffer(payload, np.uint8) ^ 128).tobytes()
        info = BLOCK.to_bytes(2) * 2 + int(own.min()).to_bytes(3) + int(own.max()).to_bytes(3)
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8) + hashlib.md5(sound).digest()
        # a block holds 24 bits of length, so longer seek tables are left out and frames found by their headers
        seek = len(table) < 1 << 24
        head = b"fLaC" + (b"\x00" if seek else b"\x80") + len(info).to_bytes(3) + info
        head += b"\x83" + len(table).to_bytes(3) + table if seek else b""
        found.append(head + data[begin[frame] : begin[frame + count]])
        frame += count
    return found


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    lead = data[at]
    if lead < 0x80:
        return lead, 1
    n = 8 - (lead ^ 0xFF).bit_length()
    value = lead & (0x7F >> n)
    for b in data[at + 1 : at + n]:
        value = value << 6 | b & 0x3F
    return value, n


def _scan(data: bytes, at: int, count: int) -> list[int]:
    """Where frames begin: the headers with the next number and a right checksum."""
    begin = []
    while len(begin) < count:
        at = data.find(b"\xff\xf8\x20\x02", at)
        if at < 0:
            raise FlacError("frames are missing")
        n, length = _read_number(data, at + 4)
        head = np.frombuffer(data, np.uint8)[at : at + 5 + length]
        right = len(head) == 5 + length and _crc(head, np.array([0]), np.array([4 + length]), CRC8, 8)[0] == head[-1]
        if right and n == len(begin):
            begin.append(at)
        at += 4
    return begin


def _layout(data: bytes) -> tuple[np.ndarray, bytes]:
    """Where each frame of a file begins (and the last ends), and the digest of its samples."""
    if data[:4] != b"fLaC":
        raise FlacError("not a FLAC file")
    at, last, info, table = 4, False, b"", b""
    while not last:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4])
        last, body = bool(kind & 0x80), data[at + 4 : at + 4 + size]
        info, table = (body if kind & 0x7F == 0 else info), (body if kind & 0x7F == 3 else table)
        at += 4 + size
    packed = int.from_bytes(info[10:18])
    if packed >> 41 & 7 or (packed >> 36 & 31) != 7 or info[:2] != BLOCK.to_bytes(2):
        raise FlacError("only mono 8-bit files with blocks of 576 samples are read")
    count, rest = divmod(packed & ((1 << 36) - 1), BLOCK)
    if rest:
        raise FlacError("the last block isn't whole")
    points = np.frombuffer(table, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
    if len(points) == count:
        begin = points["offset"].astype(np.int64) + at
    else:
        begin = np.array(_scan(data, at, count), np.int64)
    return np.append(begin, len(data)), info[18:34]


def decode_frames(data: np.ndarray, start: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The samples of frames at ``start``; raises if a header, checksum or length is wrong."""
    if (size < 10).any() or (start + size > len(data)).any():
        raise FlacError("a frame is cut off")
    crc = _crc(data, start, size - 2, CRC16, 16)
    if (crc != (data[start + size - 2].astype(np.int64) << 8 | data[start + size - 1])).any():
        raise FlacError("a frame's checksum is wrong")
    heads = [b"\xff\xf8\x20\x02" + _number(int(i)) for i in numbers]
    head = np.array([len(h) for h in heads])
    for h, at in zip(heads, start, strict=True):
        if data[at : at + len(h)].tobytes() != h:
            raise FlacError("a frame's header is wrong")
    if (_crc(data, start, head, CRC8, 8) != data[start + head]).any():
        raise FlacError("a header's checksum is wrong")
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
    word = (padded[:-4] << 24) | (padded[1:-3] << 16) | (padded[2:-2] << 8) | padded[3:-1]

    def field(at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return word[at >> 3] >> (32 - (at & 7) - width) & ((1 << width) - 1)

    def signed(value: np.ndarray, width: int) -> np.ndarray:
        return value - (value >> (width - 1) << width)

    at = (start + head + 1) * 8
    kind = field(at, 8) >> 1
    at = at + 8
    n = len(start)
    x = np.zeros((n, BLOCK), np.int64)
    constant, verbatim, lpc = kind == 0, kind == 1, kind >= 32
    fixed = (kind >= 8) & (kind <= 12)
    if not (constant | verbatim | lpc | fixed).all():
        raise FlacError("a subframe type isn't known")
    x[constant] = signed(field(at[constant], 8), 8)[:, None]
    for j in range(BLOCK if verbatim.any() else 0):
        x[verbatim, j] = signed(field(at[verbatim] + 8 * j, 8), 8)
    order = np.where(lpc, kind - 31, np.where(fixed, kind - 8, 0))
    for j in range(int(order.max(initial=0))):
        some = order > j
        x[some, j] = signed(field(at[some] + 8 * j, 8), 8)
    at = at + 8 * order
    precision, shift = field(at, 4) + 1, field(at + 4, 5)
    at = at + np.where(lpc, 9, 0)
    most = int(order[lpc].max(initial=0))
    a = np.zeros((n, most), np.int64)
    for j in range(most):
        some = np.flatnonzero(lpc & (order > j))
        width = precision[some]
        value = field(at[some] + j * width, width)
        a[some, j] = value - (value >> (width - 1) << width)
    at = at + np.where(lpc, order * precision, 0)

    coded = np.flatnonzero(lpc | fixed)
    if len(coded):
        at, own = at[coded], order[coded]
        if (field(at, 6) != 0).any():
            raise FlacError("only one Rice partition of four-bit parameters is read")
        k = field(at + 6, 4)
        at = at + 10
        bits = np.unpackbits(data)
        ahead = np.where(bits, np.arange(len(bits), dtype=np.int64), len(bits))
        ahead = np.minimum.accumulate(ahead[::-1])[::-1]
        ahead = np.append(ahead, [len(bits)] * 2)
        end = (start + size - 2)[coded] * 8
        d = np.zeros((len(coded), BLOCK), np.int64)
        for j in range(BLOCK):
            use = own <= j
            one = ahead[at]
            z = (one - at) << k | field(np.minimum(one + 1, end), k)
            d[:, j] = np.where(use, (z >> 1) ^ -(z & 1), 0)
            at = np.where(use, np.minimum(one + 1 + k, end), at)
        if (at > end).any() or (end - at >= 8).any():
            raise FlacError("a frame's length is wrong")
        _restore(x, d, coded, own, lpc[coded], a, shift)
    return x


def _restore(x, d, coded, own, is_lpc, a, shift) -> None:
    """Add the predictions to the residuals ``d`` of the rows ``coded`` of ``x``, whose first samples are there."""
    for o in range(5):
        rows = np.flatnonzero((own == o) & ~is_lpc)
        if not len(rows):
            continue
        part, lead = d[rows, o:], x[coded[rows], :o]
        for level in range(o - 1, -1, -1):
            # the last known difference of this order stands before the part
            part = np.diff(lead, n=level, axis=1)[:, -1:] + np.cumsum(part, axis=1)
        x[coded[rows], o:] = part
    rows = np.flatnonzero(is_lpc)
    if len(rows):
        where = coded[rows]
        y, res, c, s, o = x[where], d[rows], a[where], shift[where], own[rows]
        for j in range(BLOCK):
            use = o <= j
            total = np.zeros(len(rows), np.int64)
            for i in range(min(c.shape[1], j)):
                total += c[:, i] * y[:, j - 1 - i]
            y[:, j] = np.where(use, res[:, j] + (total >> s), y[:, j])
        x[where] = y


def decode(files: list[bytes]) -> list[bytes]:
    """The payloads of FLAC files as ``encode`` writes them, after all checks; raises FlacError."""
    layouts = [_layout(f) for f in files]
    shift = np.cumsum([0, *[len(f) for f in files]])
    start = np.concatenate([b[:-1] + s for (b, _), s in zip(layouts, shift, strict=False)]) if files else np.zeros(0)
    size = np.concatenate([np.diff(b) for b, _ in layouts]) if files else np.zeros(0)
    numbers = np.concatenate([np.arange(len(b) - 1) for b, _ in layouts]) if files else np.zeros(0)
    data, parts = np.frombuffer(b"".join(files), np.uint8), []
    for at in range(0, len(start), CHUNK):
        own = slice(at, at + CHUNK)
        low, high = int(start[own][0]), int((start[own] + size[own])[-1])
        x = decode_frames(data[low:high], start[own] - low, size[own], numbers[own])
        parts.append((x + 128).astype(np.uint8).tobytes())
    whole, found, done = b"".join(parts), [], 0
    for begin, digest in layouts:
        payload = whole[done : done + BLOCK * (len(begin) - 1)]
        done += len(payload)
        if hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest() != digest:
            raise FlacError("the digest of the samples is wrong")
        found.append(payload)
    return found


def pad(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)


def feature(payload: bytes) -> str:
    """Whole-number features of the samples: their sum, energy, peak, and changes of sign."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    turns = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"sum={int(x.sum())};energy={int(x @ x)};peak={int(np.abs(x).max())};turns={turns}"


def to_media(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` without ``column``, with n_bytes (of its UTF-8) and media (its padded payload as a FLAC file).

    Null is the empty text, which is one block of padding. Equal texts have equal files. Columns of docs that
    are named as a result are replaced. No rows give no rows.
    """
    docs = clear(docs, "n_bytes", "media")
    others = [c for c in docs.columns if c != column]
    source = docs.select(*others, F.coalesce(F.col(column), F.lit("")).cast("binary").alias("media"))
    schema = source.select(*others, F.lit(0).cast("bigint").alias("n_bytes"), "media").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(len(others)).to_pylist()
            columns = [batch.column(i) for i in range(len(others))]
            columns += [pa.array(map(len, data), pa.int64()), pa.array(encode([pad(d) for d in data]), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    small_batches(docs.sparkSession)
    return source.mapInArrow(run, schema)


def read_back(media: DataFrame) -> DataFrame:
    """``media`` (media and any others) with what its decoded payload holds, in place of the file.

    New columns: payload_bytes, payload_sha256, tail_crc32 (of the last 32 bytes), media_bytes, media_sha256,
    feature and error. A file that is null, damaged or of another kind has null for what is decoded and says
    why in error; the other rows are not affected.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    media = clear(media, *names)
    others = [c for c in media.columns if c != "media"]
    source = media.select(*others, "media")
    whole = [F.lit(0).cast("bigint"), F.lit(""), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), *[F.lit("")] * 3]
    nullable = [F.when(F.rand() < 2, c).alias(n) for c, n in zip(whole, names, strict=True)]
    schema = source.select(*others, *nullable).schema

    def payloads(files: list[bytes]) -> list[tuple[bytes | None, str | None]]:
        try:
            return [(p, None) for p in decode(files)]
        except (FlacError, IndexError, ValueError) as e:
            return [(None, str(e))] if len(files) == 1 else [x for f in files for x in payloads([f])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(len(others)).to_pylist()
            read = iter(payloads([f for f in files if f is not None]))
            rows = []
            for f in files:
                p, error = next(read) if f is not None else (None, "null")
                told = (None,) * 3 if p is None else (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
                own = (None, None) if f is None else (len(f), hashlib.sha256(f).hexdigest())
                rows.append((*told, *own, None if p is None else feature(p), error))
            columns = [batch.column(i) for i in range(len(others))]
            columns += [pa.array([r[i] for r in rows], pa.int64() if i in (0, 2, 3) else pa.string()) for i in range(7)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    small_batches(media.sparkSession)
    return source.mapInArrow(run, schema)


def pcm_blocks(media: DataFrame, key: str) -> DataFrame:
    """A row for each frame of each file: ``key``, first_sample, n_samples and pcm (unsigned 8-bit samples).

    Blocks are independent rows, so a reader seeks by filtering first_sample. A null or damaged file raises.
    """
    source = media.select(key, "media").where(F.col("media").isNotNull())
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                payload = decode([batch.column(1)[i].as_py()])[0]
                at = range(0, len(payload), BLOCK)
                columns = [
                    pa.array([batch.column(0)[i].as_py()] * len(at), batch.column(0).type),
                    pa.array(at, pa.int64()),
                    pa.array([BLOCK] * len(at), pa.int32()),
                    pa.array([payload[a : a + BLOCK] for a in at], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "first_sample", "n_samples", "pcm"])

    small_batches(media.sparkSession)
    return source.mapInArrow(run, f"{key} {kind}, first_sample bigint, n_samples int, pcm binary")
