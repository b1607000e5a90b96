"""Words of a batch of texts as flat numpy arrays, for operators that run inside Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BYTES = np.arange(256)
IS_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
LOWERED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_RANDOM = np.random.default_rng(20240229)
BYTE_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    raw: np.ndarray  # all bytes, a line feed after each text
    text_at: np.ndarray  # where each text begins, and the end
    start: np.ndarray  # of each word
    length: np.ndarray
    text: np.ndarray  # number of the text of each word

    @property
    def inner(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all bytes inside words, and where each word begins among them."""
        first = np.cumsum(self.length) - self.length
        shift = np.repeat(self.start - first, self.length)
        return np.arange(len(shift)) + shift, first

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, A-Z lower-cased."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        at, first = self.inner
        power = np.cumprod(np.full(int(self.length.max()), BASE))
        value = BYTE_VALUE[LOWERED[self.raw[at]]] * power[at - np.repeat(self.start, self.length)]
        return mix(np.add.reduceat(value, first))


def words(texts: list[str]) -> Words:
    """The words (runs without ASCII white space) of ``texts``."""
    coded = [t.encode() for t in texts]
    sizes = np.array([len(c) + 1 for c in coded], np.int64)
    text_at = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    inside = ~IS_SPACE[raw]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8)]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(raw, text_at, start, end - start, np.searchsorted(text_at, start, side="right") - 1)


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``k``-word shingles of each text as 64-bit hashes, sorted by text and hash, and the text of each.

    A text of fewer words is one shingle; one without words has the shingle 0 alone.
    """
    w = words(texts)
    n = np.bincount(w.text, minlength=len(texts))
    end = np.cumsum(n)
    if len(w.start):
        hashes = np.append(w.hashes(), np.zeros(k, np.uint64))
        place, last = np.arange(len(w.start)), end[w.text]
        value = np.zeros(len(place), np.uint64)
        for i, power in enumerate(np.cumprod(np.full(k, BASE))):
            value += np.where(place + i < last, hashes[i : i + len(place)] * power, np.uint64(0))
        whole = (place + k <= last) | (place == (end - n)[w.text])
        value, text = mix(value[whole]), w.text[whole]
    else:
        value, text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    none = np.flatnonzero(n == 0)
    value, text = np.append(value, np.zeros(len(none), np.uint64)), np.append(text, none)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.append(True, (value[1:] != value[:-1]) | (text[1:] != text[:-1]))[: len(value)]
    return value[new], text[new]
