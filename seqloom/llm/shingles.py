"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Words of a shingle.
WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes hashed at once; bounds the arrays of powers.
CHUNK = 1 << 19

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_value = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_seeds = np.random.default_rng(7).integers(1, 1 << 63, WORDS, dtype=np.uint64) | U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(b))]), dtype=np.uint64) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word: sums of byte values times powers, modulo 2**64."""
    raw = np.frombuffer(data, np.uint8)
    blank = _space[raw]
    edge = np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _tables(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_value[_lower[raw]] * up, dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    lens = np.array([len(t) + 1 for t in texts])
    word, start = _word_hashes(b" ".join(texts) + b" ")
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(lens)]))
    if len(word) >= WORDS:
        acc = np.zeros(len(word) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            acc += word[k : len(word) - WORDS + 1 + k] * _seeds[k]
        acc = mix(acc)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= WORDS:
            out.append(np.unique(acc[a : b - WORDS + 1]))
        elif n:
            out.append(mix(np.array([(word[a:b] * _seeds[:n]).sum(dtype=np.uint64) + U(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are runs of bytes other than blanks (0x20, 0x09 to 0x0D), A-Z lower-cased.  With fewer than
    five words the whole sequence is the one shingle; without words the set is empty.
    """
    out, held, size = [], [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= CHUNK:
            out += _sets(held)
            held, size = [], 0
    return out + (_sets(held) if held else [])
