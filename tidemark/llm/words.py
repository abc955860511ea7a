"""Vectorised words and word-window hashes over UTF-8 texts.

A word is a maximal run of bytes that a 256-entry table maps to non-zero values. Hashes are
polynomials modulo 2**64 over prefix sums, then mixed; a window's hash is a polynomial over
its words' hashes, so each window costs a few array operations whatever its length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C55 | 1)
_STEP = U(0xD6E8FEB86659FD93)
#: Bytes of one text that are hashed together.
PART = 1 << 18


def inverse(odd: np.uint64) -> np.uint64:
    """The multiplicative inverse of an odd number modulo 2**64."""
    return U(pow(int(odd), -1, 1 << 64))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, U(base))
        out[:1] = U(1)
        return np.cumprod(out, dtype=U)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return _powers(int(base), 1 << max(18, (n - 1).bit_length()))[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def word_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """Byte values: 0 for a separator, else the byte plus one, A-Z lower-cased."""
    out = np.arange(1, 257, dtype=np.uint16)
    if lower:
        out[0x41:0x5B] += 32
    out[np.frombuffer(separators, np.uint8)] = 0
    return out


#: Words of the contamination rule: all but ASCII that is neither digit nor letter.
ALNUM = word_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Words of the shingle rule: all but ASCII white space.
SOLID = word_table(bytes([0x20, *range(0x09, 0x0E)]))


def split_words(text: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one byte array."""
    v = values[text]
    inside = np.zeros(len(v) + 2, np.int8)
    inside[1:-1] = v != 0
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(v) + 1, U)
        np.cumsum(v.astype(U) * powers(_BASE, len(v)), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * powers(inverse(_BASE), len(v) + 1)[starts]
        return starts, ends, mix(raw + (ends - starts).astype(U))


def _parts(data: bytes, values: np.ndarray):
    """Offsets that cut a long text at separators into parts of about PART bytes."""
    at, raw = 0, np.frombuffer(data, np.uint8)
    while len(data) - at > PART:
        end = at + PART
        while end < len(data) and values[raw[end]]:
            end += 1
        yield at, end
        at = end
    yield at, len(data)


def words(texts: list[bytes], values: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts: the joined bytes, starts, ends, hashes, and each text's first word (one entry more than texts)."""
    joined = b" ".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=begin[1:])
    got = [(s + a, e + a, h) for a, b in _parts(joined, values) for s, e, h in [split_words(raw[a:b], values)]]
    starts, ends, hashes = (np.concatenate(x) for x in zip(*got, strict=True))
    return joined, starts, ends, hashes, np.searchsorted(starts, begin)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive words, whatever text they lie in."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, U)
    with np.errstate(over="ignore"):
        out, factor = np.zeros(n, U), U(1)
        for k in range(length):
            out += hashes[k : k + n] * factor
            factor = U(int(factor) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)
        return mix(out + U(length))
