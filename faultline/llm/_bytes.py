"""Words and n-grams of many texts at once, by numpy over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_tables.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _tables[name] = np.multiply.accumulate(row)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, in time that does not
    depend on the spans' lengths (polynomial prefix sums)."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw ^ mix((ends - starts).astype(np.uint64) + _U(seed * 0x632BE59B + 1)))


def separators(split: bytes) -> np.ndarray:
    """Byte to symbol: 0 separates words. (NUL takes 0xFF, which UTF-8 never has.)"""
    lut = np.arange(256, dtype=np.uint8)
    lut[0] = 255
    lut[list(split)] = 0
    return lut


def letters() -> np.ndarray:
    """Byte to symbol for lower-cased runs of letters, digits and non-ASCII bytes."""
    lut = np.zeros(256, np.uint8)
    for ranged in (range(48, 58), range(97, 123), range(128, 256)):
        lut[list(ranged)] = list(ranged)
    lut[65:91] = lut[97:123]
    return lut


#: [\x20\x09-\x0D]
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
BY_SPACE = separators(SPACES)
#: Bytes that are hashed at once.
BLOCK = 1 << 20
BY_LETTERS = letters()
#: Bytes of a word from which on it is hashed by itself.
LONG = 64


class Words(NamedTuple):
    symbols: np.ndarray  #: a symbol per byte of the joined texts
    starts: np.ndarray  #: byte offsets of the words
    ends: np.ndarray
    first: np.ndarray  #: of each text its first word, and the number of words at the end

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash of each word; block by block, so a long text needs little beside itself."""
        out, i = np.empty(len(self.starts), np.uint64), 0
        while i < len(out):
            first = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.starts, first + BLOCK)))
            out[i:j] = span_hashes(self.symbols[first: self.ends[j - 1]], self.starts[i:j] - first, self.ends[i:j] - first, seed)
            i = j
        return out

    def mixed_hashes(self, seed: int = 0) -> np.ndarray:
        """A hash of each word that no arithmetic of its letters predicts: eight bytes
        at a time are mixed into the state (words of up to eight bytes never meet
        others of their length); long words by xxh3."""
        import xxhash

        size = self.ends - self.starts
        h = mix(size.astype(np.uint64) * _BASE + mix(np.array([seed + 1], np.uint64)))
        padded = np.concatenate([self.symbols, np.zeros(8, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, 8)
        short = np.flatnonzero(size <= LONG)
        for at in range(0, LONG, 8):
            short = short[size[short] > at]
            for a in range(0, len(short), BLOCK >> 3):
                i = short[a: a + (BLOCK >> 3)]
                block = view[self.starts[i] + at].view("<u8").ravel()
                left = np.minimum(size[i] - at, 8).astype(np.uint64)
                block = block & (~_U(0) >> ((_U(8) - left) * _U(8)))
                h[i] = mix(h[i] ^ block)
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.symbols[self.starts[i]: self.ends[i]].tobytes(), seed)
        return h

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: list[bytes], lut: np.ndarray = BY_SPACE) -> Words:
    joined = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    symbols = lut[joined]
    inside = symbols != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=offsets[1:])
    return Words(symbols, starts, ends, np.searchsorted(starts, offsets + 1))


def gram_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive words, across text borders too."""
    at = np.arange(max(0, len(hashes) - n + 1))
    return span_hashes(hashes, at, at + n, seed)


def pieces(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Lists of texts of about ``size`` bytes together, and the place of each in
    ``texts``; a longer text comes as several pieces, cut at a space."""
    some: list[bytes] = []
    of: list[int] = []
    total = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            end = len(text) if len(text) - at <= size else text.find(b" ", at + size)
            end = len(text) if end < 0 else end
            some.append(text[at:end])
            of.append(i)
            total += end - at
            at = max(end, 1)
            if total >= size:
                yield some, np.array(of)
                some, of, total = [], [], 0
    if some:
        yield some, np.array(of)
