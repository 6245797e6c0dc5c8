"""Words and rolling hashes over whole batches of UTF-8 texts, with numpy.

A batch is one byte buffer in which texts are separated by one blank. Rolling hashes of bytes come
from prefix sums modulo 2^64: the hash of a slice is the difference of two prefix sums, brought
back to position 0 with the inverse power, so equal slices have equal hashes anywhere.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])


def translation(separators: bytes, lower: bool) -> bytes:
    """A table for bytes.translate: separators become blanks, A-Z become a-z if asked."""
    out = bytearray(range(256))
    if lower:
        out[0x41:0x5B] = bytes(range(0x61, 0x7B))
    for b in separators:
        out[b] = 0x20
    return bytes(out)


AS_IS = translation(_SEPARATORS, lower=False)
LOWERED = translation(_SEPARATORS, lower=True)


def raw(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        p = np.full(size + 1, b, dtype=U)
        p[0] = 1
        return np.multiply.accumulate(p)

    return run(base), run(pow(base, -1, 1 << 64))


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to size at least (base is odd)."""
    return _powers(base, 1 << max(16, int(size).bit_length()))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D


def prefix_sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(base, len(values))
    sums = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


class Words:
    """Words of a list of texts: how many each has, and the hash of each; places in the text if asked.

    A word's hash is a sum of pseudo-random numbers, one for each of its bytes and that byte's place
    in the word, so no arrangement of bytes cancels out as in a polynomial modulo 2^64. Texts are
    read a slice of about `batch` bytes at a time, long ones in several slices cut between words:
    what stays is 8 bytes a word (24 with places).
    """

    def __init__(self, texts: list[bytes], table: bytes, hashes: bool = True, places: bool = False, batch: int = 1 << 20, seed: int = 0):
        counts, hashed, starts, ends = np.zeros(len(texts), dtype=np.int64), [], [], []
        for owner, offset, sizes, buf in _slices(texts, table, batch):
            word = buf != 0x20
            edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
            begin, end = edge[0::2], edge[1::2]
            base = np.concatenate(([0], np.cumsum(sizes + 1)))
            own = np.searchsorted(base, begin, side="right") - 1
            counts[owner : owner + len(sizes)] += np.bincount(own, minlength=len(sizes))
            if hashes:
                hashed.append(_word_hashes(buf[word], end - begin, seed))
            if places:
                starts.append(begin - base[own] + offset)
                ends.append(end - base[own] + offset)
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        self.starts, self.ends, self.hash = cat(starts, np.int64), cat(ends, np.int64), cat(hashed, U)
        self.count, self.first = counts, np.concatenate(([0], np.cumsum(counts)))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def runs(self, starts: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
        """Hashes of the runs of `width` words from the given starts on, as windows has them."""
        return mix(sum((self.hash[starts + k] * U(pow(base, k, 1 << 64)) for k in range(width)), np.zeros(len(starts), dtype=U)))

    def windows(self, width: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every run of `width` words inside one text; start counts words of the batch.

        The hash is the polynomial of the words' hashes modulo 2^64, by doubling: a run of 2k words is a run of k and the next one.
        """
        n = len(self.hash)
        if n < width:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
        whole = np.ones(n - width + 1, dtype=bool)  # starts with `width` words of their own text behind them
        for end in self.first[1:-1].tolist():
            whole[max(0, end - width + 1) : end] = False
        starts = np.flatnonzero(whole)
        run, size, out, done = self.hash, 1, None, 0
        while True:
            if width & size:
                out, done = (run, size) if out is None else (out[: n - done - size + 1] + run[done : n - size + 1] * U(pow(base, done, 1 << 64)), done + size)
            if 2 * size > width:
                return starts, mix(out[starts])
            run = run[: n - 2 * size + 1] + run[size:] * U(pow(base, size, 1 << 64))
            size *= 2


def _slices(texts: list[bytes], table: bytes, batch: int):
    """(number of the first text, offset in it, sizes, bytes with one blank behind each): several short texts, or a piece of a long one."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > batch:
            whole, begin = texts[at].translate(table), 0
            while begin < len(whole):
                end = whole.find(b" ", begin + batch)
                end = len(whole) if end < 0 else end
                yield at, begin, np.array([end - begin]), np.frombuffer(whole[begin:end] + b" ", dtype=np.uint8)
                begin = end
            at += 1
            continue
        upto, size = at, 0
        while upto < len(texts) and len(texts[upto]) <= batch and (upto == at or size + len(texts[upto]) < batch):
            size += len(texts[upto]) + 1
            upto += 1
        part = texts[at:upto]
        yield at, 0, np.fromiter(map(len, part), dtype=np.int64, count=len(part)), np.frombuffer((b" ".join(part) + b" ").translate(table), dtype=np.uint8)
        at = upto


def _word_hashes(letters: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of words from their bytes one after the other."""
    out = np.zeros(len(sizes), dtype=U)
    if not len(sizes):
        return out
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(letters), dtype=np.int64)
    place -= np.repeat(first, sizes)
    values = place.view(U)
    values += U(seed + 1)
    values *= U(0x9E3779B97F4A7C15)
    values ^= _BYTE[letters]
    return mix(np.add.reduceat(mix(values), first) + sizes.astype(U))
