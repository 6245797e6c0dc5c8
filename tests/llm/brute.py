"""Plain-Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def substring_removal(docs: list[tuple[int, str | None]], width: int = 20) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, tuple] = {}
    split = {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(split):
        for i in range(len(split[d]) - width + 1):
            first.setdefault(tuple(split[d][i : i + width]), (d, i))
    out = {}
    for d, words in split.items():
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] != (d, i):
                gone.update(range(i, i + width))
        out[d] = (len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone).encode()))
    return out


def byte_removal(docs: list[tuple[int, str | None]], width: int = 100) -> dict[int, tuple[int, int, int, str]]:
    first: dict[bytes, tuple] = {}
    data = {d: (t or "").encode() for d, t in docs}
    for d in sorted(data):
        for i in range(len(data[d]) - width + 1):
            first.setdefault(data[d][i : i + width], (d, i))
    out = {}
    for d, text in data.items():
        gone = bytearray(len(text))
        for i in range(len(text) - width + 1):
            if first[text[i : i + width]] != (d, i):
                gone[i : i + width] = b"\x01" * width
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(text), sum(gone), spans, sha(bytes(c for c, g in zip(text, gone, strict=True) if not g)))
    return out


def shingles(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def components(nodes: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    root = {n: n for n in nodes}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = components(ids, links)
    return {d: (len(sets[d]), found[d]) for d in ids}


TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], width: int = 10) -> dict[int, tuple]:
    windows: dict[tuple, set] = {}
    for i, t in items:
        words = TEST_WORD.findall((t or "").translate(LOWER))
        if words:
            for k in range(max(1, len(words) - width + 1)):
                windows.setdefault(tuple(words[k : k + width]), set()).add(i)
    lengths = sorted({len(w) for w in windows})
    out = {}
    for d, t in docs:
        words, hit, met = TEST_WORD.findall((t or "").translate(LOWER)), set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    met |= windows[tuple(words[k : k + n])]
        out[d] = (len(words), len(hit), len(met), sha(",".join(sorted(map(str, met))).encode()), bool(hit))
    return out
