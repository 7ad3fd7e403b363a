"""Word hashes and 5-word shingles of many texts at once, on Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix64, spans

#: Texts are worked on in blocks of about so many bytes.
BLOCK_BYTES = 1 << 20
SHINGLE = 5
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RANDOM = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_STEP = mix64(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_TABLES: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i, modulo 2 ** 64, for i < n."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        _TABLES.clear()
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            t = np.full(size, np.uint64(b), np.uint64)
            t[0] = 1
            _TABLES.append(np.cumprod(t))
    return _TABLES[0], _TABLES[1]


def _block(d: np.ndarray, o: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(d)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(o), np.int64)
    word = ~_SPACE[d]
    edge = np.zeros(n + 1, bool)
    edge[o] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_RANDOM[_LOWER] if lower else _RANDOM)[d] * up[:n], out=sums[1:])
    h = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(s, o)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks (i, j, hashes, at): the words of text k of the texts i..j-1 are hashes[at[k - i] : at[k - i + 1]].

    A word is a run of bytes other than the six ASCII white-space characters. A
    text longer than a block is cut at white space, so only its hashes are held whole.
    """
    for i, j in spans(offsets, BLOCK_BYTES):
        s, e = int(offsets[i]), int(offsets[j])
        if j == i + 1 and e - s > 2 * BLOCK_BYTES:
            parts = []
            while s < e:
                cut = min(s + BLOCK_BYTES, e)
                while cut < e and not _SPACE[data[cut]]:
                    cut += 1
                parts.append(_block(data[s:cut], np.array([0, cut - s]), lower)[0])
                s = cut
            h = np.concatenate(parts)
            yield i, j, h, np.array([0, len(h)])
        else:
            h, at = _block(data[s:e], offsets[i : j + 1] - s, lower)
            yield i, j, h, at


def shingle_hashes(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of SHINGLE words of each text, and where each text's begin. Fewer words make one shingle, no words none."""
    counts = np.diff(at)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    start = np.zeros(len(at), np.int64)
    np.cumsum(sizes, out=start[1:])
    if not len(h):
        return np.zeros(0, np.uint64), start
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    window = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):
        window += padded[k : k + len(h)] * _STEP[k]
    # the first window of a text of fewer words must not run into the next text
    for t in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        own = h[at[t] : at[t + 1]]
        window[at[t]] = (own * _STEP[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    take = np.repeat(at[:-1] - start[:-1], sizes) + np.arange(start[-1])
    return mix64(window[take]), start


def sequence_hashes(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the word sequence of each text."""
    n = len(h)
    up, down = _tables(n + 1)
    out = []
    for salt in (0x8CB92BA72F3D8DD7, 0xABCDEF1234567891):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(h ^ np.uint64(salt)) * up[:n], out=sums[1:])
        out.append(mix64((sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]] + np.diff(at).astype(np.uint64)))
    return out[0], out[1]
