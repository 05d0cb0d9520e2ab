"""Vectorised word and shingle hashing over batches of whole texts.

Words are runs of bytes other than ASCII white space, after lower-casing A-Z.
Each word gets a 64-bit hash by prefix sums of a polynomial over the bytes of
the whole batch, so there is no Python work per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PIECE = 1 << 19
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixing generator: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        up = np.full(max(n, _PIECE + 1), _BASE, dtype=np.uint64)
        down = np.full(len(up), pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if len(up) <= 4 * _PIECE:
            _POWERS[0] = have
    return have


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``raw`` and their byte offsets; pieces are cut at white space to bound memory."""
    raw = raw.lower()  # bytes.lower touches A-Z only
    data = np.frombuffer(raw, dtype=np.uint8)
    if len(data) <= _PIECE:
        return _hash_piece(data)
    hashes, offsets, at = [], [], 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        h, s = _hash_piece(data[at:end])
        hashes.append(h)
        offsets.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(offsets)


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out *= np.uint64(0xA24BAED4963EE407)
            out += words[i : n + i]
    return mix64(out)


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct ``k``-word shingle hashes; with fewer words, the whole sequence counts as one."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    if n < k:
        return combine(words, n) ^ np.uint64(n)
    return np.unique(combine(words, k))


def documents_words(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text in turn (null: no words), hashed in chunks of about half a megabyte."""
    chunk: list[bytes] = []
    size = 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        chunk.append(raw)
        size += len(raw) + 1
        if size >= _PIECE:
            yield from _chunk_words(chunk, size)
            chunk, size = [], 0
    if chunk:
        yield from _chunk_words(chunk, size)


def _chunk_words(chunk: list[bytes], size: int) -> Iterator[np.ndarray]:
    if len(chunk) == 1:
        yield hash_words(chunk[0])[0]
        return
    lengths = np.array([len(x) + 1 for x in chunk])
    hashes, offsets = hash_words(b"\n".join(chunk))
    bounds = np.searchsorted(offsets, np.concatenate(([0], np.cumsum(lengths))))
    for i in range(len(chunk)):
        yield hashes[bounds[i] : bounds[i + 1]]
