"""Word shingles of whole texts as sorted arrays of 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: ASCII white space that parts words: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed in one go.
_CHUNK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits each depend on all input bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


#: Bytes of a word hashed in one step, and the words beyond so many bytes that go one by one.
_STEP, _LONG = 8, 64


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of a byte buffer that ends with white space, and the hash of each.

    Eight bytes at a time go through a bijection of the state, so words of one length
    up to eight bytes never collide and others by chance only (2 ** -64 for a pair),
    whatever their letters.
    """
    space = _SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    begins, ends = edge[0::2], edge[1::2]
    sizes = ends - begins
    raw = np.concatenate((buffer, np.zeros(_STEP, np.uint8)))
    eight = np.ndarray((len(buffer) + 1,), "<u8", raw, 0, (1,))  # the eight bytes from each place on
    out = sizes.astype(np.uint64) * np.uint64(_BASE)
    rest, at = np.arange(len(begins)), 0
    short = sizes <= _LONG
    if not short.all():
        for k in np.flatnonzero(~short).tolist():
            out[k] = xxhash.xxh3_64_intdigest(buffer[begins[k] : ends[k]].tobytes(), 1)
        rest = np.flatnonzero(short)
    while len(rest):
        left = sizes[rest] - at
        part = eight[begins[rest] + at]
        cut = left < _STEP
        part[cut] &= (np.uint64(1) << (left[cut] * 8).astype(np.uint64)) - np.uint64(1)
        out[rest] = mix64(out[rest] ^ part)
        rest = rest[left > _STEP]
        at += _STEP
    return begins, out


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles of ``width`` words, A-Z lower-cased, ascending.

    A text of fewer words has its whole sequence as the one shingle; a text
    without words, or null, has none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) < _CHUNK):
            size += len(raw[end]) + 1
            end += 1
        out.extend(_sets(raw[at:end], width))
        at = end
    return out


def _sets(raw: list[bytes], width: int) -> list[np.ndarray]:
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begins, words = word_hashes(buffer)
    bounds = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    first = np.searchsorted(begins, bounds).tolist()
    scale = np.array([pow(_BASE, k + 1, 1 << 64) for k in range(width)], np.uint64)
    n = len(words) - width + 1
    if n > 0:
        rolled = words[:n] * scale[0]
        for k in range(1, width):
            rolled += words[k : k + n] * scale[k]
        rolled = mix64(rolled)
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix64(np.sum(words[a:b] * scale[: b - a], keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
