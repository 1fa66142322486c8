"""Rolling hashes of all places of a byte string at once, by doubling the window."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1


def mix(x: int) -> int:
    """A 64-bit integer whose bits depend on all bits of ``x``: constants come from this rule."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


#: A random-looking 64-bit value for each byte.
GEAR = np.array([mix(b) for b in range(256)], np.uint64)


def windows(values: np.ndarray, base: int, width: int, modulus: int = 1 << 64) -> np.ndarray:
    """sum(values[i + k] * base ** (width - 1 - k)) mod ``modulus`` for each window of ``width`` values.

    The modulus is 2**64, or below 2**31 so that products of two remainders fit.
    """
    power = lambda n: np.uint64(pow(base, n, modulus))
    rest_of = (lambda x: x) if modulus == 1 << 64 else (lambda x: x % np.uint64(modulus))
    out, have, part, span, rest = None, 0, values.astype(np.uint64), 1, width
    if len(values) < width:
        return np.empty(0, np.uint64)
    while True:
        if rest & 1:
            if out is None:
                out, have = part, span
            else:
                n = len(values) - have - span + 1
                out = rest_of(out[:n] * power(span) + part[have : have + n])
                have += span
        rest >>= 1
        if not rest:
            return out
        part = rest_of(part[:-span] * power(span) + part[span:])
        span *= 2


def gear(data: bytes) -> np.ndarray:
    """``h = (h << 1) + GEAR[b]`` after each byte, mod 2**64: only the last 64 bytes count."""
    values = GEAR[np.frombuffer(data, np.uint8)]
    head = np.concatenate((np.zeros(63, np.uint64), values))
    return windows(head, 2, 64)
