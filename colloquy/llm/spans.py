"""64-bit hashes of many stretches of bytes at once, without an object per stretch.

Stretches of up to 16 bytes are read as one or two whole 8-byte numbers, and
these are mixed; longer ones go through xxh3 one by one. Of stretches of one
size, those of up to 8 bytes have the same hash only if they are equal. Used
for words and token pieces, of which a text has too many to handle one by one.
"""

from __future__ import annotations

import numpy as np
import xxhash

EXACT = 8  # bytes up to which equal sizes and hashes mean equal stretches
_SHORT = 16
_SECOND, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)  # the lowest i bytes of a number


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def numbers(raw: np.ndarray, used: int | None = None) -> np.ndarray:
    """The 8 bytes from any place on, as a number; of ``used`` bytes, if a buffer with 16 to spare is given."""
    if used is None:
        used = len(raw)
        padded = np.zeros(used + 16, dtype=np.uint8)
        padded[:used] = raw
        raw = padded
    return np.ndarray((used + 9,), dtype="<u8", buffer=raw, strides=(1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``raw[starts[i]:ends[i]]``."""
    size = ends - starts
    number = numbers(raw)
    out = mix((number[starts] & _KEEP[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _SIZE))
    two = np.flatnonzero((size > EXACT) & (size <= _SHORT))
    if len(two):
        second = number[starts[two] + 8] & _KEEP[size[two] - 8]
        out[two] = mix(out[two] + mix(second ^ _SECOND))
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i]:ends[i]].tobytes())
    return out


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> bool:
    """Whether all stretches of ``a`` hold the bytes of those of ``b`` of the same size; both as ``numbers``."""
    at = 0
    while len(size):
        keep = _KEEP[np.minimum(size - at, 8)]
        if ((a[a_starts + at] ^ b[b_starts + at]) & keep).any():
            return False
        at += 8
        more = size > at
        a_starts, b_starts, size = a_starts[more], b_starts[more], size[more]
        if at >= 64 and len(size):  # few and long: byte by byte
            x, y = a.base if a.base is not None else a, b.base if b.base is not None else b
            x, y = np.asarray(x).view(np.uint8), np.asarray(y).view(np.uint8)
            return all((x[i:i + n] == y[j:j + n]).all() for i, j, n in zip(a_starts.tolist(), b_starts.tolist(), size.tolist()))
    return True


def joined(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with a line feed after each, offsets of the texts and the end); ``lower``: A-Z only."""
    raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws]))).astype(np.int64)
    whole = b"\n".join([*raws, b""])
    return np.frombuffer(whole.lower() if lower else whole, dtype=np.uint8), offsets


def sorted_distinct(*parts: np.ndarray) -> np.ndarray:
    """The distinct values of all parts, ascending (sorting beats a hash table here)."""
    a = np.concatenate(parts)
    a.sort(kind="stable" if len(parts) > 1 else None)
    if not len(a):
        return a
    return a[np.concatenate(([True], a[1:] != a[:-1]))]
