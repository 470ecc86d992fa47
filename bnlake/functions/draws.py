"""``scalar.seeded_uniform`` over arrays, for tasks that draw billions of numbers and
keep only counts: the same md5 of the parts joined by '|', in numpy."""

from __future__ import annotations

import numpy as np

from bnlake.functions.scalar import TWO_52

CHUNK = 8192       # messages at once: their arrays stay in the cache
_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(np.sin(i + 1)) * 2 ** 32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TENS = 10 ** np.arange(1, 19, dtype=np.int64)


def uniforms(seed, *parts) -> np.ndarray:
    """One draw in [0, 1) a row; the parts after the seed are whole numbers >= 0 or arrays of them."""
    head = str(seed).encode()
    parts = [np.asarray(p, np.int64) for p in parts]
    if any((p < 0).any() for p in parts):
        raise ValueError("parts of a draw are >= 0")
    rows = np.broadcast_shapes(*[p.shape for p in parts])
    widths = [np.searchsorted(_TENS, p, side="right") + 1 for p in parts]
    kind = np.broadcast_to(sum(w * 20 ** i for i, w in enumerate(widths)), rows)
    out = np.empty(rows)
    for s in np.flatnonzero(np.bincount(kind)):           # rows whose parts have the same lengths
        at = np.flatnonzero(kind == s)
        lengths = [int(s) // 20 ** i % 20 for i in range(len(parts))]
        for i in range(0, len(at), CHUNK):
            here = at[i:i + CHUNK]
            out[here] = _hashed(head, [np.broadcast_to(p, rows)[here] for p in parts], lengths)
    return out


def _hashed(head: bytes, parts: list[np.ndarray], lengths: list[int]) -> np.ndarray:
    """First 52 bits of the md5 of messages of one length (one block of 64 bytes), as fractions."""
    size = len(head) + sum(lengths) + len(parts)
    if size > 55:
        raise ValueError("the parts of a draw are too long")
    text = np.zeros((64, len(parts[0])), np.uint8)
    text[:len(head)] = np.frombuffer(head, np.uint8)[:, None]
    end = len(head)
    for left, length in zip(parts, lengths):
        text[end] = ord("|")
        end += 1
        for i in range(end + length - 1, end - 1, -1):
            tens = left // 10
            text[i] = left - tens * 10 + ord("0")
            left = tens
        end += length
    text[size] = 128
    wide = text.astype(np.uint32)
    words = [wide[4 * i] | wide[4 * i + 1] << 8 | wide[4 * i + 2] << 16 | wide[4 * i + 3] << 24 for i in range(14)]
    words += [np.uint32(8 * size), np.uint32(0)]
    a, b, c, d = (np.full(len(parts[0]), x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += np.uint32(_SINES[i])
        f += words[g]
        a, d, c, b = d, c, b, b + (f << np.uint32(_SHIFTS[i]) | f >> np.uint32(32 - _SHIFTS[i]))
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    bits = a.byteswap().astype(np.uint64) << np.uint64(20) | (b.byteswap() >> np.uint32(12)).astype(np.uint64)
    return bits.astype(np.float64) / TWO_52
