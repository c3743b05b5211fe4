"""Vectorised word scanning of UTF-8 texts inside Spark tasks.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. Those separators
are ASCII, so they never occur inside a multi-byte character and the byte scan
equals the character scan. A word's hash is a polynomial over randomised byte
codes modulo 2**64, passed through a finaliser; it depends on the word alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_SEPARATORS = b" \t\n\x0b\x0c\r"
_PRIME = 0x9E3779B97F4A7C15
#: Texts are scanned together up to so many bytes, so that work arrays stay small.
SLICE_BYTES = 1 << 18

_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_CODE = mix(np.arange(1, 257, dtype=_U) * _U(_PRIME))
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(_SEPARATORS)] = False


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.n = 0
        self.up = self.down = np.empty(0, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            size = 1 << max(16, (n - 1).bit_length())
            inverse = pow(_PRIME, -1, 1 << 64)
            for name, base in (("up", _PRIME), ("down", inverse)):
                p = np.full(size, base, _U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
            self.n = size
        return self.up, self.down


_POWERS = _Powers()


def lowered(raw: bytes) -> bytes:
    """A-Z to a-z, all other bytes as they are."""
    return raw.translate(_LOWER)


def slices(texts: Iterable, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of encoded texts (null: empty) of about ``limit`` bytes with the first one's position."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if run and size + len(b) > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(b)
        size += len(b)
    if run:
        yield first, run


def scan(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Words of all ``texts``: document index, start, end (in the joined bytes) and hash, then the joined bytes."""
    joined = b" ".join(texts) + b" "
    if lower:
        joined = joined.translate(_LOWER)
    buf = np.frombuffer(joined, np.uint8)
    inside = _IS_WORD[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    up, down = _POWERS.get(len(buf) + 1)
    run = np.empty(len(buf) + 1, _U)
    run[0] = 0
    np.cumsum(_CODE[buf] * up[: len(buf)], out=run[1:])
    h = mix((run[end] - run[start]) * down[start] + (end - start).astype(_U))
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    doc = np.searchsorted(np.cumsum(lengths), start, side="right")
    return doc, start, end, h, joined


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` successive words (over document borders too: the caller masks)."""
    if len(h) < n:
        return np.empty(0, _U)
    out = np.zeros(len(h) - n + 1, _U)
    for k in range(n):
        out = out * _U(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k]
    return mix(out + _U(n))


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct ``words``-word shingle hashes of each text.

    A text with fewer words has its whole word sequence as one shingle; one
    without words has none.
    """
    doc, _, _, h, _ = scan(texts)
    count = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(count)))
    all_grams = grams(h, words)
    out = []
    for i, n in enumerate(count):
        a = first[i]
        if n >= words:
            out.append(np.unique(all_grams[a : a + n - words + 1]))
        elif n:
            out.append(grams(h[a : a + n], int(n)))
        else:
            out.append(np.empty(0, _U))
    return out
