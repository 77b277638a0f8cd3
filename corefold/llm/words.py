"""Words and word shingles of whole batches of texts, by numpy over the bytes of an Arrow array.

Words are runs without space, tab, line feed, vertical tab, form feed or carriage return.
A word is known by a 64-bit polynomial hash of its bytes and a shingle by a mix of its
words' hashes; two different shingles share one with a chance of about 2**-64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.arange(256, dtype=np.uint8)
#: Bytes hashed at once.
WINDOW = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(name: str, n: int) -> np.ndarray:
    """Powers of BASE, or of its inverse modulo 2**64, at least ``n`` of them."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        base = BASE if name == "up" else pow(BASE, -1, 1 << 64)
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        have = _powers[name] = np.cumprod(out, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each starts, with the end; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of a batch: ``starts`` and ``ends`` in bytes, and ``first``, each text's first word, with the end."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = raw(texts)
        solid = ~WHITE[self.data]
        edges = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        before = np.empty_like(solid)
        before[1:] = solid[:-1]
        before[edges] = False
        after = np.empty_like(solid)
        after[:-1] = solid[1:]
        ends = self.offsets[1:][self.offsets[1:] > 0] - 1
        after[ends] = False
        self.solid = solid
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash for each word, of its bytes or of its bytes with A-Z lower-cased."""
        table, out, k = (LOWER if lower else KEEP), np.empty(len(self.starts), np.uint64), 0
        while k < len(self.starts):
            at = int(self.starts[k])
            stop = max(k + 1, int(np.searchsorted(self.ends, at + WINDOW, side="right")))
            part = table[self.data[at : int(self.ends[stop - 1])]].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * _power("up", len(part))[: len(part)], out=sums[1:])
            s, e = self.starts[k:stop] - at, self.ends[k:stop] - at
            out[k:stop] = mix((sums[e] - sums[s]) * _power("down", len(part))[s] + (e - s).astype(np.uint64))
            k = stop
        return out

    def shingles(self, size: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` words, and each text's first window, with the end.

        A text of fewer words, but some, has one: the whole sequence. A text without words has none.
        """
        h = self.hashes(lower)
        n = np.maximum(self.counts - size + 1, np.minimum(self.counts, 1))
        at = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=at[1:])
        out = np.zeros(int(at[-1]), np.uint64)
        where = np.repeat(self.first[:-1] - at[:-1], n) + np.arange(len(out))
        length = np.repeat(np.minimum(self.counts, size), n)
        for k in range(size):
            on = slice(None) if k == 0 else length > k
            if k and on.all():
                on = slice(None)
            out[on] = out[on] * np.uint64(0xD6E8FEB86659FD93) + h[where[on] + k]
        return mix(out + length.astype(np.uint64)), at

    def sets(self, size: int) -> list[np.ndarray]:
        """For each text the sorted distinct hashes of its lower-cased shingles."""
        h, at = self.shingles(size, True)
        return [np.unique(h[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.md5(hashes.tobytes(), usedforsecurity=False).digest()
