"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of anything but space and U+0009 to U+000D. These are single bytes in UTF-8, so the bytes can be cut without decoding them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000  # a few arrays of eight bytes per text byte are alive at once; longer texts are one chunk each

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240117)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = (int(_RNG.integers(2**40, 2**60)) * 8 + 5) % 2**64  # odd, so it has an inverse modulo 2^64
_UNSTEP = pow(_STEP, -1, 2**64)
_GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {_STEP: np.ones(1, np.uint64), _UNSTEP: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        steps = np.full(n, np.uint64(base))
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more entry than texts). Null counts as empty."""
    arr = texts.cast(pa.large_string()).fill_null("")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    _, offsets, data = arr.buffers()
    if len(arr) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes of text; every row comes once."""
    _, offs = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a slice of texts: `start`, `end` in bytes, `doc` (row in the slice), and `hash` (64 bits of the word's bytes)."""

    def __init__(self, texts: pa.Array, hashed: bool = True):
        self.data, self.offs = data, offs = text_bytes(texts)
        self.rows, n = len(offs) - 1, len(data)
        space = SPACE[data]
        before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
        before[1:], after[:n - 1] = space, space[1:]
        before[offs[:-1]] = True
        after[offs[1:][offs[1:] > 0] - 1] = True
        self.space = space
        self.start = np.flatnonzero(~space & before[:n])
        self.end = np.flatnonzero(~space & after[:n]) + 1
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.rows)
        self._sums = None
        self.hash = self.range_hash(self.start, self.end) if hashed else None

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges: differences of prefix sums of a polynomial, shifted back to position 0."""
        n = len(self.data)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _power(_STEP, max(n, 1))[:n], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * _power(_UNSTEP, n + 1)[start])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside a text, and the index of their first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += self.hash[j:j + n] * _GRAM[j]
        first = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return mix(total[first]), first

    def per_text(self, values: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Sum of values by row of the slice."""
        return np.bincount(doc, weights=values, minlength=self.rows).astype(np.int64)
