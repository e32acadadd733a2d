"""Vectorised work on the UTF-8 bytes of an Arrow string column.

A batch is cut into slices of a few megabytes, so the helper arrays of a task
stay small however many rows Spark hands over; one very long text is a slice
of its own. Null texts count as empty. All hashes are 64 bits wide and depend
on the bytes only, so they agree between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
PRIME = np.uint64((1 << 31) - 1)
BASES = (0x5BD1E995, 0x1B873593)
_POWERS: dict[int, np.ndarray] = {}

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words between ASCII white space, and of words of digits, letters and non-ASCII.
DARK = ~SPACES
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with at most ``most`` bytes, or one longer row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null("")
    rows = len(texts)
    if not rows:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, rows)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _fold(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, which 31 bits hold."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    x[x == PRIME] = 0
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo the prime; those of a slice are kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES + 1)
        known = np.empty(size, np.uint64)
        known[0], done = 1, 1
        while done < size:
            more = min(done, size - done)
            known[done : done + more] = _fold(known[:more] * np.uint64(pow(base, done, int(PRIME))))
            done += more
        known = known.astype(np.uint32)  # half the memory of a worker
        if size <= 8 * SLICE_BYTES:
            _POWERS[base] = known
    return known[:n]


class SpanHash:
    """Hash of any span of a byte array, from prefix sums: two polynomials modulo a prime.

    Modulo a power of two, texts could be built that differ everywhere and have
    equal hashes for any base.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.parts = []
        for base in BASES:
            terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(base, n + 1)[:n]
            if n >= 1 << 24:
                terms = _fold(terms)  # so that the sums stay below 2^64
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.parts.append((sums, _powers(pow(base, -1, int(PRIME)), n + 1)))

    def _joined(self, pick) -> np.ndarray:
        one, two = (_fold(_fold(difference) * down) for difference, down in map(pick, self.parts))
        return mix(one | two << np.uint64(31))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._joined(lambda part: (part[0][ends] - part[0][starts], part[1][starts]))

    def rolling(self, k: int) -> np.ndarray:
        """Hash of every span of ``k`` bytes."""
        return self._joined(lambda part: (part[0][k:] - part[0][: len(part[0]) - k], part[1][: len(part[0]) - k]))


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of ``table`` bytes; runs end with their row."""
    mark = table[data]
    begin, stop = mark.copy(), mark.copy()
    begin[1:] &= ~mark[:-1]
    stop[:-1] &= ~mark[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[first] = mark[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stop[last] = mark[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of ``lengths`` values each."""
    bounds = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
