"""Words, lines and hashes of a batch of texts, as arrays over its UTF-8 bytes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. None of these occurs inside a longer UTF-8 character.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Texts are worked on this many bytes at a time; a longer text by itself.
SLICE_BYTES = 2 << 20
#: Bytes hashed at a time.
BLOCK = 1 << 20

_draw = np.random.default_rng(20240229)
#: A random odd number for each byte; and the same with A to Z as a to z.
BYTE_HASH = _draw.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_HASH = BYTE_HASH.copy()
LOWER_HASH[65:91] = BYTE_HASH[97:123]
_STEP = 0x9E3779B97F4A7C15
#: Bytes of a word that are hashed together; and a random odd number for each place in them.
#: (Powers of one number would let words collide that only need to be long and regular.)
PART = 4096
PLACES = _draw.integers(1, 1 << 63, PART, np.uint64) * np.uint64(2) + np.uint64(1)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over the batches of a task, in a worker that hands memory back to the system
    before and after it: workers are reused, and what one stage freed is still held in the next."""

    @functools.wraps(work)
    def within(tables: Iterator) -> Iterator:
        hand_back()
        yield from work(tables)
        hand_back()

    return within


def hand_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    data: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of up to ``most`` bytes."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the row of its text."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_HASH) -> np.ndarray:
    """A 64-bit hash of each of the ordered, disjoint byte ranges, none of them empty. Longer
    ones than PART bytes are hashed in parts, each mixed with its number."""
    if len(starts) and (ends - starts).max() > PART:
        parts = -(-(ends - starts) // PART)
        firsts = np.cumsum(parts) - parts
        nth = np.arange(parts.sum()) - np.repeat(firsts, parts)
        lows = np.repeat(starts, parts) + nth * PART
        own = hashes(data, lows, np.minimum(lows + PART, np.repeat(ends, parts)), table)
        sums = np.add.reduceat(mixed(own + nth.astype(np.uint64) * np.uint64(_STEP)), firsts)
        return np.where(parts == 1, own[firsts], mixed(sums + (ends - starts).astype(np.uint64)))
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(int(np.searchsorted(starts, starts[low] + BLOCK)), low + 1)
        first, own, stop = starts[low], starts[low:high] - starts[low], ends[low:high] - starts[low]
        part = data[first : first + stop[-1]]
        place = np.arange(len(part)) - np.repeat(own, np.diff(np.append(own, len(part))))
        values = table[part] * PLACES[place & (PART - 1)]
        # What lies between one range and the next counts as nothing.
        values[place >= np.repeat(stop - own, np.diff(np.append(own, len(part))))] = 0
        out[low:high] = np.add.reduceat(values, own)
        low = high
    return mixed(out + (ends - starts).astype(np.uint64))


def shingles(word_hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``n`` words within a text; a text of fewer words gives
    its whole sequence as one."""
    if not len(rows):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    step = np.uint64(_STEP)
    firsts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    counts = np.diff(np.append(firsts, len(rows)))
    whole = max(len(rows) - n + 1, 0)
    run = np.zeros(whole, np.uint64)
    for k in range(n):
        run = run * step + word_hashes[k : k + whole]
    keep = rows[: whole] == rows[n - 1 : n - 1 + whole]
    out, at = run[keep], rows[:whole][keep]
    short = counts < n
    if short.any():
        extra = np.zeros(short.sum(), np.uint64)
        for k in range(n - 1):
            more = counts[short] > k
            extra[more] = extra[more] * step + word_hashes[firsts[short][more] + k]
        out = np.concatenate([out, extra + counts[short].astype(np.uint64)])
        at = np.concatenate([at, rows[firsts[short]]])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return mixed(out), at
