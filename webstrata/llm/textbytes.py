"""Whole texts as bytes: the numpy groundwork that the text operators share.

An Arrow string column already is one run of UTF-8 bytes with offsets, so the
operators work on that run directly. `blocks` cuts a column into runs of whole
texts of about BLOCK_BYTES, which keeps every temporary array within the CPU
cache and bounds memory; a single longer text forms a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

NULL_ID = -(1 << 63)
"""Stands for a null document id in sort orders and join keys: before all others."""


def _random_words(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)


BYTE_CODES = _random_words(256, 11)

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


PORTION_ROWS, PORTION_BYTES = 512, 16 << 20


def portions(batches: Iterator[pa.RecordBatch], rows: int = PORTION_ROWS, size: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows and bytes, so that what is made of them is small as well; a larger
    row forms a slice of its own."""
    for batch in batches:
        parts = [batch.slice(k, rows) for k in range(0, batch.num_rows, rows)][::-1]
        while parts:
            part = parts.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                parts += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def ids_of(column: pa.Array) -> np.ndarray:
    """Document ids as int64; null ids become NULL_ID."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, offsets of the rows in them). Null texts are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MULTIPLIER modulo 2**64, and of its inverse: at least n of each."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", MULTIPLIER), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Hash sums from which `slice_hashes` gives the hash of any slice."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    return sums


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for overlapping slices of equal, small size (under 1,000 bytes: longer
    texts can be built that collide under any multiplier); `keyed_hashes` is for words and lines."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_LANE_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_keys: dict[str, np.ndarray] = {}


def _lane_keys(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed random words for the first n lanes of a slice, two for each."""
    if len(_keys.get("a", ())) < n:
        size = max(n, 1024)
        for name, seed in (("a", 23), ("b", 24)):
            _keys[name] = _random_words(1 << (size - 1).bit_length(), seed)
    return _keys["a"], _keys["b"]


def keyed_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes (two words each) of data[start:end]; equal contents have equal hashes wherever they stand.

    A slice is read in lanes of eight bytes. Each lane is mixed with a random word of its own
    place, the lanes are added and the sum is mixed with the length; so there is no polynomial
    whose zeros texts could hit, and slices of one lane and equal length never collide."""
    size = (ends - starts).astype(np.int64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    view = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    lanes = np.maximum(1, (size + 7) // 8)
    key_a, key_b = _lane_keys(int(lanes.max()) if len(lanes) else 1)
    lane = view[starts] & _LANE_MASK[np.minimum(size, 8)]
    a, b = mix(lane ^ key_a[0]), mix(lane + key_b[0])
    long = np.flatnonzero(lanes > 1)
    if len(long):
        more = lanes[long] - 1
        begin = np.cumsum(more) - more
        nth = np.arange(more.sum()) - np.repeat(begin, more) + 1
        at = np.repeat(starts[long], more) + 8 * nth
        lane = view[at] & _LANE_MASK[np.minimum(np.repeat(ends[long], more) - at, 8)]
        a[long] += np.add.reduceat(mix(lane ^ key_a[nth]), begin)
        b[long] += np.add.reduceat(mix(lane + key_b[nth]), begin)
    odd = size.astype(np.uint64) * MULTIPLIER
    return mix(a + odd), mix(b ^ odd)


def words(is_space: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't spaces, which never cross texts; and
    for each text the index of its first word (one more entry closes the last)."""
    inside = np.zeros(len(is_space) + 1, bool)
    inside[:-1] = ~is_space
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(is_space))]
    opens[cuts] = inside[cuts]
    starts = np.flatnonzero(opens)
    closes = inside[:-1] & (~inside[1:] | opens[1:])
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def numbered(n_per_text: np.ndarray) -> np.ndarray:
    """The number of its text for each of the items that the texts have."""
    return np.repeat(np.arange(len(n_per_text)), n_per_text)


def whole_windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start indexes of the windows of `width` items that lie within one text, and their texts."""
    total = int(first[-1])
    text = numbered(np.diff(first))
    starts = np.arange(max(0, total - width + 1))
    if len(starts) == 0:
        return starts, text[:0]
    ok = text[starts] == text[starts + width - 1]
    return starts[ok], text[starts[ok]]
