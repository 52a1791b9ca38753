"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are lower-cased (A-Z), cut into words and written as `word word ... `, so
a window of ten benchmark words is one byte string that starts after a space.
Windows are searched with shift tables over blocks of bytes: the block at the
end of the current position either shows how far no pattern can end (skip), or
its hash picks a bucket of patterns, whose first bytes and then whole strings
are compared with the text. Many positions of a text advance at the same time,
one lane each, so the search is vectorised without losing the skips.

The benchmark goes to the executors in slices of at most SLICE_BYTES of item
text, whatever its size; every slice is searched in all texts, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.shared import small_batches
from webstrata.llm.textbytes import LOWER, blocks, portions

WINDOW_WORDS = 10
SLICE_BYTES = 8 << 20
PASS_BYTES = 64 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_CLEAN = np.where(_WORD[LOWER], LOWER, 0x20).astype(np.uint8)
_CLEAN_STR = bytes(_CLEAN)

#: (shortest pattern in bytes, block bytes) of the pattern classes: a short pattern would shorten every skip.
CLASSES = ((20, 8), (4, 4), (2, 2))
TABLE_BITS = 20


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_CLEAN_STR).split()


def windows(text: str | None, width: int = WINDOW_WORDS) -> list[bytes]:
    """Windows of an item as searched: words each followed by a space."""
    ws = item_words(text)
    if not ws:
        return []
    return [b" ".join(ws[i : i + width]) + b" " for i in range(max(1, len(ws) - width + 1))]


class _Class:
    """Patterns of similar length: shift table, suffix buckets and prefixes."""

    def __init__(self, patterns: list[tuple[bytes, int]], block: int):
        self.block, self.m = block, min(len(p) for p, _ in patterns)
        heads = np.frombuffer(b"".join(p[: self.m] for p, _ in patterns), np.uint8).reshape(len(patterns), self.m)
        self.shift = np.full(1 << TABLE_BITS, self.m - block + 1, np.int64)
        for end in range(block, self.m + 1):
            slot = self.slots(np.ascontiguousarray(heads[:, end - block : end]).view(f"<u{block}").ravel())
            self.shift[slot] = np.minimum(self.shift[slot], self.m - end)
        self.patterns = patterns
        bucket = self.slots(np.ascontiguousarray(heads[:, self.m - block :]).view(f"<u{block}").ravel())
        self.order = np.argsort(bucket, kind="stable")
        self.bucket = bucket[self.order]
        self.prefix = np.ascontiguousarray(heads[:, :block]).view(f"<u{block}").ravel()[self.order]

    @staticmethod
    def slots(values: np.ndarray) -> np.ndarray:
        return (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)

    def search(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, pattern) of each occurrence of a pattern that starts after a space."""
        n, m, block = len(text), self.m, self.block
        if n < m:
            return
        view = np.ndarray((n - block + 1,), f"<u{block}", text, 0, (1,))
        lane = max(256, 8 * m)
        at = np.arange(m, n + 1, lane)  # ends of the current positions
        stop = np.minimum(at + lane, n + 1)
        found, slots = [], []
        while len(at):
            slot = self.slots(view[at - block])
            step = self.shift[slot]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
                slots.append(slot[hit])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return
        start, slot = np.concatenate(found) - m, np.concatenate(slots)
        low, high = np.searchsorted(self.bucket, slot, "left"), np.searchsorted(self.bucket, slot, "right")
        ok = (high > low) & ((start == 0) | (text[np.maximum(start, 1) - 1] <= 0x20))
        start, low, count = start[ok], low[ok], (high - low)[ok]
        # every candidate with every pattern of its bucket, a bounded number at a time
        edges = np.cumsum(count)
        for a in range(0, len(start), 4096):
            part = count[a : a + 4096]
            which = np.repeat(np.arange(a, a + len(part)), part)
            member = np.arange(part.sum()) - np.repeat(edges[a : a + 4096] - part - (edges[a] - part[0] if len(part) else 0), part) + np.repeat(low[a : a + 4096], part)
            same = view[start[which]] == self.prefix[member]
            for i, k in zip(which[same], self.order[member[same]]):
                pattern, s = self.patterns[k][0], int(start[i])
                if text[s : s + len(pattern)].tobytes() == pattern:
                    yield s, int(k)


class Matcher:
    """The windows of a slice of benchmark items, ready to be searched."""

    def __init__(self, items: Iterable[tuple[object, str | None]], width: int = WINDOW_WORDS):
        owners: dict[bytes, set] = {}
        for item, text in items:
            for w in windows(text, width):
                owners.setdefault(w, set()).add(item)
        self.owners = [sorted(v, key=str) for v in owners.values()]
        self.n_words = np.array([w.count(b" ") for w in owners], np.int64)
        self.classes, rest = [], list(zip(owners, range(len(owners))))
        for least, block in CLASSES:
            if own := [x for x in rest if len(x[0]) >= least]:
                self.classes.append(_Class(own, block))
            rest = [x for x in rest if len(x[0]) < least]

    def search(self, text: np.ndarray) -> list[tuple[int, int]]:
        return [(s, c.patterns[k][1]) for c in self.classes for s, k in c.search(text)]


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as `word word ... \\0`; words before each byte; and words before each text (and after the last)."""
    n = len(offsets) - 1
    ends = np.repeat(offsets[1:], 2)
    text = np.insert(_CLEAN[data], ends, np.tile(np.array([0x20, 0], np.uint8), n))
    word = text > 0x20
    keep = word | (text == 0)
    keep[1:] |= word[:-1]
    text = text[keep]
    return text, np.concatenate([[0], np.cumsum(text == 0x20)[text == 0]])


def scan(column: pa.Array, matchers: Iterable[Matcher]) -> tuple[list[int], list[int], list[list]]:
    """For each text: words, words inside occurrences, and the items (sorted as strings) with occurring windows.

    Each matcher is taken once and searches all texts before the next one is, so that matchers may be built on the way."""
    parts, n_words = [], []
    for first, last, data, offsets in blocks(column):
        text, words_at = normalised(data, offsets)
        n_words += np.diff(words_at).tolist()
        parts.append((text, words_at, np.zeros(int(words_at[-1]) + 1, np.int32), [set() for _ in range(last - first)]))
    for matcher in matchers:
        for text, words_at, cover, found in parts:
            hits = matcher.search(text)
            if not hits:
                continue
            start, pattern = np.array(hits).T
            word = np.cumsum(text == 0x20)[start - 1] * (start > 0)
            np.add.at(cover, word, 1)
            np.add.at(cover, word + matcher.n_words[pattern], -1)
            for d, k in zip(np.searchsorted(words_at, word, "right") - 1, pattern):
                found[d].update(matcher.owners[k])
    n_hit, items = [], []
    for _, words_at, cover, found in parts:
        inside = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
        n_hit += np.diff(inside[words_at]).tolist()
        items += [sorted(x, key=str) for x in found]
    return n_words, n_hit, items


def _slices(benchmark: DataFrame, item_id: str, item_text: str, limit: int) -> Iterator[list]:
    """The items in slices of bounded size; one slice at a time is in the driver."""
    part, size = [], 0
    for item, text in benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).toLocalIterator():
        part.append((item, text))
        size += len(text or "") + 64
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def matchers_of(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", limit: int = SLICE_BYTES) -> list:
    """Broadcast variables, each with the items of one slice."""
    small_batches(benchmark.sparkSession)
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(part) for part in _slices(benchmark, item_id, item_text, limit)]


_ready: dict[int, Matcher] = {}


class _Lazy:
    """Matchers that are built when their turn comes, so that one slice at a time is in memory."""

    def __init__(self, shared: list):
        self.shared = shared

    def __iter__(self):
        return (Matcher(b.value) for b in self.shared)


def _matchers(shared: list):
    """A worker builds the matcher of a single slice once; of several, each anew for each PASS_BYTES of texts."""
    if len(shared) != 1:
        return _Lazy(shared)
    items = shared[0].value
    if id(items) not in _ready:
        _ready.clear()
        _ready[id(items)] = Matcher(items)
    return [_ready[id(items)]]


def _passes(batches: Iterator[pa.RecordBatch], shared: list) -> Iterator[pa.RecordBatch]:
    """The batches in portions; where the benchmark has several slices, portions together up to PASS_BYTES, so
    that building the tables of a slice is little beside searching with them."""
    if len(shared) < 2:
        yield from portions(batches)
        return
    held, size = [], 0
    for part in portions(batches):
        if held and size + part.nbytes > PASS_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += part.nbytes
    if held:
        yield pa.concat_batches(held)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean; items without a word match
    nothing; repeated items count once for each id; repeated document rows give a row
    each; a null item id is written `None`. With an empty benchmark all is clean.
    Texts are searched whole. Other columns, whatever their names, are not read."""
    shared = matchers_of(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _passes(batches, shared):
            n_words, n_hit, items = scan(batch.column(1), _matchers(shared))
            names = [[str(x) for x in own] for own in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
                 pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without any benchmark window, with all their columns, in one narrow pass."""
    shared = matchers_of(benchmark)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _passes(batches, shared):
            _, n_hit, _ = scan(batch.column(at), _matchers(shared))
            yield batch.filter(pa.array([x == 0 for x in n_hit], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
