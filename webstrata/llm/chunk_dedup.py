"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of a place is a sum over the last WINDOW bytes, each byte's code shifted by
its distance, so it depends on these bytes alone. A chunk ends where the hash is the least
within RADIUS places on either side; so cuts move with the text, insertions change the chunks
around them and no others, and chunks have about 2 * RADIUS bytes. Of equal least hashes
nearer than MIN_CHUNK, as texts of a short period have, the first and then each one MIN_CHUNK
bytes or more after the last cuts: at equal places of the period, so that these chunks are
equal too. A chunk of MAX_CHUNK bytes is cut. Chunks are compared by a 128-bit digest; all but
the first (by id, then place) are repeats. Neighbouring repeats form a run.

All runs go by default. Callers that don't want to lose short lines and phrases which
unrelated texts share give the least size of a run; LEAST_RUN is that of the query.

Digests are dealt by their value and sorted. Copies within one batch are settled before
the shuffle and dealt anywhere, so a hot chunk sends one row for each batch.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm import spans as S
from webstrata.llm.shared import small_batches
from webstrata.llm.suffix_dedup import settled, sliding
from webstrata.llm.textbytes import blocks, ids_of, portions

WINDOW = 16
RADIUS = 24
MIN_CHUNK = 12
MAX_CHUNK = 4096
LEAST_RUN = 100
"""Bytes: what counts as a repeated passage, as in suffix_dedup."""

_NEVER = np.uint32(0xFFFFFFFF)
_GEAR = np.random.Generator(np.random.PCG64(41)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum over j < WINDOW of the code of the byte j places before, shifted by j."""
    h, have = _GEAR[data], 1
    while have < WINDOW:
        more = h.copy()
        more[have:] += h[:-have] << np.uint32(have)
        h, have = more, 2 * have
    return h


def _thinned(at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Cuts without those that are nearer than MIN_CHUNK to the cut before in the same text."""
    near = np.zeros(len(at) + 1, bool)
    near[1:-1] = (np.diff(at) < MIN_CHUNK) & (text[1:] == text[:-1])
    if not near.any():
        return at
    keep = ~near[:-1]
    first = np.flatnonzero(near[1:] & keep)  # of each run of near ones
    for a, b in zip(first.tolist(), np.append(first[1:], len(at)).tolist()):
        run = at[a:b].tolist()
        k = 0
        while (k := bisect_left(run, run[k] + MIN_CHUNK, k + 1)) < len(run):
            if near[a + k]:
                keep[a + k] = True
    return at[keep]


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of a block's texts. Cuts don't depend on what stands around a
    text: the first WINDOW bytes of each are never cut after, and hashes of others don't count."""
    place = np.arange(len(data))
    text = np.searchsorted(offsets, place, "right") - 1
    h = np.minimum(gear(data), _NEVER - np.uint32(1))
    h[place - offsets[text] < WINDOW] = _NEVER
    apart = place + RADIUS * (text + 1)
    wide = np.full(len(data) + RADIUS * len(offsets), _NEVER)
    wide[apart] = h
    at = np.flatnonzero((sliding(wide, 2 * RADIUS + 1, np.minimum)[apart - RADIUS] == h) & (h != _NEVER))
    edges = np.unique(np.concatenate([_thinned(at, text[at]) + 1, offsets]))
    gap = np.diff(edges)
    extra = np.maximum(0, (gap - 1) // MAX_CHUNK)
    if extra.any():
        many = np.repeat(edges[:-1], extra) + MAX_CHUNK * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
        edges = np.sort(np.concatenate([edges, many]))
    return edges[:-1], edges[1:]


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        own = ids_of(batch.column(0))
        parts = []
        for first, last, data, offsets in blocks(batch.column(1)):
            if not len(data):
                continue
            start, end = cuts(data, offsets)
            text = np.searchsorted(offsets, start, "right") - 1
            raw = memoryview(data)
            digest = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())])
            digest = np.frombuffer(digest, np.uint64).reshape(-1, 2)
            parts.append((digest[:, 0], digest[:, 1], own[first:last][text], start - offsets[text], end - start))
        if parts:
            yield settled(*(np.concatenate(x) for x in zip(*parts)))


def _later_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (deal, gram, context, id, at, size, known) sorted by digest, id, at: the spans (id, s, e) of all copies but the first."""
    head = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, ident, at, size = (batch.column(k).to_numpy() for k in range(1, 6))
        known = batch.column(6).to_numpy(zero_copy_only=False)
        own = np.flatnonzero(~known)
        goes = known.copy()
        if len(own):
            rows = np.stack([a[own], b[own], ident[own], at[own]])
            if head is not None:
                rows = np.concatenate([head, rows], axis=1)
            i = np.arange(rows.shape[1])
            new = np.ones(len(i), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            of = np.maximum.accumulate(np.where(new, i, 0))
            later = ~new & ((rows[2] != rows[2][of]) | (rows[3] != rows[3][of]))
            goes[own] = later[len(later) - len(own) :]
            head = rows[:, of[-1] : of[-1] + 1]
        yield pa.RecordBatch.from_arrays([pa.array(ident[goes]), pa.array(at[goes]), pa.array(at[goes] + size[goes])], ["id", "s", "e"])


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, s, e): the chunks that are copies of an earlier one."""
    small_batches(docs.sparkSession)
    texts = docs.select(S.key(docs, id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.mapInArrow(_chunk_rows, "deal long, gram long, context long, id long, at long, size long, known boolean")
    return rows.repartition("deal").sortWithinPartitions("gram", "context", "id", "at").mapInArrow(_later_copies, "id long, s long, e long")


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, without the
    repeated runs of at least `least` bytes.

    Null and empty texts have no chunks. A null id is before all others. Rows that share an id
    are taken for one document, none of them before the other. Texts of any length are cut whole,
    chunks never cross them, an empty table gives no rows, and other columns, whatever their names,
    are not read."""
    return S.report(docs, repeated_chunks(docs, id_col, text_col), id_col, text_col, least)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", least: int = 1) -> DataFrame:
    """The documents without the repeated runs of at least `least` bytes, with all their columns, whatever
    their names; characters are not cut. Null texts stay null; all else as in `dedup_report`."""
    return S.cut_out(docs, repeated_chunks(docs, id_col, text_col), id_col, text_col, chars_col, least)
