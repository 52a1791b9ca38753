"""Removal of repeated 100-byte strings by longest-previous-factor arrays.

A byte goes if a string of MATCH bytes covers it that also starts earlier, in a document
with a smaller id or before in the same one; the first copy stays. Sorting all suffixes
of a corpus in one order is neither needed nor possible in bounded memory, because only
strings that occur twice matter and equal strings can be brought together by content:

1. Winnowing: of the 24-byte grams of each 100-byte string the one with the least hash is
   its anchor. Equal strings have equal anchors at equal places, so all copies of a string
   meet under one anchor. An anchor's context is the union of the strings that hold it.
2. Anchors (narrow rows: hash of gram, hash of context, id, position) are dealt by gram
   and sorted. All copies of a context but the first are removed whole. A gram with one
   context is settled with that, as all inside of repeated passages is; so only the first
   copies of contexts at the edges of repeats are left.
3. The bytes of those contexts are fetched and put in suffix order (to the depth of MATCH
   bytes). There the previous and the next smaller position of each suffix and the bytes
   shared with them give the array of longest previous factors; a string whose factor is
   MATCH bytes long goes.

Copies of a context within one batch are settled before the shuffle, so a hot passage
sends one row for each batch. Grams with more than HOT edge contexts don't go to one task:
their strings are compared by 128-bit hashes under a partial minimum instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm import spans as S
from webstrata.llm.shared import small_batches, written
from webstrata.llm.textbytes import blocks, ids_of, mix, prefix_hashes, slice_hashes

MATCH = 100
GRAM = 24
HOT = 20_000
GROUP_BYTES = 1 << 19

_REACH = MATCH - GRAM + 1  # grams in a string


def sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """least(values[i : i + width]) for each i where that lies inside."""
    have = 1
    while 2 * have <= width:
        values = least(values[: len(values) - have], values[have:])
        have *= 2
    return least(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash of gram, hash of context, text, position in the text) of the anchors of a block's texts."""
    none = np.zeros(0, np.int64)
    if len(data) < MATCH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    sums = prefix_hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = slice_hashes(sums, at, at + GRAM)
    least = sliding(gram, _REACH, np.minimum)  # for each string
    inside = np.zeros(len(least) + 1, np.int64)
    long = np.diff(offsets) >= MATCH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, (offsets[1:] - MATCH + 1)[long], -1)
    least = np.where(np.cumsum(inside[:-1]) > 0, least, 0)
    pad = np.zeros(_REACH - 1, np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), _REACH, np.maximum)  # over the strings that hold a gram
    p = np.flatnonzero((most == gram) & (most > 0))
    text = np.searchsorted(offsets, p, "right") - 1
    left, right = np.maximum(offsets[text], p + GRAM - MATCH), np.minimum(offsets[text + 1], p + MATCH)
    context = mix(slice_hashes(sums, left, right) + (p - left).astype(np.uint64))
    return gram[p], context, text, p - offsets[text]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = ids_of(batch.column(0))
        parts = []
        for first, last, data, offsets in blocks(batch.column(1)):
            gram, context, text, at = anchors(data, offsets)
            parts.append((gram, context, own[first:last][text], at))
        if not parts:
            continue
        gram, context, ident, at = (np.concatenate(x) for x in zip(*parts))
        yield settled(gram, context, ident, at)


def settled(gram: np.ndarray, context: np.ndarray, ident: np.ndarray, at: np.ndarray, size: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows (deal, gram, context, id, at, known[, size]): copies of an earlier row of this
    batch are known to be repeats and are dealt anywhere; others by their gram."""
    order = np.lexsort((at, ident, context, gram))
    gram, context, ident, at = gram[order], context[order], ident[order], at[order]
    same = np.zeros(len(gram), bool)
    same[1:] = (gram[1:] == gram[:-1]) & (context[1:] == context[:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(gram)))) if len(gram) else order
    same &= (ident != ident[head]) | (at != at[head])
    deal = np.where(same, mix(ident.astype(np.uint64) * np.uint64(31) + at.astype(np.uint64)), gram)
    columns = [deal.view(np.int64), gram.view(np.int64), context.view(np.int64), ident, at]
    names = ["deal", "gram", "context", "id", "at"]
    if size is not None:
        columns.append(size[order])
        names.append("size")
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(same)], [*names, "known"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by gram, context, id, at: (id, at, gram, repeat). Repeats are all rows of a
    context but its first; others are the first rows of contexts whose gram has several contexts."""
    head = np.full((4, 1), -1)  # gram, context, id, at of the first row of the current context
    lead = np.full((4, 1), -1)  # of the current gram
    started = led = False  # is there a current gram; is its first row sent
    for batch in batches:
        known = batch.column(5).to_numpy(zero_copy_only=False)
        rows = np.stack([batch.column(k).to_numpy() for k in range(1, 5)])
        out_id, out_at, out_gram, out_repeat = [rows[2][known]], [rows[3][known]], [rows[0][known]], [np.ones(known.sum(), bool)]
        rows = rows[:, ~known]
        if rows.shape[1]:
            rows = np.concatenate([head, rows], axis=1)
            i = np.arange(rows.shape[1])
            new_gram = np.ones(len(i), bool)
            new_gram[1:] = rows[0][1:] != rows[0][:-1]
            if not started:
                new_gram[1] = True
            new = new_gram.copy()
            new[1:] |= rows[1][1:] != rows[1][:-1]
            of = np.maximum.accumulate(np.where(new, i, 0))
            repeat = ~new & ((rows[2] != rows[2][of]) | (rows[3] != rows[3][of]))
            edge = new & ~new_gram
            repeat[0] = edge[0] = False
            gram_of = np.maximum.accumulate(np.where(new_gram, i, 0))
            firsts = np.unique(gram_of[edge])
            if len(firsts) and firsts[0] == 0:
                if not led:
                    out_id.append(lead[2]), out_at.append(lead[3]), out_gram.append(lead[0]), out_repeat.append(np.zeros(1, bool))
                led = True
                firsts = firsts[1:]
            for pick, flag in ((repeat, True), (edge, False), (firsts, False)):
                out_id.append(rows[2][pick]), out_at.append(rows[3][pick]), out_gram.append(rows[0][pick])
                out_repeat.append(np.full(len(out_id[-1]), flag))
            head = rows[:, of[-1] : of[-1] + 1]
            if gram_of[-1] > 0:
                lead, led = rows[:, gram_of[-1] : gram_of[-1] + 1], gram_of[-1] in firsts
            started = True
        yield pa.RecordBatch.from_arrays([*map(pa.array, (np.concatenate(x) for x in (out_id, out_at, out_gram, out_repeat)))], ["id", "at", "gram", "repeat"])


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, text, edges): (gram, id, start, bytes) of each edge's context."""
    for batch in batches:
        ident, gram, start, body = [], [], [], []
        for i, text, edges in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()):
            for e in edges:
                left = max(0, e["at"] + GRAM - MATCH)
                ident.append(i)
                gram.append(e["gram"])
                start.append(left)
                body.append(text[left : e["at"] + MATCH])
        yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(ident, pa.int64()), pa.array(start, pa.int64()), pa.array(body, pa.binary())], ["gram", "id", "start", "body"])


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Least values of all runs of 1, 2, 4, ... places: entry s of level k is min(values[s : s + 2**k])."""
    levels = [values]
    while len(levels[-1]) > (width := 1 << (len(levels) - 1)):
        levels.append(np.minimum(levels[-1][:-width], levels[-1][width:]))
    return levels


def _shared_with_previous_smaller(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place in suffix order: the bytes shared with the last place before it that has a smaller
    position; 0 if there is none. common[r] is what places r - 1 and r share."""
    n = len(position)
    place, back = np.arange(n), np.zeros(n, np.int64)  # back: places before that have no smaller position
    for k, least in reversed([*enumerate(_minima(position))]):
        start = place - back - (1 << k)
        ok = np.flatnonzero(start >= 0)
        ok = ok[least[start[ok]] >= position[ok]]
        back[ok] += 1 << k
    out = np.zeros(n, common.dtype)
    have = np.flatnonzero(back < place)
    level = np.frexp((back[have] + 1).astype(np.float64))[1] - 1  # the longest run that fits between the two
    for k, least in enumerate(_minima(common)):
        at = have[level == k]
        out[at] = np.minimum(least[at - back[at]], least[at + 1 - (1 << k)])
    return out


def longest_previous_factors(windows: np.ndarray, position: np.ndarray) -> np.ndarray:
    """The longest previous factor, up to their length, of each of some strings of equal length.

    Strings are put in suffix order, and the bytes that neighbours share are counted. The longest factor that
    also starts at a smaller position is shared with the nearest place, before or after, that has a smaller
    position: whatever is shared with one farther off is shared with that one too. Equal positions are the
    same place of a text and aren't before each other."""
    n, width = len(windows), windows.dtype.itemsize
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(windows, kind="stable")
    body, pos = windows[order].view(np.uint8).reshape(n, width), position[order]
    differ = body[1:] != body[:-1]
    common = np.zeros(n, np.uint16)
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    before = _shared_with_previous_smaller(pos, common)
    after = _shared_with_previous_smaller(pos[::-1], np.concatenate([common[:1], common[:0:-1]]))[::-1]
    out = np.empty(n, np.int64)
    out[order] = np.maximum(before, after)
    return out


def _windows(body: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All MATCH-byte strings of some byte strings: (strings, number of their source, offset there)."""
    lengths = np.array([len(b) for b in body])
    count = np.maximum(0, lengths - MATCH + 1)
    source = np.repeat(np.arange(len(body)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(lengths) - lengths)[source] + offset
    data = np.frombuffer(b"".join(body), np.uint8)
    if not len(start):
        return np.zeros(0, f"S{MATCH}"), source, offset
    rows = np.lib.stride_tricks.sliding_window_view(data, MATCH)[start]
    return np.ascontiguousarray(rows).view(f"S{MATCH}").ravel(), source, offset


def _spans(ident: np.ndarray, start: np.ndarray, goes: np.ndarray, source: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    """Runs of removed strings as (id, s, e)."""
    source, offset = source[goes], offset[goes]
    opens = np.ones(len(source), bool)
    opens[1:] = (source[1:] != source[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(opens)
    last = np.concatenate([first[1:], [len(source)]])[: len(first)] - 1
    s = start[source[first]] + offset[first]
    return pa.RecordBatch.from_arrays([pa.array(ident[source[first]]), pa.array(s), pa.array(start[source[first]] + offset[last] + MATCH)], ["id", "s", "e"])


def _factor_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts sorted by gram: the spans whose strings have a previous factor. Whole
    grams are taken together, in portions of about GROUP_BYTES."""
    held: list[pa.RecordBatch] = []
    size = 0

    def done() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ident, start = table.column(1).to_numpy(), table.column(2).to_numpy()
        strings, source, offset = _windows(table.column(3).to_pylist())
        where = np.zeros(len(source), np.dtype([("id", np.int64), ("at", np.int64)]))
        where["id"], where["at"] = ident[source], start[source] + offset
        order = np.lexsort((where["at"], where["id"]))
        new = np.ones(len(order), np.int64)
        new[1:] = where[order][1:] != where[order][:-1]
        position = np.empty(len(order), np.int64)
        position[order] = np.cumsum(new)
        return _spans(ident, start, longest_previous_factors(strings, position) == MATCH, source, offset)

    last = None
    for batch in batches:
        gram = batch.column(0).to_numpy()
        if not len(gram):
            continue
        cuts = [0, *(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), len(gram)]
        a = 0
        for b, c in zip(cuts[:-1], cuts[1:]):
            if b != a or last is not None and gram[b] != last:
                # a gram begins at b: what is held may go
                if b > a:
                    held.append(batch.slice(a, b - a))
                    size += held[-1].column(3).nbytes
                    a = b
                if size >= GROUP_BYTES:
                    yield done()
                    held, size = [], 0
            last = gram[b]
        held.append(batch.slice(a))
        size += held[-1].column(3).nbytes
    if held:
        yield done()


def _hashed_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each MATCH-byte string of the contexts of hot grams: (h, g: its 128-bit hash, id, at)."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            strings, source, offset = _windows(part.column(3).to_pylist())
            raw = strings.view(f"V{MATCH}").tolist() if len(strings) else []
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in raw), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(part.column(1).to_numpy()[source]), pa.array(part.column(2).to_numpy()[source] + offset)], ["h", "g", "id", "at"]
            )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, s, e): byte spans, which may overlap, whose union is to be removed."""
    small_batches(docs.sparkSession)
    texts = docs.select(S.key(docs, id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.mapInArrow(_anchor_rows, "deal long, gram long, context long, id long, at long, known boolean")
    dealt = rows.repartition("deal").sortWithinPartitions("gram", "context", "id", "at")
    found = written(dealt.mapInArrow(_repeats, "id long, at long, gram long, repeat boolean"))
    whole = found.where("repeat").select("id", F.greatest(F.col("at") + (GRAM - MATCH), F.lit(0)).alias("s"), (F.col("at") + MATCH).alias("e"))

    edges = found.where("not repeat")
    own = edges.groupBy("id").agg(F.collect_list(F.struct("at", "gram")).alias("edges"))
    context = texts.join(own, "id").select("id", "text", "edges").mapInArrow(_context_rows, "gram long, id long, start long, body binary")
    many = edges.groupBy("gram").count().where(F.col("count") > hot).select("gram")
    if many.isEmpty():
        calm, strings = context, None
    else:
        context, many = written(context), written(many)
        calm = context.join(many, "gram", "left_anti")
        strings = written(context.join(many, "gram", "left_semi").select("gram", "id", "start", "body").mapInArrow(_hashed_strings, "h long, g long, id long, at long"))
    out = calm.select("gram", "id", "start", "body").repartition("gram").sortWithinPartitions("gram").mapInArrow(_factor_spans, "id long, s long, e long")
    out = whole.unionByName(out)
    if strings is not None:
        first = strings.groupBy("h", "g").agg(F.min(F.struct("id", "at")).alias("first"))
        later = strings.join(first, ["h", "g"]).where(F.struct("id", "at") > F.col("first"))
        out = out.unionByName(later.select("id", F.col("at").alias("s"), (F.col("at") + MATCH).alias("e")))
    return out


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts have no bytes. A null id is before all others. Rows that share an
    id are taken for one document: none of them is before the other, and what is removed
    from one by its place is removed from all. Texts are judged whole, matches never cross
    them, and other columns are not read."""
    return S.report(docs, repeated_spans(docs, id_col, text_col), id_col, text_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents without the repeated bytes, with all their columns; characters are not cut."""
    return S.cut_out(docs, repeated_spans(docs, id_col, text_col), id_col, text_col, chars_col)
