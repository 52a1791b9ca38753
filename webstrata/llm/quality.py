"""Quality rules: hashed n-gram log-likelihood ratio of every document.

A text's tokens are its runs of letters and digits and its runs of other signs, so a symbol
stuck to a word is a token of its own. Tokens and pairs of neighbours are hashed to BUCKETS
buckets, and two multinomials over the buckets are counted: one over all documents (the raw
corpus) and one over the trusted documents. A document's score is the mean over its n-grams of

    log((trusted[b] / all trusted + SMOOTHING) / (raw[b] / all raw + SMOOTHING))

where its own n-grams are left out of both counts, so every document, trusted or not, is judged
by the other ones only, and words that it alone has say nothing. Only shares enter, and the mean
is over n-grams: a score depends neither on a text's length nor on the table's size. A document
is kept if it passes the base rules (at least MIN_WORDS words, at most half of them in repeated
three-word windows) and its score is at least THRESHOLD, that is if its n-grams are on average
at most a factor exp(0.25) rarer in the trusted documents than in the corpus.

Raw counts cover every document. The trusted set is a bounded sample of labelled ids
(TRUSTED_IDS, chosen by hash), so its size doesn't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.shared import small_batches
from webstrata.llm.textbytes import ASCII_SPACE, blocks, ids_of, keyed_hashes, mix, numbered, portions, whole_windows, words

BUCKETS = 1 << 16
SMOOTHING = 1e-4
THRESHOLD = -0.25
MIN_WORDS = 50
TRUSTED_IDS = 50_000

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CHAR = np.ones(256, np.int64)
_CHAR[0x80:0xC0] = 0  # continuation bytes

_SPACE, _WORD, _SIGN = 0, 1, 2
_KIND = np.full(256, _SIGN, np.int8)
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _WORD
_KIND[ASCII_SPACE] = _SPACE


class _Words:
    """The words of a block of texts: place, text number and hashes of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.first = words(ASCII_SPACE[data], offsets)
        self.text = numbered(np.diff(self.first))
        self.hash, self.hash2 = keyed_hashes(data, self.starts, self.ends)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each token and each pair of neighbouring tokens of a block of texts."""
    kind = _KIND[data]
    opens = np.ones(len(data), bool)
    opens[1:] = kind[1:] != kind[:-1]
    opens[offsets[offsets < len(data)]] = True
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], len(data))
    token = kind[starts] != _SPACE
    starts, ends = starts[token], ends[token]
    first = np.searchsorted(starts, offsets)
    one, _ = keyed_hashes(data, starts, ends)
    pair, of = whole_windows(first, 2)
    two = mix(one[pair] * np.uint64(3) + one[pair + 1]) if len(pair) else one[:0]
    return (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([numbered(np.diff(first)), of])


@dataclass
class Counts:
    """n-grams of each bucket in the corpus and in the trusted documents, and the trusted ids (sorted)."""

    raw: np.ndarray
    good: np.ndarray
    trusted: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The score of each text of a block; 0 where nothing is left of either count without the text."""
        n = len(offsets) - 1
        own = np.isin(ids, self.trusted).astype(np.int64)
        bucket, text = grams(data, offsets)
        size = np.bincount(text, minlength=n)
        key, count = np.unique(text * BUCKETS + bucket, return_counts=True)
        text, bucket = key // BUCKETS, key % BUCKETS
        good_rest, raw_rest = self.good.sum() - size * own, self.raw.sum() - size
        judged = (good_rest > 0) & (raw_rest > 0)
        share = lambda part, whole: part / np.maximum(1, whole)[text] + SMOOTHING
        ratio = np.log(share(self.good[bucket] - count * own[text], good_rest) / share(self.raw[bucket] - count, raw_rest))
        return np.where(judged, np.bincount(text, weights=ratio * count, minlength=n) / np.maximum(1, size), 0.0)


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_IDS) -> list[int]:
    """Ids of at most `limit` documents labelled good, chosen by hash. What is toxic is another question."""
    rows = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("i")).distinct()
    return sorted(r.i for r in rows.orderBy(F.xxhash64("i"), "i").limit(limit).collect())


def gram_counts(docs: DataFrame, trusted: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n-grams per bucket: bucket, raw, trusted. Each task sends one row for a bucket."""
    ids = docs.sparkSession.sparkContext.broadcast(np.array(trusted, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in portions(batches):
            own = np.isin(ids_of(batch.column(0)), ids.value)
            for first, last, data, offsets in blocks(batch.column(1)):
                bucket, text = grams(data, offsets)
                raw += np.bincount(bucket, minlength=BUCKETS)
                good += np.bincount(bucket[own[first:last][text]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "trusted"])

    counted = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "bucket long, raw long, trusted long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Counts:
    """The counts over all documents; those of the trusted ones are 0 if there are none."""
    small_batches(docs.sparkSession)
    trusted = trusted_ids(labels)
    out = Counts(np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), np.array(trusted, np.int64))
    for r in gram_counts(docs, trusted, id_col, text_col).collect():  # BUCKETS rows at most
        out.raw[r.bucket], out.good[r.bucket] = r.raw, r.trusted
    return out


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, ws: _Words) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line of the text."""
    breaks = np.flatnonzero(data == 0x0A)
    n = len(offsets) - 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    of_break = np.searchsorted(offsets, breaks, "right") - 1
    text = np.sort(np.concatenate([np.arange(n), of_break]), kind="stable")
    ends = np.empty(len(starts), np.int64)
    same = np.zeros(len(starts), bool)
    same[:-1] = text[1:] == text[:-1]
    ends[:-1] = np.where(same[:-1], starts[1:] - 1, offsets[text[:-1] + 1])
    ends[-1:] = offsets[-1]
    has_word = np.searchsorted(ws.starts, ends) > np.searchsorted(ws.starts, starts)
    starts, ends, text = starts[has_word], ends[has_word], text[has_word]
    h, g = keyed_hashes(data, starts, ends)
    order = np.lexsort((g, h, text))
    again = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order][1:][again], minlength=n)


def _repeated_words(ws: _Words, n: int) -> np.ndarray:
    """Per text: words inside three-word windows that the text has twice or more."""
    start, text = whole_windows(ws.first, 3)
    if len(start) == 0:
        return np.zeros(n, np.int64)
    three = lambda w: mix(mix(w[start] * np.uint64(3) + w[start + 1]) * np.uint64(5) + w[start + 2])
    key, check = three(ws.hash) ^ mix(text.astype(np.uint64) + np.uint64(1)), three(ws.hash2)
    order = np.argsort(key, kind="stable")
    key, check, text = key[order], check[order], text[order]
    same = (key[1:] == key[:-1]) & (check[1:] == check[:-1]) & (text[1:] == text[:-1])
    often = np.zeros(len(key), bool)
    often[1:] |= same
    often[:-1] |= same
    cover = np.zeros(len(ws.starts) + 1, np.int64)
    at = start[order[often]]
    for k in range(3):
        cover[at + k] = 1
    return np.bincount(ws.text, weights=cover[:-1], minlength=n).astype(np.int64)


def measures(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, known: Counts) -> dict[str, np.ndarray]:
    """The measures and the verdict of each text of a block."""
    n = len(offsets) - 1
    ws = _Words(data, offsets)
    total = lambda per_byte: np.concatenate([[0], np.cumsum(per_byte)])
    chars, symbols = total(_CHAR[data]), total(_SYMBOL[data])
    out = {"n_words": np.diff(ws.first), "word_chars": np.bincount(ws.text, weights=chars[ws.ends] - chars[ws.starts], minlength=n).astype(np.int64)}
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]
    out["n_dup_lines"] = _duplicate_lines(data, offsets, ws)
    out["n_repeat_words"] = _repeated_words(ws, n)
    out["score"] = known.scores(data, offsets, ids)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["score"] >= THRESHOLD)
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, score.

    Null and empty texts have no words and fail the base rules; texts are read whole, whatever
    their length. Labels without a document count for nothing; ids labelled several times count
    once if any label is good; without trusted documents, and for the only document of either
    count, scores are 0. Repeated rows give a row each and count each; an empty table gives none.
    Other columns are not read."""
    known = docs.sparkSession.sparkContext.broadcast(counts(docs, labels, id_col, text_col))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            ids = ids_of(batch.column(0))
            parts = [measures(data, offsets, ids[first:last], known.value) for first, last, data, offsets in blocks(batch.column(1))]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate([p[k] for p in parts])) for k in names)], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    )


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document rows that `judge` keeps, with all their columns, whatever their names.

    Null, empty and very long texts, labels, repeated rows and empty tables: as in `judge`."""
    known = docs.sparkSession.sparkContext.broadcast(counts(docs, labels, id_col, text_col))
    id_at, at = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            ids = ids_of(batch.column(id_at))
            kept = [measures(data, offsets, ids[first:last], known.value)["kept"] for first, last, data, offsets in blocks(batch.column(at))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
