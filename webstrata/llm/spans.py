"""Spans of bytes to be removed from documents, and their removal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm.textbytes import NULL_ID, portions


def key(docs: DataFrame, id_col: str) -> Column:
    """A document's id as a join key and sort key: null ids become NULL_ID."""
    return F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID))


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """All documents with an array of their spans (id, s, e) as one more, last column, whose name is new."""
    taken = {c.lower() for c in docs.columns}
    name = "spans"
    while {name, f"{name}_of"} & taken:
        name = f"_{name}"
    own = spans.groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias(name)).withColumnRenamed("id", f"{name}_of")
    return docs.join(own, key(docs, id_col) == own[f"{name}_of"], "left").drop(f"{name}_of"), name


def union(spans: pa.Scalar | None, n: int, least: int = 1) -> list[tuple[int, int]]:
    """Spans clipped to n bytes and joined where they touch or overlap; joined ones under `least` bytes go."""
    if spans is None or not len(spans):
        return []
    s, e = (np.clip(spans.field(k).to_numpy(zero_copy_only=False), 0, n) for k in (0, 1))
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    opens = np.concatenate([[True], s[1:] > e[:-1]])
    first = np.flatnonzero(opens)
    last = np.concatenate([first[1:], [len(s)]]) - 1
    return [(a, b) for a, b in zip(s[first].tolist(), e[last].tolist()) if b - a >= least]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _rows(batch: pa.RecordBatch, text_at: int, span_at: int, least: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    column = batch.column(span_at)
    values, offsets = column.values, column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i, text in enumerate(batch.column(text_at).cast(pa.large_binary()).fill_null(b"").to_pylist()):
        own = values.slice(int(offsets[i]), int(offsets[i + 1] - offsets[i])) if valid[i] else None
        yield text, union(own, len(text), least)


def report(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, least: int = 1) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    joined, name = with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), spans, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows = [(len(t), sum(b - a for a, b in x), len(x), hashlib.sha256(kept_bytes(t, x)).hexdigest()) for t, x in _rows(batch, 1, 2, least)]
            n, removed, count, digest = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return joined.select("doc_id", "text", name).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the characters that they cut."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def cut_out(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", least: int = 1) -> DataFrame:
    """The documents without the spans, with all their columns; chars_col, if there, gets the new length.

    A character of which a span has only some bytes stays. Null texts stay null."""
    joined, name = with_spans(docs, spans, id_col)
    at, n = docs.columns.index(text_col), len(docs.columns)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else -1
    chars_type = docs.schema[chars_at].dataType if chars_at >= 0 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = [kept_bytes(t, whole_characters(t, x)).decode() for t, x in _rows(batch, at, n, least)]
            null = batch.column(at).is_null()
            columns = [batch.column(k) for k in range(n)]
            columns[at] = pa.array(texts, pa.string(), mask=null.to_numpy(zero_copy_only=False))
            if chars_at >= 0:
                kind = pa.int64() if isinstance(chars_type, T.LongType) else columns[chars_at].type
                columns[chars_at] = pa.array([len(t) for t in texts], mask=null.to_numpy(zero_copy_only=False)).cast(kind)
            yield pa.RecordBatch.from_arrays(columns, docs_names)

    docs_names = list(docs.columns)
    return joined.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))
