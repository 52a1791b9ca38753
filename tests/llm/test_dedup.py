import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import ODD, frame, random_docs
from webstrata.llm import chunk_dedup, minhash, suffix_dedup
from webstrata.llm import spans as S


def removed_bytes(docs):
    """Brute force: per id (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen = {}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    for d, t in order:
        b = (t or "").encode()
        for s in range(len(b) - 99):
            seen.setdefault(b[s : s + 100], (d, s))
    out = {}
    for d, t in order:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if seen[b[s : s + 100]] != (d, s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup_equals_brute_force(spark, hot):
    docs = random_docs() + ODD + [(910, "ab" * 300), (911, ("x" * 37 + "y") * 9)]
    df = frame(spark, docs)
    rows = S.report(df, suffix_dedup.repeated_spans(df, hot=hot), "doc_id", "text").collect()
    expected = removed_bytes(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id], r


def test_longest_previous_factors():
    data = np.array([b"b" * 100, b"a" * 100, b"b" * 100, b"c" * 100, b"a" * 99 + b"b"], "S100")
    assert suffix_dedup.longest_previous_factors(data, np.array([3, 2, 1, 0, 4])).tolist() == [100, 0, 0, 0, 99]
    assert suffix_dedup.longest_previous_factors(data[:0], np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize("letters, n, positions", [("ab", 1, 1), ("ab", 300, 300), ("ab\0", 257, 40), ("a", 64, 64), ("abcdefgh", 500, 500)])
def test_longest_previous_factors_equal_brute_force(letters, n, positions):
    r = random.Random(n)
    strings = ["".join(r.choices(letters, k=12)).encode() for _ in range(n)]
    position = [r.randrange(positions) for _ in range(n)]
    shared = lambda x, y: next((k for k in range(12) if x[k] != y[k]), 12)
    expected = [max((shared(x, y) for y, q in zip(strings, position) if q < p), default=0) for x, p in zip(strings, position)]
    assert suffix_dedup.longest_previous_factors(np.array(strings, "S12"), np.array(position)).tolist() == expected


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert suffix_dedup.dedup_report(empty).collect() == []
    assert chunk_dedup.dedup_report(empty).collect() == []
    assert minhash.classes(empty).collect() == []


def test_cut_out_keeps_columns_and_characters(spark):
    passage = "".join(random.Random(1).choices("éàüßñ", k=120))
    docs = [(1, "x" + passage), (2, "yy" + passage + "z"), (3, None)]
    out = {r.doc_id: r for r in suffix_dedup.without_repeats(frame(spark, docs), chars_col=None).collect()}
    assert out[1].text == docs[0][1] and out[3].text is None
    assert out[2].text == "yyz" and (out[2].spans, out[2].id, out[2].bucket) == (1, "x", 2.5)


GEAR = [int(x) for x in np.random.Generator(np.random.PCG64(41)).integers(0, 1 << 32, 256, dtype=np.uint32)]


def chunks_of(b):
    """Chunks byte by byte: the least gear hash of 24 places on either side cuts."""
    h = [None if p < 16 else min(sum(GEAR[b[p - j]] << j for j in range(16)) % (1 << 32), (1 << 32) - 2) for p in range(len(b))]
    ends, last = [], -100
    for p in range(16, len(b)):
        if h[p] == min(x for x in h[max(0, p - 24) : p + 25] if x is not None) and p - last >= 12:
            ends.append(p + 1)
            last = p
    edges = [0, *[e for e in ends if e < len(b)], len(b)]
    return [(s + k, min(s + k + 4096, e), b[s + k : min(s + k + 4096, e)]) for s, e in zip(edges, edges[1:]) for k in range(0, e - s, 4096)]


def removed_chunks(docs, least):
    seen, out, done = set(), {}, set()
    for d, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        if d in done:
            continue
        done.add(d)
        b = (t or "").encode()
        runs = []
        for s, e, c in chunks_of(b) if b else []:
            if c in seen:
                if runs and runs[-1][1] == s:
                    runs[-1] = (runs[-1][0], e)
                else:
                    runs.append((s, e))
            seen.add(c)
        runs = [r for r in runs if r[1] - r[0] >= least]
        out[d] = (len(b), sum(e - s for s, e in runs), len(runs), hashlib.sha256(S.kept_bytes(b, runs)).hexdigest())
    return out


CHUNKY = [(930, "ab" * 900), (931, "x " + "abc" * 500 + "ab" * 40), (932, "a" * 9000), (933, "the the " * 300 + "end"), (934, "")]


@pytest.mark.parametrize("least", [1, 100])
def test_chunk_dedup_equals_brute_force(spark, least):
    docs = random_docs(seed=9) + ODD + CHUNKY
    expected = removed_chunks(docs, least)
    rows = chunk_dedup.dedup_report(frame(spark, docs), least=least).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id], r
    kept = chunk_dedup.without_repeats(frame(spark, docs), chars_col=None, least=least)
    assert kept.columns == frame(spark, docs).columns
    assert all(len((r.text or "").encode()) >= expected[r.doc_id][0] - expected[r.doc_id][1] for r in kept.collect())


def test_chunks_resist_insertions():
    b = " ".join(t for _, t in random_docs(40)).encode()
    before, after = {c for *_, c in chunks_of(b)}, {c for *_, c in chunks_of(b[:1000] + b"something new" + b[1000:])}
    assert len(before - after) <= 3
    assert all(len(c) <= chunk_dedup.MAX_CHUNK for *_, c in chunks_of(b"a" * 20_000))


def test_cuts_do_not_depend_on_the_block():
    texts = [(t or "").encode() for _, t in random_docs(30) + ODD + CHUNKY]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    start, end = chunk_dedup.cuts(data, offsets)
    assert [(s, e) for s, e in zip(start.tolist(), end.tolist())] == [(o + s, o + e) for o, t in zip(offsets.tolist(), texts) for s, e, _ in chunks_of(t) if t]


def test_repeated_passages_of_short_periods_are_found(spark):
    """Passages of 300 bytes of any period are removed from the second of two contexts but for their ends."""
    rng = random.Random(8)
    docs, long = [], lambda: "".join(rng.choices("abcdefgh ", k=200))
    for p in range(1, 40):
        passage = ("".join(rng.choices("abcdefghijk ", k=p)) * 300)[:300]
        docs += [(2 * p, long() + passage + long()), (2 * p + 1, long() + passage + long())]
    rows = {r.doc_id: r for r in chunk_dedup.dedup_report(frame(spark, docs), least=100).collect()}
    assert all(150 <= rows[2 * p + 1].n_removed <= 300 for p in range(1, 40))


def test_clashing_columns_and_long_texts(spark):
    """Columns named like the operators' own stay as they are, and texts over 1 MB are read whole."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400_000)]
    passage = " ".join("".join(rng.choices("ijklmnop", k=6)) for _ in range(60))
    docs = [(1, " ".join(words[:200_000]) + passage), (2, passage + " ".join(words[200_000:])), (3, None)]
    for operator in (suffix_dedup.without_repeats, chunk_dedup.without_repeats):
        out = {r.doc_id: r for r in operator(frame(spark, docs), chars_col="Spans_of" if operator is None else None).collect()}
        assert out[1].text == docs[0][1] and out[3].text is None
        assert len(passage) - 110 <= len(docs[1][1]) - len(out[2].text) <= len(passage) and out[2].text.endswith(words[-1])
        assert (out[2].spans, out[2].id, out[2].bucket, out[2].Spans_of, out[2]._spans) == (1, "x", 2.5, True, "y")
    kept = minhash.one_of_each(frame(spark, docs + [(4, docs[0][1] + " more")])).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3] and all(r.kept_id == 0 for r in kept)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def component_ids(docs, percent=85):
    sets = [(d, shingles(t)) for d, t in docs]
    low = lambda d: (d is not None, d or 0)
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a != b and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)), key=low)
                root[q] = p
    return {d: (len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize("members, size, hot", [(256, 4 << 20, 8), (4, 60, 8), (1, 1, 1)])
def test_minhash_equals_all_pairs(spark, members, size, hot, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(minhash, "HOT_BLOCKS", hot)
    monkeypatch.setattr(minhash, "BLOCK_WORDS", size)
    docs = random_docs(220, seed=12) + ODD
    expected = component_ids(docs)
    rows = minhash.classes(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id], r
        assert r.kept == (r.component_id == r.doc_id)


def template_docs(n=240, seed=3):
    """Texts from one template: most share a band, few are similar, and some stand in chains."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(200)]
    docs = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([2, 4, 9, 12])):
            words[rng.randrange(200)] = f"x{rng.randrange(4000)}"
        docs.append((i, " ".join(words)))
        if i % 9 == 0 and i:
            near = docs[-2][1].split()
            near[rng.randrange(200)] = f"y{i}"
            docs[-1] = (i, " ".join(near))
    return docs


def test_minhash_of_templates(spark, monkeypatch):
    """Large open buckets go by rare shingles: fewer pairs of sets meet, and no link is lost."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 8)
    monkeypatch.setattr(minhash, "HOT_BLOCKS", 1)
    met = []
    real = minhash._by_rare_shingles
    monkeypatch.setattr(minhash, "_by_rare_shingles", lambda *a: met.append(1) or real(*a))
    docs = template_docs()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(frame(spark, docs)).collect()} == component_ids(docs)
    assert met


def test_minhash_of_repeated_ids(spark):
    """Rows of one id with different texts: each by its own text, always the same."""
    w = [f"w{i}" for i in range(60)]
    docs = [(5, " ".join(w[:40])), (5, " ".join(w[20:])), (3, " ".join(w[:40])), (9, " ".join(w[20:])), (11, " ".join(w[20:] + ["z"])), (5, "")]
    rows = {tuple(r) for r in minhash.classes(frame(spark, docs)).select("doc_id", "n_shingles", "component_id").collect()}
    assert rows == {(5, 36, 3), (5, 36, 5), (3, 36, 3), (9, 36, 5), (11, 37, 5), (5, 0, 5)}
    assert rows == {tuple(r) for r in minhash.classes(frame(spark, docs[::-1])).select("doc_id", "n_shingles", "component_id").collect()}


def test_open_groups_know_equal_members(spark):
    ids = [(b, i, i % 3, 7) for b in (1, 2) for i in range(6)] + [(3, i, i % 3, 7) for i in (0, 1, 2, 3, 4, 6)] + [(4, 8, 1, 7), (4, 11, 1, 7)]
    rows = minhash._open_groups(spark.createDataFrame(ids, "bucket long, id long, label long, n long")).collect()
    assert sorted({r.bucket for r in rows}) == [1, 3]
    assert {(r.n_main, r.n_rest, r.words_main) for r in rows if r.bucket == 1} == {(2, 4, 14)}


def test_minhash_chains(spark):
    """Each text is linked with the next only: the component follows the chain."""
    w = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(w[5 * i : 5 * i + 150])) for i in range(30)]
    expected = component_ids(docs)
    assert len({c for _, c in expected.values()}) == 1
    assert {r.component_id for r in minhash.classes(frame(spark, docs)).collect()} == {0}


def test_products_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    got = minhash.products(sets, columns=16)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert got[i, j] == len(np.intersect1d(a, b))


def test_groups_over_batches():
    import pyarrow as pa

    keys = [1, 1, 2, 2, 2, 3, 4, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(list(range(a, b)))], ["k", "v"]) for a, b in ((0, 1), (1, 4), (4, 4), (4, 7), (7, 8))]
    got = defaultdict(list)
    n = 0
    for t in minhash.groups(iter(batches), 1):
        n += 1
        got[t.column(0)[0].as_py()] += t.column(1).to_pylist()
    assert n == 4 and got == {1: [0, 1], 2: [2, 3, 4], 3: [5], 4: [6, 7]}


def test_rows_of_slices():
    """Spans of a slice of a batch are those of its own rows."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    own = [[{"s": i, "e": i + 2}, {"s": i + 1, "e": i + 3}] if i % 3 else None for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(["x" * 30] * 20), pa.array(own, kind)], ["i", "t", "spans"])
    got = [spans for k in range(0, 20, 7) for _, spans in S._rows(batch.slice(k, 7), 1, 2, 1)]
    assert got == [[(i, i + 3)] if i % 3 else [] for i in range(20)]
