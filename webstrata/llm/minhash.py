"""Near-duplicate documents by circulant MinHash, with exact Jaccard verification.

Two permutations give all signature coordinates: the first scatters a shingle to a slot
of a table of 2**SLOT_BITS, and the second, the table itself, is read from that slot on,
so coordinate k of a shingle is table[slot + k]: the second permutation circularly
shifted by k. A document's coordinate is the minimum over its shingles. Coordinates are
banded; documents that share a band are candidates.

1. Documents with equal shingle sets are one class, represented by the smallest id.
2. In each band bucket every representative is compared with the smallest one there,
   exactly, on full shingle sets; components of the links so far follow.
3. Buckets that still hold several components are compared exactly, in blocks: all pairs
   of one block of members with another in one matrix product, so that no task holds
   more than two blocks, whose members and bytes are bounded. Members of the component of
   the bucket's smallest member need not be compared with one another. Components follow again.
4. Of buckets with more than HOT_BLOCKS blocks of members outside that component, sets are not
   sent to all blocks. In any one order of all shingles, two sets can only be similar if they
   share one of the first n - ceil(n * percent / 100) + 1 of each, where n is the set's size. The
   order puts rare shingles first, by counts in a table of RARITY_BUCKETS; the members are
   grouped again by those shingles, and the groups go the way of 3. Texts made from one
   template, which share a band but not their rare shingles, part here.

No link between different texts that share a band is missed. With 24 bands of 4 rows two
sets of similarity 0.85 fail to share a band with a chance of 2e-8, of 0.8 with one of 3e-6.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm.shared import components, forget, small_batches, written
from webstrata.llm.textbytes import ASCII_SPACE, LOWER, NULL_ID, blocks, keyed_hashes, mix, portions, words

SHINGLE_WORDS = 5
PERCENT = 85
BANDS, ROWS = 24, 4
SLOT_BITS = 20
BLOCK_MEMBERS, BLOCK_WORDS = 256, 4 << 20
HOT_BLOCKS = 8
RARITY_BUCKETS = 1 << 18
BLOOM_BITS = 1 << 25

_K = BANDS * ROWS
_state: dict[str, np.ndarray] = {}


def _table() -> np.ndarray:
    """Row s: the second permutation read circularly from slot s on, for all coordinates."""
    if not _state:
        order = np.random.Generator(np.random.PCG64(29)).permutation(1 << SLOT_BITS).astype(np.uint32)
        _state["t"] = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: _K - 1]]), _K)
    return _state["t"]


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of a set of 64-bit shingle hashes."""
    slot = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    table, least = _table(), None
    for i in range(0, len(slot), 512):
        part = table[slot[i : i + 512]].min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column.

    Words have keyed 128-bit hashes; a shingle's 64-bit hash is mixed from all bits of its words'.
    Two different shingles of a pair of documents get one hash with a chance of 2**-64 for
    each pair of shingles, whatever the texts are."""
    for first, last, data, offsets in blocks(column):
        data = LOWER[data]
        starts, ends, word = words(ASCII_SPACE[data], offsets)
        h, g = keyed_hashes(data, starts, ends)
        n = max(0, len(h) - SHINGLE_WORDS + 1)
        five = np.zeros(n, np.uint64)
        for k in range(SHINGLE_WORDS):
            five = mix(mix(five + h[k : k + n]) ^ g[k : k + n])
        for a, b in zip(word[:-1].tolist(), word[1:].tolist()):
            if b - a >= SHINGLE_WORDS:
                yield np.unique(five[a : b - SHINGLE_WORDS + 1])
            elif b > a:
                one = np.array([b - a], np.uint64) * np.uint64(0x2545F4914F6CDD1D)
                for k in range(a, b):
                    one = mix(mix(one + h[k : k + 1]) ^ g[k : k + 1])
                yield one
            else:
                yield h[:0]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_shingles, set_key (digest of the set), bands (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            n, keys, bands = [], [], []
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(_bands(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()).fill_null(NULL_ID), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "n_shingles", "set_key", "bands"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, n_shingles long, set_key binary, bands array<long>"
    )


def _bands(sig: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h + sig[k::ROWS].astype(np.uint64))
    return h.view(np.int64)


def _slots() -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(BLOOM_BITS)) for k in (1, 2)]


def _bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of a fixed number of bits, as 64-bit words, merged before it comes to the driver."""
    slots = ids.select(F.explode(F.array(*_slots())).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()  # BLOOM_BITS / 64 rows at most
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, set): the shingle sets, as sorted 64-bit words, of the wanted (id, set_key).

    Texts aren't shuffled: most unwanted rows are left out by a Bloom filter where they are read,
    the sets of the others meet the wanted keys."""
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            keep = np.ones(batch.num_rows, bool)
            for k in (2, 3):
                slot = batch.column(k).to_numpy().astype(np.uint64)
                keep &= (bloom.value[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
            batch = batch.filter(pa.array(keep))
            sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], ["id", "set_key", "set"])

    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.select("id", "text", *(c.alias(f"slot{k}") for k, c in enumerate(_slots()))).mapInArrow(run, "id long, set_key binary, set binary")
    return found.join(wanted, ["id", "set_key"], "left_semi").groupBy("id").agg(F.first("set").alias("set"))  # equal keys, equal sets


def _similar(inter: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (n + m - inter)


def _views(column: pa.Array) -> Iterator[np.ndarray]:
    """The sets of a binary column, without a copy."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    words = np.frombuffer(data, np.uint64) if data is not None and data.size >= 8 else np.zeros(0, np.uint64)
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield words[a // 8 : b // 8]


def _check_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, set_a, set_b) those whose sets are similar."""
    for batch in batches:
        ok = []
        for x, y in zip(_views(batch.column(2)), _views(batch.column(3))):
            at = np.searchsorted(y, x)
            inter = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            ok.append(bool(_similar(inter, len(x), len(y), percent)))
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])


def products(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs of the sets, as a product of 0/1 matrices in slices."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    values, which = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    shingle, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    column, row = number[inverse[keep]], which[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for c in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(column, [c, c + columns])
        part = np.zeros((n, columns), np.float32)
        part[row[a:b], column[a:b] - c] = 1
        out += part @ part.T
    sizes = np.array([len(s) for s in sets])
    np.fill_diagonal(out, sizes)
    return out.astype(np.int64)


def _forest(links: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join different labels, as few as connect what all of them connect."""
    _, root = np.unique(label, return_inverse=True)
    root = root.astype(np.int64)
    i, j = np.nonzero(np.triu(links, 1))
    while True:
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
        if not len(i):
            return
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        _, first = np.unique(high, return_index=True)  # each class is hung on a smaller one, once
        for k in first:
            yield int(i[k]), int(j[k])
        parent = np.arange(root.max() + 1)
        parent[high[first]] = low[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        root = parent[root]


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first n_keys columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        cut = np.zeros(batch.num_rows, bool)
        for k in keys:
            cut[1:] |= k[1:] != k[:-1]
        head = tuple(k[0] for k in keys)
        if held and head != last:
            yield pa.Table.from_batches(held)
            held = []
        at = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for a, b in zip(at[:-1], at[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(k[-1] for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def _check_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, task, id, label, set) sorted by task: links between different labels."""
    for table in groups(batches, 2):
        ids, label = table.column(2).to_numpy(), table.column(3).to_numpy()
        _, first = np.unique(ids, return_index=True)
        ids, label = ids[first], label[first]
        if len(ids) < 2 or (label == label[0]).all():
            continue
        raw = table.column(4).to_pylist()
        sets = [np.frombuffer(raw[k], np.uint64) for k in first]
        inter, n = products(sets), np.array([len(s) for s in sets])
        links = list(_forest(_similar(inter, n[:, None], n[None, :], percent), label))
        if links:
            i, j = np.array(links).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])


def _open_groups(members: DataFrame) -> DataFrame:
    """Of rows (bucket, id, label, n) those of buckets with several labels, and what the buckets hold:
    in_main (has the row the label of the bucket's smallest id), n_main, n_rest, words_main, words_rest.
    Of buckets with equal members one is left."""
    pivots = members.groupBy("bucket").agg(F.min(F.struct("id", "label"))["label"].alias("main"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    sides = members.join(pivots.select("bucket", "main"), "bucket").select("bucket", "id", "label", "n", (F.col("label") == F.col("main")).alias("in_main"))
    is_main, is_rest = F.col("in_main").cast("long"), 1 - F.col("in_main").cast("long")
    marks = [F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(20,0)")).alias(f"mark{k}") for k in (1, 2)]
    sizes = sides.groupBy("bucket").agg(
        F.sum(is_main).alias("n_main"), F.sum(is_rest).alias("n_rest"), F.sum(is_main * F.col("n")).alias("words_main"), F.sum(is_rest * F.col("n")).alias("words_rest"), F.max("id").alias("top"), *marks
    )
    told = ["n_main", "n_rest", "words_main", "words_rest"]
    sizes = sizes.groupBy(*told, "top", "mark1", "mark2").agg(F.min("bucket").alias("bucket"))
    return sides.join(sizes.select("bucket", *told), "bucket")


def _n_blocks(n: str, words: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / BLOCK_MEMBERS), F.ceil(F.col(words) / BLOCK_WORDS)).cast("int")


def _links_in_blocks(placed: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different labels of the groups of `_open_groups`: every block of members
    meets every other one in a task of its own, but main blocks don't meet main blocks."""
    placed = placed.withColumn("r", _n_blocks("n_rest", "words_rest")).withColumn("m", _n_blocks("n_main", "words_main"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("in_main"), F.col("m")).otherwise(F.col("r"))).cast("int"))
    all_rest, all_main = F.sequence(F.lit(0), F.col("r") - 1), F.sequence(F.col("r"), F.col("r") + F.col("m") - 1)
    task = F.when(F.col("in_main"), F.transform(all_rest, lambda x: F.struct(x.alias("x"), (F.col("r") + F.col("own")).alias("y")))).otherwise(
        F.concat(
            F.transform(all_rest, lambda x: F.struct(F.least(x, F.col("own")).alias("x"), F.greatest(x, F.col("own")).alias("y"))),
            F.transform(all_main, lambda y: F.struct(F.col("own").alias("x"), y.alias("y"))),
        )
    )
    tasks = placed.select("bucket", "id", "label", F.explode(task).alias("t")).select("bucket", (F.col("t.x").cast("long") * (1 << 31) + F.col("t.y")).alias("task"), "id", "label")
    spread = tasks.join(known, "id").select("bucket", "task", "id", "label", "set").repartition("bucket", "task").sortWithinPartitions("bucket", "task")
    return spread.mapInArrow(functools.partial(_check_blocks, percent=percent), "a long, b long")


def _rarity(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(RARITY_BUCKETS)).astype(np.int64)


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, label, set): the shingles in each bucket of rarity, one row a bucket and task."""
    found = np.zeros(RARITY_BUCKETS, np.int64)
    for batch in portions(batches):
        found += np.bincount(_rarity(np.concatenate(list(_views(batch.column(2))))), minlength=RARITY_BUCKETS)
    some = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["rarity", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (id, label, set): (bucket, id, label, n), a row for each of the rarest shingles of a set."""
    for batch in portions(batches):
        sets = list(_views(batch.column(2)))
        size = np.array([len(x) for x in sets])
        rare = [x[np.argsort(counts[_rarity(x)], kind="stable")[: len(x) + (-percent * len(x)) // 100 + 1]] for x in sets]
        of = np.repeat(np.arange(len(sets)), [len(x) for x in rare])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rare).view(np.int64)), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(size[of])], ["bucket", "id", "label", "n"])


def _by_rare_shingles(members: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Groups (bucket, id, label, n) of the members (id, label) by their rarest shingles: all similar pairs meet."""
    rows = written(members.join(known, "id").select("id", "label", "set"))
    counts = np.zeros(RARITY_BUCKETS, np.int64)
    for r in rows.mapInArrow(_shingle_counts, "rarity long, n long").groupBy("rarity").agg(F.sum("n").alias("n")).collect():  # RARITY_BUCKETS rows at most
        counts[r.rarity] = r.n
    shared = members.sparkSession.sparkContext.broadcast(counts)
    return rows.mapInArrow(lambda batches: _prefixes(batches, shared.value, percent), "bucket long, id long, label long, n long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept, set_id (the smallest id
    with an equal set; the id itself for an empty one).

    Documents are linked from a Jaccard similarity of `percent` hundredths on. Texts without words,
    null and empty ones included, link with nothing; texts of any length are read whole. A null id
    sorts before all others and comes back null. Repeated rows are one document. Rows that share an
    id and not their text are judged by their own texts; where such an id is the smallest of several
    sets, the one with the smallest digest is compared with others. An empty table gives no rows.
    Other columns, whatever their names, are not read."""
    small_batches(docs.sparkSession)
    found = written(sketches(docs, id_col, text_col))
    # one document for each distinct set
    sets = found.where("n_shingles > 0").groupBy("set_key").agg(F.min("id").alias("rep"))
    first = found.where("n_shingles > 0").join(sets, "set_key").where("id = rep").groupBy("id").agg(F.min("set_key").alias("set_key"), F.min_by(F.struct("n_shingles", "bands"), "set_key").alias("s"))
    reps = written(first.select("id", "set_key", F.col("s.n_shingles").alias("n"), F.explode("s.bands").alias("bucket")))
    buckets = reps.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("n_members")).where("n_members > 1")
    members = written(reps.join(buckets, "bucket").select("bucket", "id", "set_key", "n", "pivot"))

    # every member with the smallest of its bucket
    pairs = members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    known = written(sets_of(docs, members.select("id", "set_key").distinct(), id_col, text_col))
    both = pairs.join(known.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(known.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    links = written(both.select("a", "b", "set_a", "set_b").mapInArrow(functools.partial(_check_pairs, percent=percent), "a long, b long"))

    # what is left: buckets with several components, in blocks
    label = components(links)
    labelled = members.join(label, "id", "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("label"))
    # two members have been compared, as one of them was the pivot
    placed = written(_open_groups(labelled).where("n_main + n_rest > 2"))
    large = _n_blocks("n_rest", "words_rest") > HOT_BLOCKS
    more = written(_links_in_blocks(placed.where(~large), known, percent))
    done = [reps, members, known, links, more, placed]
    hot = placed.where(large).select("id", "label").distinct()
    if not hot.isEmpty():
        rare = _by_rare_shingles(written(hot), known, percent)
        done.append(written(_links_in_blocks(_open_groups(written(rare)), known, percent)))
        more = more.unionByName(done[-1])
    label = components(links.unionByName(more)) if not more.isEmpty() else label
    for table in done:
        forget(table)

    ends = sets.join(label, sets["rep"] == label["id"], "left").select("set_key", "rep", F.coalesce("root", "rep").alias("component"))
    empty = F.col("n_shingles") == 0
    out = found.select("id", "n_shingles", "set_key").join(ends, "set_key", "left")
    shown = lambda c: F.when(c != NULL_ID, c)
    component = F.when(empty, F.col("id")).otherwise(F.col("component"))
    return out.select(
        shown(F.col("id")).alias("doc_id"), "n_shingles", shown(component).alias("component_id"), (F.col("id") == component).alias("kept"),
        shown(F.when(empty, F.col("id")).otherwise(F.col("rep"))).alias("set_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The document rows whose id is the smallest of their component, with all their columns, whatever their names.

    Documents without words, null and empty texts included, all stay; so do repeated rows of a
    document that stays. A null id counts as the smallest. An empty table gives an empty one."""
    kept = classes(docs, id_col, text_col, percent).where("kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("kept_id")).distinct()
    return docs.join(kept, F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)) == kept["kept_id"], "left_semi")
