"""Byte-level BPE by speculation and verification.

Each distinct word is first cut greedily into the longest tokens (all words advance
through one token trie together). A cut is the BPE result exactly if every token is
its own encoding and every two neighbours are compatible, that is if encoding their
joint bytes gives these two tokens again. Compatibility is decided for all pairs at
once by undoing the merges at the seam in reverse order. Only words with a pair (or
token) that fails are merged exactly. Words, not texts, are encoded: results are kept
in a bounded table per worker, and a text's ids are put together from its words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.shared import small_batches
from webstrata.llm.textbytes import portions

#: Fixed value: the pattern that byte-level BPE vocabularies of this family split texts with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KEEP_WORDS = 300_000
KEEP_BYTES = 64
TRIE_BYTES = 256
SHORT_WORD = 48
BLOCK_CHARS = 1 << 20
_NEVER = 1 << 40


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in vocabulary files: printable Latin-1
    bytes for themselves, the other bytes in order for the code points from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def unsupported(data: dict) -> list[str]:
    """The settings of a vocabulary file that change its ids and that this encoder doesn't follow.

    Truncation, padding and post-processing aren't used; all else must say what `Bpe` does: byte-level BPE
    without normalising, the usual pattern, no space put in front, and added tokens found as they stand."""
    model, before, after = data.get("model") or {}, data.get("pre_tokenizer") or {}, data.get("decoder") or {}
    out = [f"model.{k}" for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    out += [k for k, ok in (
        ("model.type", model.get("type", "BPE") == "BPE"), ("normalizer", not data.get("normalizer")), ("pre_tokenizer.type", before.get("type") == "ByteLevel"),
        ("pre_tokenizer.add_prefix_space", not before.get("add_prefix_space", True)), ("pre_tokenizer.use_regex", before.get("use_regex", True)), ("decoder.type", after.get("type") == "ByteLevel"),
    ) if not ok]
    return out + [f"added_tokens.{k}" for k in ("single_word", "lstrip", "rstrip") if any(t.get(k) for t in data.get("added_tokens") or [])]


def vocabulary(path: str) -> str:
    """The text of a vocabulary file, read in the driver; a ValueError names settings that aren't supported."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if found := unsupported(json.loads(spec)):
        raise ValueError(f"{path}: not supported: {', '.join(found)}")
    return spec


class Bpe:
    def __init__(self, spec: str):
        data = json.loads(spec)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.bytes_of = {i: raw(t) for t, i in data["model"]["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        size = max(self.bytes_of) + 1
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token; bytes have none
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks = [], []
        self.size = size
        for r, pair in enumerate(data["model"]["merges"]):
            a, b = (self.id_of[raw(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.merge[a, b] = (r, made)
            keys.append(a * size + b)
            ranks.append(r)
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = a, b, r
        self.pair_rank = {p: r for p, (r, _) in self.merge.items()}
        self.made = {r: t for r, t in self.merge.values()}
        self.first = [self.id_of[bytes([b])] for b in range(256)]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self._trie()
        self.own = np.full(size, -1, np.int8)  # is a token its own encoding? -1: not yet known
        self.words: dict[str, tuple[str, int, bytes]] = {}
        self.find = regex.compile(PATTERN).findall

    def _trie(self) -> None:
        """Inner nodes have a row of 256 children each; a child is a node number or, for leaves, ~token."""
        node = {b"": 0}
        for b in self.id_of:
            for i in range(1, len(b)):
                node.setdefault(b[:i], len(node))
        self.inner = node.keys()  # what longer tokens begin with
        self.child = np.full((len(node), 256), np.iinfo(np.int32).min, np.int32)
        self.token = np.full(len(node), -1, np.int32)
        for b, i in self.id_of.items():
            if b in node:
                self.token[node[b]] = i
            else:
                self.child[node[b[:-1]], b[-1]] = ~i
        for b, n in node.items():
            if b:
                self.child[node[b[:-1]], b[-1]] = n

    # speculation

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of the longest-match cuts, in order. Very long words are cut one by one."""
        long = [i for i, w in enumerate(words) if len(w) > TRIE_BYTES]
        lengths = np.array([0 if len(w) > TRIE_BYTES else len(w) for w in words], np.int64)
        text = np.frombuffer(b"".join(w for w in words if len(w) <= TRIE_BYTES) + b"\0", np.uint8)
        end = np.cumsum(lengths)
        lane = np.flatnonzero(lengths)
        at, end = (end - lengths)[lane], end[lane]
        node, best, best_end = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64), at.copy()
        out_lane, out_token = [], []
        none = np.iinfo(np.int32).min
        while len(lane):
            nxt = np.where(at < end, self.child[node, text[at]], none)
            leaf = (nxt < 0) & (nxt != none)
            inner = nxt >= 0
            at = at + (leaf | inner)
            best[leaf], best_end[leaf] = ~nxt[leaf], at[leaf]
            node = np.where(inner, nxt, 0)
            token = np.where(inner, self.token[node], -1)
            has = token >= 0
            best[has], best_end[has] = token[has], at[has]
            done = ~inner
            out_lane.append(lane[done])
            out_token.append(best[done])
            at[done] = best_end[done]
            live = ~(done & (best_end >= end))
            if not live.all():
                lane, at, end, node, best, best_end = (x[live] for x in (lane, at, end, node, best, best_end))
        for i in long:
            w, p, tokens = words[i], 0, []
            while p < len(w):
                n = best = 1
                while p + n < len(w) and w[p : p + n] in self.inner:
                    n += 1
                    if w[p : p + n] in self.id_of:
                        best = n
                tokens.append(self.id_of[w[p : p + best]])
                p += best
            out_lane.append(np.full(len(tokens), i))
            out_token.append(np.array(tokens, np.int64))
        if not out_lane:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, token = np.concatenate(out_lane), np.concatenate(out_token)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    # verification

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_ranks[i], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does encoding their joint bytes keep the seam between them?

        The pieces at the seam, x and y, are followed back in time. At each stage the seam
        closes if x and y merge before either is used up by its own side; on the right side
        at equal rank too, as the leftmost of equal merges comes first."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        x_used, y_used = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(live):
            r = self._pair_rank(x, y)
            closes = (r < x_used) & (r <= y_used) & (r < _NEVER)
            ok[live[closes]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~closes & ((rx >= 0) | (ry >= 0))
            live, x, y, x_used, y_used, rx, ry = (v[go] for v in (live, x, y, x_used, y_used, rx, ry))
            undo_x = rx > ry
            x_used, y_used = np.where(undo_x, rx, x_used), np.where(undo_x, y_used, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def merged(self, word: bytes) -> list[int]:
        """Exact BPE of a word: the pair of lowest rank, leftmost first, until none is left."""
        tokens = [*map(self.first.__getitem__, word)]
        n = len(tokens)
        if n <= SHORT_WORD:
            get, none = self.pair_rank.get, _NEVER
            ranks = [get(p, none) for p in zip(tokens, tokens[1:])]
            while ranks and (r := min(ranks)) != none:
                i = ranks.index(r)
                tokens[i : i + 2] = [self.made[r]]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((tokens[i - 1], tokens[i]), none)
                if i < len(ranks):
                    ranks[i] = get((tokens[i], tokens[i + 1]), none)
            return tokens
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (m := self.merge.get((tokens[i], tokens[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if tokens[i] == a else n
            if j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = self.merge[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (m := self.merge.get((tokens[p], tokens[q]))):
                    heapq.heappush(heap, (m[0], p, tokens[p], tokens[q]))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        word, token = self.greedy(words)
        fresh = np.unique(token[self.own[token] < 0])
        for t in fresh.tolist():
            self.own[t] = self.merged(self.bytes_of[t]) == [t]
        bad = set(word[self.own[token] == 0].tolist())
        beside = word[1:] == word[:-1]
        a, b, of = token[:-1][beside], token[1:][beside], word[1:][beside]
        keys, inverse = np.unique(a * self.size + b, return_inverse=True)
        ok = self.compatible(keys // self.size, keys % self.size) if len(keys) else np.zeros(0, bool)
        bad.update(of[~ok[inverse]].tolist())
        cuts = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        tokens = token.tolist()
        return [self.merged(w) if i in bad else tokens[cuts[i] : cuts[i + 1]] for i, w in enumerate(words)]

    # texts

    def pieces(self, text: str) -> list[str]:
        """The words of a text; a special token's string is one piece."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.find(text)
        out: list[str] = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else self.find(part)
        return out

    def _entry(self, ids: list[int]) -> tuple[str, int, bytes]:
        return ",".join(map(str, ids)), len(ids), b"".join(map(self.bytes_of.__getitem__, ids))

    def encode_all(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """For each text its words' entries: ids in decimal, their number, and the bytes that they decode to."""
        cut = [self.pieces(t) for t in texts]
        if len(self.words) > KEEP_WORDS:
            self.words.clear()
        new = list(set().union(*cut).difference(self.words))
        special = [w for w in new if w in self.special]
        plain = [w for w in new if w not in self.special]
        own = {w: self._entry([self.special[w]]) for w in special}
        own |= {w: self._entry(ids) for w, ids in zip(plain, self.encode_words([w.encode() for w in plain]))}
        if len(self.words) + len(own) <= 2 * KEEP_WORDS and all(len(w) <= KEEP_BYTES for w in own):
            self.words |= own
            get = self.words.__getitem__
        else:
            self.words |= {w: e for w, e in own.items() if len(w) <= KEEP_BYTES}
            get = lambda w: own[w] if w in own else self.words[w]
        return [list(map(get, ws)) for ws in cut]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, n, _ in self.encode_all([text])[0] if n for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _runs(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


_ready: dict[int, Bpe] = {}


def _bpe(shared) -> Bpe:
    spec = shared.value
    if id(spec) not in _ready:
        _ready.clear()
        _ready[id(spec)] = Bpe(spec)
    return _ready[id(spec)]


def tokenise(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids_sha256, decoded_sha256. Narrow: no shuffle.

    `tokenizer` is the path of a byte-level BPE file, read in the driver and broadcast (a
    vocabulary has a fixed size, about 1.5 MB); `vocabulary` refuses others. Texts are encoded whole; null and empty
    texts have no tokens. Repeated rows give a row each; other columns are not read."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared)
        for batch in portions(batches):
            n, ids, decoded = [], [], []
            for part in _runs(batch.column(1).fill_null("").to_pylist()):
                for entries in bpe.encode_all(part):
                    n.append(sum([e[1] for e in entries]))
                    ids.append(hashlib.sha256(",".join([e[0] for e in entries]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(_valid(b"".join([e[2] for e in entries]))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _valid(raw: bytes) -> bytes:
    """The UTF-8 of a decoded text, where bytes that are none become U+FFFD."""
    return raw.decode("utf-8", "replace").encode()


def token_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, ids (array of int). See `tokenise`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared)
        for batch in portions(batches):
            ids = [[int(i) for e in entries if e[1] for i in e[0].split(",")] for part in _runs(batch.column(1).fill_null("").to_pylist()) for entries in bpe.encode_all(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
