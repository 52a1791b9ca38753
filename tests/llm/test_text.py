import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import ODD, frame, random_docs
from webstrata.llm import bpe, decontamination, html_text, quality
from webstrata.llm.queries import default_tokenizer
from webstrata.llm.textbytes import ASCII_SPACE, BLOCK_BYTES, blocks, keyed_hashes, prefix_hashes, slice_hashes, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def contaminated(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, own = WORD.findall(lower(t)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    own |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(2, None), (3, ""), (4, "..."), (5, "One"), (6, "same WORDS"), (7, "the same words the")]


@pytest.mark.parametrize("limit", [8 << 20, 200])
def test_decontamination_equals_brute_force(spark, limit, monkeypatch):
    docs = random_docs() + ODD
    items = ITEMS + [(10 + i, t) for i, (_, t) in enumerate(docs[:20])] + [(10, docs[3][1]), (99, " ".join(docs[5][1].split()[3:16]).upper())]
    docs = docs[10:] + [(950, "x, " + docs[2][1].replace(" ", " -- ") + "!"), (951, "bone ones"), (952, "ONE.")]
    monkeypatch.setattr(decontamination, "_slices", lambda b, i, t, n, f=decontamination._slices: f(b, i, t, limit))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.contamination(frame(spark, docs), bench).collect()
    assert sorted(map(tuple, rows), key=str) == contaminated(docs, items)
    kept = decontamination.clean_documents(frame(spark, docs), bench)
    assert kept.columns == frame(spark, docs).columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect() if r.text) == sorted((d, t) for d, t in docs if d is not None and t and not contaminated([(d, t)], items)[0][5])


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontamination.contamination(frame(spark, [(1, "a b c")]), none).collect()] == [0]
    assert decontamination.contamination(frame(spark, []), none).collect() == []


def test_a_pass_builds_each_slice_once(monkeypatch):
    """However many blocks and batches a pass has, and with the same result as all items in one matcher."""
    items = [(i, f"w{i} " * 12) for i in range(6)]
    slices = [type("Sent", (), {"value": items[k : k + 2]}) for k in (0, 2, 4)]
    texts = [f"start {'w%d ' % (i % 9) * 12} end " * 700 for i in range(120)]
    batches = [pa.record_batch([pa.array(range(k, k + 40)), pa.array(texts[k : k + 40])], ["doc_id", "text"]) for k in (0, 40, 80)]
    built, build = [], decontamination.Matcher
    monkeypatch.setattr(decontamination, "Matcher", lambda own: built.append(own) or build(own))
    passes = list(decontamination._passes(iter(batches), slices))
    assert [p.num_rows for p in passes] == [120] and passes[0].nbytes > 4 * BLOCK_BYTES
    found = decontamination.scan(passes[0].column(1), decontamination._matchers(slices))
    assert len(built) == 3
    assert found == decontamination.scan(pa.array(texts), [build(items)]) and sum(found[1]) > 0
    monkeypatch.setattr(decontamination, "PASS_BYTES", 1)
    assert sum(p.num_rows for p in decontamination._passes(iter(batches), slices)) == 120


def test_matcher_skips():
    """Most positions of a text are never looked at."""
    m = decontamination.Matcher([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")])
    assert m.classes[0].m >= 20 and m.classes[0].shift.max() == m.classes[0].m - m.classes[0].block + 1


# quality


def brute_measures(t):
    t = t or ""
    w, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed


def test_quality_measures_equal_brute_force(spark):
    docs = random_docs() + ODD + [(920, "a b c\n\na b c\na b c \n# | <x>\n#"), (921, "x y z x y z q"), (922, "\n".join(["same line of words here"] * 20))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(5000, 1, 0), (None, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.judge(frame(spark, docs), labels).collect()
    expected = Counter((d, *brute_measures(t)) for d, t in docs)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == expected
    assert all(r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in rows)


_M = (1 << 64) - 1


def _mixed(h):
    for _ in range(2):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & _M
    return h ^ h >> 32


def _keyed(word, keys):
    """A word's hash, byte by byte."""
    lanes = [int.from_bytes(word[i : i + 8], "little") for i in range(0, len(word), 8)] or [0]
    return _mixed((sum(_mixed(x ^ k) for x, k in zip(lanes, keys)) + len(word) * 0x9E3779B97F4A7C15) & _M)


def brute_scores(docs, trusted):
    keys = [int(x) for x in np.random.Generator(np.random.PCG64(23)).integers(0, 1 << 64, 1024, dtype=np.uint64)]
    own = []
    for _, t in docs:
        h = [_keyed(x, keys) for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", (t or "").encode())]
        own.append(Counter([x % 65536 for x in h] + [_mixed((3 * x + y) & _M) % 65536 for x, y in zip(h, h[1:])]))
    raw, good = sum(own, Counter()), sum((c for c, (d, _) in zip(own, docs) if d in trusted), Counter())
    out = []
    for c, (d, _) in zip(own, docs):
        less = c if d in trusted else Counter()
        t, r = good.total() - less.total(), raw.total() - c.total()
        out.append(sum(n * np.log(((good[b] - less[b]) / t + 1e-4) / ((raw[b] - c[b]) / r + 1e-4)) for b, n in c.items()) / max(1, c.total()) if t and r else 0.0)
    return out


def test_quality_scores_equal_brute_force(spark):
    docs = [(i, t) for i, t in random_docs(60)] + [(800, ""), (801, None), (802, "x***, y$$$ --- ###\tz_1"), (803, "word " * 300_000), (803, "a b c")]
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(20), 802]], "doc_id long, quality int, toxic int")
    expected = Counter((d, round(x, 9)) for (d, _), x in zip(docs, brute_scores(docs, {*range(20), 802})))
    assert Counter((r.doc_id, round(r.score, 9)) for r in quality.judge(frame(spark, docs), labels).collect()) == expected


def test_lines_and_words_that_polynomials_confuse(spark):
    """A Thue-Morse text and its complement have equal polynomial hashes modulo 2**64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.judge(frame(spark, [(1, f"{a}\n{b}\n{a}"), (2, f"x y {a} x y {b}")]), labels).collect()
    assert {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in rows} == {1: (1, 0), 2: (0, 0)}
    from webstrata.llm import minhash

    x, y, z = minhash.shingle_sets(pa.array([a, b, a]))
    assert x.tolist() == z.tolist() != y.tolist()


def test_keyed_hashes_are_of_the_content():
    data = np.frombuffer(b"0123456789abcdefX0123456789abcdef0123456789abcdef\0", np.uint8)
    at = np.array([0, 17, 33, 33, 0, 0, 8])
    a, b = keyed_hashes(data, at, np.array([16, 33, 49, 50, 8, 0, 8]))
    assert a[0] == a[1] == a[2] and b[0] == b[1] == b[2] and a[5] == a[6]
    assert len(set(a.tolist())) == len(set(b.tolist())) == 4


def test_quality_without_trusted_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.judge(frame(spark, random_docs(5)), labels).collect()} == {0.0}
    assert quality.judge(frame(spark, []), labels).collect() == []


@pytest.mark.parametrize("size", ["0.001", "0.01", "0.1"])
def test_quality_separates_labelled_documents(spark, data, size):
    """Every score leaves the document itself out, so all labelled ones are held out."""
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', size)}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels).join(labels, "doc_id", "left").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))
    assert n.get((None, False), 0) <= 0.12 * n[None, True]  # about a twelfth of the labelled ones is bad


# tokens


def test_very_long_words_equal_the_library():
    import random
    import tokenizers

    library, own = tokenizers.Tokenizer.from_file(default_tokenizer()), bpe.Bpe(bpe.vocabulary(default_tokenizer()))
    r = random.Random(3)
    for word in ("a" * 100_001, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=60_000)), "".join(r.choices("éß中😀", k=5_000)), "=-" * 20_000, " " * 70_000):
        assert own.encode(word) == library.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("change,named", [
    ({"normalizer": {"type": "NFC"}}, "normalizer"), ({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, "pre_tokenizer.add_prefix_space"), ({"pre_tokenizer": None}, "pre_tokenizer.type"),
    ({"added_tokens": [{"id": 50256, "content": "<x>", "lstrip": True}]}, "added_tokens.lstrip"), ({"model": {"type": "BPE", "ignore_merges": True}}, "model.ignore_merges"), ({"model": {"type": "WordPiece"}}, "model.type"),
])
def test_other_vocabularies_are_refused(tmp_path, change, named):
    import json

    with open(default_tokenizer(), encoding="utf-8") as f:
        data = json.load(f)
    assert bpe.unsupported(data) == []
    (tmp_path / "v.json").write_text(json.dumps(data | change))
    with pytest.raises(ValueError, match=named):
        bpe.vocabulary(str(tmp_path / "v.json"))


def test_tokens_equal_the_library(spark):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(default_tokenizer())
    docs = random_docs(60) + ODD + [(930, "it's I'll we've 'sometimes ''s 's<|endoftext|> x  \n\n y\t\tz <|endoftext|>"), (931, "中文字 😀😀 ١٢٣ 42abc"), (932, "ab" * 3000), (933, " " * 500 + "x")]
    expected = []
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert text == (t or "")
    assert sorted(map(tuple, bpe.tokenise(frame(spark, docs), default_tokenizer()).collect()), key=str) == sorted(expected, key=str)
    assert bpe.tokenise(frame(spark, []), default_tokenizer()).collect() == []


def test_speculation_is_verified():
    with open(default_tokenizer(), encoding="utf-8") as f:
        b = bpe.Bpe(f.read())
    words_ = [t.encode() for _, x in random_docs(30) for t in b.find(x)]
    assert b.encode_words(words_) == [b.merged(w) for w in words_]
    long = b"the" * 200
    assert b.encode_words([long])[0] == b.merged(long)
    assert b.decode(b.encode("naïve <|endoftext|> text")) == "naïve <|endoftext|> text"


# pages

PAGE = """<html><head><title>x</title></head><body><header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use cookies on the site to be of use</div>
<main><article><div class="post-header"><h1>Head line</h1></div><p>Short.</p><p>This is the text of the article and it is long enough to be judged as it is by the rules.</p><aside>Related: the stuff</aside>
<blockquote>quote <a href=x>link</a></blockquote><div class="advert">Buy!</div><form><p>Your mail</p></form><p>End &lt;b&gt; &nbsp; now<p>x<!-- no --></article>
<div id="comments"><p>This is a comment of the reader and it is of a good length to be judged.</p></div></main><div class="sidebar"><p>side bar of the page that is a long long text and it is for the reader of it</p></div><footer>&copy;</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head line Short. This is the text of the article and it is long enough to be judged as it is by the rules. quote link End <b> now x"
    assert html_text.main_text("<p>Hello world.</p>") == "Hello world."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<!-- open") == ""
    assert html_text.main_text('<p>First.</p><p>Second <i x="a>b">c</i></p><p title="open>Third<img alt=no') == "First. Second c Third"
    plain = "<div><div class=menu><a>x</a> <a>y</a></div><p>Good text for the reader of this and that, which is a good block of the page.<p>Short<script>var a='<p>x</p>'</script></div>"
    assert html_text.main_text(plain) == "Good text for the reader of this and that, which is a good block of the page. Short"


def test_pages_of_the_table(spark, data):
    import html as h

    pages = spark.read.parquet(f"{data.replace('0.001', '0.01')}/pages.parquet")
    for r in html_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        expected = " ".join(h.unescape(re.sub(r"<(/?p|br|/?h1)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert (r.text, r.n_chars) == (expected, len(expected))



# bytes


def test_words_and_hashes():
    texts = ["a bb", "", "bb  c\n", None, " ", "ß\tbb"]
    out = []
    for first, last, buf, offsets in blocks(pa.array(texts)):
        starts, ends, index = words(ASCII_SPACE[buf], offsets)
        assert np.array_equal(index, np.searchsorted(starts, offsets))
        out = [buf[s:e].tobytes().decode() for s, e in zip(starts, ends)]
        h = slice_hashes(prefix_hashes(buf), starts, ends)
        assert h[1] == h[2] == h[5] and len(set(h.tolist())) == 4
    assert out == ["a", "bb", "bb", "c", "ß", "bb"]


def test_blocks_hold_whole_texts():
    texts = ["x" * 10, "y" * 25, "", "z" * 3, "w" * 40]
    got = [(a, b) for a, b, *_ in blocks(pa.array(texts), 30)]
    assert got[0][0] == 0 and got[-1][1] == 5 and all(b == c for (_, b), (c, _) in zip(got, got[1:]))
