"""Main text: ordinary pages that marks must not empty, and the two passes against a plain implementation."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from webstrata.llm import html_text as H

GOOD = "This is the text of the page and it is one good paragraph that is long enough for the reader of it, with the words that are in all texts."
LINKS = "<ul><li><a href=/a>one</a></li><li><a href=/b>two</a></li></ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div style='overflow:hidden'><p>{GOOD}</p></div>", f"<div aria-hidden='false'><p>{GOOD}</p></div>", f"<p title='the hidden river'>{GOOD}</p>",
        f"<div class='content no-sidebar'><p>{GOOD}</p></div>", f"<div class='elementor-widget-text'><p>{GOOD}</p></div>", f"<div data-id='comment'><p>{GOOD}</p></div>",
        f"<nav>{LINKS}<p>{GOOD}</p>", f"<form id='all'><div class='menu'>{LINKS}</div><p>{GOOD}</p><div class='sidebar'><p>{GOOD} Side.</p></div></form>",
        f"<script data-x=\"{'x' * 200_001}\">var a = 1</script><p>{GOOD}</p>", f"<body class='has-header page-footer'><div data-class='ad'>{GOOD}</div></body>",
        f"<section class='post-body with-comments'>{GOOD}</section><section id='comments'><p>{GOOD}</p></section>", f"<main class='main-content'>{LINKS}<p>{GOOD}</p></main><footer>{GOOD}</footer>",
    ],
)
def test_marks_do_not_empty_pages(page):
    assert H.main_text(page) == GOOD


def test_teasers_do_not_hide_the_page():
    body = " ".join([GOOD] * 5)
    assert H.main_text(f"<article>Short tease</article><div><p>{body}</p></div>") == f"Short tease {body}"
    assert H.main_text(f"<div>{GOOD}</div><article><h1>Head</h1><p>{body}</p></article>") == f"Head {body}"
    assert H.main_text(f"<h1>Head</h1><article><p>{body}</p></article><h2>More</h2><p>tiny</p>") == f"Head {body}"


@pytest.mark.parametrize(
    "name, mark",
    [("sidebar", "strong"), ("no-sidebar", None), ("has-header", None), ("site-header", "strong"), ("cookie-notice", "strong"), ("post-comments", "strong"), ("commentList", "strong"),
     ("elementor-widget-text", "weak"), ("content-sidebar-wrap", "weak"), ("download", None), ("header", "strong"), ("ad_box_left", "strong"), ("text", None)],
)
def test_word_marks(name, mark):
    assert H._word_mark(name, False) == mark


def test_markup():
    assert H.main_text("<article>Text &am<b>p;</b> <a name=x>here</a> <i>a<p>b</i>c</article>") == "Text &amp; here a bc"
    assert H.main_text(f"<p>{GOOD}</p><div hidden><p>{GOOD}</p></div><span class=ad>x</span><p style='color:red; display : none'>{GOOD}</p>") == GOOD
    assert H.main_text(f"<head><title>x</title><body><p>{GOOD}<ul><li>a<li class=ad>b<li>c</ul>") == f"{GOOD} a c"
    assert H.main_text(f"<script>a</script foo><scripty>{GOOD}</scripty>") == GOOD


def test_undecided_blocks_inherit():
    text = "this is the text of a page that has it all " * 3
    blocks = H.classify(H.cut(f"<h2>Head</h2><p>{text}</p><p>Short</p><p><a href=x>one</a></p><p>tiny</p><p><a href=x>two</a></p>"))
    assert [b.label for b in blocks] == ["good", "good", "good", "bad", "bad", "bad"]


# a plain implementation for well-formed pages without article, main and weak marks


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.now, self.link = [], [], [], []

    def flush(self):
        body = " ".join("".join(self.now).split())
        if body:
            link = " ".join("".join(self.link).split())
            self.blocks.append((body, len(link), any(bad for _, bad in self.open), any(t in ("h1", "h2", "h3") for t, _ in self.open)))
        self.now, self.link = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("a", "b", "i"):
            self.flush()
        if tag != "br":
            self.open.append((tag, tag in ("nav", "footer", "aside", "form", "header") or dict(attrs).get("class") in ("ad", "sidebar", "comments", "cookie-notice", "menu")))

    def handle_endtag(self, tag):
        if tag not in ("a", "b", "i"):
            self.flush()
        self.open.pop()

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if not {"script", "style", "title", "head"} & set(tags):
            self.now.append(data)
            if "a" in tags:
                self.link.append(data)


def plain_main_text(page):
    reader = _Reader()
    reader.feed(page)
    reader.flush()
    labels = []
    for text, linked, marked, heading in reader.blocks:
        words = [w.strip(".,;:!?\"'()") for w in text.lower().split()]
        stop = sum(w in H.STOP_WORDS for w in words) / max(1, sum(w != "" for w in words))
        if marked:
            labels.append("marked")
        elif linked / len(text) > 0.34:
            labels.append("bad")
        elif len(text) < 70 or heading:
            labels.append("bad" if text[0] == "©" else "?")
        else:
            labels.append("good" if stop >= 0.12 else "?")
    out = list(labels)
    for i, label in enumerate(labels):
        if label == "?":
            near = sorted((abs(i - j), x != "good", j < i, x) for j, x in enumerate(labels) if x in ("good", "bad"))
            later = sorted((j, x) for j, x in enumerate(labels) if x in ("good", "bad") and j > i)
            out[i] = later[0][1] if reader.blocks[i][3] and later else near[0][3] if near else "good"
    if "good" not in out:
        out = ["good" if x == "?" else y for x, y in zip(labels, out)]
    return " ".join(b[0] for b, x in zip(reader.blocks, out) if x == "good")


def generated(seed):
    rng = random.Random(seed)
    stop, rare = sorted(H.STOP_WORDS), ["".join(rng.choices("abcdefgßé", k=rng.randrange(4, 9))) for _ in range(200)]
    words = lambda n, share: " ".join(rng.choice(stop if rng.random() < share else rare) for _ in range(n)).capitalize() + "."

    def block():
        kind = rng.random()
        if kind < 0.35:
            return f"<p>{words(rng.randrange(10, 60), 0.4)} <b>{words(2, 0.5)}</b> &amp; <i>x</i></p>"
        if kind < 0.5:
            return f"<p>{words(rng.randrange(1, 6), 0.3)}<br>{words(2, 0.1)}</p>"
        if kind < 0.6:
            return f"<h2>{words(rng.randrange(2, 20), 0.3)}</h2>"
        if kind < 0.7:
            return f"<div>{words(rng.randrange(12, 30), 0.0)}</div>"
        if kind < 0.85:
            return "<ul>" + "".join(f"<li><a href='/{i}'>{words(rng.randrange(1, 12), 0.3)}</a></li>" for i in range(rng.randrange(1, 5))) + "</ul>"
        if kind < 0.92:
            return f"<div class='{rng.choice(['ad', 'sidebar', 'comments', 'cookie-notice', 'menu'])}'><p>{words(rng.randrange(3, 50), 0.4)}</p></div>"
        return rng.choice([f"<div><p>© 2024 {words(3, 0.2)}</p></div>", "<script>var a = '<p>x</p>' </script>", f"<aside>{words(30, 0.4)}</aside>"])

    return f"<html><head><title>{words(3, 0.2)}</title></head><body><nav>{block()}</nav>" + "".join(block() for _ in range(rng.randrange(0, 14))) + f"<footer>{words(20, 0.4)}</footer></body></html>"


def test_passes_equal_a_plain_implementation():
    pages = [generated(s) for s in range(400)]
    for page in pages:
        if plain_main_text(page) or not H.main_text(page):
            assert H.main_text(page) == plain_main_text(page), page
    assert sum(bool(plain_main_text(p)) for p in pages) > 300


def test_table_without_article(spark, data):
    """The pages of the table read the same with a plain div in place of the article: by both implementations."""
    pages = spark.read.parquet(f"{data.replace('0.001', '0.01')}/pages.parquet").collect()
    for r in pages:
        with_article = H.main_text(r.html)
        bare = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert H.main_text(bare) == with_article and with_article


def test_page_rows(spark):
    rows = [(None, None, None), (1, "u", "<p>a  b</p>"), (1, "u", "<p>a  b</p>"), (2, "", ""), (3, "u", f"<p>{GOOD}</p>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    long = " ".join([GOOD] * 20_000)
    assert sorted(map(tuple, H.extract(pages).collect()), key=str) == sorted([(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "", 0), (2, "", "", 0), (3, "u", long, len(long))], key=str)
    assert H.extract(pages.limit(0)).collect() == []
