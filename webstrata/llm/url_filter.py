"""URL filters: rules, and gradient-boosted trees on lexical features for all other urls.

DataFrame operations only. Features come from the url's text: lengths, depth, digit ratios,
entropy, numbers of parameters, and statistics of the host's suffixes of one, two and three
labels among all labelled urls. The trees are fitted on a bounded sample of labelled urls
(SAMPLE rows, chosen by hash), whose suffix statistics leave out the FOLDS-th part of the labelled
urls that the row itself is of; so no row tells its own label. The trees are compiled to one
SQL expression, so judging is a fully native projection, behind joins with the suffixes: each
a broadcast if they are few, else a shuffle.

The tables hold no labelled urls. `seed_labels` makes some: the urls of the table, labelled by a
list of known bad sites, and a fixed number of generated ones (`seed_urls`) of families that
differ in their lexical features and not in one character: both labels have hosts with and
without hyphens, digits and parameters.
"""

from __future__ import annotations

import functools

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.shared import written

SAMPLE = 20_000
TREES, DEPTH = 10, 4
LEVELS = (1, 2, 3)
FOLDS = 5
SEED_URLS = 8_000
#: Suffix tables up to these rows and characters are broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 16_000_000

#: Fixed values: (host suffix, path prefix, verdict) of the rules.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

#: Names of known bad sites; a url counts as labelled `block` if a label of its
#: host is one of these, written with or without hyphens, and else as labelled `allow`.
SEED_BLOCKED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: What generated urls are made of.
_NAMES = "river stone garden music school city press radio history science harbour kitchen travel forest bridge library museum weather market village".split()
_GOOD_ENDS, _BAD_ENDS = "com org net de fr es edu".split(), "com net biz info top xyz click".split()

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def below(host: Column, suffix: str) -> Column:
    return (host == suffix) | host.endswith("." + suffix)


def rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule reads `net/de/`."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    pick = lambda value: F.coalesce(*(F.when(below(host, r[0]) & path.startswith(r[1]), value(r)) for r in ordered), F.lit(None).cast("string"))
    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def features() -> dict[str, Column]:
    """Lexical features over columns url (not null), host, path and n1, bad1, n2, .. (labelled urls of the
    host's suffixes, and blocked ones of these), each a double."""
    h, u = F.col("host"), F.col("url")
    n = F.greatest(F.length(h), F.lit(1))
    share = lambda c: (F.length(h) - F.length(F.replace(h, c, F.lit("")))) / n
    letters = F.array_distinct(F.filter(F.split(h, ""), lambda c: c != ""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    found = {
        "url_chars": F.length(u), "host_chars": F.length(h), "path_chars": F.length("path"), "query_chars": F.length(query), "depth": _count(F.col("path"), "/[^/]"),
        "digit_ratio": _count(u, "[0-9]") / F.greatest(F.length(u), F.lit(1)), "host_digit_ratio": _count(h, "[0-9]") / n,
        "entropy": F.aggregate(letters, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))),
        "parameters": F.when(query != "", _count(query, "&") + 1).otherwise(0),
    }
    for k in LEVELS:
        seen, bad = F.coalesce(f"n{k}", F.lit(0)), F.coalesce(f"bad{k}", F.lit(0))
        found |= {f"suffix{k}_seen": F.log1p(seen), f"suffix{k}_bad": (bad + 1) / (seen + 2)}
    return {name: c.cast("double") for name, c in found.items()}


def suffix(host: Column, labels: int) -> Column:
    """The last labels of a host, or all if it has fewer."""
    return F.substring_index(host, ".", -labels)


def _prepared(urls: DataFrame) -> DataFrame:
    out = urls.withColumns({"url": F.coalesce(F.col("url").cast("string"), F.lit(""))})
    out = out.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    return out.withColumns({f"suffix{k}": suffix(F.col("host"), k) for k in LEVELS})


def seed_urls(spark: SparkSession, n: int = SEED_URLS, salt: int = 0) -> DataFrame:
    """(url, label, family): n generated urls, the same ones for one salt. `article` and `shop` are labelled 0,
    `random host` (names that no one would choose), `redirect` (many opaque parameters) and `stuffed`
    (deep paths full of numbers) 1."""
    i, one = F.col("id"), lambda c: F.xxhash64("id", F.lit(f"{salt} {c}"))
    pick = lambda words, c: F.element_at(F.array(*map(F.lit, words)), (F.pmod(one(c), F.lit(len(words))) + 1).cast("int"))
    number = lambda c, low, high: F.pmod(one(c), F.lit(high - low)) + low
    token = lambda c, size: F.substr(F.translate(F.sha2(F.concat_ws(" ", i.cast("string"), F.lit(f"{salt} {c}")), 256), "abcdef13", "kxqzjvwp"), F.lit(1), size.cast("int"))
    name = F.concat(pick(_NAMES, 1), pick(["-", ""], 2), pick(_NAMES, 3))
    words = F.concat_ws("-", pick(_NAMES, 4), pick(_NAMES, 5), pick(_NAMES, 6))
    at = lambda h, ends: F.concat(pick(["http://", "https://"], 7), pick(["", "www.", "blog.", "m."], 8), h, F.lit("."), pick(ends, 9))
    few = pick(["", "", "?page=2&ref=x", "?utm_source=feed", "#top", ".html", "/"], 10)
    article = F.concat(at(name, _GOOD_ENDS), F.lit("/"), pick(["en", "de", "news", "2021/05", "post"], 11), F.lit("/"), F.when(one(12) % 2 == 0, words).otherwise(number(13, 1, 10_000).cast("string")), few)
    shop = F.concat(at(F.concat(name, number(14, 1, 25).cast("string")), _GOOD_ENDS), F.lit("/"), pick(_NAMES, 15), F.lit("?id="), number(16, 1, 100_000).cast("string"), pick(["", "&lang=en"], 17))
    random = F.concat(at(F.concat(token(18, number(19, 8, 16)), pick(["", "-"], 20), token(21, number(22, 3, 8))), _BAD_ENDS), F.lit("/"), token(23, number(24, 0, 9)), few)
    parts = F.transform(F.sequence(F.lit(1), number(25, 4, 10)), lambda k: F.concat(F.lit("p"), k.cast("string"), F.lit("="), F.substr(token(26, F.lit(60)), (3 * k).cast("int"), F.lit(11))))
    redirect = F.concat(at(name, _BAD_ENDS), pick(["/r?", "/go.php?", "/click/?"], 27), F.array_join(parts, "&"))
    deep = F.transform(F.sequence(F.lit(1), number(28, 5, 11)), lambda k: F.concat(pick(_NAMES, 29), F.lit("-"), F.substr(F.pmod(F.xxhash64("id", k, F.lit(salt)), F.lit(10**9)).cast("string"), F.lit(1), F.lit(7))))
    stuffed = F.concat(at(name, _BAD_ENDS), F.lit("/"), F.array_join(deep, "/"))
    kind = F.pmod(i, F.lit(8))
    families = [(kind < 3, article, "article", 0.0), (kind < 5, shop, "shop", 0.0), (kind == 5, random, "random host", 1.0), (kind == 6, redirect, "redirect", 1.0), (kind == 7, stuffed, "stuffed", 1.0)]
    choose = lambda k: F.coalesce(*(F.when(f[0], f[k] if isinstance(f[k], Column) else F.lit(f[k])) for f in families))
    return spark.range(n).select(choose(1).alias("url"), choose(3).alias("label"), choose(2).alias("family"))


def seed_labels(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, label): the urls with a host, labelled 1 where the host is of SEED_BLOCKED, else 0, and the generated ones."""
    h = host(F.col(url_col).cast("string"))
    names = [n for b in SEED_BLOCKED for n in (b, b.replace("-", ""))]
    bad = F.arrays_overlap(F.split(h, r"\."), F.array(*map(F.lit, names)))
    own = pages.where(h != "").select(F.col(url_col).cast("string").alias("url"), bad.cast("double").alias("label"))
    return own.unionByName(seed_urls(pages.sparkSession).select("url", "label"))


class Model:
    """Trees as one Column over the features; `margin` > 0 means block. `suffixes` holds, for each of
    LEVELS, suffix, n and bad; `trees` is what was compiled."""

    def __init__(self, margin: Column, suffixes: list[DataFrame] | None = None, trees: GBTClassificationModel | None = None):
        self.margin, self.suffixes, self.trees = margin, suffixes, trees


def _column(node, names: list[str]) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(names[split.featureIndex()]) <= float(split.threshold()), _column(node.leftChild(), names)).otherwise(_column(node.rightChild(), names))


def _fold() -> Column:
    return F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS))


def _out_of_fold(sample: DataFrame, known: DataFrame) -> DataFrame:
    """The sample with n and bad of its suffixes, counted over the labelled urls of the other folds."""
    sample = sample.withColumn("fold", _fold())
    for k in LEVELS:
        name = f"suffix{k}"
        wanted = F.broadcast(sample.select(name).distinct())  # SAMPLE rows at most
        folds = known.join(wanted, name, "left_semi").groupBy(name, _fold().alias("other")).agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
        pairs = sample.select(name, "fold").distinct().join(folds, name).where("fold <> other").groupBy(name, "fold").agg(F.sum("n").alias(f"n{k}"), F.sum("bad").alias(f"bad{k}"))
        sample = sample.join(pairs, [name, "fold"], "left")
    return sample


def fit(labelled: DataFrame, limit: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Fit on at most `limit` distinct labelled urls, chosen by hash; suffixes are counted over all
    distinct labelled urls. Labels other than 0 and 1 and null urls are left out; a url labelled both ways counts as blocked. Without both labels
    in the sample, all urls get the one label that is there, or allow."""
    known = written(_prepared(labelled.where("url is not null and label in (0, 1)").groupBy("url").agg(F.max("label").alias("label"))))
    sample = written(known.orderBy(F.xxhash64("url"), "url").limit(limit))
    found = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return Model(F.lit(1.0 if 1.0 in found else -1.0))
    names = list(features())
    ready = _out_of_fold(sample, known).select("label", *(c.alias(n) for n, c in features().items()))
    data = VectorAssembler(inputCols=names, outputCol="features").transform(ready).select("features", "label").coalesce(2)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, cacheNodeIds=False).fit(data)
    margin = functools.reduce(lambda a, b: a + b, (F.lit(float(w)) * _column(t._java_obj.rootNode(), names) for w, t in zip(model.treeWeights, model.trees)))
    suffixes = []
    for k in LEVELS:
        table = written(known.groupBy(F.col(f"suffix{k}").alias("suffix")).agg(F.count("*").alias("n"), F.sum("label").alias("bad")))
        size = table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("suffix")), F.lit(0)).alias("chars")).first()
        suffixes.append(F.broadcast(table) if size.rows <= BROADCAST_ROWS and size.chars <= BROADCAST_CHARS else table)
    return Model(margin, suffixes, model)


def scored(urls: DataFrame, model: Model) -> DataFrame:
    """Rows with url, plus host, path, the features and `margin`."""
    out = _prepared(urls)
    if model.suffixes is None:
        return out.withColumn("margin", model.margin)
    for k, table in zip(LEVELS, model.suffixes):
        out = out.join(table.select(F.col("suffix").alias(f"suffix{k}"), F.col("n").alias(f"n{k}"), F.col("bad").alias(f"bad{k}")), f"suffix{k}", "left")
    return out.select("*", *(c.alias(n) for n, c in features().items())).withColumn("margin", model.margin)


def judge(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, margin.

    Null and empty urls and urls without `://` have an empty host and path, fit no rule and are judged
    by the trees like others; urls may have any length. Repeated rows give a row each, an empty table
    gives none; other columns, whatever their names, are not read."""
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    out = scored(urls, fit(labelled))
    named, verdict = rule(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", named.alias("rule"), F.coalesce(verdict, F.when(F.col("margin") > 0, "block").otherwise("allow")).alias("verdict"), "margin")
