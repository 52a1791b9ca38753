"""URL functions as column expressions; only resolution against a base needs Python.

Keys follow one documented rule, `surt`: scheme, user, port and fragment go, the host is
lower-cased, a leading `www`, `www1`, ... goes, and its labels are reversed:
`https://www.Example.org:80/a?b#c` becomes `(org,example,)/a?b`.
"""

from __future__ import annotations

from collections.abc import Collection
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCHEME = r"^[a-zA-Z][a-zA-Z+.-]*://?"


def add_implicit_scheme(url: Column, scheme: str = "http") -> Column:
    return F.when(url.rlike(_SCHEME), url).otherwise(F.concat(F.lit(f"{scheme}://"), url))


def remove_scheme(url: Column) -> Column:
    return F.regexp_replace(url, _SCHEME, "")


def host(url: Column) -> Column:
    """Lower-case host, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_surt(host: Column) -> Column:
    """`(org,example,` for example.org."""
    return F.concat(F.lit("("), F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(","))


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www[0-9]*\.", "")


def surt(url: Column) -> Column:
    """The sort-friendly key of a url; see the module's text."""
    full = add_implicit_scheme(F.trim(url))
    rest = F.regexp_extract(full, r"(?s)://?[^/?#]*([^#]*)", 1)
    return F.concat(host_surt(without_www(host(full))), F.lit(")"), F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest))


def comparison_key(url: Column) -> Column:
    """Key under which urls count as the same page: `surt` in lower case without a closing slash; null for urls without a host."""
    key = F.regexp_replace(F.lower(surt(url)), "/+$", "")
    return F.when(host(add_implicit_scheme(F.trim(url))) != "", key)


#: Public suffixes of two labels; all others are taken to have one.
TWO_LABEL_SUFFIXES = ("com.au", "net.au", "org.au", "edu.au", "gov.au", "asn.au", "id.au", "co.uk", "org.uk", "ac.uk", "gov.uk", "co.nz", "org.nz", "govt.nz", "ac.nz", "co.jp", "com.br", "co.za")


def site(url: Column, suffixes: Collection[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The registrable domain of a url: one label more than its public suffix; for hosts of a
    single label, or numbers, the host without www; for urls without host the url itself.

    `suffixes` are the public suffixes of two and more labels that count, such as those of a full list;
    the longest one that a host ends with holds, and other hosts have a suffix of one label."""
    h = host(add_implicit_scheme(url))
    n = F.lit(2)
    for labels in sorted({s.count(".") + 1 for s in suffixes}):
        own = [s for s in suffixes if s.count(".") + 1 == labels]
        n = F.when(F.substring_index(h, ".", -labels).isin(*own), labels + 1).otherwise(n)
    labels = F.split(h, "[.]")
    named = F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return F.when(h == "", url).when(h.rlike(r"^[0-9.]+$") | (F.size(labels) < n), without_www(h)).otherwise(named)


def clean_url(url: Column) -> Column:
    """Scheme and host in lower case, default port and fragment gone, an empty path as `/`; spaces and line ends escaped."""
    c = F.regexp_replace(url, r"(?s)#.*", "")
    scheme = F.lower(F.regexp_extract(c, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    authority = F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?]*)", 1))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    rest = F.regexp_extract(c, r"(?s)^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*(.*)$", 1)
    rest = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    out = F.when(scheme == "", c).otherwise(F.concat(scheme, F.lit("://"), authority, rest))
    return F.replace(F.replace(F.replace(out, F.lit(" "), F.lit("%20")), F.lit("\r"), F.lit("%0d")), F.lit("\n"), F.lit("%0a"))


def _resolved(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b: str | None, x: str | None) -> str | None:
        try:
            return None if b is None or x is None else urljoin(b, x.strip())
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype=object)


def resolve(base: Column, link: Column) -> Column:
    """A link resolved against its base url (RFC 3986); null where that fails."""
    return F.pandas_udf(_resolved, "string")(base, link)


def sane(url: Column) -> Column:
    """Does the url have a host with a dot, and no white space?"""
    return host(url).contains(".") & ~url.rlike(r"\s")


# archives that serve instances of titles below <prefix><number>/<date>/


def original_url(url: Column, prefix: str) -> Column:
    """The url that an archive's delivery url stands for: `<prefix>12/20010101-0000/host.tld/x` is
    `http://host.tld/x`; other urls are themselves. `prefix` is literal, as `http://archive.example/pan/`."""
    inner = F.regexp_extract(url, rf"^\Q{prefix}\E[0-9]+/[0-9-]+/([^/]+\.[^/]+/.*)$", 1)
    return F.when(inner != "", F.concat(F.lit("http://"), inner)).otherwise(url)


def is_recursive(url: Column, prefix: str) -> Column:
    """Is it a page of the archive captured by the archive itself?"""
    return url.rlike(rf"^\Q{prefix}\E[0-9]+/[0-9-]+/\Q{prefix.split('://')[1]}\E.*$")


def url_map_instance(url: Column, prefix: str) -> Column:
    """`<number>/<date>` of an instance's url.map; empty for other urls."""
    return F.regexp_extract(url, rf"^\Q{prefix}\E([0-9]+/[0-9-]+)/url\.map$", 1)


def mirror_path(path: Column, instance: Column) -> Column:
    """A path of an instance without its leading slash, number and date; the date may lack its `-0000`."""
    p = F.regexp_replace(path, "^/", "")
    legacy = F.regexp_replace(instance, "-0000$", "")
    rest = lambda head: F.substr(p, F.length(head) + 2)
    return F.when(p.startswith(F.concat(instance, F.lit("/"))), rest(instance)).when(p.startswith(F.concat(legacy, F.lit("/"))), rest(legacy)).otherwise(p)


def map_aliases(maps: DataFrame, prefix: str) -> DataFrame:
    """(instance, alias, target, kind) from url.map bodies (instance, body).

    Lines read `target^^path`. A primary alias is the path below the instance; a secondary
    one is the target's own address below it, where no primary alias of the instance covers it."""
    parts = F.split(F.trim(F.col("line")), r"\^\^")
    base = F.concat(F.lit(prefix), F.col("instance"), F.lit("/"))
    lines = maps.select("instance", F.explode(F.split("body", "\r?\n")).alias("line")).where(F.size(parts) >= 2)
    primary = lines.select("instance", clean_url(add_implicit_scheme(F.get(parts, 0))).alias("target"), clean_url(F.concat(base, mirror_path(F.get(parts, 1), F.col("instance")))).alias("alias"))
    primary = primary.where(sane(F.col("target")) & sane(F.col("alias")))
    secondary = primary.select("instance", "target", F.concat(base, remove_scheme(F.col("target"))).alias("alias")).where(sane(F.col("alias")))
    secondary = secondary.join(primary.select("instance", "alias").distinct(), ["instance", "alias"], "left_anti")
    return primary.select("instance", "alias", "target", F.lit("primary").alias("kind")).unionByName(secondary.select("instance", "alias", "target", F.lit("secondary").alias("kind")))


def index_page_aliases(records: DataFrame, prefix: str) -> DataFrame:
    """(filename, alias, target): directories of `.../index.html` pages of files (filename, url) without any url.map."""
    mapped = records.where(url_map_instance(F.col("url"), prefix) != "").select("filename").distinct()
    pages = records.where(F.col("url").startswith(prefix) & F.col("url").endswith("/index.html") & ~is_recursive(F.col("url"), prefix))
    return pages.join(mapped, "filename", "left_anti").select("filename", F.regexp_replace("url", "index[.]html$", "").alias("alias"), F.col("url").alias("target"))


def request_key(url: Column, method: Column, body: Column) -> Column:
    """The key of a capture with its request folded in: for POST and PUT `__method` and the body become parameters."""
    encoded = F.concat(F.lit("__method="), method, F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit("&"), body)).otherwise(""))
    full = F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), encoded)
    return F.when(method.isin("POST", "PUT"), surt(full)).otherwise(surt(url))


def highlighted(url: Column) -> Column:
    """A seed's url as HTML with its host emphasised."""
    h = F.regexp_extract(url, r"://([^/?#:]+)", 1)
    safe = F.replace(F.replace(F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(h == "", safe).otherwise(F.replace(safe, h, F.concat(F.lit("<strong>"), h, F.lit("</strong>"))))
