"""String, header and number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_space(text: Column) -> Column:
    """Trimmed of characters up to U+0020, runs of two or more spaces as one; a single line end stays."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[ \t\n\x0B\f\r]{2,}", " ")


def heading_text(text: Column) -> Column:
    """Every run of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def index_escape(text: Column) -> Column:
    """Spaces, line ends and NULs escaped for a line of fields."""
    return F.replace(F.replace(F.replace(text, F.lit(" "), F.lit("%20")), F.lit("\n"), F.lit("%0A")), F.lit("\0"), F.lit("%00"))


def content_type(header: Column) -> Column:
    """A Content-Type without parameters; two types are written in their usual way."""
    base = F.substring_index(F.substring_index(F.trim(header), ";", 1), " ", 1)
    return F.when(base == "application/xhtml+xml", "text/html").when(base == "application/x-pdf", "application/pdf").otherwise(base)


#: Content types whose text is extracted.
EXTRACTED_TYPES = (
    "text/html",
    "application/pdf",
    "application/vnd.ms-excel",
    "text/csv",
    "application/csv",
    "application/vnd.ms-powerpoint",
    "application/msword",
    "application/vnd.ms-word.document.macroEnabled.12",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.oasis.opendocument.presentation",
    "application/vnd.oasis.opendocument.text",
    "application/vnd.oasis.opendocument.spreadsheet",
)


def text_error(content_type: Column) -> Column:
    return F.when(~F.coalesce(content_type.isin(*EXTRACTED_TYPES), F.lit(False)), "not implemented for content-type")


def status_code(line: Column) -> Column:
    """The status of an HTTP status line, or -1."""
    return F.coalesce(F.regexp_extract(line, r"(?s)^\s*\S+\s+(\d+)(?:\s.*|$)", 1).try_cast("int"), F.lit(-1))


def headers(block: Column) -> Column:
    """HTTP headers as a map from lower-case names to values; of repeated headers the first counts."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike("^[^:\\s]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_extract(x, "(?s)^[^:]+:(.*)$", 1)).alias("v")))
    firsts = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(firsts)


def is_brotli(encoding: Column) -> Column:
    """Is one of the comma-separated content encodings `br`?"""
    return F.exists(F.split(F.coalesce(encoding, F.lit("")), ","), lambda x: F.lower(F.trim(x)) == "br")


def display_size(n: Column) -> Column:
    """Bytes with a binary unit and one decimal."""
    size = F.abs(n)
    steps = [(1 << (10 * k), unit) for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB", "EiB"), 1)]
    out = F.when(size < 1024, F.format_string("%d bytes", n))
    for step, unit in steps:
        # tenths of the unit, rounded half up, in whole numbers
        whole = F.floor(size / F.lit(step // 1024)) if step > 1024 else size
        shown = F.format_string(f"%.1f {unit}", whole / F.lit(1024.0) * F.signum(n.cast("double")))
        out = out.when(whole <= 1048576, shown) if step < 1 << 60 else out.otherwise(shown)
    return out


def task_name(class_name: Column) -> Column:
    """`CdxIndexer` as `Cdx Indexer`."""
    return F.regexp_replace(class_name, "([a-z])([A-Z])", "$1 $2")


def duration(seconds: Column) -> Column:
    """`1h 2m 3s`, leading zero parts left out."""
    h, m, s = (F.floor(seconds / 3600).cast("long"), (F.floor(seconds / 60) % 60).cast("long"), (seconds % 60).cast("long"))
    text = lambda c, unit: F.concat(c.cast("string"), F.lit(unit))
    return F.when(h > 0, F.concat_ws(" ", text(h, "h"), text(m, "m"), text(s, "s"))).when(m > 0, F.concat_ws(" ", text(m, "m"), text(s, "s"))).otherwise(text(s, "s"))


def byte_ranges(header: Column, size: Column) -> Column:
    """The ranges of a Range header as array<struct<first, last>>, clipped to the size; null if the
    header is malformed or a range starts beyond the end. `-n` is the last n bytes, or all."""
    parts = F.split(F.regexp_extract(header, r"^bytes=(.*)$", 1), ",")

    def one(x: Column) -> Column:
        a, b = F.regexp_extract(x, r"^\s*(\d*)-(\d*)\s*$", 1).try_cast("long"), F.regexp_extract(x, r"^\s*(\d*)-(\d*)\s*$", 2).try_cast("long")
        first = F.when(a.isNull(), F.greatest(size - b, F.lit(0))).otherwise(a)
        last = F.when(a.isNull() | b.isNull(), size - 1).otherwise(F.least(b, size - 1))
        ok = x.rlike(r"^\s*(\d+-\d*|-\d+)\s*$") & (first < size) & (first <= last)
        return F.when(ok, F.struct(first.cast("long").alias("first"), last.cast("long").alias("last")))

    found = F.transform(parts, one)
    return F.when(header.rlike("^bytes=.+") & ~F.exists(found, lambda r: r.isNull()), found)


def artifact_type(path: Column) -> Column:
    return F.when(path.endswith(".log"), "LOG").when(path.endswith(".xcxml") | path.endswith(".cxml"), "CONFIG").when(path.endswith(".recover.gz"), "RECOVER").when(path.endswith(".dump"), "DUMP").otherwise("UNKNOWN")


def artifact_content_type(path: Column) -> Column:
    plain = path.endswith(".log") | path.endswith(".dump") | path.endswith(".txt")
    return F.when(path.endswith(".cxml"), "application/xml").when(plain, "text/plain").otherwise("application/octet-stream")


#: Names under which pages state each property, in order of preference.
META_NAMES = {
    "description": ("description", "DC.description", "DC.Description", "dcterms.description"),
    "keywords": ("Keywords", "keywords", "DC.keywords", "DC.Keywords", "dcterms.keywords", "pdf:docinfo:keywords"),
    "publisher": ("publisher", "DC.publisher", "DC.Publisher", "dcterms.publisher"),
    "creator": ("creator", "DC.creator", "DC.Creator", "dcterms.creator"),
    "contributor": ("contributor", "DC.contributor", "DC.Contributor", "dcterms.contributor"),
    "coverage": ("coverage", "DC.coverage", "DC.Coverage", "dcterms.coverage", "subject", "Subject", "pdf:docinfo:subject"),
    "og_site_name": ("og:site_name",),
    "og_title": ("og:title",),
}


def property_of(meta: Column, name: str) -> Column:
    """A property from a map of meta tags: the first of its names that is there, cleaned."""
    return collapse_space(F.coalesce(*(F.try_element_at(meta, F.lit(k)) for k in META_NAMES[name])))
