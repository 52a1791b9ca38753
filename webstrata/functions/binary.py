"""Digests, signatures and damaged-record rules over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def sha1_base32(content: Column) -> Column:
    """Upper-case base32 SHA-1: each five hex digits of the hash are four base32 digits."""
    digest = F.sha1(content)
    five = lambda k: F.conv(F.substr(digest, k * 5 + 1, F.lit(5)), 16, 10).cast("int")
    letter = lambda n: F.substr(F.lit(BASE32), n + 1, F.lit(1))
    four = lambda n: F.concat(*(letter(F.shiftright(n, s).bitwiseAND(F.lit(31))) for s in (15, 10, 5, 0)))
    return F.when(content.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: four(five(k))), ""))


def digest_of_header(header: Column) -> Column:
    return F.regexp_replace(header, "^sha1:", "")


def digest_header(sha256: Column) -> Column:
    """`sha-256=` and base64, from a hex digest."""
    return F.concat(F.lit("sha-256="), F.base64(F.unhex(sha256)))


def is_gzip(content: Column) -> Column:
    return F.coalesce(F.hex(F.substring(content, 1, 2)) == "1F8B", F.lit(False))


def gzip_name(name: Column, gzip: Column) -> Column:
    """A file name that says so if its content is gzip: `.warc` gets `.gz`."""
    return F.when(F.lower(name).endswith(".warc") & gzip, F.concat(name, F.lit(".gz"))).otherwise(name)


#: How damaged records begin.
DELETED_MARK, FAKE_500_MARK, HTTP_MARK = "DELETED", "500 ", "HTTP/1."


def damage(content: Column) -> Column:
    """Why a record can't be parsed, by its first bytes (as Latin-1 text): DELETED, FAKE_500,
    COLON_IN_HTTP_STATUS, JUNK_<n>KB_BEFORE_HEADER (n of 1, 2, 4, 8), NO_HTTP_HEADER or UNKNOWN."""
    n, colon, line = F.length(content), F.instr(content, ":"), F.instr(content, "\n")
    http = content.startswith(HTTP_MARK) & (n > len(HTTP_MARK))
    out = F.when(content.startswith(DELETED_MARK), "DELETED").when(content.startswith(FAKE_500_MARK) & (n > len(FAKE_500_MARK)), "FAKE_500")
    out = out.when(http & (colon > 0) & ((colon < line) | (line == 0)), "COLON_IN_HTTP_STATUS")
    other = ~content.startswith(HTTP_MARK) & (n > len(HTTP_MARK))
    for kb in (1, 2, 4, 8):
        out = out.when(other & (F.substring(content, kb * 1024 + 1, len(HTTP_MARK)) == HTTP_MARK) & (n > kb * 1024 + len(HTTP_MARK)), f"JUNK_{kb}KB_BEFORE_HEADER")
    return out.when(other & content.rlike(r"^[\r\n]*<"), "NO_HTTP_HEADER").otherwise("UNKNOWN")


def aligned_header(content: Column) -> Column:
    """The first multiple of 1024, up to 8192, at which an HTTP header begins; 0 if none does."""
    places = F.filter(F.sequence(F.lit(1024), F.lit(8192), F.lit(1024)), lambda o: (F.substr(content, o + 1, F.lit(len(HTTP_MARK))) == HTTP_MARK) & (F.length(content) > o + len(HTTP_MARK)))
    return F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(0))


def shorter_header(header: Column, delta: Column) -> Column:
    """An archive header line whose last field, the length, is less by delta."""
    text = F.regexp_replace(header, r"\s+$", "")
    length = F.substring_index(text, " ", -1).try_cast("long")
    return F.concat(F.regexp_extract(text, r"(?s)^(.*) [^ ]*$", 1), F.lit(" "), (length - delta).cast("string"), F.lit("\n"))


#: What the repair of an archive does with each kind of damage.
REPAIRS = {
    "DELETED": "discard", "FAKE_500": "discard", "COLON_IN_HTTP_STATUS": "replace_colon", "JUNK_1KB_BEFORE_HEADER": "trim_junk",
    "JUNK_2KB_BEFORE_HEADER": "trim_junk", "JUNK_4KB_BEFORE_HEADER": "trim_junk", "JUNK_8KB_BEFORE_HEADER": "trim_junk",
}


def repair_action(damage: Column) -> Column:
    """discard, replace_colon, trim_junk or copy."""
    table = F.create_map(*(F.lit(x) for pair in REPAIRS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, damage), F.lit("copy"))
