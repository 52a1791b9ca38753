"""Checks of stored files, caches and locks against what the catalogue says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCK_EXPIRY_SECONDS = 120
STALE_SWEEP_MILLIS = 300_000


def scrubbed(manifest: DataFrame, read: DataFrame) -> DataFrame:
    """(id, result, sha256): NEW, OK or MISMATCH for files (id, sha256) that were read (id, digest), ERROR for others.

    sha256 is what the catalogue should have: that of a new file is the one read."""
    out = manifest.select("id", "sha256").join(read.select("id", "digest"), "id", "left")
    result = F.when(F.col("digest").isNull(), "ERROR").when(F.col("sha256").isNull(), "NEW").when(F.col("sha256") == F.col("digest"), "OK").otherwise("MISMATCH")
    return out.select("id", result.alias("result"), F.coalesce("sha256", "digest").alias("sha256"))


def cache_validity(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(id, valid) of files (id, warc_state_id, size, sha256) by cache entries (id, has_meta, meta_id, meta_size, meta_sha256).

    An entry without metadata is good for a closed file with a digest. Else its id and size must
    agree, and its digest where both are known."""
    c = cache.select("id", "has_meta", "meta_id", "meta_size", "meta_sha256").withColumn("cached", F.lit(True))
    legacy = (F.col("warc_state_id") != 0) & F.col("sha256").isNotNull()
    agrees = (F.col("meta_id") == F.col("id")) & (F.col("meta_size") == F.col("size")) & F.coalesce(F.col("meta_sha256") == F.col("sha256"), F.lit(True))
    valid = F.when(F.col("cached").isNull(), False).when(~F.col("has_meta"), legacy).otherwise(agrees)
    return files.join(c, "id", "left").select("id", F.coalesce(valid, F.lit(False)).alias("valid"))


def live_locks(locks: DataFrame, now: int) -> DataFrame:
    """Locks (name, owner, checkin_time in epoch seconds) that haven't expired."""
    return locks.where(F.col("checkin_time") + LOCK_EXPIRY_SECONDS >= now)


def acquired(locks: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """Of the wanted locks (name, owner), those whose name no live lock has; of several owners the first in order."""
    free = wanted.join(live_locks(locks, now).select("name"), "name", "left_anti")
    return free.groupBy("name").agg(F.min("owner").alias("owner")).select("name", "owner", F.lit(now).cast("long").alias("checkin_time"), F.lit(now).cast("long").alias("acquire_time"))


def renewed(locks: DataFrame, owner: str, now: int) -> DataFrame:
    """The locks after their owner has checked in: its live ones are good for another term, expired ones stay so."""
    alive = (F.col("owner") == owner) & (F.col("checkin_time") + LOCK_EXPIRY_SECONDS >= now)
    return locks.withColumn("checkin_time", F.when(alive, F.lit(now).cast("long")).otherwise(F.col("checkin_time")))


def released(locks: DataFrame, owner: str, names: list[str] | None = None) -> DataFrame:
    """The locks without those of an owner, or without the named ones of them."""
    own = F.col("owner").eqNullSafe(F.lit(owner))
    return locks.where(~(own if names is None else own & F.coalesce(F.col("name").isin(*names), F.lit(False))))


def sweep_due(last_sweep_millis: int, now_millis: int) -> bool:
    return now_millis - last_sweep_millis >= STALE_SWEEP_MILLIS


def first_unreadable(records: DataFrame) -> DataFrame:
    """(filename, position) of the first record (filename, position, parsed) of each file that can't be parsed."""
    return records.where(~F.col("parsed")).groupBy("filename").agg(F.min("position").alias("position"))


def without_ranges(records: DataFrame, bad: DataFrame) -> DataFrame:
    """Records (filename, position) without those at the positions to be removed."""
    return records.join(bad.select("filename", "position"), ["filename", "position"], "left_anti")


def replaceable(blobs: DataFrame) -> DataFrame:
    """(id, decision) for blobs (id, readable, size, sha256, new_size, new_sha256): only an unreadable one whose
    replacement agrees in size and digest may be replaced."""
    same = (F.col("size") == F.col("new_size")) & (F.col("sha256") == F.col("new_sha256"))
    return blobs.select("id", F.when(F.col("readable"), "refuse_readable").when(F.coalesce(same, F.lit(False)), "replace").otherwise("refuse_different").alias("decision"))


def changed_fields(source: DataFrame, catalogue: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, action, fields): create for rows only the source has, patch with the names of the fields that differ
    for rows of both; rows that agree, or that only the catalogue has, need nothing."""
    a, b = source.select(key, *fields).alias("a"), catalogue.select(F.col(key).alias("_key"), *fields).alias("b")
    out = a.join(b, F.col(f"a.{key}") == F.col("_key"), "left")
    names = F.filter(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    new = F.col("_key").isNull()
    out = out.select(F.col(f"a.{key}").alias(key), F.when(new, "create").otherwise("patch").alias("action"), F.when(new, F.array(*map(F.lit, fields))).otherwise(names).alias("fields"))
    return out.where(F.size("fields") > 0)
