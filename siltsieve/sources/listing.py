"""Listings put together: in memory, several as one, behind a permission, by device; app lists; a folder's classification."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltsieve.functions import files as N
from siltsieve.sources.folder import SCHEMA, FolderSource

HASHED_MAX = 25 << 20


class PermissionMissing(RuntimeError):
    """A listing was asked for before access was verified."""


def memory(spark: SparkSession, files: dict[str, bytes], unreadable: frozenset[str] = frozenset(), modified=None, head: int = 4096, tail: int = 65_557) -> DataFrame:
    """Files given as bytes, with the columns of the folder source; unreadable ones have an issue and no bytes."""
    rows = []
    for path in sorted(files):
        data = files[path]
        bad = path in unreadable
        rows.append((path, path.rsplit("/", 1)[-1], path, None if bad else len(data), modified, "fileSystem", None if bad else bytearray(data[:head]), None if bad else bytearray(data[-tail:]), "can't be read" if bad else None))
    return spark.createDataFrame(rows, SCHEMA)


def composite(*sources: DataFrame) -> DataFrame:
    """All listings as one; of an id that several list, the last one's row."""
    every = reduce(DataFrame.unionByName, [s.withColumn("source_id", F.lit(k)) for k, s in enumerate(sources)])
    last = every.groupBy("id").agg(F.max("source_id").alias("source_id"))
    return every.join(last, ["id", "source_id"], "left_semi")


def guarded(granted: Callable[[], bool], source: Callable[[], DataFrame]) -> DataFrame:
    """The listing, made only after access is verified."""
    if not granted():
        raise PermissionMissing("access has not been granted")
    return source()


@dataclass(frozen=True)
class Device:
    """Roots and exclusions of a device; `simulated` makes a plain folder look like one."""

    roots: tuple[str, ...]
    excluded: tuple[str, ...] = ()
    platform: str = "desktop"
    reads_apps: bool = False


def android(root: str) -> Device:
    return Device((root,), (f"{root}/Android/data", f"{root}/Android/obb"), "android", True)


def ios(root: str) -> Device:
    return Device((root,), (), "ios")


def list_device(spark: SparkSession, device: Device) -> DataFrame:
    spark.dataSource.register(FolderSource)
    read = spark.read.format("folder").option("excluded", ",".join(device.excluded))
    return composite(*(read.load(root) for root in device.roots))


def photo_library(assets: DataFrame) -> DataFrame:
    """Assets (id, name, size_bytes, taken) of a library that gives no bytes."""
    return assets.select("id", "name", F.lit(None).cast("string").alias("path"), "size_bytes", F.col("taken").alias("modified"), F.lit("photoLibrary").alias("origin"), *(F.lit(None).cast(t).alias(n) for n, t in (("head", "binary"), ("tail", "binary"), ("issue", "string"))))


_APP = "packageName string, label string, sizeBytes long, installedAt string, lastUsedAt string, isSystem boolean, isEssential boolean"


def json_apps(spark: SparkSession, path: str) -> DataFrame:
    """Apps from a JSON array: dates as ISO text or milliseconds; no label means the package, no size 0; apps without a package are dropped."""
    raw = spark.read.option("multiLine", True).schema(_APP).json(path)
    when = lambda c: F.coalesce(F.timestamp_millis(F.nullif(F.greatest(F.col(c).try_cast("long"), F.lit(0)), F.lit(0))), F.try_to_timestamp(F.when(~F.col(c).rlike(r"^-?\d+$"), F.col(c))))
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    return raw.where(F.col("packageName") != "").select(F.col("packageName").alias("package"), F.coalesce("label", "packageName").alias("label"), F.coalesce("sizeBytes", F.lit(0)).alias("size_bytes"), when("installedAt").alias("installed_at"), when("lastUsedAt").alias("last_used"), off("isSystem").alias("is_system"), off("isEssential").alias("is_essential"))


def installed_apps(launchable: DataFrame, usage: DataFrame, essential: DataFrame) -> DataFrame:
    """launchable (package, ...) with last_used (the latest of its usage rows) and is_essential."""
    last = usage.groupBy("package").agg(F.max("last_used").alias("last_used"))
    marks = essential.select("package").distinct().withColumn("is_essential", F.lit(True))
    return launchable.join(last, "package", "left").join(marks, "package", "left").withColumn("is_essential", F.coalesce("is_essential", F.lit(False)))


def unused_apps(apps: DataFrame, now: Column, days: int = 90, kept: DataFrame | None = None) -> DataFrame:
    """Apps that are no system's and not essential, installed at the cutoff or before (or unknown), last used strictly before it or never, and not kept; largest first, then by label."""
    cutoff = now - F.make_dt_interval(F.lit(days))
    out = apps.where(~F.col("is_system") & ~F.col("is_essential") & (F.col("installed_at").isNull() | (F.col("installed_at") <= cutoff)) & (F.col("last_used").isNull() | (F.col("last_used") < cutoff)))
    if kept is not None:
        out = out.join(kept.select("package"), "package", "left_anti")
    return out.orderBy(F.col("size_bytes").desc(), F.lower("label"), "package")


def classify_folder(files: DataFrame) -> DataFrame:
    """files: path, size_bytes, content, mean, std, sharpness (null for what is no picture) -> path, verdict, duplicate_of.

    Empty, then duplicate of an earlier path (SHA-256, up to 25 MiB only), then black, then blurry; null for clean files.
    """
    key = F.when((F.col("size_bytes") > 0) & (F.col("size_bytes") <= HASHED_MAX), F.sha2("content", 256))
    own = files.select("path", "size_bytes", "mean", "std", "sharpness", key.alias("key"))
    first = own.where("key is not null").groupBy("key").agg(F.min("path").alias("first"))
    each = own.join(first, "key", "left")
    again = F.coalesce(F.col("path") != F.col("first"), F.lit(False))
    verdict = F.when(F.col("size_bytes") == 0, "empty").when(again, "duplicate").when((F.col("mean") <= 8) & (F.col("std") <= 6), "black").when(F.col("sharpness") < 60, "blurry")
    return each.select("path", "size_bytes", verdict.alias("verdict"), F.when(again, F.col("first")).alias("duplicate_of"))


def photo_filter(items: DataFrame) -> DataFrame:
    return items.where(N.is_photo(N.extension(F.col("name"))))
