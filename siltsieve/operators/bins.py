"""Bin, exclusions, apps and reports: filters, orders, summaries and pure changes of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def search(entries: DataFrame, text: str = "", category: str | None = None) -> DataFrame:
    """Entries of a category whose name, path or reason holds the text, literally and in any case."""
    needle = text.strip().lower()
    out = entries if category is None else entries.where(F.col("category") == category)
    if not needle:
        return out
    return out.where(F.contains(F.lower("file_name"), F.lit(needle)) | F.contains(F.lower("original_path"), F.lit(needle)) | F.contains(F.lower("reason"), F.lit(needle)))


def bin_order(by: str) -> list[Column]:
    """newest, oldest, largest, name or leaving (null last); ties by name, then id."""
    first = {"newest": [F.col("collected_at").desc()], "oldest": [F.col("collected_at")], "largest": [F.col("original_bytes").desc()], "name": [], "leaving": [F.col("expires_at").asc_nulls_last()]}[by]
    return [*first, F.lower("file_name"), F.col("id")]


def summary(entries: DataFrame, now: Column) -> DataFrame:
    """One row: entries, bytes before and after, bytes saved (never negative), entries that leave within 3 days or should have."""
    saved = F.greatest(F.col("original_bytes") - F.col("stored_bytes"), F.lit(0))
    leaving = F.count_if(F.col("expires_at") <= now + F.expr("INTERVAL 3 DAYS"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return entries.agg(F.count("*").alias("entries"), total("original_bytes").alias("original_bytes"), total("stored_bytes").alias("stored_bytes"), total(saved).alias("saved_bytes"), leaving.alias("leaving_soon"))


def emptied(entries: DataFrame, wanted: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: removed entries and their bytes, and how many wanted ones were kept."""
    gone = entries.join(removed.select("id").distinct(), "id", "left_semi")
    kept = wanted.select("id").distinct().join(removed.select("id").distinct(), "id", "left_anti")
    return gone.agg(F.count("*").alias("removed"), F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("freed_bytes")).crossJoin(kept.agg(F.count("*").alias("kept")))  # one row each


def unused(apps: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Apps, not the system's, that were never used or last strictly before the cutoff; largest first."""
    cutoff = now - F.make_dt_interval(days=F.lit(days))
    return apps.where(~F.col("is_system") & (F.col("last_used").isNull() | (F.col("last_used") < cutoff))).orderBy(F.col("size_bytes").desc(), F.lower("label"), "package")


def not_excluded(items: DataFrame, exclusions: DataFrame, now: Column) -> DataFrame:
    """Items (kind, id) without an exclusion that is active."""
    return items.join(exclusions.where(F.col("until").isNull() | (F.col("until") > now)), ["kind", "id"], "left_anti")


def with_exclusion(exclusions: DataFrame, added: DataFrame) -> DataFrame:
    """The later exclusion of each (kind, id); adding one again starts its period anew."""
    both = exclusions.unionByName(added)
    return both.groupBy("kind", "id").agg(F.max_by("until", "excluded_at").alias("until"), F.max("excluded_at").alias("excluded_at"))


def reclaimable(findings: DataFrame) -> DataFrame:
    """findings: category, id, size_bytes, is_kept -> by category: findings, distinct bytes; an item counts once in its category."""
    once = findings.where(~F.col("is_kept")).groupBy("category", "id").agg(F.max("size_bytes").alias("size_bytes"), F.count("*").alias("times"))
    return once.groupBy("category").agg(F.sum("times").cast("long").alias("findings"), F.sum("size_bytes").cast("long").alias("bytes"))


def top_per_category(findings: DataFrame, k: int = 20) -> DataFrame:
    """The k largest of each category with their position."""
    w = Window.partitionBy("category").orderBy(F.col("size_bytes").desc(), "id")
    return findings.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def one_candidate(candidates: DataFrame, priority: list[str]) -> DataFrame:
    """One category an item, by priority."""
    at = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("category"))
    return candidates.groupBy("id").agg(F.min_by("category", at).alias("category"))
