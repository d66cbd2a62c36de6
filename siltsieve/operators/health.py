"""The empty & unreadable scan over a listing with first, last and whole bytes, and what other scans take from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltsieve.functions import formats

SCHEMA = "id {}, rule string, confidence string, evidence string, misnamed string"


def health(files: DataFrame) -> DataFrame:
    """files: id, name, size_bytes, head, tail, whole (null above 32 MiB), issue -> id, rule, confidence, evidence, misnamed. One pass, no shuffle."""
    kind = dict(files.dtypes)["id"]
    return files.select("id", "name", F.col("size_bytes").cast("long").alias("size_bytes"), "head", "tail", "whole", "issue").mapInArrow(formats.health_of, SCHEMA.format(kind))


def with_policy(verdicts: DataFrame, modified: Column, now: Column, *, disabled: tuple[str, ...] = (), certain_only: bool = False, grace_minutes: int = 10) -> DataFrame:
    """verdicts with `held_back`: disabled, unsure and fresh ones give no rule. A null time is not fresh."""
    fresh = F.col("rule").isin(*formats.GRACED) & F.coalesce(F.unix_micros(now) - F.unix_micros(modified) < grace_minutes * 60_000_000, F.lit(False))
    why = F.when(F.col("rule").isNull(), None).when(fresh, "grace").when(F.col("rule").isin(*(disabled or ("",))), "disabled").when(F.lit(certain_only) & (F.col("confidence") != "certain"), "unsure")
    out = verdicts.withColumn("held_back", why)
    return out.withColumns({c: F.when(F.col("held_back").isNull(), F.col(c)) for c in ("rule", "confidence")})


def healthy(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items without a verdict: the others leave the scans that come after."""
    return items.join(verdicts.where("rule is not null").select("id"), "id", "left_anti")


def counts_by_rule(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("rule is not null").groupBy("rule").agg(F.count("*").alias("items"))


def partial_copies(broken: DataFrame, whole: DataFrame, prefix: int = 65_536, most: int = 50) -> DataFrame:
    """Failed downloads: for each broken file the healthy, larger file of the same inner extension that begins with its bytes.

    broken, whole: id, ext, size_bytes, head (their first `prefix` bytes). Files meet at (extension, digest of as many first
    bytes as the broken one has, up to `prefix`): each length that occurs among the broken files of an extension gives one
    digest of a healthy file. Of several, the smallest id among the `most` nearest in size counts.
    """
    own = broken.select(F.col("id").alias("broken_id"), "ext", F.col("size_bytes").alias("n"), F.least(F.col("size_bytes"), F.lit(prefix)).cast("int").alias("length"), "head")
    own = own.where("length > 0").withColumn("key", F.sha2(F.expr("substring(head, 1, length)"), 256)).drop("head")
    lengths = own.select("ext", "length").distinct()
    each = whole.select(F.col("id").alias("whole_id"), "ext", F.col("size_bytes").alias("m"), "head").join(F.broadcast(lengths) if lengths.count() <= 10_000 else lengths, "ext")
    each = each.where("m > length").withColumn("key", F.sha2(F.expr("substring(head, 1, length)"), 256)).select("whole_id", "ext", "m", "length", "key")
    found = own.join(each, ["ext", "length", "key"]).where("m > n")
    return found.groupBy("broken_id").agg(F.min_by("whole_id", F.struct("m", "whole_id")).alias("whole_id"))
