"""Pure changes of the bin and of exclusions: each takes tables and gives new ones; no file is moved."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCLUSION_DAYS, CAP = 30, 100 * 1024 * 1024


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select("id").distinct()


def collect(bin_: DataFrame, exclusions: DataFrame, items: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(bin, exclusions) after items (id, reason) were collected: ids already there keep their record, their exclusions go."""
    new = items.groupBy("id").agg(F.min("reason").alias("reason")).join(_ids(bin_), "id", "left_anti")
    added = new.select("id", F.coalesce("reason", F.lit("manual")).alias("reason"), now.cast("timestamp").alias("collected_at"))
    return bin_.select("id", "reason", "collected_at").unionByName(added), exclusions.join(_ids(items).withColumn("kind", F.lit("file")), ["kind", "id"], "left_anti")


def recover(bin_: DataFrame, exclusions: DataFrame, items: DataFrame, now: Column, do_not_collect: bool = False) -> tuple[DataFrame, DataFrame]:
    """(bin, exclusions) after items (id, label) left the bin; with `do_not_collect` they are excluded for 30 days."""
    left = bin_.join(_ids(items), "id", "left_anti")
    if not do_not_collect:
        return left, exclusions
    return left, exclude(exclusions, items.select(F.lit("file").alias("kind"), "id", "label"), now)


def delete(bin_: DataFrame, wanted: DataFrame, removed: DataFrame, missing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bin, ids that left it): of the wanted ones in the bin, those that the device removed or no longer has."""
    gone = _ids(wanted).join(_ids(bin_), "id", "left_semi").join(_ids(removed).unionByName(_ids(missing)).distinct(), "id", "left_semi")
    return bin_.join(gone, "id", "left_anti"), gone


def forget_missing(bin_: DataFrame, missing: DataFrame) -> DataFrame:
    return bin_.join(_ids(missing), "id", "left_anti")


def present(bin_: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with their asset's columns, ids whose asset is gone, to be forgotten)."""
    return bin_.join(assets, "id"), _ids(bin_.join(assets, "id", "left_anti"))


def exclude(exclusions: DataFrame, items: DataFrame, now: Column, days: int = EXCLUSION_DAYS) -> DataFrame:
    """exclusions (kind, id, excluded_at, until, label) with items (kind, id, label) added; adding one again starts its period anew."""
    new = items.dropDuplicates(["kind", "id"]).select("kind", "id", now.cast("timestamp").alias("excluded_at"), (now.cast("timestamp") + F.make_dt_interval(F.lit(days))).alias("until"), "label")
    return exclusions.join(new, ["kind", "id"], "left_anti").select(*new.columns).unionByName(new)


def restore(exclusions: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries put back as they were."""
    return exclusions.join(entries, ["kind", "id"], "left_anti").unionByName(entries)


def remove(exclusions: DataFrame, items: DataFrame) -> DataFrame:
    return exclusions.join(items.select("kind", "id"), ["kind", "id"], "left_anti")


def purge(exclusions: DataFrame, now: Column) -> DataFrame:
    """Exclusions that are still active."""
    return exclusions.where(F.col("until").isNull() | (F.col("until") > now))


def active(exclusions: DataFrame, now: Column) -> DataFrame:
    """Soonest end first, permanent ones last, then by label (id where there is none) and key."""
    name = F.lower(F.coalesce("label", "id"))
    return purge(exclusions, now).orderBy(F.col("until").asc_nulls_last(), name, F.concat_ws(":", "kind", "id"))


def expired(entries: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Entries whose `days` are over; the exact end counts as over."""
    return entries.where(F.unix_micros(now) - F.unix_micros("collected_at") >= days * 86_400_000_000)


def admit(files: DataFrame, used: int = 0, cap: int = CAP) -> DataFrame:
    """files: seq, id, stored_bytes -> with `admitted`: in order of arrival, those that still fit; a rejected one takes no space.

    What is left after each file depends on all before it, so one task walks them, in Arrow batches; it keeps a single number.
    """

    def run(batches):
        left = cap - used
        for frame in batches:
            ok = []
            for n in frame.stored_bytes:
                fits = n <= left
                left -= n if fits else 0
                ok.append(fits)
            yield frame.assign(admitted=pd.Series(ok, dtype=bool))

    rows = files.select("seq", "id", F.col("stored_bytes").cast("long").alias("stored_bytes"))
    kind = dict(rows.dtypes)
    return rows.orderBy("seq").coalesce(1).mapInPandas(run, f"seq {kind['seq']}, id {kind['id']}, stored_bytes long, admitted boolean")


def free_name(names: DataFrame, taken: DataFrame) -> DataFrame:
    """names: id, folder, name; taken: folder, name -> id, free: the name, or with " (n)" before its extension for the smallest free n.

    Restored metadata only: the numbers in use of a stem are gathered per stem, never per folder.
    """
    split = lambda d: d.withColumns({"stem": F.regexp_replace("name", r"^(.+?)(\.[^.]*)?$", "$1"), "ext": F.regexp_extract("name", r"^.+?(\.[^.]*)?$", 1)})
    other = taken.select("folder", F.regexp_replace("name", r"^(.+?) \((\d+)\)(\.[^.]*)?$", "$1$3").alias("name"), F.coalesce(F.try_element_at(F.regexp_extract_all("name", F.lit(r" \((\d+)\)(?:\.[^.]*)?$"), F.lit(1)), F.lit(1)).cast("int"), F.lit(0)).alias("n"))
    exact = taken.select("folder", "name").distinct().withColumn("clash", F.lit(True))
    used = other.where("n > 0").groupBy("folder", "name").agg(F.collect_set("n").alias("used"))
    each = split(names).join(exact, ["folder", "name"], "left").join(used, ["folder", "name"], "left")
    used = F.coalesce("used", F.array().cast("array<int>"))
    n = F.array_min(F.array_except(F.sequence(F.lit(1), F.size(used) + 1), used))
    return each.select("id", F.when(F.col("clash"), F.concat("stem", F.lit(" ("), n.cast("string"), F.lit(")"), "ext")).otherwise(F.col("name")).alias("free"))


def parse_records(lines: DataFrame) -> DataFrame:
    """line `id|reason|ms` (the id may hold bars) -> id, reason, collected_at; malformed lines are dropped, an unknown reason is `other`."""
    # Reasons of collection.
    known = ("duplicate", "blurry", "blank", "empty", "unreadable", "screenshot", "largeOldVideo", "unused", "manual", "other")
    ms = F.substring_index("line", "|", -1)
    rest = F.expr("substring(line, 1, length(line) - length(substring_index(line, '|', -1)) - 1)")
    reason = F.substring_index(rest, "|", -1)
    ident = F.expr("substring(line, 1, length(line) - length(substring_index(line, '|', -2)) - 1)")
    good = (F.size(F.split("line", r"\|")) >= 3) & ms.rlike(r"^-?\d{1,18}$") & (ident != "")
    return lines.where(good).select(ident.alias("id"), F.when(reason.isin(*known), reason).otherwise("other").alias("reason"), F.timestamp_millis(ms.cast("long")).alias("collected_at"))


def parse_exclusions(lines: DataFrame) -> DataFrame:
    """JSON lines of exclusions, and old lines `id|until ms` (files, excluded 30 days before): malformed ones are dropped."""
    schema = "id string, kind string, excludedAt long, until long, label string"
    j = F.from_json("line", schema)
    old = F.regexp_extract("line", r"^([^{].*)\|(\d{1,18})$", 1)
    until = F.regexp_extract("line", r"^[^{].*\|(\d{1,18})$", 1).cast("long")
    at = F.timestamp_millis
    new = lines.select(j.alias("j")).where("j.id is not null and j.excludedAt is not null").select(F.coalesce("j.kind", F.lit("file")).alias("kind"), "j.id", at("j.excludedAt").alias("excluded_at"), at("j.until").alias("until"), "j.label")
    was = lines.where(old != "").select(F.lit("file").alias("kind"), old.alias("id"), at(until - EXCLUSION_DAYS * 86_400_000).alias("excluded_at"), at(until).alias("until"), F.lit(None).cast("string").alias("label"))
    return new.unionByName(was)


def to_json_lines(exclusions: DataFrame) -> DataFrame:
    return exclusions.select(F.to_json(F.struct("id", "kind", F.unix_millis("excluded_at").alias("excludedAt"), F.unix_millis("until").alias("until"), "label")).alias("line"))


def write_index(entries: DataFrame, path: str) -> None:
    """Bin indexes, one JSON folder for each folder of the bin."""
    entries.repartition("folder").write.mode("overwrite").partitionBy("folder").json(path)


def newest(loads: DataFrame, key: str = "id") -> DataFrame:
    """Of overlapping loads (generation), the newest one's rows."""
    return loads.join(loads.agg(F.max("generation").alias("generation")), "generation", "left_semi")
