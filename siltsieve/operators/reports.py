"""Reports of a scan: totals, counts by rule and category, JSON and text, results pages, and comparison with what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltsieve.functions import files as N

# Categories in the order of display.
CATEGORIES = ("emptyFile", "unreadableFile", "duplicatePhoto", "blankPhoto", "unusedApp")


def totals(items: DataFrame) -> DataFrame:
    """One row: items, bytes, folders (distinct; items without a path have none)."""
    return items.agg(F.count("*").alias("items"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"), F.count_distinct(N.folder(F.col("path"))).alias("folders"))


def overall(findings: DataFrame) -> DataFrame:
    """One row: distinct removable bytes; an item of several findings counts once."""
    once = findings.where(~F.col("is_kept")).groupBy("id").agg(F.max("size_bytes").alias("size_bytes"))
    return once.agg(F.count("*").alias("items"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"))


def by_category(findings: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """category, findings, bytes for every category, zeros included, in their order. findings: category, finding, id, size_bytes, is_kept."""
    once = findings.groupBy("category", "id").agg(F.max(F.when(~F.col("is_kept"), F.col("size_bytes"))).alias("size_bytes"))
    size = once.groupBy("category").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"))
    n = findings.groupBy("category", "finding").agg(F.lit(1)).groupBy("category").agg(F.count("*").alias("findings"))
    every = findings.sparkSession.createDataFrame([(c, k) for k, c in enumerate(categories)], "category string, place int")
    out = every.join(n, "category", "left").join(size, "category", "left")
    return out.orderBy("place").select("category", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("items"))


def finding_list(findings: DataFrame) -> DataFrame:
    """One row for each finding with its removable bytes, most first."""
    own = F.coalesce(F.sum(F.when(~F.col("is_kept"), F.col("size_bytes"))), F.lit(0)).cast("long")
    out = findings.groupBy("category", "finding").agg(own.alias("bytes"), F.min(F.when(F.col("is_kept"), F.col("id"))).alias("keep_id"), F.count("*").alias("items"), F.first("reason").alias("reason"))
    return out.orderBy(F.col("bytes").desc(), "finding")


def to_json(findings: DataFrame, items: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """One row, `report`: totals and categories as JSON. Findings themselves are written by `findings_json`, a line each, as they grow with the data."""
    t, o, c = totals(items), overall(findings), by_category(findings)
    if status is not None:
        c = c.join(status, "category", "left")
    entries = F.map_from_entries(F.collect_list(F.struct("category", F.struct(*(x for x in c.columns if x != "category")))))
    one = t.crossJoin(o.select(F.col("bytes").alias("reclaimable"))).crossJoin(c.agg(entries.alias("categories")))  # one row each
    return one.select(F.to_json(F.struct(F.col("items").alias("itemsScanned"), F.col("bytes").alias("bytesScanned"), F.col("folders").alias("foldersScanned"), F.col("reclaimable").alias("reclaimableBytes"), "categories")).alias("report"))


def findings_json(findings: DataFrame) -> DataFrame:
    """`line`: one JSON object for each finding with its items. A finding of very many items is a line for each 10,000 of them (part)."""
    part = F.floor((F.row_number().over(Window.partitionBy("finding", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")) - 1) / 156)
    each = findings.withColumn("part", part * 64 + F.pmod(F.xxhash64("id"), F.lit(64)))
    each = each.withColumn("part", F.floor(F.col("part") / 64))
    rows = each.groupBy("category", "finding", "part").agg(F.first("reason").alias("reason"), F.array_sort(F.collect_list(F.struct("id", "size_bytes", "is_kept"))).alias("items"))
    return rows.select(F.to_json(F.struct("category", "finding", "part", "reason", "items")).alias("line"))


def text(findings: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """place, line: the report as text; of each category the `most` findings with most bytes, and how many more there are."""
    order = {c: k for k, c in enumerate(CATEGORIES)}
    place = F.coalesce(*(F.when(F.col("category") == c, k) for c, k in order.items()), F.lit(len(order)))
    size = N.format_bytes
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.col("bytes").desc(), "finding"))
    listed = finding_list(findings).withColumn("k", rank)
    n = listed.groupBy("category").agg(F.count("*").alias("n"))
    lines = listed.where(F.col("k") <= most).select((place * 1000 + 100 + F.col("k")).alias("place"), F.concat(F.lit("  - "), "reason", F.lit(" ("), size(F.col("bytes")), F.lit(")")).alias("line"))
    more = n.where(F.col("n") > most).select((place * 1000 + 999).alias("place"), F.concat(F.lit("  … and "), (F.col("n") - most).cast("string"), F.lit(" more")).alias("line"))
    heads = by_category(findings).select((place * 1000).alias("place"), F.concat(F.rpad("category", 18, " "), F.lit(" "), F.col("findings").cast("string"), F.lit(" found, "), size(F.col("bytes")), F.lit(" reclaimable")).alias("line"))
    t = totals(items).select(F.lit(-2).alias("place"), F.concat(F.lit("Scanned "), F.col("items").cast("string"), F.lit(" items ("), size(F.col("bytes")), F.lit(")")).alias("line"))
    o = overall(findings).select(F.lit(-1).alias("place"), F.concat(F.lit("Reclaimable: "), size(F.col("bytes"))).alias("line"))
    return t.unionByName(o).unionByName(heads).unionByName(lines).unionByName(more).orderBy("place")


def decimal_bytes(n: Column) -> Column:
    """Steps of 1000, at most three digits: 999 B, 1.5 KB, 123 MB; one decimal below 100 unless it is 0.

    Rounds the double itself, ties to even, as printf does: format_string would round the digits that it is shown with, half up.
    """
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = n / float(1000**k)
        shown = F.regexp_replace(F.call_function("format_number", v, F.when(v >= 100, "0").otherwise("0.0")), r"\.0$", "")
        low = 1000 if k == 1 else 999.5 * 1000 ** (k - 1)
        out = F.when(n >= low, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out


def collected_label(collected: Column, now: Column) -> Column:
    """Today, Yesterday, n days ago, or the date from a week on, by calendar days."""
    days = F.date_diff(now, collected)
    return F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(collected, "MMM d, yyyy"))


def time_left_label(expires: Column, now: Column) -> Column:
    left = F.unix_micros(expires.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    days = F.floor(left / 86_400_000_000).cast("long")
    return F.when(left <= 0, "Due for removal").when(days < 1, "Less than a day left").when(days == 1, "1 day left").otherwise(F.concat(days.cast("string"), F.lit(" days left")))


def results_page(candidates: DataFrame, unused_apps: DataFrame, storage: DataFrame) -> DataFrame:
    """label, bytes, wasted (of all), used_fraction. candidates: reason, size_bytes; apps: size_bytes; storage: one row free, total."""
    apps = unused_apps.agg(F.lit("Unused apps").alias("label"), F.sum("size_bytes").alias("bytes")).where("bytes is not null")
    rows = candidates.groupBy(F.col("reason").alias("label")).agg(F.sum("size_bytes").alias("bytes")).unionByName(apps)
    whole = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("wasted")).crossJoin(storage.select(N.used_fraction(F.col("free"), F.col("total")).alias("used_fraction")))  # one row each
    return rows.crossJoin(F.broadcast(whole)).select("label", F.col("bytes").cast("long").alias("bytes"), F.col("wasted").cast("long").alias("wasted"), "used_fraction")  # one row on the right


def collection_rows(candidates: DataFrame) -> DataFrame:
    """label `reason (n)` and bytes of each reason."""
    return candidates.groupBy("reason").agg(F.count("*").alias("n"), F.sum("size_bytes").cast("long").alias("bytes")).select(F.format_string("%s (%d)", "reason", "n").alias("label"), "bytes")


def folder_summary(verdicts: DataFrame) -> DataFrame:
    """One row: files, duplicates, empty, blurry, bytes that can go. verdicts: size_bytes, verdict (null for clean)."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.agg(F.count("*").alias("files"), n("duplicate").alias("duplicates"), n("empty").alias("empty"), n("blurry").alias("blurry"), F.coalesce(F.sum(F.when(F.col("verdict").isNotNull(), F.col("size_bytes"))), F.lit(0)).cast("long").alias("bytes"))


def screenshot_batches(verdicts: DataFrame, now: Column, old_days: int = 30) -> DataFrame:
    """batch (empty, unreadable or the kind), items, old (30 days and more), apps (counts by app). verdicts: id, kind, health, app, taken."""
    batch = F.when(F.col("health").startswith("E"), "empty").when(F.col("health").isNotNull(), "unreadable").otherwise(F.col("kind"))
    old = F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("taken").cast("timestamp")) >= old_days * 86_400_000_000, F.lit(False))
    each = verdicts.withColumns({"batch": batch, "old": old}).groupBy("batch", "app").agg(F.count("*").alias("n"), F.count_if("old").alias("old"))
    apps = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("app").isNotNull(), F.struct("app", "n")))))
    return each.groupBy("batch").agg(F.sum("n").alias("items"), F.sum("old").alias("old"), apps.alias("apps"))


def precision_recall(found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row from groups of ids (id, group): pairs found, expected, right, precision, recall; pairs are counted from group sizes, not made."""
    pairs = lambda c: F.coalesce(F.sum(c * (c - 1) / 2), F.lit(0)).cast("long")
    size = lambda d, *by: d.groupBy(*by).agg(F.count("*").alias("n")).agg(pairs(F.col("n")).alias("p"))
    both = found.select("id", F.col("group").alias("f")).join(expected.select("id", F.col("group").alias("e")), "id")
    one = size(found, "group").select(F.col("p").alias("found")).crossJoin(size(expected, "group").select(F.col("p").alias("expected"))).crossJoin(size(both, "f", "e").select(F.col("p").alias("right")))  # one row each
    share = lambda a, b: F.when(F.col(b) == 0, F.lit(1.0)).otherwise(F.col(a) / F.col(b))
    return one.select("*", share("right", "found").alias("precision"), share("right", "expected").alias("recall"))


def matching_groups(found: DataFrame, expected: DataFrame) -> DataFrame:
    """expected group, best found group (most ids in common, then smallest), common; expected groups without one have null."""
    both = found.select("id", F.col("group").alias("f")).join(expected.select("id", F.col("group").alias("e")), "id").groupBy("e", "f").agg(F.count("*").alias("common"))
    best = both.groupBy("e").agg(F.min_by(F.struct("f", "common"), F.struct(-F.col("common"), "f")).alias("b")).select("e", F.col("b.f").alias("found_group"), F.col("b.common").alias("common"))
    return expected.select(F.col("group").alias("e")).distinct().join(best, "e", "left").select(F.col("e").alias("expected_group"), "found_group", "common")


def write_report(spark: SparkSession, findings: DataFrame, items: DataFrame, path: str) -> None:
    """report (JSON), findings (JSON lines) and text under a folder."""
    to_json(findings, items).write.mode("overwrite").text(f"{path}/report")
    findings_json(findings).write.mode("overwrite").text(f"{path}/findings")
    text(findings, items).select("line").coalesce(1).write.mode("overwrite").text(f"{path}/text")
