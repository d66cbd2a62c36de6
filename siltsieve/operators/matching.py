"""Matching: staged exact duplicates, text and near-text edges, Hamming and time-band joins, keepers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltsieve.operators import graph


def exact_groups(items: DataFrame, content: str = "content", size: str = "size_bytes") -> DataFrame:
    """items (without their content) of identical content with `key`: equal size, then equal SHA-256 of the first 64 KB and of all.

    Sizes that occur once never have their content hashed; what is shuffled are digests and the other columns, never content.
    """
    again = items.groupBy(size).agg(F.count("*").alias("n")).where("n > 1").select(size)
    raw = F.col(content).cast("binary")
    hashed = items.join(again, size, "left_semi").withColumn("head", F.sha2(F.substring(raw, 1, 65_536), 256)).withColumn("key", F.when(F.octet_length(raw) <= 65_536, F.col("head")).otherwise(F.sha2(raw, 256))).drop(content)
    same = hashed.groupBy("head", "key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return hashed.join(same, "key", "left_semi").drop("head")


def keeper(members: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """members with `position` in their group; 1 is kept. The order has to be total."""
    return members.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def duplicate_groups(items: DataFrame, ident: str = "id") -> DataFrame:
    """One row a group of identical items: keep_id (smallest), members, reclaimable_bytes."""
    found = exact_groups(items)
    out = found.groupBy("key").agg(F.min(ident).alias("keep_id"), F.count("*").alias("members"), F.max("size_bytes").alias("size_bytes"))
    return out.where("members > 1").withColumn("reclaimable_bytes", (F.col("members") - 1) * F.col("size_bytes")).drop("size_bytes")


def same_key_pairs(units: DataFrame, ident: str, key: str) -> DataFrame:
    """Star edges: every item of a key with the smallest; as good as all pairs for components, and linear. Keys are computed once."""
    rows = graph.kept(units.select(F.col(ident).alias("b"), key))
    least = rows.groupBy(key).agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1")
    return rows.join(least, key).where("b <> a").select("a", "b")


def hamming_pairs(hashes: DataFrame, ident: str, value: str, distance: int = 8, bits: int = 63, bands: int = 3) -> DataFrame:
    """a, b, distance of all pairs within a Hamming distance.

    Of `bands` bands one differs in at most distance // bands bits, so a hash is stored under its bands and looked up under
    every value that near: few wide bands instead of many narrow ones whose values most rows share. Hashes are computed once.
    """
    rows = graph.kept(hashes.select(F.col(ident).alias("id"), F.col(value).cast("long").alias("h")))
    edges, reach = [round(k * bits / bands) for k in range(bands + 1)], distance // bands
    band = lambda k: F.shiftrightunsigned(F.col("h"), edges[k]).bitwiseAND((1 << (edges[k + 1] - edges[k])) - 1)
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), band(k).alias("v")) for k in range(bands)])).alias("at")
    stored = rows.select(F.col("id").alias("b"), F.col("h").alias("hb"), key).select("b", "hb", "at.k", "at.v")

    def near_values(k: int) -> Column:
        flips = [sum(1 << i for i in c) for n in range(reach + 1) for c in combinations(range(edges[k + 1] - edges[k]), n)]
        own = band(k)
        return F.transform(F.lit(flips).cast("array<long>"), lambda m: own.bitwiseXOR(m))

    wanted = [F.struct(F.lit(k).alias("k"), near_values(k).alias("vs")) for k in range(bands)]
    asked = rows.select(F.col("id").alias("a"), F.col("h").alias("ha"), F.inline(F.array(*wanted))).select("a", "ha", "k", F.explode("vs").alias("v"))
    d = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    near = asked.join(stored, ["k", "v"]).where(F.col("a") < F.col("b")).select("a", "b", d.alias("distance"))
    return near.where(F.col("distance") <= distance).distinct()


def close_in_time(items: DataFrame, ident: str, time: str, group: str, minutes: int) -> DataFrame:
    """a, b, gap_us of pairs of one group within so many minutes: joined on buckets of that length and the next, never all with all."""
    span = minutes * 60_000_000
    rows = items.where(F.col(time).isNotNull()).select(F.col(ident).alias("id"), F.col(group).alias("g"), F.unix_micros(F.col(time).cast("timestamp")).alias("t")).withColumn("k", F.floor(F.col("t") / span))
    other = rows.withColumn("k", F.explode(F.array(F.col("k"), F.col("k") + 1)))
    x, y = rows.alias("x"), other.alias("y")
    found = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.k") == F.col("y.k")) & ((F.col("y.t") < F.col("x.t")) | ((F.col("y.t") == F.col("x.t")) & (F.col("y.id") < F.col("x.id")))) & (F.col("x.t") - F.col("y.t") <= span))
    return found.select(F.col("y.id").alias("a"), F.col("x.id").alias("b"), (F.col("x.t") - F.col("y.t")).alias("gap_us"))


def first_seen(items: DataFrame, key: list[str], order: list[Column], ident: str) -> DataFrame:
    """Items that an earlier one with the same key precedes, with `first_id`; the earliest comes from a partial minimum, not a sort."""
    rank = F.struct(*order, F.col(ident).alias("_id"))
    first = items.groupBy(*key).agg(F.min(rank).alias("_first"))
    return items.join(first, key).where(F.col(ident) != F.col("_first._id")).withColumn("first_id", F.col("_first._id")).drop("_first")
