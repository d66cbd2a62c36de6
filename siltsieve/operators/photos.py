"""Photo operators over hashes and measures: best-copy groups, greedy grouping, retakes, blur, screens and library rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltsieve.functions import files as N
from siltsieve.operators import clusters, graph

FAR = "9999-01-01"


@dataclass(frozen=True)
class GroupRules:
    distance: int = 6
    minutes: int = 3
    shape: float = 0.03
    clarity: float = 0.6
    centering: float = 0.25
    resolution: float = 0.15
    tie: float = 0.02


def hash_from_bits(bits: Column) -> Column:
    """A string of 64 zeros and ones as a signed 64-bit number."""
    half = lambda s: F.conv(s, 2, 10).cast("long")
    return F.shiftleft(half(F.substring(bits, 1, 32)), 32).bitwiseOR(half(F.substring(bits, 33, 32)))


def duplicate_edges(photos: DataFrame, rules: GroupRules = GroupRules()) -> DataFrame:
    """photos: id, hash, width, height, taken, is_video, seconds -> a, b: same kind and hash, or photos taken within minutes with near hashes and shapes.

    Times meet in buckets of the window's length and the next, so no photo is compared with all others.
    """
    kind = F.when(F.col("is_video"), F.concat(F.lit("video-"), F.col("seconds").cast("string"))).otherwise("image")
    rows = graph.kept(photos.withColumns({"kind": kind, "t": F.unix_micros(F.col("taken").cast("timestamp")), "shape": F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width") / F.col("height"))}).select("id", "hash", "kind", "t", "shape"))
    x, y = rows.alias("x"), rows.alias("y")
    same = x.join(y, (F.col("x.kind") == F.col("y.kind")) & (F.col("x.hash") == F.col("y.hash")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    span = rules.minutes * 60_000_000
    timed = rows.where("kind = 'image' and t is not null").withColumn("k", F.floor(F.col("t") / span))
    x, y = timed.alias("x"), timed.withColumn("k", F.explode(F.array(F.col("k"), F.col("k") + 1))).alias("y")
    alike = F.coalesce(F.abs(F.col("x.shape") - F.col("y.shape")) <= rules.shape * F.greatest("x.shape", "y.shape"), F.lit(True))
    earlier = (F.col("y.t") < F.col("x.t")) | ((F.col("y.t") == F.col("x.t")) & (F.col("y.id") < F.col("x.id")))
    close = x.join(y, (F.col("x.k") == F.col("y.k")) & earlier & (F.col("x.t") - F.col("y.t") <= span) & (N.hamming(F.col("x.hash"), F.col("y.hash")) <= rules.distance) & alike)
    return same.unionByName(close.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))).distinct()


def scores(members: DataFrame, rules: GroupRules = GroupRules()) -> DataFrame:
    """members: group, id, clarity, centering, width, height -> with score: against the clearest and the largest of the group, from partial maxima."""
    pixels = F.col("width") * F.col("height")
    top = members.groupBy("group").agg(F.max(F.coalesce("clarity", F.lit(0.0))).alias("clearest"), F.max(pixels).alias("largest"))
    clear = F.when(F.col("clearest") > 0, rules.clarity * F.coalesce("clarity", F.lit(0.0)) / F.col("clearest")).otherwise(0.0)
    size = F.when(F.col("largest") > 0, rules.resolution * pixels / F.col("largest")).otherwise(rules.resolution)
    return members.join(top, "group").withColumn("score", clear + rules.centering * F.coalesce("centering", F.lit(0.0)) + size).drop("clearest", "largest")


def best_copies(members: DataFrame, rules: GroupRules = GroupRules()) -> DataFrame:
    """group, best_id, members of groups of two and more; largest groups first. Near ties go to most pixels, oldest, smallest id."""
    scored = scores(members, rules)
    top = scored.groupBy("group").agg(F.max("score").alias("top"), F.count("*").alias("members")).where("members > 1")
    tied = scored.join(top, "group").where(F.col("score") >= F.col("top") - rules.tie)
    order = F.struct((-F.col("width") * F.col("height")).alias("p"), F.coalesce("taken", F.lit(FAR).cast("timestamp")).alias("t"), "id")
    return tied.groupBy("group", "members").agg(F.min_by("id", order).alias("best_id")).orderBy(F.col("members").desc(), "best_id")


def groups(photos: DataFrame, edges: DataFrame) -> DataFrame:
    """photos with `group` (smallest id): cliques, filled in the order taken; photos without a match are left out."""
    roots = graph.connected(graph.kept(edges))
    place = F.unix_micros(F.coalesce(F.col("taken").cast("timestamp"), F.lit(FAR).cast("timestamp"))).alias("place")
    members = roots.join(photos.select(F.col("id").alias("node"), place), "node").select("root", F.col("node").alias("id"), "place")
    found = clusters.first_fit_components(members, edges)
    named = found.groupBy("root", "cluster").agg(F.min("id").alias("group"), F.count("*").alias("n")).where("n > 1")
    return photos.join(found.join(named, ["root", "cluster"]).select("id", "group"), "id")


def without(members: DataFrame, removed: DataFrame) -> DataFrame:
    """Groups less the removed ids; groups of one go."""
    left = members.join(removed.select("id").distinct(), "id", "left_anti")
    return left.join(left.groupBy("group").count().where("count > 1").select("group"), "group", "left_semi")


def blank_photos(photos: DataFrame, most_std: float = 5.0) -> DataFrame:
    """photos: id, mean, std -> id and what they show: black, white or one flat colour."""
    return photos.where(F.col("std") <= most_std).select("id", F.when(F.col("mean") < 40, "black").when(F.col("mean") > 215, "white").otherwise("flat").alias("shows"))


def library_verdicts(assets: DataFrame) -> DataFrame:
    """assets: id, place, is_image, seconds, unreadable, mean, std, sharpness, hash -> id, rules, duplicate_of.

    R1 unreadable, else R2 black; R3 blurry; R4 the hash of an earlier asset of its kind. The earliest comes from a partial minimum.
    """
    seen = assets.where("not unreadable and hash is not null")
    first = seen.groupBy("is_image", "seconds", "hash").agg(F.min(F.struct("place", "id")).alias("first"))
    dup = seen.join(first, ["is_image", "seconds", "hash"]).where(F.col("id") != F.col("first.id")).select("id", F.col("first.id").alias("duplicate_of"))
    each = assets.join(dup, "id", "left")
    r = [F.when(F.col("unreadable"), "R1").when((F.col("mean") <= 8) & (F.col("std") <= 6), "R2"), F.when(F.col("is_image") & ~F.col("unreadable") & (F.col("sharpness") < 60), "R3"), F.when(F.col("duplicate_of").isNotNull(), "R4")]
    return each.select("id", F.array_compact(F.array(*r)).alias("rules"), "duplicate_of")


def reason_of(rules: Column) -> Column:
    """One reason for a file: empty (unreadable or blank), then duplicate, then blurry."""
    has = lambda c: F.array_contains(rules, c)
    return F.when(has("R1"), "unreadable").when(has("R2"), "blank").when(has("R4"), "duplicate").when(has("R3"), "blurry")


def blur_verdicts(photos: DataFrame, retakes: DataFrame | None = None) -> DataFrame:
    """photos: id, width_px (edge width), ratio (of directions) -> id, rule: B01 very soft, B04 with a sharper retake, B03 motion, B02 soft; blurriest first."""
    p = photos.join(retakes.select("id", "best_id"), "id", "left") if retakes is not None else photos.withColumn("best_id", F.lit(None))
    w = F.col("width_px")
    rule = F.when(w >= 3.6, "B01").when(F.col("best_id").isNotNull(), "B04").when((w >= 2.2) & (F.col("ratio") >= 2.5), "B03").when(w >= 2.4, "B02")
    return p.withColumn("rule", rule).where("rule is not null").select("id", "rule", F.when(F.col("rule").isin("B01", "B04"), "certain").otherwise("likely").alias("confidence"), "width_px", "best_id").orderBy(F.col("width_px").desc(), "id")


def keeper(members: DataFrame) -> DataFrame:
    """members: group, id, pixels, camera, secondhand, copy_named, size_bytes, modified, shots (the group is of shots, not copies), sharp (passes the gate) -> with position, 1 is kept.

    Copies: most pixels, camera details, not second-hand, not copy-named, largest, oldest, id; shots: the gate first, and the oldest before the largest.
    """
    age, size = F.unix_micros(F.coalesce(F.col("modified").cast("timestamp"), F.lit(FAR).cast("timestamp"))), -F.col("size_bytes")
    order = [F.when(F.col("shots") & ~F.col("sharp"), 1).otherwise(0), F.col("pixels").desc(), F.col("camera").desc(), F.col("secondhand"), F.col("copy_named"), F.when(F.col("shots"), age).otherwise(size), F.when(F.col("shots"), size).otherwise(age), F.col("id")]
    return members.withColumn("position", F.row_number().over(Window.partitionBy("group").orderBy(*order)))


def greedy_groups(photos: DataFrame, coarse: int = 6, fine: int = 16) -> DataFrame:
    """photos: id, place, coarse (64-bit), f0..f3 (256-bit) -> id, anchor: each photo joins the first earlier anchor that it matches, else is one.

    Candidates come from a banded join on the coarse hash; the order is settled within connected candidates only. Ids of
    photos without a match are left out.
    """
    from siltsieve.operators.matching import hamming_pairs

    pairs = hamming_pairs(photos, "id", "coarse", coarse, bits=64, bands=3).select("a", "b")
    side = lambda e: photos.select(F.col("id").alias(e), *(F.col(f"f{k}").alias(f"{e}{k}") for k in range(4)))
    d = sum((N.hamming(F.col(f"a{k}"), F.col(f"b{k}")) for k in range(4)), F.lit(0))
    close = graph.kept(pairs.join(side("a"), "a").join(side("b"), "b").where(d <= fine).select("a", "b"))
    members = graph.connected(close).join(photos.select(F.col("id").alias("node"), "place"), "node").select("root", F.col("node").alias("id"), "place")
    kind = dict(photos.dtypes)["id"]

    def run(key, rows, links):
        import pandas as pd

        known = {(min(a, b), max(a, b)) for a, b in zip(links.a, links.b, strict=True)}
        anchors, out = [], []
        for i in rows.sort_values(["place", "id"]).id.tolist():
            home = next((x for x in anchors if (min(i, x), max(i, x)) in known), None)
            if home is None:
                anchors.append(i)
            out.append((i, i if home is None else home))
        return pd.DataFrame(out, columns=["id", "anchor"])

    inside = close.join(members.select(F.col("id").alias("a"), F.col("root").alias("part")), "a").select("part", "a", "b")
    return members.groupBy("root").cogroup(inside.groupBy("part")).applyInPandas(run, f"id {kind}, anchor {kind}")


def mass_best(members: DataFrame) -> DataFrame:
    """group, best_id: most pixels, largest, oldest (null last), smallest id."""
    order = F.struct((-F.col("pixels")).alias("p"), (-F.col("size_bytes")).alias("s"), F.coalesce("modified", F.lit(FAR).cast("timestamp")).alias("t"), "id")
    return members.groupBy("group").agg(F.min_by("id", order).alias("best_id"))
