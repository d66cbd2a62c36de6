"""Large and old videos: recorded date, rules V10 to V14 in their order, holds, batches. Sizes, names and container facts are columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltsieve.functions import files as N
from siltsieve.functions import names as M

MB, GB, DAY = 1024**2, 1024**3, 86_400_000_000
# Codecs for editing and capture.
INTERMEDIATE = (
    "apco", "apcs", "apcn", "apch", "ap4h", "ap4x", "avdn", "avdh", "mjpa", "mjpb", "mjpg", "jpeg", "ulrg", "ulra", "uly0", "uly2", "uly4", "ulh0", "ulh2", "ffv1",
    "lags", "hfyu", "fps1", "cfhd", "raw ", "v210", "2vuy", "yuv2", "v_uncompressed", "v_prores", "v_ffv1", "v_mjpeg",
)
ORDER = ("V01", "V02", "V03", "V04", "V10", "V11", "V12", "V13", "V14")


@dataclass(frozen=True)
class VideoRules:
    """Thresholds; sizes are 1024-based. `disabled` and `certain_only` pass on to the next rule."""

    old_days: int = 365
    large: int = 500 * MB
    huge: int = 2 * GB
    old_min: int = 100 * MB
    oversized_min: int = 200 * MB
    bits_per_pixel: float = 1.0
    reencode_bits_per_pixel: float = 0.1
    saving_share: float = 0.5
    assumed_fps: float = 30.0
    intermediate: tuple[str, ...] = INTERMEDIATE
    recent_days: int = 14
    project_days: int = 60
    disabled: frozenset[str] = field(default_factory=frozenset)
    certain_only: bool = False


def recorded(modified: Column, created: Column, named: Column, now: Column) -> Column:
    """struct(at, from): the container's time if it makes sense (after 1995, before tomorrow), else the name's, else the file's."""
    sane = lambda t: (t > F.lit("1995-01-01").cast("timestamp")) & (t < now + F.expr("INTERVAL 1 DAY"))
    choice = lambda t, what: F.struct(t.cast("timestamp").alias("at"), F.lit(what).alias("from"))
    return F.when(sane(created), choice(created, "metadata")).when(sane(named), choice(named, "name")).when(modified.isNotNull(), choice(modified, "modified")).otherwise(choice(F.lit(None), "unknown"))


def oversize(rules: VideoRules, size: Column, width: Column, height: Column, fps: Column, seconds: Column, codec: Column) -> Column:
    """Bytes that re-encoding saves, or null where the video is not oversized."""
    pixels = width * height * F.coalesce(fps, F.lit(rules.assumed_fps)) * seconds
    saving = size - F.round(pixels * rules.reencode_bits_per_pixel / 8).cast("long")
    dense = (size * 8 / pixels >= rules.bits_per_pixel) | F.coalesce(codec.isin(*rules.intermediate), F.lit(False))
    return F.when((pixels > 0) & (size >= rules.oversized_min) & dense & (saving >= rules.saving_share * size), saving)


def live_photos(videos: DataFrame, stills: DataFrame) -> DataFrame:
    """ids of .mov files with a still of the same folder and stem."""
    key = lambda d: d.select("id", F.concat(F.array_join(M.folders(F.col("path")), "/"), F.lit("/"), F.lower(M.stem(F.col("name")))).alias("key"), N.extension(F.col("name")).alias("ext"))
    return key(videos).where("ext = 'mov'").join(key(stills).select("key").distinct(), "key", "left_semi").select("id")


def in_active_projects(videos: DataFrame, projects: DataFrame, now: Column, rules: VideoRules = VideoRules()) -> DataFrame:
    """ids of videos that a project changed in the last 60 days names in its text, or that lie in the folder of one whose text can't be read.

    projects: folder, modified, words (array of the lower-case file names in its text, null if unsearchable). Names and folders
    are joined by equality: a project's names are exploded and each video brings all folders above it, so nothing is compared
    pair by pair.
    """
    live = projects.where(F.unix_micros(now) - F.unix_micros("modified") <= rules.project_days * DAY)
    named = live.where("words is not null").select(F.explode("words").alias("key")).distinct()
    by_name = videos.select("id", F.lower("name").alias("key")).join(named, "key", "left_semi").select("id")
    closed = live.where("words is null").select(F.lower("folder").alias("key")).distinct()
    above = M.folders(F.col("path"))
    each = videos.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(above), F.lit(1))), lambda k: F.array_join(F.slice(above, F.lit(1), k), "/"))).alias("key"))
    return by_name.unionByName(each.join(closed, "key", "left_semi").select("id")).distinct()


def judge(videos: DataFrame, now: Column, rules: VideoRules = VideoRules(), live: DataFrame | None = None, active: DataFrame | None = None) -> DataFrame:
    """videos: id, name, path, size_bytes, modified, created, width, height, fps, seconds, codec, health -> rule, confidence, saving_bytes, held, source, tool, app, recorded_at, recorded_from.

    health is V01 to V04 from the container check, or null; such verdicts come first and are never held. One of V10 to V14 is
    held back, with the reason in `held`, for the movie half of a Live Photo, videos of active projects and recent ones.
    """
    named = M.match_name(F.col("name"), F.col("path"), M.VIDEOS)
    v = videos.withColumn("_n", named).withColumn("_r", recorded(F.col("modified"), F.col("created"), M.taken_at(F.col("_n")), now))
    v = v.withColumns({
        "tool": F.col("_n.tool"), "app": F.col("_n.app"), "source": F.coalesce("_n.source", M.source_from_folders(F.col("path"))), "recorded_at": F.col("_r.at"), "recorded_from": F.col("_r.from"),
        "saving_bytes": oversize(rules, *(F.col(c) for c in ("size_bytes", "width", "height", "fps", "seconds", "codec"))), "_age": F.unix_micros(now) - F.unix_micros("_r.at"),
    })
    size, old = F.col("size_bytes"), F.col("_age") >= rules.old_days * DAY
    dated = F.when(F.col("recorded_from").isin("metadata", "name"), "certain").otherwise("likely")
    sure = F.lit("certain")
    cases = [
        ("V10", old & (size >= rules.large), dated), ("V11", size >= rules.huge, sure), ("V12", F.col("saving_bytes").isNotNull(), F.when(F.col("fps").isNull(), "likely").otherwise("certain")),
        ("V13", size >= rules.large, sure), ("V14", old & (size >= rules.old_min), dated),
    ]
    found = F.when(F.col("health").isNotNull() & ~F.col("health").isin(*(rules.disabled or {""})), F.struct(F.col("health").alias("rule"), F.when(F.col("health").isin("V01", "V02"), "certain").otherwise("likely").alias("confidence")))
    for code, holds, level in cases:
        if code not in rules.disabled:
            found = found.when(holds & ((level == "certain") | F.lit(not rules.certain_only)), F.struct(F.lit(code).alias("rule"), level.alias("confidence")))
    v = v.withColumn("_f", found)
    for name, ids in (("_live", live), ("_active", active)):
        v = v.join(ids.select("id", F.lit(True).alias(name)), "id", "left") if ids is not None else v.withColumn(name, F.lit(None).cast("boolean"))
    reclaim = F.col("_f.rule") >= "V10"
    held = F.when(reclaim, F.when(F.col("_live"), "livePhoto").when(F.col("_active"), "activeProject").when(F.col("_age") < rules.recent_days * DAY, "recent"))
    v = v.withColumn("held", held)
    return v.withColumns({"rule": F.when(F.col("held").isNull(), F.col("_f.rule")), "confidence": F.when(F.col("held").isNull(), F.col("_f.confidence"))}).drop("_n", "_r", "_f", "_age", "_live", "_active")


def batches(verdicts: DataFrame) -> DataFrame:
    """batch, items, bytes, saving_bytes (oversized only), preselect, sources (counts by source), in the order of review."""
    names = [("unplayable", ("V01", "V02")), ("damaged", ("V03", "V04")), ("oldLarge", ("V10",)), ("huge", ("V11",)), ("oversized", ("V12",)), ("large", ("V13",)), ("old", ("V14",))]
    name, place = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (batch, codes) in enumerate(names):
        name, place = F.when(F.col("rule").isin(*codes), batch).otherwise(name), F.when(F.col("rule").isin(*codes), k).otherwise(place)
    each = verdicts.withColumns({"batch": name, "place": place}).where("batch is not null").groupBy("batch", "place", "source").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.sum("saving_bytes").alias("saving"))
    out = each.groupBy("batch", "place").agg(F.sum("n").alias("items"), F.sum("bytes").alias("bytes"), F.sum("saving").alias("saving"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"))
    return out.orderBy("place").select("batch", "items", "bytes", F.when(F.col("batch") == "oversized", F.coalesce("saving", F.lit(0))).alias("saving_bytes"), (F.col("batch") == "unplayable").alias("preselect"), "sources")


def ranked(verdicts: DataFrame) -> DataFrame:
    """Largest first, then by id."""
    return verdicts.orderBy(F.col("size_bytes").desc(), "id")
