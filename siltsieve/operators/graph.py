"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import tempfile
import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_one_at_a_time = threading.Lock()
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in spark.checkpoint.dir; where that is unset and all runs on this machine, in a folder of our own.

    Its shuffle files go as soon as it is kept: nothing reads them again.
    """
    conf = df.sparkSession.conf
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="siltsieve-checkpoint-"))
    with _one_at_a_time:  # the setting is the session's, and threads may share it
        before = conf.get(_FREE, None)
        conf.set(_FREE, "true")
        try:
            return df.select("*").checkpoint()  # a plan of its own, made under the setting
        finally:
            conf.set(_FREE, before) if before is not None else conf.unset(_FREE)


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """a, b -> node, root: the smallest node that edges reach. Raises if `rounds` rounds (about log2 of the longest path are needed) do not settle them."""
    pairs = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = kept(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = pairs.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("node"), "root").unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
