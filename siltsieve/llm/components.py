"""Connected components of an edge table: union-find on bounded slices of it, then alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back

#: A task's union-find takes so many edges at a time.
SLICE = 1 << 17


def stars_of(parent: dict) -> dict:
    """node -> smallest node of its component, roots left out. parent: as `join` leaves it."""
    return {x: find(parent, x) for x in parent}


def find(parent: dict, x):
    while (up := parent.get(x, x)) != x:
        parent[x] = up = parent.get(up, up)
        x = up
    return x


def join(parent: dict, a, b) -> None:
    """The larger root is put below the smaller one."""
    a, b = find(parent, a), find(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)


def contracted(edges: DataFrame, count: int, most: int) -> DataFrame:
    """Stars u, v (u > v) that connect what `count` edges u, v do; each task makes them of at most `most` edges at a time.

    Partitions are put together by number of edges, whatever their keys, and nothing is shuffled.
    """
    kind = edges.schema["u"].dataType

    def slices(batches):
        parent, held = {}, 0

        def stars():
            found = stars_of(parent)
            return pa.RecordBatch.from_arrays([pa.array(x, arrow) for x in (list(found), list(found.values()))], names=["u", "v"])

        arrow = pa.null()
        for batch in batches:
            arrow = batch.schema.field(0).type
            for k in range(0, batch.num_rows, most):
                part = batch.slice(k, most)
                if held + part.num_rows > most and held:
                    yield stars()
                    parent, held = {}, 0
                for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    join(parent, a, b)
                held += part.num_rows
        if held:
            yield stars()
        parent.clear()
        give_back()

    return edges.coalesce(max(1, -(-count // most))).mapInArrow(slices, f"u {kind.simpleString()}, v {kind.simpleString()}")


def components(edges: DataFrame, rounds: int = 60, most: int = SLICE) -> DataFrame:
    """edges: a, b of one orderable type -> node, root (the smallest node that links reach); nodes without an edge are not listed.

    Edges that fit one slice are done at once. Others become stars slice by slice; every round then joins stars by large and
    small stars and contracts them again. It ends when they fit one slice or nothing changes, after about log2 of the longest
    path. Each round's edges go to the shared folder, so a lost executor repeats one round at most.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    count, seen = edges.count(), None
    for _ in range(rounds):
        edges = cut(contracted(edges, count, most))
        if count <= most:
            break
        count, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, total) == seen:
            break
        seen = count, total
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of u, and u, are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        count = edges.count()
    else:
        raise RuntimeError("components did not settle")
    stars = edges.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("node"), "root").unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
