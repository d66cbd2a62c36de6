"""Clusters of a component: complete linkage, and first-fit cliques."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltsieve.operators import graph

#: Components of more items are left whole by first fit.
LARGEST = 200


def complete_linkage(ids: list, edges: dict[tuple, float]) -> list[list]:
    """Merges the best-scored pair of clusters of which all members match, until none is left.

    The score of two clusters is that of their worst pair; of equal scores the pair that stands first is merged, and a merged
    cluster stands last. A queue holds the pairs of clusters of which all members match: a merge looks at the neighbours of its two
    only, and leaves fewer pairs than it takes, so time is about that of sorting the edges.
    """
    found = _link([((), i) for i in ids], {(((), a), ((), b)): s for (a, b), s in edges.items()})
    return [[i for _, i in c] for c in found]


def _link(names: list[tuple], edges: dict[tuple, float]) -> list[list]:
    """`complete_linkage` of clusters by their names: (path, id), of which some may be merged already, in any order.

    id is a cluster's first member, path the scores of the merges that led from there to it, last one first, negated. Order of names is
    the order in which `complete_linkage` has the clusters: single items by id, then merged ones in the order of their merges.
    """
    clusters = {k: [k] for k in names}
    near: dict[tuple, dict[tuple, float]] = {k: {} for k in clusters}
    for (x, y), s in edges.items():
        if x in near and y in near and x != y:
            near[x][y] = near[y][x] = s
    queue = [(-s, i, j) for i, found in near.items() for j, s in found.items() if i < j]
    heapq.heapify(queue)
    while queue:
        s, i, j = heapq.heappop(queue)
        if i not in near or j not in near:
            continue
        of_i, of_j = near.pop(i), near.pop(j)
        name = ((s, *i[0]), i[1])
        near[name] = merged = {}
        for k in (of_i.keys() | of_j.keys()) - {i, j}:
            near[k].pop(i, None)
            near[k].pop(j, None)
            if k in of_i and k in of_j:
                merged[k] = near[k][name] = worst = min(of_i[k], of_j[k])
                heapq.heappush(queue, (-worst, min(k, name), max(k, name)))
        clusters[name] = clusters.pop(i) + clusters.pop(j)
    return [clusters[k] for k in sorted(clusters)]


def first_fit(ids: list, edges: set[tuple]) -> list[list]:
    """Each item, in the given order, joins the first cluster all of whose members it matches."""
    clusters: list[list] = []
    for i in ids:
        for c in clusters:
            if all((min(i, x), max(i, x)) in edges for x in c):
                c.append(i)
                break
        else:
            clusters.append([i])
    return clusters


#: Pairs of a component that one task links by itself.
PAIRS = 50_000
#: Rounds of larger components; what they leave goes to a task, of any size.
ROUNDS = 60


def cluster_components(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges: a, b, score, each pair once; roots: node, root -> root, cluster (its smallest id), id.

    A component of which every two match is one cluster, whatever the scores. Others are linked in a task each; those of more than
    `PAIRS` pairs first in rounds by all tasks, until no more are left.
    """
    inside = edges.join(roots.withColumnRenamed("node", "a"), "a").select("root", "a", "b", "score")
    pairs = inside.groupBy("root").agg(F.count("*").alias("pairs"))
    open_ = graph.kept(roots.groupBy("root").agg(F.count("*").alias("n")).join(pairs, "root").where("2 * pairs < n * (n - 1)").select("root", "pairs"))
    whole = roots.join(open_, "root", "left_anti").selectExpr("root", "root as cluster", "node as id")
    start = inside.join(open_, "root").select("root", *(F.struct(F.col(c).alias("id"), F.array().cast("array<double>").alias("path")).alias(e) for c, e in ("ax", "by")), "score", "pairs")
    small = _linked(start.where(f"pairs <= {PAIRS}")).select("root", "cluster", "id")
    out = whole.unionByName(small)
    if open_.where(f"pairs > {PAIRS}").isEmpty():
        return out
    nodes = roots.join(open_.where(f"pairs > {PAIRS}"), "root").select("root", F.col("node").alias("id"))
    return out.unionByName(_linked_in_rounds(nodes, start.where(f"pairs > {PAIRS}").drop("pairs")))


def _linked(links: DataFrame) -> DataFrame:
    """links: root, x, y (id, path: a name of `_link`), score -> root, cluster (the id that stands first), id: each root is linked in one task."""
    kind = dict(links.select("x.id").dtypes)["id"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = ([(tuple(p), i) for p, i in zip(rows[f"path_{e}"], rows[e], strict=True)] for e in "xy")
        known = {(min(a, b), max(a, b)): s for a, b, s in zip(x, y, rows.score, strict=True)}
        found = _link(list({*x, *y}), known)
        return pd.DataFrame([(key[0], min(c)[1], i) for c in found for _, i in c], columns=["root", "cluster", "id"])

    flat = links.select("root", F.col("x.id").alias("x"), F.col("x.path").alias("path_x"), F.col("y.id").alias("y"), F.col("y.path").alias("path_y"), "score")
    return flat.groupBy("root").applyInPandas(run, f"root {kind}, cluster {kind}, id {kind}")


def _linked_in_rounds(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes: root, id; links: root, x, y (id, path), score -> root, cluster (smallest id), id.

    A round merges all pairs that are the best of both their clusters. `complete_linkage` merges them too, sooner or later: no other
    merge makes a pair that comes before the ones it takes. A pair of merged clusters stays if all pairs between their parts do.
    """
    live, ready, links = graph.kept(links), None, None
    for turn in range(ROUNDS + 1):
        left = live.groupBy("root").agg(F.count("*").alias("pairs"))
        fits = graph.kept(left.where(f"pairs <= {PAIRS}" if turn < ROUNDS else "true").select("root"))
        part = live.join(F.broadcast(fits), "root").select("root", "x", "y", "score")
        ready = part if ready is None else ready.unionByName(part)
        live = live.join(F.broadcast(fits), "root", "left_anti")
        if live.isEmpty():
            break
        first = lambda e: F.struct(F.col(f"{e}.path").alias("path"), F.col(f"{e}.id").alias("id"))
        pair = live.select("x", "y", F.struct((-F.col("score")).alias("s"), F.least(first("x"), first("y")).alias("lo"), F.greatest(first("x"), first("y")).alias("hi")).alias("pair"))
        best = pair.select(F.explode(F.array("x.id", "y.id")).alias("id"), "pair").groupBy("id").agg(F.min("pair").alias("pair"))
        merged = best.groupBy(F.col("pair.lo.id").alias("a"), F.col("pair.hi.id").alias("b")).agg(F.count("*").alias("n"), F.first("pair").alias("pair")).where("n = 2")
        merged = graph.kept(merged.select("a", "b", F.concat(F.array("pair.s"), F.col("pair.lo.path")).alias("path")))
        links = merged.select("a", "b") if links is None else links.unionByName(merged.select("a", "b"))
        moved = merged.select(F.explode(F.array("a", "b")).alias("key"), F.struct(F.col("a").alias("id"), "path").alias("move"))
        for e in "xy":
            live = _moved(live, e, moved)
        live = live.where("x.id <> y.id").groupBy("root", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("score").alias("score"), F.count("*").alias("n"))
        live = graph.kept(live.where("n = x.parts * y.parts").select("root", *(F.struct(f"{e}.id", f"{e}.path").alias(e) for e in "xy"), "score"))
    last = graph.kept(_linked(ready)).where("cluster <> id").select(F.col("cluster").alias("a"), F.col("id").alias("b"))
    named = graph.connected(last if links is None else links.unionByName(last)).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    return nodes.join(named, "id", "left").select("root", F.coalesce("cluster", "id").alias("cluster"), "id")


def _moved(live: DataFrame, e: str, moved: DataFrame) -> DataFrame:
    """live with the end `e` (id, path) as moved (key, move) has it, and of how many parts it is now: 1 or 2.

    A window and no join: Spark's guess of a join's size is the product of both sides, which round after round has ever more digits.
    """
    kind = dict(moved.dtypes)["move"]
    rows = live.select(F.col(f"{e}.id").alias("key"), F.struct(*live.columns).alias("row"), F.lit(None).cast(kind).alias("move"))
    rows = rows.unionByName(moved.withColumn("row", F.lit(None).cast(dict(rows.dtypes)["row"])))
    rows = rows.withColumn("move", F.max("move").over(Window.partitionBy("key"))).where("row is not null").select("row.*", "move")
    new = F.coalesce("move", F.struct(f"{e}.id", f"{e}.path"))
    return rows.withColumn(e, F.struct(new["id"].alias("id"), new["path"].alias("path"), F.when(F.col("move").isNull(), 1).otherwise(2).alias("parts"))).drop("move")


def first_fit_components(members: DataFrame, edges: DataFrame, largest: int = LARGEST) -> DataFrame:
    """members: root, id, place (its order in the component); edges: a, b -> root, cluster, id. Larger components stay whole."""
    kind = dict(members.dtypes)["id"]
    sizes = members.groupBy("root").count()
    named = members.join(sizes, "root")
    whole = named.where(f"count > {largest}").selectExpr("root", "cast(0 as int) cluster", "id")
    small = named.where(f"count <= {largest}").select("root", "id", "place")
    inside = edges.join(small.select(F.col("id").alias("a"), F.col("root").alias("part")), "a").select("part", "a", "b")

    def run(key: tuple, rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        known = {(min(a, b), max(a, b)) for a, b in zip(links.a, links.b, strict=True)}
        found = first_fit(rows.sort_values(["place", "id"]).id.tolist(), known)
        return pd.DataFrame([(key[0], k, i) for k, c in enumerate(found) for i in c], columns=["root", "cluster", "id"])

    out = small.groupBy("root").cogroup(inside.groupBy("part")).applyInPandas(run, f"root {dict(members.dtypes)['root']}, cluster int, id {kind}")
    return out.unionByName(whole)
