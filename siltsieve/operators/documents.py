"""The duplicate-document scan: units, edges F01 to F04 with the first rule of a pair, complete-linkage groups, keepers, singles.

items: id, name, path, size_bytes, modified, content (text). Identical items are one unit before any text is compared, so copies
make no pairs. All stages keep ids, keys and hashes; texts are read once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltsieve.functions import files as N
from siltsieve.functions import text as T
from siltsieve.operators import clusters, graph

RULES = ("F01", "F02", "F03", "F04", "F05")
CERTAIN = ("F01", "F02")
# Folders of second-hand copies.
SECONDHAND = [
    "download", "downloads", "whatsapp", "whatsapp documents", "telegram", "telegram documents", "messenger", "signal", "bluetooth",
    "sent", "shared", "received", "copies", "backup", "backups", "outlook", "gmail", "attachments",
]
MIN_WORDS, VERSION_WORDS, SHINGLE = 20, 40, 5
SIMILAR, NEAR, RATIO = 0.85, 0.6, 0.8
#: Found in every text that has a word with four digits: words of other texts are not looked at one by one.
SOME_DIGITS = r"[0-9](?:[\p{L}\p{N}]*[0-9]){3}"


def units(items: DataFrame) -> DataFrame:
    """One row for each distinct content: unit (smallest id), name, n_words, text_key, ids (words with four digits and more), s (hashed shingles, sorted).

    An item's content is compared by SHA-256; sizes alone never make a unit.
    """
    d = items.select("id", "name", F.sha2(F.col("content").cast("binary"), 256).alias("key"), T.words(F.col("content")).alias("w"), F.col("content").rlike(SOME_DIGITS).alias("digits"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, SHINGLE)))
    d = d.select("id", "key", T.name_stem(F.col("name")).alias("stem"), F.size("w").alias("n_words"), T.text_key(F.col("w")).alias("text_key"), F.when(F.col("digits"), F.array_distinct(T.identifiers(F.col("w")))).otherwise(F.array().cast("array<string>")).alias("ids"), F.when(F.size("w") >= VERSION_WORDS, F.sort_array(F.array_distinct(runs))).alias("s"))
    rows = graph.kept(d.withColumn("row", F.monotonically_increasing_id()))
    first = rows.groupBy("key").agg(F.min(F.struct("id", "row")).alias("x")).select("x.row")
    copies = graph.kept(rows.select("row").join(first, "row", "left_anti"))  # only numbers are dealt out, never shingles
    return rows.join(_small(copies), "row", "left_anti").select("key", F.col("id").alias("unit"), "stem", "n_words", "text_key", "ids", "s")


#: Rows of one or two ids that are sent to every task at most.
MOST_BROADCAST = 500_000


def _small(kept: DataFrame) -> DataFrame:
    return F.broadcast(kept) if kept.count() <= MOST_BROADCAST else kept


def same_key(units_: DataFrame, key: str, rule: str) -> DataFrame:
    """Edges of units that share a key: a star around the smallest. With complete linkage, equal keys are one another's match."""
    least = units_.groupBy(key).agg(F.min("unit").alias("a"), F.count("*").alias("n")).where("n > 1")
    return units_.join(least, key).where(F.col("unit") != F.col("a")).select("a", F.col("unit").alias("b"), F.lit(1.0).alias("score"), F.lit(rule).alias("rule"))


#: Rows of one shingle that meet as a block; more are dealt to pairs of blocks.
BLOCK = 256
#: Shingles that more rows begin with are tried last, the most frequent of them at most.
OFTEN, MOST_OFTEN = 8, 100_000


def _often(sets: DataFrame, near: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequent hashes, sorted, and their counts among the first hashes of all sets."""
    n = F.size("s")
    first = sets.select(F.explode(F.slice("s", 1, (n - F.ceil(n * near - 1e-9) + 1).cast("int"))).alias("g"))
    found = graph.kept(first.groupBy("g").agg(F.count("*").alias("rows")).where(f"rows > {OFTEN}").orderBy(F.col("rows").desc(), "g").limit(MOST_OFTEN)).toPandas().sort_values("g")
    return found.g.to_numpy("int64"), found.rows.to_numpy("int64")


def _first_hashes(sets: DataFrame, near: float, often: tuple[np.ndarray, np.ndarray], part: int, parts: int) -> DataFrame:
    """unit, n, left, g, blocks: of the first n - ceil(near n) + 1 hashes of each set, rare ones before frequent ones, those of one part.

    left: hashes of the set from this one on. blocks: what a frequent hash is dealt to, by its count in `often`; 1 for others.
    """
    known, counts = often
    classes, blocks = np.frexp(counts.astype("float64"))[1], (counts + BLOCK - 1) // BLOCK

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                s = rows.column(1)
                n = pc.list_value_length(s).to_numpy(zero_copy_only=False).astype("int64")
                g = s.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(n)), n)
                rare, deal = np.zeros(len(g), "int64"), np.ones(len(g), "int64")
                if len(known):
                    place = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    found = known[place] == g
                    rare, deal = np.where(found, classes[place], 0), np.where(found, blocks[place], 1)
                order = np.lexsort((g, rare, row))
                g, deal = g[order], deal[order]
                i = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
                keep = (i < np.repeat(n - np.ceil(n * near - 1e-9).astype("int64") + 1, n)) & (g % parts == part)
                n = n[row[keep]]
                columns = [rows.column(0).take(pa.array(row[keep])), pa.array(n, pa.int32()), pa.array(n - i[keep], pa.int32()), pa.array(g[keep]), pa.array(deal[keep])]
                yield pa.RecordBatch.from_arrays(columns, ["unit", "n", "left", "g", "blocks"])

    return sets.select("unit", "s").where(F.size("s") > 0).mapInArrow(run, f"unit {dict(sets.dtypes)['unit']}, n int, left int, g long, blocks long")


#: First hashes are dealt out in so many turns, each with its share of the hashes, so that no more than that lies on disk at once.
TURNS = 2


def candidates(sets: DataFrame, near: float = NEAR) -> DataFrame:
    """sets: unit, s (sorted) -> a, b of all that may have a Jaccard of `near`: they share one of the first n - ceil(near n) + 1 hashes.

    The order of hashes is the same for all sets: those that begin many sets last, so common passages make no candidates of
    texts that differ elsewhere. Two sets whose first common hash leaves too few behind it are none. A hash that many sets
    share is dealt to tasks as pairs of blocks of its sets; pairs whose sizes differ too much never leave them.
    """
    often, out = _often(sets, near), None
    for turn in range(TURNS):
        first = _first_hashes(sets, near, often, turn, TURNS).withColumn("own", F.pmod(F.xxhash64("unit"), F.col("blocks")))
        first = first.withColumn("rows", F.count("*").over(Window.partitionBy("g", "own"))).where("rows > 1 or blocks > 1")
        first = first.withColumn("blocks", F.expr(f"if(blocks > 1, blocks, (rows + {BLOCK - 1}) div {BLOCK})")).withColumn("own", F.pmod(F.xxhash64("unit"), F.col("blocks")))
        first = first.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = first.select("g", "unit", "n", "left", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        x, y = dealt.alias("x"), dealt.alias("y")
        same = (F.col("x.g") == F.col("y.g")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
        once = (F.col("x.i") == F.col("x.j")) | (F.col("x.own") != F.col("y.own"))
        sizes = F.least("x.n", "y.n") >= near * F.greatest("x.n", "y.n")
        enough = F.least("x.left", "y.left") >= near / (1 + near) * (F.col("x.n") + F.col("y.n")) - 1e-6
        pairs = x.join(y, same & once & (F.col("x.unit") < F.col("y.unit")) & sizes & enough)
        pairs = graph.kept(pairs.select(F.col("x.unit").alias("a"), F.col("y.unit").alias("b")).distinct())
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


#: Sets that one task compares at once.
AT_ONCE = 512
#: Sets that are compared are dealt out in rounds, each of at most this share of the hashes of all sets.
DEALT = 0.4


def scored(pairs: DataFrame, sets: DataFrame, near: float = NEAR) -> DataFrame:
    """pairs: a, b, kept; sets: unit, s (sorted) -> a, b, score (Jaccard) of pairs from `near` on.

    A set goes once to each task that compares it, not once for each of its pairs: sets with the same smallest neighbour go
    together, in blocks where they are many. Sets without a pair are not dealt out at all.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("unit"), F.least("a", "m").alias("m"))
    many = least.groupBy("m").agg(F.expr(f"(count(*) + {BLOCK - 1}) div {BLOCK}").alias("blocks"))
    home = graph.kept(least.join(many, "m").select("unit", F.xxhash64("m", F.pmod(F.xxhash64("unit"), F.col("blocks"))).alias("home")))
    side = lambda e: home.select(F.col("unit").alias(e), F.col("home").alias(f"home_{e}"))
    tasks = home.count() // AT_ONCE + 1
    task = F.pmod(F.xxhash64(F.least("home_a", "home_b"), F.greatest("home_a", "home_b")), F.lit(tasks))
    dealt = graph.kept(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", task.alias("task")))
    wanted = graph.kept(dealt.select(F.col("task").alias("part"), F.explode(F.array("a", "b")).alias("unit")).distinct())
    n = F.size("s").cast("long")
    held, copied, rows = sets.select("unit", n.alias("n")).join(wanted.groupBy("unit").count(), "unit", "left").agg(F.sum("n"), F.sum(F.col("n") * F.col("count")), F.sum("count")).first()
    rounds = max((rows or 0) // MOST_BROADCAST, int((copied or 0) / (DEALT * (held or 1)))) + 1

    def run(links: pa.Table, texts: pa.Table) -> pa.Table:
        ends, s = texts.column("unit").to_pylist(), texts.column("s").combine_chunks()
        flat, off = s.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(s).to_numpy(zero_copy_only=False))]).astype("int64")
        at = {u: k for k, u in enumerate(ends)}
        other = {}
        for k, (a, b) in enumerate(zip(links.column("a").to_pylist(), links.column("b").to_pylist(), strict=True)):
            other.setdefault(at[a], []).append((k, at[b]))
        score = np.zeros(links.num_rows)
        for a, found in other.items():
            own = flat[off[a] : off[a + 1]]
            for k, b in found:
                them = flat[off[b] : off[b + 1]]
                place = np.minimum(np.searchsorted(own, them), len(own) - 1)
                c = int(np.count_nonzero(own[place] == them))
                score[k] = c / (len(own) + len(them) - c)
        out = pa.table({"a": links.column("a"), "b": links.column("b"), "score": score})
        return out.filter(pa.array(score >= near))

    kind, out = dict(pairs.dtypes)["a"], None
    for k in range(rounds):
        texts = sets.select("unit", "s").join(F.broadcast(wanted.where(f"part % {rounds} = {k}")), "unit")
        part = graph.kept(dealt.where(f"task % {rounds} = {k}").groupBy("task").cogroup(texts.groupBy("part")).applyInArrow(run, f"a {kind}, b {kind}, score double"))
        out = part if out is None else out.unionByName(part)
    return out


def versions(units_: DataFrame, near: float = NEAR) -> DataFrame:
    """a, b, score, verdict, blocked of pairs of units from `near` on; F04 unless lengths, names or reference numbers speak against it."""
    own = units_.where("s is not null").groupBy("text_key").agg(F.min("unit").alias("unit")).select("unit")  # the same words are F03 already
    again = graph.kept(units_.where("s is not null").select("unit").join(own, "unit", "left_anti"))
    sets = units_.where("s is not null").join(_small(again), "unit", "left_anti")
    lean = graph.kept(sets.select("unit", "stem", "ids", "n_words"))
    pairs = graph.kept(candidates(sets.select("unit", "s"), near))
    side = lambda e: lean.select(F.col("unit").alias(e), *(F.col(c).alias(f"{c}_{e}") for c in ("stem", "ids", "n_words")))
    both = scored(pairs, sets, near).join(side("a"), "a").join(side("b"), "b")
    short = F.least("n_words_a", "n_words_b") < RATIO * F.greatest("n_words_a", "n_words_b")
    differ = (F.size(F.array_except("ids_a", "ids_b")) > 0) & (F.size(F.array_except("ids_b", "ids_a")) > 0)
    why = F.when(F.col("score") < SIMILAR, "similarity").when(short, "length").when(~T.names_related(F.col("stem_a"), F.col("stem_b")), "names").when(differ, "numbers")
    return both.select("a", "b", "score", F.when(why.isNull(), "F04").otherwise("near miss").alias("verdict"), why.alias("blocked"))


def edges(units_: DataFrame, more: DataFrame | None = None, disabled: tuple[str, ...] = ()) -> DataFrame:
    """a, b, rule, score of pairs of units, each by its first rule. more: a, b, score, rule of F02 or F05 (content keys, scans)."""
    texts = units_.where(f"n_words >= {MIN_WORDS}")
    found = same_key(texts, "text_key", "F03").unionByName(versions(units_).where("verdict = 'F04'").select("a", "b", "score", F.col("verdict").alias("rule")))
    if more is not None:
        found = found.unionByName(more.select("a", "b", "score", "rule"))
    found = found.where(~F.col("rule").isin(*(disabled or ("",))))
    return found.groupBy("a", "b").agg(F.min_by(F.struct("rule", "score"), F.struct("rule", -F.col("score"))).alias("x")).select("a", "b", "x.rule", "x.score")


def content_key_edges(units_: DataFrame) -> DataFrame:
    """units (unit, content_key) of one content key, which names its format."""
    return same_key(units_.where("content_key is not null").select("unit", "content_key"), "content_key", "F02")


def strength(rule: Column, score: Column) -> Column:
    """What clustering orders matches by: 5 for F01 to 1 for F05, and half the score."""
    return len(RULES) - (F.array_position(F.array(*(F.lit(r) for r in RULES)), rule) - 1) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 0.5


def groups(units_: DataFrame, edges_: DataFrame) -> DataFrame:
    """unit, cluster (its smallest unit): complete linkage over classes of equal words; equal words stay together."""
    owner = graph.kept(edges_.where("rule in ('F02', 'F03')").select("a", "b"))
    named = graph.connected(owner).select(F.col("node").alias("unit"), F.col("root").alias("class"))
    cls = units_.select("unit").join(named, "unit", "left").select("unit", F.coalesce("class", "unit").alias("class"))
    ends = edges_.where("rule in ('F04', 'F05')").withColumn("strength", strength(F.col("rule"), F.col("score")))
    ends = ends.join(cls.select(F.col("unit").alias("a"), F.col("class").alias("ca")), "a").join(cls.select(F.col("unit").alias("b"), F.col("class").alias("cb")), "b").where("ca <> cb")
    linked = graph.kept(ends.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.max("strength").alias("score")))
    found = clusters.cluster_components(linked, graph.connected(linked.select("a", "b"))).select(F.col("id").alias("class"), F.col("cluster").alias("first"))
    return cls.join(found, "class", "left").select("unit", F.coalesce("first", "class").alias("cluster"))


def keepers(items: DataFrame, units_: DataFrame, groups_: DataFrame, edges_: DataFrame) -> DataFrame:
    """One row for each item of a group of two and more: id, group, kept, rule (by which it matches the kept item), kind, confidence, size_bytes.

    Kept is, in groups that an F04 edge made, the newest item (a null time counts as newest), then one not in a second-hand
    folder, not named like a copy, the oldest, the smallest id. Items without a direct match to the kept one are dropped.
    """
    keyed = items.select("id", "name", "path", "modified", "size_bytes", F.sha2(F.col("content").cast("binary"), 256).alias("key")).join(units_.select("key", "unit", "text_key"), "key").join(groups_, "unit")
    kind = edges_.where("rule = 'F04'").join(groups_.withColumnRenamed("unit", "a"), "a").select("cluster", "b").join(groups_.select(F.col("unit").alias("b"), F.col("cluster").alias("other")), "b").where("cluster = other").select("cluster").distinct()
    keyed = keyed.join(kind.withColumn("versions", F.lit(True)), "cluster", "left").withColumn("versions", F.coalesce("versions", F.lit(False)))
    time = F.coalesce(F.col("modified").cast("timestamp"), F.lit("9999-01-01").cast("timestamp"))
    order = F.struct(F.when(F.col("versions"), -F.unix_micros(time)).alias("newest"), N.in_folder(F.col("path"), SECONDHAND).alias("secondhand"), N.has_copy_name(F.col("name")).alias("copy"), F.unix_micros(time).alias("oldest"), F.col("id").alias("id"))
    best = keyed.groupBy("cluster").agg(F.count("*").alias("n"), F.min_by(F.struct("id", "unit", "text_key"), order).alias("keep")).where("n > 1")
    named = keyed.join(best, "cluster")
    pairs = edges_.where("rule in ('F04', 'F05')").select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), F.col("rule").alias("edge"))
    # an F04 edge stands for its two texts: units of the same words have it too
    first = units_.groupBy("text_key").agg(F.min("unit").alias("first"))
    named = named.join(first, "text_key").join(first.select(F.col("text_key").alias("kt"), F.col("first").alias("keep_first")), F.col("keep.text_key") == F.col("kt"))
    named = named.join(pairs, (F.least("first", "keep_first") == F.col("p")) & (F.greatest("first", "keep_first") == F.col("q")), "left")
    kept = F.col("id") == F.col("keep.id")
    rule = F.when(kept, F.lit(None)).when(F.col("unit") == F.col("keep.unit"), "F01").when(F.col("text_key") == F.col("keep.text_key"), "F03").otherwise(F.col("edge"))
    named = named.withColumns({"kept": kept, "rule": rule}).where("kept or rule is not null")
    left = named.groupBy("cluster").agg(F.count("*").alias("members"), F.bool_and(F.col("kept") | F.col("rule").isin(*CERTAIN)).alias("sure")).where("members > 1")
    named = named.join(left, "cluster")
    return named.select("id", F.col("cluster").alias("group"), "kept", "rule", F.when(F.col("versions"), "versions").otherwise("copies").alias("kind"), F.when(F.col("sure"), "certain").otherwise("likely").alias("confidence"), "size_bytes")


def scan(items: DataFrame, more: DataFrame | None = None, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Members of all groups, as `keepers` gives them."""
    own = units(items)
    found = graph.kept(edges(own, more, disabled))
    own = graph.kept(own.select("key", "unit", "text_key"))  # shingles are not read again
    return keepers(items, own, graph.kept(groups(own, found)), found)


def group_list(members: DataFrame) -> DataFrame:
    """One row for each group: group, keep_id, members, reclaimable_bytes, confidence; most bytes first, then by the kept id."""
    out = members.groupBy("group", "kind", "confidence").agg(F.min(F.when(F.col("kept"), F.col("id"))).alias("keep_id"), F.count("*").alias("members"), F.coalesce(F.sum(F.when(~F.col("kept"), F.col("size_bytes"))), F.lit(0)).alias("reclaimable_bytes"))
    return out.orderBy(F.col("reclaimable_bytes").desc(), "keep_id")


def singles(items: DataFrame, members: DataFrame) -> DataFrame:
    """Items of no group."""
    return items.join(members.select("id"), "id", "left_anti")


def rank(members: DataFrame, group: str, order: list[Column]) -> DataFrame:
    return members.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
