"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Targets: sources, in code-point order with null last, share `share` of all tokens by cycling weights; a source stops at
`most` times its size and its excess is reshared by weight. The level at which that comes to rest is found by repeated sums
over the sources; the driver sees two numbers a round.

Schedule: slot i has the golden-ratio point frac(i * phi), in 31-bit integers. The points are mapped through the cumulative
numbers of blocks that the sources need, so every stretch of the schedule holds the sources in nearly their target shares.
Slots are ranked within their source, in chunks, so that a hot source is ranked by many tasks.

Blocks: a source's documents are shuffled by hash and laid end to end; the line is cut into blocks of equal token counts. Slot
r of a source takes block r of its line, over again in a new epoch once the line ends, and the last one only as far as the
target goes. Everything is keyed by (source, bucket) or (source, block), never by the source alone.

Defined results: a null or empty text has size 0 and takes nothing; null sources are one source, the last; repeated rows are
rows of their own; an empty table gives no rows; reruns give the same rows. The period of the points bounds a schedule to
2**29 blocks in need; `block` grows with the total beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, table

WEIGHTS, SHARE, MOST, BLOCK = (3, 1, 2), 1.5, 2, 8192
#: round(2**31 / golden ratio), odd, so that 2**31 slots have 2**31 different points.
STEP, PERIOD = 1_327_217_885, 2**31
CHUNK, BUCKET_ROWS = 4096, 2048


def ranked(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with `rank` (from 0) and `before` (sum of value over smaller keys), by ranges of the unique key; no single task sorts all rows."""
    parts = cut(df.repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("part").agg(F.count("*").alias("n"), F.sum(value).alias("v"))  # one row a partition
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("v0"))
    own = Window.partitionBy("part").orderBy(key)
    out = parts.join(sums, "part").withColumn("rank", F.col("n0") + F.row_number().over(own) - 1)
    return out.withColumn("before", F.col("v0") + F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)).drop("part", "n0", "v0")


def source_key(c):
    """Orders as the source by code point, null last, and is never null."""
    return F.coalesce(F.concat(F.lit("0"), c), F.lit("1"))


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One small row per row of docs; the only pass over the texts."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("id"), source_key(F.col(source_col)).alias("key"), size.alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_hash")).withColumn("h", F.xxhash64("id", F.lit(17)))


def source_targets(base: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """key, source_size, weight, target."""
    sources = cut(ranked(base.groupBy("key").agg(F.sum("size").alias("source_size")), "key", "source_size").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = most * F.col("source_size") <= level * F.col("weight")
        kept, weight = sources.agg(F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (total - (kept or 0.0)) / weight if weight else level
        if not weight or new <= level * (1 + 1e-15):
            break
        level = new
    return sources.select("key", "source_size", "weight", F.least(most * F.col("source_size").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """slot, key, epoch, block, lo, hi: which tokens of its source's line each slot takes, in the order of the mix."""
    spark = targets.sparkSession
    take = F.round("target").cast("long")
    need = F.expr(f"take div source_size * ((source_size + {block - 1}) div {block}) + (take % source_size + {block - 1}) div {block}")
    plan = ranked(targets.where("source_size > 0").withColumn("take", take).where("take > 0").withColumn("need", need), "key", "need")
    plan = cut(plan)
    total, n_sources = plan.agg(F.sum("need"), F.count("*")).first()
    total = total or 1
    bits = min(20, max(1, (2 * n_sources).bit_length()))
    shift = 31 - bits
    lows = plan.select("*", F.expr(f"before * {PERIOD}L div {total}L").alias("from_point"), F.expr(f"(before + need) * {PERIOD}L div {total}L").alias("to_point")).where("to_point > from_point")
    bins = lows.withColumn("bin", F.explode(F.sequence(F.shiftright("from_point", shift), F.shiftright(F.col("to_point") - 1, shift))))
    # four times the need: the longest wait for a source with one block is under four rounds
    slots = spark.range(4 * total + 64).select(F.col("id").alias("slot"), F.expr(f"(id % {PERIOD}L) * {STEP}L % {PERIOD}L").alias("point")).withColumn("bin", F.shiftright("point", shift))
    dealt = slots.join(bins, "bin").where("point >= from_point and point < to_point").select("slot", "key", "need", "take", "source_size", F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = dealt.groupBy("key", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    rank = F.col("n0") + F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot")) - 1
    per_epoch = F.expr(f"(source_size + {block - 1}) div {block}")
    out = dealt.join(counts, ["key", "chunk"]).withColumn("rank", rank).where("rank < need").withColumn("per_epoch", per_epoch)
    out = out.withColumns({"epoch": F.expr("rank div per_epoch"), "block": F.expr("rank % per_epoch")})
    hi = F.least((F.col("block") + 1) * block, F.col("source_size"), F.col("take") - F.col("epoch") * F.col("source_size"))
    return out.select("slot", "key", "epoch", "block", (F.col("block") * block).alias("lo"), hi.alias("hi"))


def taken_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """One row per row of docs, block that it lies in and slot that takes that block (slot null: nothing takes it)."""
    base = cut(sizes(docs, id_col, text_col, source_col))
    total, n = base.agg(F.sum("size"), F.count("*")).first()
    block = max(block, int(share * (total or 0)) >> 28)
    targets = cut(source_targets(base, weights=weights, share=share, most=most))
    slots = schedule(targets, block)
    base = base.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(5)), F.lit(max(1, n // BUCKET_ROWS))))
    sums = base.groupBy("key", "bucket").agg(F.sum("size").alias("v"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("v0", F.coalesce(F.sum("v").over(before), F.lit(0))).join(targets, "key").select("key", "bucket", "v0", "source_size", "target")
    own = Window.partitionBy("key", "bucket").orderBy("h", "id", "size", "row_hash")
    placed = base.join(sums, ["key", "bucket"]).withColumns({"ord": F.row_number().over(own), "at": F.col("v0") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}")))))
    return pieces.join(slots, ["key", "block"], "left").withColumns({k: F.when(F.col("slot").isNotNull(), v) for k, v in {"from": F.greatest("at", "lo") - F.col("at"), "to": F.least(F.col("at") + F.col("size"), F.col("hi")) - F.col("at")}.items()})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target (its source's), taken."""
    pieces = taken_pieces(docs, id_col, text_col, source_col, **how)
    taken = F.coalesce(F.sum(F.greatest(F.col("to") - F.col("from"), F.lit(0))), F.lit(0)).alias("taken")
    return pieces.groupBy("key", "bucket", "ord", "id", "size", "source_size", "target").agg(taken).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each document and epoch that takes it, its text cut to the words taken.

    Rows are sorted by the first slot that takes them and, within it, by their place on the source's line.
    """
    pieces = taken_pieces(docs, id_col, text_col, source_col, **how).where("to > from")
    spans = pieces.groupBy("key", "bucket", "ord", "row_hash", "size", "epoch").agg(F.min("slot").alias("slot"), F.min("from").alias("a"), F.max("to").alias("b"))
    spans = spans.groupBy("key", "bucket", "ord", "row_hash", "size").agg(F.array_sort(F.collect_list(F.struct("epoch", "slot", "a", "b"))).alias("spans"))
    turn = lambda *by: F.row_number().over(Window.partitionBy("row_hash").orderBy(*by))  # noqa: E731  rows that repeat are told apart by number
    spans = spans.select("row_hash", "size", "spans", "bucket", "ord", turn("bucket", "ord").alias("turn"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    ident, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    rows = docs.toDF(*names).withColumn("row_hash", F.xxhash64(F.col(ident).cast("long"), F.col(text))).withColumn("turn", turn(ident))
    # a difference is no join key: the texts stay where their turns were numbered and are not dealt out again by both columns
    same = (rows["row_hash"] == spans["row_hash"]) & (rows["turn"] - spans["turn"] == 0)
    out = rows.join(spans, same).select(*names, "bucket", "ord", "size", F.explode("spans").alias("span"))
    out = out.orderBy("span.slot", "bucket", "ord", "span.epoch")
    words = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))
    part = F.array_join(F.slice(words, (F.col("span.a") + 1).cast("int"), (F.col("span.b") - F.col("span.a")).cast("int")), " ")
    whole = (F.col("span.a") == 0) & (F.col("span.b") == F.col("size"))
    return out.withColumn(text, F.when(whole, F.col(text)).otherwise(part)).select(*names).toDF(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op1_mixing": op1_mixing}
SQL: dict[str, str] = {}
