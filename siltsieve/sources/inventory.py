"""Views of the driver's tables as the inputs of the operators. Every mapping is synthetic and documented here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text files: id = doc_id, size in bytes of UTF-8."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("text").alias("content"), F.col("source"))


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files notes.txt, every third notes-<source>.txt, second-hand in src0 (a download folder), a day newer with each id modulo 100."""
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("notes-"), "source", F.lit(".txt"))).otherwise("notes.txt")
    folder = F.when(F.col("source") == "src0", "download").otherwise(F.col("source"))
    return d.select(F.col("doc_id").alias("id"), name.alias("name"), F.concat(F.lit("/"), folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), name).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("doc_id") % 100) * 86_400).alias("modified"), F.col("text").alias("content"))


def bin_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their customers as bin entries: category is the priority, sizes are cents of the price, a third never expires."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("c_name").alias("file_name"), F.concat(F.lit("/"), "c_mktsegment", F.lit("/"), "c_name").alias("original_path"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("reason"),
        cents.alias("original_bytes"), F.when(F.col("o_orderkey") % 2 == 0, F.floor(cents / 2)).otherwise(cents).cast("long").alias("stored_bytes"),
        F.col("o_orderdate").alias("collected_at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
    )


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as apps: last used at their last order, size from the balance, system by nation 0."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    used = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_used"))
    return c.join(used, "c_custkey", "left").select(F.col("c_custkey").alias("package"), F.col("c_name").alias("label"), F.round(F.abs("c_acctbal") * 100).cast("long").alias("size_bytes"), "last_used", (F.col("c_nationkey") == 0).alias("is_system"))
