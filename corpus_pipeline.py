"""Documents to packed training sequences: quality rules, line dedup, near-duplicate removal, source mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all but the last
return the columns of `documents`. Between stages the rows are written as Parquet to the shared folder and read again, so a
lost executor costs a part of one stage. Rows without a doc_id stay in the near-duplicate stage, as no group can name them. Of rows that
share a doc_id each is judged by its own text: one stays if they are near duplicates, all do if their texts are unlike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltsieve.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from siltsieve.llm.common import cut, fresh_dir, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of a text that has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops long lines that five and more documents hold, but for one of them."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # docs may have n_lines and n_dropped of its own
    ident, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    return _counted(line_dedup.clean_lines(docs.toDF(*names), ident, text).select(*names).toDF(*docs.columns)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a five-word similarity of 0.8 or more, one row with the smallest doc_id stays.

    Rows are numbered and kept, so that their numbers stay; a doc_id that occurs twice would name two rows.
    """
    names, at = [f"c{k}" for k in range(len(docs.columns))], fresh_dir(spark, "near-rows")
    docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()).write.parquet(at)
    rows = spark.read.parquet(at)
    ident, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    groups = ngram_join.near_groups(rows, ident, text, n=5, percent=80, key_col="row")
    lost = cut(groups.where("doc_id is not null and key <> keep_key").select(F.col("key").alias("row")))
    return rows.join(F.broadcast(lost) if lost.count() <= ngram_join.MOST_BROADCAST else lost, "row", "left_anti").select(*names).toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and epoch that the mix takes; the last document of a source is cut to the words taken."""
    return _counted(mixing.mixed_documents(docs)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, vocabulary=packing.vocabulary())


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("n-gram jaccard join", near_duplicate_stage), ("mixing sources", mixing_stage), ("packing", packing_stage)]
#: The quality classifier, the shuffle of the mix and the tokenizer have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            at = fresh_dir(spark, f"stage-{k}")
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
    return docs
