"""The corpus pipeline: documents -> quality rules -> line dedup -> near-duplicates -> mixing -> packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and all but the last return the
columns of documents. Every result is written as Parquet and read again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import line_dedup, mixing, order_minhash, packing, quality_rules
from tracewell.llm.common import SPACE_CHARS, new_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Of rows that share an identifier, each goes by its own text."""
    return quality_rules.judge_kept(docs.select(*COLUMNS), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; documents go whose words were all in such copies."""
    out = line_dedup.dedup_lines(docs)
    left = F.length(F.translate(F.coalesce("text", F.lit("")), SPACE_CHARS, "")) > 0
    return out.where(left | (F.size("dropped_lines") == 0)).withColumn("n_chars", F.when(F.size("dropped_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return order_minhash.drop_near_duplicates(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Thresholds, alignments and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = new_folder(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
