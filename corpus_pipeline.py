"""A corpus from raw documents to packed sequences, in five stages of the llm subpackage.

Each stage takes what the one before kept, from Parquet. All but the last return
the documents' own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagtide.session import fresh_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    from tagtide.llm.hostrules import kept

    return kept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand in an earlier one; those that lose every word go."""
    from tagtide.llm.linedup import without_repeats

    return without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    from tagtide.llm.simhash import representatives

    return representatives(docs, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    from tagtide.llm.decontaminate import decontaminated

    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens."""
    from tagtide.llm.packing import pack_documents
    from tagtide.llm.queries import vocabulary

    return pack_documents(docs, vocabulary(), 2048, end=0)


STAGES = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination), ("best-fit packing", packing),
]

#: SimHash, latent retrieval and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        folder = fresh_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
