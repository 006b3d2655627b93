"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Documents of null or empty text have the score 0 of the classifier, which decides on them as on all others; those that stay pass
the other stages and end as one token. Rows of null doc_id are never near copies of others. Rows that repeat a doc_id count as
copies of one document for lines and near copies, and are packed each on its own. Texts of any length are processed whole. Columns
besides doc_id, text and n_chars are handed on as they are, whatever their names. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, lines, packing, quality, simhash
from quire.llm.common import stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go."""
    return quality.select_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that have an earlier equal or similar line go; every document stays."""
    return lines.dedup_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows are cut out of the texts; every document stays."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in one piece, each piece in a sequence."""
    cut = packing.pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(cut)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL: the classifier's fit, fuzzy lines and fingerprints are beyond it. Tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
