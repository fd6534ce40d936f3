"""The corpus pipeline: language ID, exact dedup, near-dedup and packing of ``documents``.

Each stage gets what its predecessor kept, written as Parquet and read again. All but the
last return the columns of ``documents``; the last returns where each piece of a document
was packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import stored, table
from foliant.llm.exact_dedup import exact_dedup
from foliant.llm.language_id import UNKNOWN, fit, identify
from foliant.llm.minmax_dedup import near_duplicates
from foliant.llm.packing import pack

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_SHARE = 0.34
# With fr, en or es left out at sf0.1, 95 % of its texts have under 0.53, 99 % of the others over 0.92; an unlearned script has 0.
MIN_CONFIDENCE = 0.6


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language.

    Those without letters go, those where no language has a third of the letters, and those whose
    letters don't suit the learned languages: under ``MIN_CONFIDENCE`` of what held-out rows have.
    """
    found = identify(docs, fit(docs), carry=COLUMNS[1:])
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SHARE) & (F.col("confidence") >= MIN_CONFIDENCE)).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, the one with the largest id; of rows equal in id and text, one."""
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    both = docs.withColumn("__digest", digest).join(
        kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("__digest") == F.col("text_sha256")), "left_semi")
    return both.dropDuplicates(["doc_id", "__digest"]).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one with the smallest id."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in a window; no two of a source or of equal text share one."""
    return pack(docs)


STAGES = [("language ID", known_language), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies), ("packing", pack_windows)]
ORACLE_SQL = None  # a trained language model and a sequential packing have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
