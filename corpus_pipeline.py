"""A corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and returns a frame, which `run` writes as Parquet
and reads again as the next one's documents. All but the last return the columns of
documents; the last has a row for each packed piece. Null texts count as empty, repeated
rows as documents of their own until a stage removes or takes them, and an empty table goes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.classifier import rate_quality
from scriptloom.llm.common import stored, table
from scriptloom.llm.mixing import take_copies
from scriptloom.llm.ngram_join import near_duplicates_left
from scriptloom.llm.packing import pack_documents
from scriptloom.llm.radix_dedup import keep_first

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    # Other columns go along as one, so that none clashes with what the classifier adds.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    narrow = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_doc"))
    rated = rate_quality(narrow, table(spark, sf_dir, "labels")).where(F.col("predicted") == 1)
    return rated.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_doc.`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that shares most of its five-word shingles."""
    return near_duplicates_left(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return take_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources", mixing),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
