"""From raw documents to packed training sequences in five stages.

In every stage a row is decided by its id and its text together, so rows that share an id, or have none, do not share a fate. Null
and empty texts pass the middle stages as they are and are packed as an end token alone, unless the classifier rejects them.
Repeated rows are lines, near copies and leaks like any others. Columns beside doc_id and text are kept, whatever their names, up to
the packing. A stage without rows gives none, and without labels or benchmark items nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarden.llm import decontaminate, line_dedup, near_dedup, packing, quality
from inkwarden.llm.common import settle, table


#: Lines shorter than this go only when they repeat exactly: one edit makes another word, number or bracket of them.
LINE_CHARS = 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Without labels of both classes all stay or all go by the known rate."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, within one edit, go, and with its last line a document; n_chars follows the text."""
    rest = line_dedup.without_repeats(docs, min_chars=LINE_CHARS)
    if "n_chars" not in docs.columns:
        return rest
    return rest.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the smallest id; null ids and texts without words are in no group."""
    return near_dedup.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; without items all stay."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences of 1024 tokens."""
    return packing.best_fit_packing(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontaminate", benchmark_stage), ("packing", packing_stage)]

#: SQL cannot express the classifier, the latent search or the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, f"stage-{name}")
    return docs
