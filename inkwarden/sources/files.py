"""Corpus readers and result writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .templates import SEED_SCHEMA

CORPUS = "text string, entities array<struct<entity_type:string,start:int,end:int>>"
PAIRS = "original string, synthesized string"


def labelled_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of one file per domain: domain, text, entities ([] where missing). Blank lines are skipped by the reader."""
    rows = spark.read.schema(CORPUS).json(path)
    domain = F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl(?:\.gz)?$", 1)
    return rows.select(domain.alias("domain"), "text", F.coalesce("entities", F.array().cast("array<struct<entity_type:string,start:int,end:int>>")).alias("entities")).filter(F.col("text").isNotNull())


def write_corpus(rows: DataFrame, path: str) -> None:
    """JSON lines in one folder per domain (domain, text, entities), which `partitioned_corpus` reads back."""
    rows.select("domain", "text", "entities").write.partitionBy("domain").json(path)


def partitioned_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus with one folder per domain; a filter on the domain reads its folder only."""
    rows = spark.read.schema(CORPUS + ", domain string").json(path)
    return rows.select("domain", "text", F.coalesce("entities", F.array().cast("array<struct<entity_type:string,start:int,end:int>>")).alias("entities")).filter(F.col("text").isNotNull())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Where none is set, a temporary one in local mode and an error on a cluster, whose machines do not see each other's folders.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="inkwarden-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: what follows does not depend on executors that hold its parts."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_domain(corpus: DataFrame, domains: list[str]) -> DataFrame:
    """Documents and entities of each named domain; zero where it has no file."""
    spark = corpus.sparkSession
    listed = spark.createDataFrame([(d,) for d in domains], "domain string")
    counts = corpus.groupBy("domain").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("entities")).alias("entities"))
    return listed.join(counts, "domain", "left").select("domain", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("entities", F.lit(0)).alias("entities"))


def read_seeds(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Domain seeds of JSON lines, or of files that each hold one JSON array; missing lists are empty and a missing flag is false."""
    rows = spark.read.schema(SEED_SCHEMA).option("multiLine", not lines).json(path)
    none = F.array().cast("array<string>")
    filled = {c: F.coalesce(c, none) for c in ("example_documents", "custom_entity_types")} | {"is_platform_default": F.coalesce("is_platform_default", F.lit(False))}
    return rows.withColumns(filled)


def synthesis_pairs(spark: SparkSession, path: str) -> DataFrame:
    """original and synthesized, empty where missing."""
    return spark.read.schema(PAIRS).json(path).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("original", "synthesized")])


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_texts(rows: DataFrame, path: str, by: list[str], text_col: str = "text") -> None:
    rows.select(*by, F.col(text_col).alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def write_results(rows: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in order, numbers as they are rounded by the query."""
    rows.orderBy(*order).write.mode("overwrite").json(path)


def read_jdbc(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
