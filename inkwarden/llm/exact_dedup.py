"""Exact deduplication by skew-safe combining, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, order_code, settle, whole


def normalised(text: Column) -> Column:
    """The text without its ASCII white space; null counts as empty."""
    return F.translate(whole(text), ASCII_SPACE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Two rows are equal when their texts are identical after `normalised`. Three combining stages, each grouping on the
    digest *and* the full content, so a digest collision can never merge two texts:

    1. local: the map-side half of the first aggregate collapses the copies a task holds;
    2. salted: (digest, content, salt) groups spread one hot text over `salts` reducers;
    3. global: at most `salts` winners for each text meet by digest.

    The winner table (digest, winner, size; no text) is written to the shared folder, and documents find their winner by
    joining on the digest; a digest with two contents stops the job there instead of giving a wrong group. That join
    is a plain sort-merge join over two exchanges, which adaptive execution splits where one digest is hot.

    Of a group the row with the most code points in the original text, then the smallest id stays. Null and empty texts
    are one group. A null id ranks after all others. Fully identical rows (same id, same text) are indistinguishable, so
    all of them are marked like the first. Extra columns are ignored. No rows in, no rows out.
    """
    text = whole(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("body")).select(
        "doc_id",
        normalised(F.col("body")).alias("content"),
        order_code(F.length("body"), F.col("doc_id")).alias("rank"),
    ).withColumn("digest", F.unhex(F.sha2("content", 256)))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "content", "salt")
        .agg(F.max_by("doc_id", "rank").alias("doc_id"), F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    )
    merged = (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max_by("doc_id", "rank").alias("keep_id"), F.max("rank").alias("best"), F.sum("n").alias("group_size"))
    )
    winners = merged.groupBy("digest").agg(
        F.any_value("keep_id").alias("keep_id"), F.any_value("best").alias("best"), F.any_value("group_size").alias("group_size"), F.count(F.lit(1)).alias("contents")
    )
    winners = settle(winners, "exact-winners").select(
        "digest", "keep_id", "best",
        F.when(F.col("contents") > 1, F.raise_error(F.lit("two contents share one SHA-256 digest")).cast("bigint")).otherwise(F.col("group_size")).alias("group_size"),
    )
    return rows.select("doc_id", "rank", "digest").join(winners, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("rank") == F.col("best")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of `docs` with equal texts, the one `exact_dedup` keeps, with all its columns.

    Rows are told apart by id and text, so a repeated id may keep some of its rows. Of rows with one id and equal texts the
    longest stays, and one of them where they do not differ.
    """
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_text")).distinct()
    marked = docs.withColumn("__id", F.col(id_col).cast("bigint")).withColumn("__text", F.sha2(normalised(F.col(text_col)), 256))
    found = marked.join(kept, F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__text") == F.col("__kept_text")), "left_semi")
    best = Window.partitionBy("__text", "__id").orderBy(F.length(whole(F.col(text_col))).desc())
    return found.withColumn("__row", F.row_number().over(best)).filter("__row = 1").select(*docs.columns)
