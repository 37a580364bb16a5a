"""Evaluation of detectors and of generated text, and reports over checkpoints and batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.files import stored
from .jobs import BLOCK_BITS, in_order

KEYS = ["entity_type", "start", "end"]


def span_confusion(found: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp and fn of exact spans as sets, for each group `by` (which the spans carry). Duplicates count once."""
    keys = list(dict.fromkeys([*by, "doc_id", *KEYS]))
    f, t = found.select(*keys).distinct().withColumn("f", F.lit(1)), truth.select(*keys).distinct().withColumn("t", F.lit(1))
    both = f.join(t, keys, "full")
    hit = lambda c: F.sum(c.cast("bigint"))
    in_f, in_t = F.col("f").isNotNull(), F.col("t").isNotNull()
    return both.groupBy(*by).agg(hit(in_f & in_t).alias("tp"), hit(in_f & ~in_t).alias("fp"), hit(~in_f & in_t).alias("fn"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def with_scores(counts: DataFrame) -> DataFrame:
    """precision, recall and f1; 0 where a denominator is."""
    rows = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro(counts: DataFrame, domain: str = "domain") -> DataFrame:
    """Mean of the unrounded scores of a domain's types, to four places."""
    return with_scores(counts).groupBy(domain).agg(*[F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def rollup(found: DataFrame, truth: DataFrame, domain: str = "domain") -> DataFrame:
    """Scores for each domain and type, each domain, and all together."""
    counts = span_confusion(found, truth, [domain, "entity_type"])
    return with_scores(counts.rollup(domain, "entity_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    """(precision, recall) of each row's two word lists: shares of the words of `b` that `a` has too, and the other way round."""
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
    flat = [x.flatten() for x in (a, b)]
    code = pa.concat_arrays(flat).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    most = int(code.max()) + 1 if len(code) else 1
    row = [np.repeat(np.arange(len(n)), n) for n in sizes]
    own = [row[0] * most + code[: len(flat[0])], row[1] * most + code[len(flat[0]) :]]

    def share(x, y):
        hits = np.bincount(row[x][np.isin(own[x], own[y])], minlength=len(a))
        return pa.array(np.where(sizes[x] > 0, hits / np.maximum(sizes[x], 1), 0.0))

    return pa.StructArray.from_arrays([share(1, 0), share(0, 1)], names=["precision", "recall"])


def lexical_score(pairs: DataFrame, original: str = "original", synthesized: str = "synthesized") -> DataFrame:
    """precision, recall and f1 of greedy token matching with one-hot tokens: shares of tokens that the other text has too.

    A missing text has no tokens and scores 0. Words are compared as numbers, a batch at a time, so a long text costs no square of its words.
    """

    @F.arrow_udf("precision double, recall double")
    def shares(a: pa.Array, b: pa.Array) -> pa.Array:
        return _shared(a, b)

    rows = pairs.withColumn("__s", shares(words(F.lower(original)), words(F.lower(synthesized)))).withColumn("precision", F.col("__s.precision")).withColumn("recall", F.col("__s.recall")).drop("__s")
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def batch_totals(results: DataFrame, by: str = "job_id") -> DataFrame:
    return results.groupBy(by).agg(
        F.count_if(F.col("status") == "completed").alias("completed"), F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("found"), F.lit(0)).alias("found"), F.coalesce(F.sum("replaced"), F.lit(0)).alias("replaced"),
    )


def best_checkpoint(checkpoints: DataFrame, by: str = "job_id") -> DataFrame:
    """The step with the least eval loss (a zero or missing loss counts as none); without any, the last recorded."""
    loss = F.when(F.col("eval_loss") != 0, F.col("eval_loss"))
    best = F.min_by("step", F.when(loss.isNotNull(), F.struct(loss.alias("l"), F.col("ord"))))
    return checkpoints.groupBy(by).agg(F.coalesce(best, F.max_by("step", "ord")).alias("best_step"))


def flag_best(checkpoints: DataFrame, by: str = "job_id", block_bits: int = BLOCK_BITS) -> DataFrame:
    """`was_best`: under all earlier eval losses when recorded; `is_best`: the last of those.

    A running minimum over blocks of neighbours (`in_order`): each block's least loss, the least of the blocks before it, then the
    rows of a block from there. A job with a third of all rows is many blocks; only its blocks' minima meet in one window.
    """
    rows = in_order(checkpoints, by, ["ord"], block_bits)
    least = rows.groupBy(by, "block").agg(F.min("eval_loss").alias("least"))
    before = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entry = stored(least.withColumn("before", F.min("least").over(before)).select(F.col(by).alias("__by"), F.col("block").alias("__block"), "before"), "least-before")
    rows = rows.join(entry, F.col(by).eqNullSafe(F.col("__by")) & (F.col("block") == F.col("__block")))
    inside = Window.partitionBy(by, "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.least("before", F.min("eval_loss").over(inside))
    rows = stored(rows.withColumn("was_best", F.coalesce(F.col("eval_loss").isNotNull() & (so_far.isNull() | (F.col("eval_loss") < so_far)), F.lit(False))).drop("__by", "__block", "before"), "was-best")
    last = rows.filter("was_best").groupBy(F.col(by).alias("__by")).agg(F.max("row").alias("__last"))
    marked = rows.join(last, F.col(by).eqNullSafe(F.col("__by")), "left").withColumn("is_best", F.coalesce(F.col("row") == F.col("__last"), F.lit(False)))
    return marked.select(*checkpoints.columns, "was_best", "is_best")
