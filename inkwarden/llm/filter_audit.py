"""Which filter removes what, in every order of the filters: lattice edges summed once, permutations read as paths."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, whole


def row_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of one text each; words are runs of other than ASCII white space, case counts."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 100,
        "B": 100 * different.cast("bigint") < 80 * n.cast("bigint"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 10 * F.length(text).cast("bigint"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def marked(docs: DataFrame, labels: DataFrame, copies: str = "E") -> tuple[DataFrame, str]:
    """(part, mask, good, toxic of every document; the filters' letters, the first of which is bit 0 of the mask).

    Filter `copies` fails where a smaller id has the identical text (equal SHA-256). The rows stored are light: id, part, mask and
    digest. The smallest id of each digest comes from an aggregate that combines in each task first; rows find it by digest
    *and* id, so that a text with millions of copies meets one row and not a task of its own.
    """
    filters = row_filters(F.col("t"))
    letters = "".join(filters) + copies
    mask = sum((F.when(F.coalesce(fails, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values())), F.lit(0))
    last = F.lit(2**63 - 1)
    light = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), last).alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), whole(F.col("text")).alias("t"))
    light = settle(light.select("id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest")), "audit-rows")
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    first = light.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    rows = light.join(settle(known, "audit-labels"), "id", "left").join(settle(first, "audit-first"), ["digest", "id"], "left")
    rows = rows.select(
        "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + F.lit(1 << len(filters))).alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    return rows, letters


def lattice_edges(rows: DataFrame, n: int) -> DataFrame:
    """For each part, set of filters already applied and next filter: what arrives there and what the next one removes.

    Documents with equal marks are counted first, then each such count goes to all n * 2^(n-1) edges (80 for five filters).
    """
    edges = [(applied, f) for applied in range(1 << n) for f in range(n) if not applied >> f & 1]
    counts = rows.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    each = counts.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("applied"), F.lit(f).alias("next"), F.lit(1 << f).alias("bit")) for a, f in edges])).alias("e")).select("*", "e.*")
    mask, bit = F.col("mask"), F.col("bit")
    arrives, fails = mask.bitwiseAND(F.col("applied")) == 0, mask.bitwiseAND(bit) != 0
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0)))
    return each.groupBy("part", "applied", "next").agg(
        total(arrives & ~fails).alias("kept"),
        total(arrives & fails).alias("removed"),
        total(~arrives & fails).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(arrives & fails & F.col("good")).alias("good_lost"),
        total(arrives & fails & F.col("toxic")).alias("toxic_lost"),
    )


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (lang), order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A permutation is a path through the lattice of applied sets, so its five steps are five edges; 600 steps (a constant table)
    join the summed edges. `shapley` weighs each edge with the number of orders that walk it.

    Null text is empty, null lang the part ''. A null id counts as larger than all others; rows that share an id and a text do not
    fail as copies of each other. Several labels of one id count as one that has all their marks. Extra columns are ignored. No
    documents in, no rows out.
    """
    rows, letters = marked(docs, labels)
    n = len(letters)
    edges = lattice_edges(rows, n)
    steps = []
    for order in permutations(range(n)):
        for k, f in enumerate(order):
            steps.append(("".join(letters[i] for i in order), k + 1, sum(1 << i for i in order[:k]), f))
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, next int")
    size = F.bit_count("applied")
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), (size + 1).cast("int"))
    edges = edges.withColumn("shapley", F.sum(F.col("removed") * ways).over(Window.partitionBy("part", "next")))
    return edges.join(F.broadcast(steps), ["applied", "next"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", F.col("shapley").cast("bigint").alias("shapley")
    )
