"""Quality reports, style profiles and gates over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .chunk import sentences


def quality_report(docs: DataFrame, domain: str = "general", text_col: str = "text", left: str | None = None, right: str | None = None) -> DataFrame:
    """`docs` with semantic, coherence, fluency, domain, overall, passes and reason; `left` and `right` are unit-vector columns."""
    t = F.col(text_col)
    semantic = tx.similarity(F.col(left), F.col(right)) if left else F.lit(0.5)
    rows = docs.withColumns({"semantic": semantic, "coherence": tx.coherence(t), "fluency": tx.fluency(t), "domain_quality": tx.domain_quality(t, domain)})
    blank = t.isNull() | (F.trim(t) == "")
    rows = rows.withColumn("overall", F.when(blank, 0.0).otherwise(tx.overall(F.col("semantic"), F.col("coherence"), F.col("fluency"), F.col("domain_quality"))))
    rows = rows.withColumn("passes", F.when(blank, False).otherwise(tx.passes(F.col("semantic"), F.col("coherence"), F.col("fluency"))))
    return rows.withColumn("reason", F.when(blank, "empty synthetic text"))


def gate(docs: DataFrame, left: str, right: str, threshold: float = 0.7) -> DataFrame:
    return docs.filter(tx.similarity(F.col(left), F.col(right)) >= threshold)


def style_profile(docs: DataFrame, markers: int = 5, text_col: str = "text") -> DataFrame:
    """avg_sentence_length, formality_score (share of words of 7 and more letters), domain_markers (the text's most frequent
    words of 5 and more letters, ties by alphabet) and tone, in the row."""
    long_words = F.sort_array(F.filter("__w", lambda x: F.length(x) >= 5))
    none = F.array().cast("array<struct<n:int,w:string>>")
    start = F.struct(F.lit("").alias("prev"), F.lit(0).alias("run"), none.alias("out"))
    # only the best `markers` are kept; words come by alphabet, so a later one takes a place only with more occurrences
    better = lambda a: (a["run"] > 0) & ((F.size(a["out"]) < markers) | (-a["run"] < F.element_at(a["out"], -1)["n"]))
    put = lambda a: F.when(better(a), F.slice(F.array_sort(F.concat(a["out"], F.array(F.struct((-a["run"]).alias("n"), a["prev"].alias("w"))))), 1, markers)).otherwise(a["out"])
    step = lambda a, x: F.when(a["prev"] == x, F.struct(x.alias("prev"), (a["run"] + 1).alias("run"), a["out"].alias("out"))).otherwise(F.struct(x.alias("prev"), F.lit(1).alias("run"), put(a).alias("out")))
    top = F.transform(F.aggregate(long_words, start, step, put), lambda x: x["w"])
    rows = docs.withColumn("__w", tx.words(F.lower(text_col)))
    n = F.size("__w")
    rows = rows.withColumn("avg_sentence_length", n / F.greatest(F.lit(1), F.size(sentences(F.col(text_col))))).withColumn("formality_score", F.when(n == 0, 0.5).otherwise(F.size(F.filter("__w", lambda x: F.length(x) >= 7)) / n))
    tone = F.when(F.col("formality_score") >= 0.4, "formal").when(F.col("formality_score") <= 0.15, "casual").otherwise("neutral")
    return rows.withColumn("domain_markers", top).withColumn("tone", tone).drop("__w")
