"""Replacement of personal data: spans to rewritten texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fakes
from ..functions.recognizers import Recognizer
from ..functions.spans import SPAN, resolve, splice
from ..sources.files import stored
from .detect import THRESHOLD, detect, with_spans


def replacement(strategy: str, entity_type: Column, value: Column, seed: int = 0, language: Column | None = None) -> Column:
    if strategy == "mask":
        return fakes.mask(entity_type, value)
    if strategy == "random":
        return fakes.random_letters(entity_type, value, seed)
    if strategy == "entity_aware":
        return fakes.entity_aware(entity_type, value, seed, language)
    raise ValueError(f"unknown replacement strategy {strategy!r}")


def anonymize(
    docs: DataFrame, strategy: str = "mask", types: list[str] | None = None, threshold: float = THRESHOLD, extra: list[Recognizer] | None = None, seed: int = 0, text_col: str = "text", language_col: str | None = None
) -> DataFrame:
    """`docs` with `spans` (resolved, each with its replacement) and `anonymized_text`.

    A fake depends on (seed, type, value) alone, so equal values get equal fakes in all documents without a shuffle. Null
    texts stay null, blank ones unchanged.
    """
    rows = with_spans(docs, types, threshold, extra, text_col, "__spans", resolved=True)
    language = F.col(language_col) if language_col else None
    filled = F.transform(
        "__spans",
        lambda s: F.struct(s["entity_type"].alias("entity_type"), s["value"].alias("value"), replacement(strategy, s["entity_type"], s["value"], seed, language).alias("replacement"), s["start"].alias("start"), s["end"].alias("end"), s["confidence"].alias("confidence")),
    )
    rows = rows.withColumn("spans", filled).drop("__spans")
    return rows.withColumn("anonymized_text", F.when(F.size("spans") == 0, F.col(text_col)).otherwise(splice(F.col(text_col), F.col("spans"), lambda s: s["replacement"])))


def mask_until_clean(docs: DataFrame, types: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, anonymized_text, spans left) of each row, masked until detection finds nothing in it.

    A mask can uncover a value: digits that ran on into a neighbour, and so failed their check, pass it once the neighbour is a
    mask. Only rows in which something was found go into the next round. Masks hold no values, so each round leaves less text
    that could match, and the rounds end. This is a replacement, not the residual scan, which reports and mends nothing
    (`pipelines.anonymize_job`).
    """
    rows, clean = docs.select(id_col, F.col(text_col).alias("anonymized_text")), []
    while True:
        masked = anonymize(rows, "mask", types, text_col="anonymized_text").select(id_col, "anonymized_text") if not clean else _masked_again(rows)
        seen = stored(with_spans(masked, types, text_col="anonymized_text"), "masked")
        clean.append(seen.filter(F.size("spans") == 0))
        rows = seen.filter(F.size("spans") > 0)
        if rows.isEmpty():
            break
    out = clean[0]
    for part in clean[1:]:
        out = out.unionByName(part)
    return out


def _masked_again(rows: DataFrame) -> DataFrame:
    """Rows whose spans are known, with those spans masked."""
    text = splice(F.col("anonymized_text"), resolve(F.col("spans")), lambda s: fakes.mask(s["entity_type"], s["value"]))
    return rows.withColumn("anonymized_text", text).drop("spans")


def replacement_map(docs: DataFrame, strategy: str = "mask", types: list[str] | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(value, entity_type, replacement) once for each value of the batch; of several types, the first's (`first_types`)."""
    found = first_types(detect(docs, types, id_col=id_col, text_col=text_col), id_col)
    return found.select("value", "entity_type", replacement(strategy, F.col("entity_type"), F.col("value"), seed).alias("replacement"))


def first_types(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(value, entity_type): the type of a value's first occurrence, in order of documents and from the right within one."""
    order = F.struct(F.col(id_col), -F.col("start"), F.col("entity_type"))
    return spans.groupBy("value").agg(F.min_by("entity_type", order).alias("entity_type"), F.count_distinct("entity_type").alias("types"))


def splice_rows(docs: DataFrame, replaced: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rewrite texts from a long table (id, start, end, replacement) of spans that do not overlap."""
    by_doc = replaced.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("__spans"))
    text = F.col(text_col)
    return docs.join(by_doc, id_col, "left").withColumn("anonymized_text", F.when(F.col("__spans").isNull(), text).otherwise(splice(text, F.col("__spans"), lambda s: s["replacement"]))).drop("__spans")


def resolve_rows(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The spans of a long table that stay where they overlap (`resolve`)."""
    fields = ["entity_type", "value", "start", "end", "confidence"]
    by_doc = spans.groupBy(id_col).agg(F.collect_list(F.struct(*fields)).cast(SPAN).alias("__spans"))
    return by_doc.select(id_col, F.explode(resolve(F.col("__spans"))).alias("s")).select(id_col, *[f"s.{c}" for c in fields])


def largest_first(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spans of a long table without those that an equal start and a longer span, or an equal span and a surer type, outranks."""
    w = Window.partitionBy(id_col, "start").orderBy(F.desc("end"), F.desc("confidence"), "entity_type")
    return spans.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
