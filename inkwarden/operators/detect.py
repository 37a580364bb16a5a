"""Personal-data detection: documents to spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.recognizers import DEFAULT_TYPES, REGISTRY, Recognizer, guarded
from ..functions.spans import SPAN, exploded, find, resolve, shadow

#: F1 scores that confidences are calibrated with, and the one for other types.
BASELINE_F1 = {
    "US_SSN": 0.97, "CREDIT_CARD": 0.96, "EMAIL_ADDRESS": 0.95, "PHONE_NUMBER": 0.93, "PERSON": 0.91,
    "IP_ADDRESS": 0.94, "DATE_TIME": 0.88, "LOCATION": 0.82, "ORGANIZATION": 0.79, "URL": 0.92,
}
OTHER_F1 = 0.80
THRESHOLD = 0.7
LANGUAGES = ["en", "de", "fr", "es", "it", "pt", "nl", "pl", "ru", "zh"]


def recognizers_for(types: list[str] | None, extra: list[Recognizer] | None = None) -> list[Recognizer]:
    """The recognizers of the requested types only, so that the plan holds no others."""
    unknown = [t for t in types or [] if t not in REGISTRY and t not in {r.entity_type for r in extra or []}]
    if unknown:
        raise ValueError(f"no recognizer for {unknown}")
    wanted = types or DEFAULT_TYPES
    return [REGISTRY[t] for t in wanted if t in REGISTRY] + [r for r in extra or [] if types is None or r.entity_type in wanted]


def checked(found: Column, r: Recognizer) -> Column:
    return F.filter(found, lambda s: r.check(s["value"])) if r.check else found


def spans_column(text: Column, seen: Column, recognizers: list[Recognizer], threshold: float = THRESHOLD) -> Column:
    """All spans of a text, sorted by start. Recognizers below the threshold are left out of the plan.

    Patterns with digits are matched only in texts that hold one, which is looked up once for all of them.
    """
    empty = F.array().cast(SPAN)
    parts, numeric = [], []
    for r in recognizers:
        if r.score >= threshold:
            found = guarded(r, seen, checked(find(text, seen, r.sought, r.entity_type, r.score), r), empty)
            (numeric if "[0-9]" in r.pattern else parts).append(found)
    if numeric:
        parts.append(F.when(seen.rlike("[0-9]"), F.concat(*numeric)).otherwise(empty))
    if not parts:
        return empty
    every = parts[0] if len(parts) == 1 else F.concat(*parts)
    order = lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["entity_type"].alias("c"), s.alias("s"))
    ordered = F.transform(F.array_sort(F.transform(every, order)), lambda k: k["s"])
    return F.when(text.isNull() | (F.trim(text) == ""), empty).otherwise(ordered)


def with_spans(docs: DataFrame, types: list[str] | None = None, threshold: float = THRESHOLD, extra: list[Recognizer] | None = None, text_col: str = "text", out: str = "spans", resolved: bool = False) -> DataFrame:
    """`docs` with an array of spans. Null and blank texts have none."""
    text = F.col(text_col)
    with_seen = docs.withColumn("__seen", shadow(text))
    spans = spans_column(text, F.col("__seen"), recognizers_for(types, extra), threshold)
    return with_seen.withColumn(out, resolve(spans) if resolved else spans).drop("__seen")


def detect(docs: DataFrame, types: list[str] | None = None, threshold: float = THRESHOLD, extra: list[Recognizer] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: id, entity_type, value, start, end, confidence. Text does not leave the scan's stage."""
    rows = with_spans(docs.select(id_col, text_col), types, threshold, extra, text_col)
    return exploded(rows, "spans", id_col).select(id_col, "s.entity_type", "s.value", "s.start", "s.end", "s.confidence")


def calibrate(confidence: Column, entity_type: Column, baseline: dict[str, float] | None = None) -> Column:
    """min(1, c / max(baseline F1, 0.01)) to four places."""
    table = F.create_map(*[F.lit(x) for kv in (baseline or BASELINE_F1).items() for x in kv])
    f1 = F.greatest(F.coalesce(F.element_at(table, entity_type), F.lit(OTHER_F1)), F.lit(0.01))
    return F.round(F.least(F.lit(1.0), confidence * (1 / f1)), 4)


def boost_by_context(spans: DataFrame, docs: DataFrame, words: list[str], width: int = 40, boost: float = 0.15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Raise the confidence of spans that have a context word within `width` characters before or after."""
    near = F.lower(F.concat(F.substring(F.col(text_col), F.greatest(F.lit(1), F.col("start") + 1 - width), F.least(F.col("start"), F.lit(width))), F.lit(" "), F.substring(F.col(text_col), F.col("end") + 1, F.lit(width))))
    hit = near.rlike("(^|[^a-z])(" + "|".join(words) + ")([^a-z]|$)")
    joined = spans.join(docs.select(id_col, text_col), id_col)
    return joined.withColumn("boosted", F.when(hit, F.least(F.lit(1.0), F.col("confidence") + boost)).otherwise(F.col("confidence"))).drop(text_col)


def detect_by_tenant(docs: DataFrame, types: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_types: int = 10_000) -> DataFrame:
    """Spans of each document by its tenant's enabled custom types (tenant_id, name, pattern, score, enabled).

    The pattern is a column: documents meet the patterns of their tenant in an equi-join. The type table is configuration; it is
    broadcast only while it has at most `most_types` rows, and joined by shuffle beyond.
    """
    on = types.filter("enabled").select("tenant_id", "name", "pattern", "score")
    on = F.broadcast(on) if on.limit(most_types + 1).count() <= most_types else on
    rows = docs.join(on, "tenant_id").withColumn("seen", shadow(F.col(text_col)))
    hits = rows.withColumn("m", F.expr("regexp_extract_all(seen, pattern, 0)")).filter(F.size("m") > 0).withColumn("g", F.expr("split(seen, pattern, -1)"))
    at = F.expr("transform(sequence(0, size(m) - 1), i -> named_struct('start', aggregate(slice(g, 1, i + 1), 0, (a, x) -> a + length(x)) + aggregate(slice(m, 1, i), 0, (a, x) -> a + length(x)), 'n', length(m[i])))")
    return hits.select(id_col, "tenant_id", F.col("name").alias("entity_type"), "score", F.explode(at).alias("s"), text_col).select(
        id_col, "tenant_id", "entity_type", F.substring(F.col(text_col), F.col("s.start") + 1, F.col("s.n")).alias("value"), F.col("s.start").alias("start"), (F.col("s.start") + F.col("s.n")).alias("end"), F.col("score").alias("confidence")
    )


def route_language(language: Column, loaded: list[str] | None = None) -> Column:
    """The language whose recognizers are used; unknown ones fall back to English."""
    return F.when(language.isin(*(loaded or LANGUAGES)), language).otherwise(F.lit("en"))


def residual(rewritten: DataFrame, issued: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "anonymized_text", threshold: float = THRESHOLD) -> DataFrame:
    """Spans still found in rewritten texts, all types searched; values that were issued as replacements do not count."""
    found = detect(rewritten, None, threshold, None, id_col, text_col)
    return found if issued is None else found.join(issued.select(F.col("replacement").alias("value")).distinct(), "value", "left_anti")
