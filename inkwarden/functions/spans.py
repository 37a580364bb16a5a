"""Character spans as arrays of structs: finding, resolving overlaps, splicing. Offsets are code points, 0-based, end-exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<entity_type:string,value:string,start:int,end:int,confidence:double>>"


def shadow(text: Column) -> Column:
    """An ASCII text of the same length: other letters become `x`, other characters blanks.

    Word boundaries then mean the same in every regular-expression engine, and offsets stay those of the text.
    """
    replaced = F.regexp_replace(F.regexp_replace(text, r"[\p{L}\p{M}&&[^\x00-\x7F]]", "x"), r"[^\x00-\x7F]", " ")
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(replaced)


def exploded(rows: DataFrame, spans: str, *columns) -> DataFrame:
    """A row (`columns`, s) for each span of the array column `spans`.

    A plain explode makes the optimizer filter on the array's size below the column that computes it, where all patterns are
    matched a second time, and the shadow text is made again for each of them; an outer one with a filter on its result does not.
    """
    return rows.select(*columns, F.explode_outer(spans).alias("s")).filter(F.col("s").isNotNull())


def find(text: Column, seen: Column, pattern: str, entity_type: str, score: float) -> Column:
    """All matches of `pattern` in `seen`, a text of the same length as `text`, as SPAN with the values of `text`.

    Matches and the gaps between them come from two built-in calls, the second only where the first finds any; a fold over
    their lengths gives the offsets.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(a, x):
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    def places(hits):
        zipped = F.zip_with(hits, F.split(seen, pattern, -1), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
        found = F.aggregate(F.filter(zipped, lambda x: x["hit"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
        return F.when(F.size(hits) > 0, found).otherwise(none)

    once = F.transform(F.array(F.regexp_extract_all(seen, F.lit(pattern), F.lit(0))), places)
    return F.transform(
        F.element_at(once, 1),
        lambda s: F.struct(
            F.lit(entity_type).alias("entity_type"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("value"), s["start"].alias("start"), s["end"].alias("end"), F.lit(float(score)).alias("confidence")
        ),
    )


def resolve(spans: Column) -> Column:
    """Spans that do not overlap: in order of start, the longer, the surer, then by type; one that begins inside a taken one goes."""
    key = lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), (-s["confidence"]).alias("c"), s["entity_type"].alias("d"), s.alias("s"))
    ordered = F.transform(F.array_sort(F.transform(spans, key)), lambda k: k["s"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(s)).alias("out"))).otherwise(a)
    return F.aggregate(ordered, start, step, lambda a: a["out"])


def splice(text: Column, spans: Column, replacement) -> Column:
    """The text with each span replaced by `replacement(span)`; spans are in order and do not overlap."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), replacement(s)).alias("out"), s["end"].alias("at"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
