"""End-to-end plans: anonymization jobs and synthesis with a pluggable generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.templates import synthesis_prompt
from ..operators import detect, jobs, replace

Generator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def anonymize_job(docs: DataFrame, strategy: str = "mask", types: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, anonymized_text, found, residual, epsilon and status of each document.

    The residual scan searches all types; what a replacement itself put there is no leftover. A text in which all types were
    searched and none found is unchanged, so it is not searched again.
    """
    done = replace.anonymize(docs.select(id_col, text_col), strategy, types, text_col=text_col)
    again = F.col("anonymized_text") if types else F.when(F.size("spans") > 0, F.col("anonymized_text"))
    rows = detect.with_spans(done.withColumn("__again", again), None, text_col="__again", out="__left")
    issued = F.transform("spans", lambda s: s["replacement"])
    rows = rows.withColumn("residual", F.size(F.filter("__left", lambda s: ~F.exists(issued, lambda r: F.contains(r, s["value"])))))
    return rows.select(id_col, "anonymized_text", F.size("spans").alias("found"), "residual", (F.size("spans") * jobs.EPSILON_REPLACE).alias("epsilon"), jobs.status_after(F.col("residual"), F.lit(None).cast("string")).alias("status"))


def echo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stand-in generator: the prompt's last paragraph. A model client takes its place, one per partition."""
    for b in batches:
        yield b.assign(generated=b["prompt"].str.rsplit("\n", n=1).str[-1])


def synthesize(requests: DataFrame, generator: Generator = echo, id_col: str = "doc_id") -> DataFrame:
    """Anonymize the example, build the prompt, generate: id, prompt, generated."""
    safe = replace.anonymize(requests.withColumnRenamed("example_text", "text"), "mask")
    prompts = safe.select(id_col, synthesis_prompt(F.col("domain"), F.col("anonymized_text"), F.col("topic_hint")).alias("prompt"))
    return prompts.mapInPandas(generator, prompts.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", generated string")
