"""Prompt templates: rendering, messages, and the wording of prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(required: Column, names: Column) -> Column:
    return F.array_except(required, names)


def render(template: Column, variables: Column, opening: str = "{{", closing: str = "}}") -> Column:
    """Each (k, v) of the ordered array replaces its placeholder in turn; a value's own placeholders are open to later ones."""
    return F.aggregate(variables, template, lambda a, e: F.replace(a, F.concat(F.lit(opening), e["k"], F.lit(closing)), F.coalesce(e["v"], F.lit(""))))


def unresolved(rendered: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(rendered, F.lit(r"\{\{(\w+)\}\}"), F.lit(1)))


def messages(system: Column, few_shot: Column, user: Column) -> Column:
    """system, then user and assistant of each example, then user."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    shots = F.flatten(F.transform(few_shot, lambda s: F.array(message("user", s["user"]), message("assistant", s["assistant"]))))
    return F.concat(F.array(message("system", system)), shots, F.array(message("user", user)))


def prompt(msgs: Column) -> Column:
    return F.array_join(F.transform(msgs, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"])), "\n\n")


def synthesis_prompt(domain: Column, example: Column, topic: Column, style: Column | None = None) -> Column:
    """Instructions for a synthetic document of a domain, with the parts that are given."""
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Write a realistic "), domain, F.lit(" document. Use invented names and numbers only.")),
        F.when(F.length(topic) > 0, F.concat(F.lit("Topic: "), topic)),
        F.when(F.length(style) > 0, F.concat(F.lit("Style: "), style)) if style is not None else F.lit(None).cast("string"),
        F.when(F.length(example) > 0, F.concat(F.lit("Follow the structure of this example:\n"), example)),
    )


def legal_terms(text: Column) -> Column:
    """The defined term of a contract in capitals."""
    return F.replace(F.replace(text, F.lit(" the agreement "), F.lit(" the Agreement ")), F.lit(" this agreement "), F.lit(" this Agreement "))


def hipaa_filter(text: Column) -> Column:
    """Social-security numbers and the last digits of ten-digit numbers hidden."""
    return F.regexp_replace(F.regexp_replace(text, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[SSN REDACTED]"), r"\b([0-9]{3})([0-9]{3})[0-9]{4}\b", "($1) $2-XXXX")


def route_provider(model: Column, default: str = "vllm") -> tuple[Column, Column]:
    """(provider, model name) from a `provider/` prefix."""
    known = F.regexp_extract(model, "^(vllm|ollama|litellm)/", 1)
    return F.when(known != "", known).otherwise(F.lit(default)), F.regexp_replace(model, "^(vllm|ollama|litellm)/", "")


def payload(provider: Column, model: Column, text: Column, max_tokens: int = 2048, temperature: float = 0.7, top_p: float = 0.95) -> Column:
    """The JSON body of a generation request: chat completion, or the native form of ollama."""
    chat = F.to_json(F.struct(model.alias("model"), F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature"), F.lit(top_p).alias("top_p")))
    native = F.to_json(F.struct(model.alias("model"), text.alias("prompt"), F.lit(False).alias("stream"), F.struct(F.lit(max_tokens).alias("num_predict"), F.lit(temperature).alias("temperature"), F.lit(top_p).alias("top_p")).alias("options")))
    return F.when(provider == "ollama", native).otherwise(chat)
