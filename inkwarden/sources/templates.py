"""Built-in prompt templates and domain seeds, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEMPLATE_SCHEMA = "template_id string, version string, domain string, description string, system_message string, user_message_template string, required_variables array<string>, few_shot array<struct<user:string,assistant:string>>"
SEED_SCHEMA = "name string, domain string, prompt_template string, example_documents array<string>, custom_entity_types array<string>, is_platform_default boolean"
#: (domain, kind, what is asked for, its variables)
KINDS = [
    ("general", "document", "a document on {{topic}} for {{audience}}", ["topic", "audience"]), ("legal", "clause", "a {{clause_type}} clause under the law of {{jurisdiction}}", ["clause_type", "jurisdiction"]),
    ("legal", "brief", "a brief on {{issue}} for {{court}}", ["issue", "court"]), ("legal", "compliance", "a statement of compliance with {{regulation}}", ["regulation"]),
    ("medical", "soap_note", "a SOAP note about {{complaint}}", ["complaint"]), ("medical", "discharge", "a discharge summary after {{procedure}}", ["procedure"]),
    ("financial", "report", "a report section on {{metric}} in {{period}}", ["metric", "period"]), ("financial", "risk", "a narrative of {{risk}} risk", ["risk"]), ("financial", "filing", "a filing extract on {{subject}}", ["subject"]),
]


def builtin_templates(spark: SparkSession) -> DataFrame:
    rows = [(f"{d}_{k}", "1.0", d, f"Writes {w.replace('{{', '').replace('}}', '').replace('_', ' ')}", f"You write {d} texts with invented names only.", f"Write {w}.", v, []) for d, k, w, v in KINDS]
    return spark.createDataFrame(rows, TEMPLATE_SCHEMA)


def domain_seeds(spark: SparkSession) -> DataFrame:
    """Seed rows with single-brace placeholders, as `functions.templates.render` reads them with braces given."""
    rows = [(f"{d} {k}".replace("_", " "), d, f"Write {w}.".replace("{{", "{").replace("}}", "}"), [], ["PERSON", "DATE_TIME"], True) for d, k, w, _ in KINDS if d != "general"]
    return spark.createDataFrame(rows, SEED_SCHEMA)
