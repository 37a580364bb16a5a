"""Queries of templates, parsing, fine-tuning data, cache and jobs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..functions import templates as tpl
from ..operators import cache, finetune, jobs
from .privacy import docs
from .registry import query, table

# ------------------------------------------------------------------ templates
TEMPLATE = "Dear {{name}}, your balance of {{balance}} is held in {{segment}}. {{closing}}"


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer")


def variables():
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    return F.array(pair("name", F.col("c_name")), pair("balance", F.col("c_acctbal").cast("decimal(12,2)").cast("string")), pair("closing", F.lit("Regards from {{segment}}")), pair("segment", F.col("c_mktsegment")))


RENDER_SQL = "replace(replace(replace(replace('" + TEMPLATE + "', '{{name}}', c_name), '{{balance}}', CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR)), '{{closing}}', 'Regards from {{segment}}'), '{{segment}}', c_mktsegment)"


@query("tpl_render", f"SELECT c_custkey, {RENDER_SQL} AS rendered, CAST(0 AS INTEGER) AS unresolved FROM customer")
def _(spark, sf_dir):
    r = tpl.render(F.lit(TEMPLATE), variables())
    return customers(spark, sf_dir).select("c_custkey", r.alias("rendered")).select("c_custkey", "rendered", F.size(tpl.unresolved(F.col("rendered"))).alias("unresolved"))


@query("tpl_missing", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ['date'] ELSE ['balance', 'date'] END AS missing FROM customer")
def _(spark, sf_dir):
    have = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("name"), F.lit("balance"))).otherwise(F.array(F.lit("name")))
    return customers(spark, sf_dir).select("c_custkey", tpl.missing(F.array(*[F.lit(x) for x in ("name", "balance", "date")]), have).alias("missing"))


def sample_messages():
    shots = F.array(F.struct(F.lit("2+2?").alias("user"), F.lit("4").alias("assistant")))
    return tpl.messages(F.lit("Be brief."), shots, F.concat(F.lit("Who is "), F.col("c_name"), F.lit("?")))


@query("tpl_messages", "SELECT c_custkey, CAST(i AS INTEGER) AS pos, ['system', 'user', 'assistant', 'user'][i + 1] AS role, ['Be brief.', '2+2?', '4', 'Who is ' || c_name || '?'][i + 1] AS content FROM (SELECT c_custkey, c_name, unnest(range(0, 4)) AS i FROM customer)")
def _(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", F.posexplode(sample_messages()).alias("pos", "m")).select("c_custkey", "pos", "m.role", "m.content")


@query("tpl_prompt", "SELECT c_custkey, '[SYSTEM]' || chr(10) || 'Be brief.' || chr(10) || chr(10) || '[USER]' || chr(10) || '2+2?' || chr(10) || chr(10) || '[ASSISTANT]' || chr(10) || '4' || chr(10) || chr(10) || '[USER]' || chr(10) || 'Who is ' || c_name || '?' AS prompt FROM customer")
def _(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", tpl.prompt(sample_messages()).alias("prompt"))


@query("synth_prompt", "SELECT doc_id, 'Write a realistic ' || lang || ' document. Use invented names and numbers only.' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Topic: ' || source ELSE '' END || CASE WHEN length(text) > 0 THEN chr(10) || chr(10) || 'Follow the structure of this example:' || chr(10) || text ELSE '' END AS prompt FROM documents")
def _(spark, sf_dir):
    topic = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit(""))
    return docs(spark, sf_dir).select("doc_id", tpl.synthesis_prompt(F.col("lang"), F.col("text"), topic).alias("prompt"))


@query("legal_terms", "SELECT c_custkey, replace(replace('Under the agreement with ' || c_name || ', this agreement ends.', ' the agreement ', ' the Agreement '), ' this agreement ', ' this Agreement ') AS text FROM customer")
def _(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", tpl.legal_terms(F.concat(F.lit("Under the agreement with "), "c_name", F.lit(", this agreement ends."))).alias("text"))


HIPAA_TEXT = "'ssn 123-45-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ' tel ' || lpad(CAST(c_custkey * 7919 % 10000000000 AS VARCHAR), 10, '0')"


@query("hipaa_filter", f"SELECT c_custkey, regexp_replace(regexp_replace({HIPAA_TEXT}, '\\b[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\\b', '[SSN REDACTED]', 'g'), '\\b([0-9]{{3}})([0-9]{{3}})[0-9]{{4}}\\b', '(\\1) \\2-XXXX', 'g') AS text FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.concat(F.lit("ssn 123-45-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(" tel "), F.lpad((k * 7919 % 10**10).cast("string"), 10, "0"))
    return customers(spark, sf_dir).select("c_custkey", tpl.hipaa_filter(text).alias("text"))


MODEL_SQL = "CASE c_custkey % 4 WHEN 0 THEN 'vllm/' WHEN 1 THEN 'ollama/' WHEN 2 THEN 'litellm/' ELSE '' END || 'model-' || lower(c_mktsegment)"


def models(spark, sf_dir):
    k = F.col("c_custkey") % 4
    return customers(spark, sf_dir).select("c_custkey", F.concat(F.when(k == 0, "vllm/").when(k == 1, "ollama/").when(k == 2, "litellm/").otherwise(""), F.lit("model-"), F.lower("c_mktsegment")).alias("model"))


@query("provider_route", f"SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'vllm' WHEN 1 THEN 'ollama' WHEN 2 THEN 'litellm' ELSE 'vllm' END AS provider, 'model-' || lower(c_mktsegment) AS name FROM customer")
def _(spark, sf_dir):
    provider, name = tpl.route_provider(F.col("model"))
    return models(spark, sf_dir).select("c_custkey", provider.alias("provider"), name.alias("name"))


@query("llm_payload", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN '{"model":"model-' || lower(c_mktsegment) || '","prompt":"' || c_name || '","stream":false,"options":{"num_predict":2048,"temperature":0.7,"top_p":0.95}}'
  ELSE '{"model":"model-' || lower(c_mktsegment) || '","messages":[{"role":"user","content":"' || c_name || '"}],"max_tokens":2048,"temperature":0.7,"top_p":0.95}' END AS payload FROM customer""")  # fmt: skip
def _(spark, sf_dir):
    provider, name = tpl.route_provider(F.col("model"))
    return models(spark, sf_dir).join(customers(spark, sf_dir).select("c_custkey", "c_name"), "c_custkey").select("c_custkey", tpl.payload(provider, name, F.col("c_name")).alias("payload"))


@query("domain_route", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'legal:clause' WHEN 1 THEN 'medical:soap_note' WHEN 2 THEN 'financial:report' END AS template_id FROM documents")
def _(spark, sf_dir):
    routes = spark.createDataFrame([("legal", "clause", "legal:clause"), ("medical", "soap_note", "medical:soap_note"), ("financial", "report", "financial:report")], "domain string, kind string, template_id string")
    k = F.col("doc_id") % 4
    requests = docs(spark, sf_dir).select("doc_id", F.when(k == 0, "legal").when(k == 1, "medical").when(k == 2, "financial").otherwise("hr").alias("domain"), F.when(k == 0, "clause").when(k == 1, "soap_note").otherwise("report").alias("kind"))
    return requests.join(F.broadcast(routes), ["domain", "kind"], "left").select("doc_id", "template_id")


@query("list_templates", """WITH t(template_id, domain) AS (VALUES ('general_document', 'general'), ('legal_clause', 'legal'), ('legal_brief', 'legal'), ('legal_compliance', 'legal'), ('medical_soap_note', 'medical'), ('medical_discharge', 'medical'), ('financial_report', 'financial'), ('financial_risk', 'financial'), ('financial_filing', 'financial'))
SELECT d.domain, template_id, count(*) AS documents FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'legal' WHEN 1 THEN 'medical' WHEN 2 THEN 'financial' ELSE 'hr' END AS domain FROM documents) d LEFT JOIN t USING (domain) GROUP BY ALL""")
def _(spark, sf_dir):
    from ..sources.templates import builtin_templates

    k = F.col("doc_id") % 4
    asked = docs(spark, sf_dir).select(F.when(k == 0, "legal").when(k == 1, "medical").when(k == 2, "financial").otherwise("hr").alias("domain"))
    return asked.groupBy("domain").agg(F.count(F.lit(1)).alias("documents")).join(F.broadcast(builtin_templates(spark).select("domain", "template_id")), "domain", "left").select("domain", "template_id", "documents")


@query("seed_scan", "SELECT p_name AS name, p_brand AS domain, 'Write about {item} of size ' || p_size || '.' AS prompt_template, [p_type] AS example_documents, CAST([] AS VARCHAR[]) AS custom_entity_types, p_size % 7 = 0 AS is_platform_default FROM part")
def _(spark, sf_dir):
    """The parts written as a JSON file of domain seeds, and read back."""
    from ..sources import files

    prompt = F.concat(F.lit("Write about {item} of size "), F.col("p_size").cast("string"), F.lit("."))
    seeds = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("domain"), prompt.alias("prompt_template"), F.array("p_type").alias("example_documents"), (F.col("p_size") % 7 == 0).alias("is_platform_default"))
    path = files.scratch(spark, "seeds")
    seeds.write.json(path)
    return files.read_seeds(spark, path)


@query("synthesize")
def _(spark, sf_dir):
    from .pipelines import synthesize

    return synthesize(docs(spark, sf_dir).select("doc_id", F.col("lang").alias("domain"), F.col("text").alias("example_text"), F.col("source").alias("topic_hint")))


# ------------------------------------------------------------------ parsing
RAW_SQL = """CASE c_custkey % 5 WHEN 0 THEN '```json' || chr(10) || j || chr(10) || '```' WHEN 1 THEN 'Sure, here is the answer: ' || j WHEN 2 THEN 'text before ' || j || ' and after' WHEN 3 THEN '[' || c_custkey || ', 2]' ELSE 'nothing here' END"""
J_SQL = """'{"id": ' || c_custkey || ', "name": "' || c_name || '", "ok": ' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE '"yes"' END || '}'"""


def raw(spark, sf_dir):
    k = F.col("c_custkey")
    j = F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "name": "'), F.col("c_name"), F.lit('", "ok": '), F.when(k % 2 == 0, "true").otherwise('"yes"'), F.lit("}"))
    c = customers(spark, sf_dir).select(k, j.alias("j"))
    text = F.when(k % 5 == 0, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).when(k % 5 == 1, F.concat(F.lit("Sure, here is the answer: "), "j")).when(k % 5 == 2, F.concat(F.lit("text before "), "j", F.lit(" and after")))
    return c.select(k, text.when(k % 5 == 3, F.concat(F.lit("["), k.cast("string"), F.lit(", 2]"))).otherwise("nothing here").alias("raw"))


@query("sanitize", f"SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN j WHEN 1 THEN j ELSE {RAW_SQL} END AS text FROM (SELECT *, {J_SQL} AS j FROM customer)")
def _(spark, sf_dir):
    return raw(spark, sf_dir).select("c_custkey", parse.sanitize(F.col("raw")).alias("text"))


@query("strip_fences", f"SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN j ELSE {RAW_SQL} END AS text FROM (SELECT *, {J_SQL} AS j FROM customer)")
def _(spark, sf_dir):
    return raw(spark, sf_dir).select("c_custkey", parse.strip_fences(F.col("raw")).alias("text"))


@query("parse_json", """SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN c_custkey END AS id, CASE WHEN c_custkey % 5 < 3 THEN c_name END AS name, CASE WHEN c_custkey % 5 = 3 THEN c_custkey END AS item, c_custkey % 5 < 4 AS parsed FROM customer""")
def _(spark, sf_dir):
    rows = raw(spark, sf_dir).withColumn("v", parse.parse_json(F.col("raw")))
    return rows.select("c_custkey", F.try_variant_get("v", "$.id", "bigint").alias("id"), F.try_variant_get("v", "$.name", "string").alias("name"), F.try_variant_get("v", "$.items[0]", "bigint").alias("item"), F.col("v").isNotNull().alias("parsed"))


SCHEMA = {"required": ["id", "age"], "properties": {"id": {"type": "integer"}, "name": {"type": "string", "maxLength": 5}, "ok": {"type": "boolean"}}}


@query("schema_validate", """SELECT c_custkey, CASE WHEN c_custkey % 5 >= 3 THEN ['id: required', 'age: required'] WHEN c_custkey % 2 = 0 THEN ['age: required', 'name: longer than 5']
ELSE ['age: required', 'name: longer than 5', 'ok: boolean wanted, string found'] END AS errors FROM customer""")  # fmt: skip
def _(spark, sf_dir):
    rows = raw(spark, sf_dir).withColumn("v", parse.parse_json(F.col("raw")))
    return rows.select("c_custkey", parse.schema_errors(F.col("v"), SCHEMA).alias("errors"))


@query("extract_fields", "SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN c_name END AS name, CASE WHEN c_custkey % 5 < 3 THEN CAST(c_custkey AS VARCHAR) END AS id FROM customer")
def _(spark, sf_dir):
    m = parse.extract_fields(F.col("raw"), {"name": r'"name": "([^"]*)"', "id": r'"ID": ([0-9]+)'})
    return raw(spark, sf_dir).select("c_custkey", m.alias("m")).select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["id"].alias("id"))


@query("coerce_types", """SELECT c_custkey, CAST(c_custkey AS BIGINT) AS i, CAST(c_acctbal AS DOUBLE) AS n, CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS b, [c_name, CAST(c_custkey AS VARCHAR)] AS a FROM customer""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    words = F.when(k % 3 == 0, " Yes").when(k % 3 == 1, "OFF").otherwise("maybe")
    listed = F.when(k % 2 == 0, F.concat(F.lit('["'), "c_name", F.lit('", "'), k.cast("string"), F.lit('"]'))).otherwise(F.concat("c_name", F.lit(" , "), k.cast("string"), F.lit(",")))
    return customers(spark, sf_dir).select(k, parse.to_integer(F.format_number(k, 0)).alias("i"), parse.to_number(F.col("c_acctbal").cast("string")).alias("n"), parse.to_boolean(words).alias("b"), parse.to_array(listed).alias("a"))


@query("retry_prompt", "SELECT c_custkey, 'The last answer does not fit the schema.' || chr(10) || chr(10) || 'Answer:' || chr(10) || c_name || chr(10) || chr(10) || 'Errors:' || chr(10) || '- a' || chr(10) || '- b' || chr(10) || chr(10) || 'Schema:' || chr(10) || '{}' || chr(10) || chr(10) || 'Return corrected JSON only.' AS prompt FROM customer")
def _(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", parse.retry_prompt(F.col("c_name"), F.array(F.lit("a"), F.lit("b")), F.lit("{}")).alias("prompt"))


# ------------------------------------------------------------------ fine-tuning data
def samples(spark, sf_dir):
    """Each user turn with the answer that follows it."""
    c = table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant')")
    ask = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    answer = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return ask.join(answer, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), "instruction", F.lit("").alias("input"), "output", F.lit("").alias("text"))


SAMPLES_SQL = "(SELECT a.conv_id * 1000 + a.turn AS sample_id, a.text AS instruction, '' AS input, b.text AS output FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant' WHERE b.text <> '')"


@query("ft_instruct", f"SELECT sample_id, instruction, input, output FROM {SAMPLES_SQL}")
def _(spark, sf_dir):
    return finetune.formatted(samples(spark, sf_dir), "instruct")


@query("ft_sharegpt", f"""SELECT sample_id, CAST(i AS INTEGER) AS pos, CASE i WHEN 0 THEN 'human' ELSE 'gpt' END AS "from", CASE WHEN i = 1 OR instruction = '' THEN output ELSE regexp_replace(regexp_replace(instruction, '^\\s+', ''), '\\s+$', '') END AS value
FROM (SELECT *, unnest(range(0, 2)) AS i FROM {SAMPLES_SQL})""")  # fmt: skip
def _(spark, sf_dir):
    return finetune.formatted(samples(spark, sf_dir), "sharegpt").select("sample_id", F.posexplode("conversations").alias("pos", "t")).select("sample_id", "pos", "t.from", "t.value")


@query("ft_split", f"SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY sha256('42:' || sample_id)) <= greatest(1, CAST(floor(count(*) OVER () * 0.9) AS BIGINT)) THEN 'train' ELSE 'validation' END AS split FROM {SAMPLES_SQL}")
def _(spark, sf_dir):
    return finetune.split(finetune.formatted(samples(spark, sf_dir))).select("sample_id", "split")


@query("ft_adequacy", f"SELECT t AS train, n - t AS validation, t >= 800 AS train_enough, n - t >= 10 AS validation_enough FROM (SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * 0.9) AS BIGINT)) AS t FROM {SAMPLES_SQL})")
def _(spark, sf_dir):
    return finetune.adequacy(finetune.split(finetune.formatted(samples(spark, sf_dir))))


@query("ft_jsonl")
def _(spark, sf_dir):
    return finetune.formatted(samples(spark, sf_dir)).select("sample_id", F.to_json(F.struct("instruction", "input", "output")).alias("line"))


@query("lora_modules", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['q_proj', 'v_proj', 'k_proj', 'o_proj'] WHEN 1 THEN ['query_key_value', 'dense'] WHEN 2 THEN ['query_key_value', 'dense'] ELSE ['q_proj', 'v_proj'] END AS modules FROM part")
def _(spark, sf_dir):
    k = F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select("p_partkey", finetune.lora_modules(F.when(k == 0, "Llama3-8b").when(k == 1, "falcon-7b").when(k == 2, "GPT-NeoX-20b").otherwise("other")).alias("modules"))


# ------------------------------------------------------------------ cache, over the event log: a user's k-value is a prompt
def accesses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_id").alias("at"), cache.cache_key(F.concat(F.lit("prompt "), (F.col("user_id") % 300).cast("string")), F.lit('{"t": 1}')).alias("cache_key"), "event_type", "user_id")


KEY_SQL = "'prompt:' || substr(sha256('prompt ' || user_id % 300), 1, 32) || ':' || substr(sha256('{\"t\": 1}'), 1, 16)"
A_SQL = f"(SELECT event_id, event_id AS used_at, {KEY_SQL} AS cache_key, event_type, user_id FROM events)"
ENTRY_SQL = f"(SELECT cache_key, event_id AS entry_id, used_at AS created_at, 3600 AS ttl, 'r' || event_id AS response, 'v' || user_id % 3 AS template_version FROM {A_SQL} WHERE event_type = 'purchase')"
LATEST_SQL = f"(SELECT * FROM {ENTRY_SQL} QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, entry_id DESC) = 1)"
REQUEST_SQL = f"(SELECT event_id AS request_id, used_at, cache_key FROM {A_SQL} WHERE event_type = 'view')"


def entries(spark, sf_dir):
    return accesses(spark, sf_dir).filter("event_type = 'purchase'").select("cache_key", F.col("event_id").alias("entry_id"), F.col("at").alias("created_at"), F.lit(3600).alias("ttl"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("response"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("template_version"))


def requests(spark, sf_dir):
    return accesses(spark, sf_dir).filter("event_type = 'view'").select(F.col("event_id").alias("request_id"), "at", "cache_key")


@query("cache_key", f"SELECT event_id, cache_key FROM {A_SQL}")
def _(spark, sf_dir):
    return accesses(spark, sf_dir).select("event_id", "cache_key")


@query("cache_latest", f"SELECT cache_key, entry_id, response FROM {LATEST_SQL}")
def _(spark, sf_dir):
    return cache.latest(entries(spark, sf_dir)).select("cache_key", "entry_id", "response")


EXACT_SQL = f"SELECT request_id, response FROM {REQUEST_SQL} r LEFT JOIN {LATEST_SQL} e ON r.cache_key = e.cache_key AND used_at >= created_at AND used_at - created_at < ttl"


@query("cache_exact", EXACT_SQL)
def _(spark, sf_dir):
    return cache.exact(requests(spark, sf_dir), entries(spark, sf_dir)).select("request_id", "response")


@query("cache_misses", f"SELECT request_id FROM ({EXACT_SQL}) WHERE response IS NULL")
def _(spark, sf_dir):
    return cache.misses(requests(spark, sf_dir), entries(spark, sf_dir)).select("request_id")


DOT_SQL = "greatest(0.0, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(v.embedding[i] AS DOUBLE))))"
#: Requests lie between two vectors of the table: those with an even number of tens near the second, which is an entry, the others between both.
ASKED_SQL = "(SELECT a.vec_id, list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) + CASE WHEN a.vec_id % 20 = 0 THEN 4 ELSE 1 END * CAST(b.embedding[i] AS DOUBLE)) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 10 = 0)"
UNIT_SQL = f"(SELECT vec_id, list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z)))) AS embedding FROM {ASKED_SQL})"
SEMANTIC_SQL = f"SELECT request_id, entry_id, s AS similarity FROM (SELECT q.vec_id AS request_id, v.vec_id AS entry_id, {DOT_SQL} AS s FROM {UNIT_SQL} q JOIN embeddings v ON v.vec_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, v.vec_id) = 1) WHERE s >= 0.92"


def vector_requests(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    a = e.filter("vec_id % 10 = 0").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    weight = F.when(F.col("vec_id") % 20 == 0, 4).otherwise(1)
    a = a.select(F.col("vec_id").alias("request_id"), F.zip_with("embedding", "next", lambda x, y: x.cast("double") + weight * y.cast("double")).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, z: s + z * z))
    a = a.withColumn("norm", norm).select("request_id", F.transform("x", lambda y: y / F.col("norm")).alias("embedding"))
    return a, e.filter("vec_id % 10 <> 0").select(F.col("vec_id").alias("entry_id"), "embedding")


#: Every tenth vector of the table asks all others.
ALL_SEMANTIC_SQL = f"SELECT request_id, entry_id, s AS similarity FROM (SELECT q.vec_id AS request_id, v.vec_id AS entry_id, {DOT_SQL} AS s FROM embeddings q JOIN embeddings v ON q.vec_id % 10 = 0 AND v.vec_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, v.vec_id) = 1) WHERE s >= 0.5"


@query("cache_semantic", f"SELECT request_id, entry_id, round(similarity, 6) AS similarity FROM ({ALL_SEMANTIC_SQL})")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked, held = (e.filter(f"vec_id % 10 {sign} 0").select(F.col("vec_id").alias(name), "embedding") for sign, name in (("=", "request_id"), ("<>", "entry_id")))
    return cache.semantic(asked, held, 0.5).withColumn("similarity", F.round("similarity", 6))


def looked_up(spark, sf_dir):
    req, ent = vector_requests(spark, sf_dir)
    req = req.withColumns({"cache_key": F.concat(F.lit("k"), (F.col("request_id") % 30).cast("string")), "at": F.lit(10)})
    ent = ent.withColumns({"cache_key": F.concat(F.lit("k"), (F.col("entry_id") % 31).cast("string")), "created_at": F.lit(5), "ttl": F.lit(3600), "response": F.concat(F.lit("r"), F.col("entry_id").cast("string"))})
    return cache.lookup(req, ent)


LOOKUP_SQL = f"""SELECT q.vec_id AS request_id, CASE WHEN e.entry_id IS NOT NULL THEN 'hit' WHEN s.entry_id IS NOT NULL THEN 'semantic_hit' ELSE 'miss' END AS outcome, 'r' || coalesce(e.entry_id, s.entry_id) AS response
FROM {UNIT_SQL} q LEFT JOIN (SELECT vec_id % 31 AS k, max(vec_id) AS entry_id FROM embeddings WHERE vec_id % 10 <> 0 GROUP BY vec_id % 31) e ON q.vec_id % 30 = e.k LEFT JOIN ({SEMANTIC_SQL}) s ON s.request_id = q.vec_id WHERE q.vec_id % 10 = 0"""


@query("cache_lookup", LOOKUP_SQL)
def _(spark, sf_dir):
    return looked_up(spark, sf_dir)


@query("cache_metrics", f"SELECT CAST(count(*) FILTER (outcome = 'hit') AS BIGINT) AS hits, CAST(count(*) FILTER (outcome = 'semantic_hit') AS BIGINT) AS semantic_hits, CAST(count(*) FILTER (outcome = 'miss') AS BIGINT) AS misses, round(count(*) FILTER (outcome <> 'miss') / CAST(count(*) AS DOUBLE), 4) AS hit_rate, CAST(coalesce(sum(length(response)), 0) AS BIGINT) AS characters FROM ({LOOKUP_SQL})")
def _(spark, sf_dir):
    return cache.metrics(looked_up(spark, sf_dir))


@query("cache_lru", f"SELECT cache_key, max(used_at) AS last_used FROM {A_SQL} GROUP BY cache_key ORDER BY last_used DESC LIMIT 128")
def _(spark, sf_dir):
    return cache.evict_lru(accesses(spark, sf_dir).withColumn("access_id", F.col("event_id")), 128)


@query("cache_invalidate", f"SELECT entry_id FROM {ENTRY_SQL} WHERE template_version <> 'v1'")
def _(spark, sf_dir):
    return cache.invalidate_version(entries(spark, sf_dir), "v1").select("entry_id")


# ------------------------------------------------------------------ tenant tables: customers as tenants, orders as jobs
def tenant_templates(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 10).alias("tenant_id"), (F.col("p_size") % 3 != 0).alias("is_active"), (F.col("p_size") % 7 == 0).alias("is_platform_default"))


@query("list_domains", "SELECT p_partkey, p_name FROM part WHERE p_size % 3 <> 0 AND (p_partkey % 10 = 3 OR p_size % 7 = 0)")
def _(spark, sf_dir):
    return jobs.list_domains(tenant_templates(spark, sf_dir), 3).select("p_partkey", "p_name")


@query("get_template", "SELECT p_partkey, p_name FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part WHERE p_partkey % 10 = 3 AND p_size % 3 <> 0)")
def _(spark, sf_dir):
    t = jobs.list_domains(tenant_templates(spark, sf_dir), 3, False)
    return jobs.get(t, "p_partkey", t.agg(F.min("p_partkey")).first()[0], 3).select("p_partkey", "p_name")


for _name, _key in [("get_job", 32), ("get_ft_job", 33)]:

    @query(_name, f"SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice <> 0 THEN o_totalprice END AS loss FROM orders WHERE o_orderkey = {_key}")
    def _(spark, sf_dir, key=_key):
        o = table(spark, sf_dir, "orders")
        tenant = o.filter(F.col("o_orderkey") == key).select("o_custkey").first()
        return jobs.get(o, "o_orderkey", key, tenant[0] if tenant else -1, "o_custkey").select("o_orderkey", "o_orderstatus", F.when(F.col("o_totalprice") != 0, F.col("o_totalprice")).alias("loss"))


@query("list_entity_types", "SELECT p_partkey FROM part WHERE p_partkey % 10 = 4 AND p_size % 3 <> 0")
def _(spark, sf_dir):
    return jobs.list_entity_types(tenant_templates(spark, sf_dir).withColumnRenamed("is_active", "enabled"), 4).select("p_partkey")


@query("soft_delete", "SELECT p_partkey, p_size % 3 <> 0 AND p_partkey <> 7 AS enabled FROM part")
def _(spark, sf_dir):
    return jobs.soft_delete(tenant_templates(spark, sf_dir).withColumnRenamed("is_active", "enabled"), "p_partkey", 7).select("p_partkey", "enabled")


@query("validate_requests", "SELECT doc_id, list_filter([CASE WHEN length(text) NOT BETWEEN 1 AND 20000 * 25 THEN 'text length' END, CASE WHEN doc_id % 5 * 10000 NOT BETWEEN 1 AND 32768 THEN 'max_tokens' END, CASE WHEN doc_id % 7 > 4 THEN 'temperature' END, CASE WHEN doc_id % 30 NOT BETWEEN 1 AND 20 THEN 'concurrency' END], lambda x: x IS NOT NULL) AS problems FROM documents")
def _(spark, sf_dir):
    k = F.col("doc_id")
    r = docs(spark, sf_dir).select("doc_id", "text", (k % 5 * 10000).alias("max_tokens"), ((k % 7) / 2.0).alias("temperature"), F.lit(0.95).alias("top_p"), (k % 30).alias("concurrency"))
    return jobs.validate_requests(r).select("doc_id", "problems")


@query("dp_ledger", """WITH RECURSIVE u AS (
  SELECT event_id, user_id % 100 AS tenant, CASE WHEN event_type = 'purchase' THEN 5 ELSE 1 END AS need, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 100 ORDER BY ts, event_id) AS n FROM events
), r AS (
  SELECT event_id, tenant, n, need <= 50 AS allowed, CASE WHEN need <= 50 AND ok THEN need ELSE 0 END AS spent FROM u WHERE n = 1
  UNION ALL SELECT u.event_id, u.tenant, u.n, r.spent + need <= 50, CASE WHEN r.spent + need <= 50 AND ok THEN r.spent + need ELSE r.spent END FROM r JOIN u ON u.tenant = r.tenant AND u.n = r.n + 1
) SELECT event_id, allowed, round(CAST(spent AS DOUBLE) / 10, 6) AS spent FROM r""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 100).alias("tenant_id"), jobs.epsilon(F.when(F.col("event_type") == "purchase", "synthesize").otherwise("replace")).alias("epsilon"), (F.col("event_type") != "error").alias("succeeded"))
    return jobs.ledger(e, 5.0, ["ts", "event_id"]).select("event_id", "allowed", "spent")


@query("batch_manifest", """SELECT o_custkey AS job_id, '{"job_id":' || o_custkey || ',"documents":[' || string_agg('{"document_id":' || o_orderkey || ',"status":"' || CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END || '"}', ',' ORDER BY o_orderkey) || ']}' AS manifest FROM orders GROUP BY o_custkey""")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    return jobs.manifest(o)


@query("batch_status", "SELECT o_custkey AS job_id, CAST(count(*) FILTER (o_totalprice > 50000) AS BIGINT) AS completed, count(*) AS documents FROM orders GROUP BY o_custkey")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), jobs.status_after(F.lit(0), F.when(F.col("o_totalprice") <= 50000, "too small")).alias("status"))
    return o.groupBy("job_id").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count(F.lit(1)).alias("documents"))


@query("anonymize_job")
def _(spark, sf_dir):
    from .pipelines import anonymize_job

    return anonymize_job(docs(spark, sf_dir)).drop("anonymized_text")
