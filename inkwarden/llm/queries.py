"""The opN_<name> queries of this subpackage and their SQL, for the catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, filter_audit, line_dedup, line_repeats, near_dedup, packing, period_runs, quality, token_counts, url_filter, warc
from .common import table, whole

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents
), g AS (
  SELECT doc_id, k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size
  FROM n WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g
"""


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


ORACLES["op2_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_page
  FROM pages
)
SELECT page_id, payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM p
"""


@query
def op6_line_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_repeats.repeated_spans(table(spark, sf_dir, "documents"))


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


ORACLES["op4_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN ['#' || array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s
  FROM w
), ids AS (SELECT s, row_number() OVER () AS sid FROM sh GROUP BY s HAVING count(*) > 1
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), k AS (SELECT sh.doc_id, sid FROM sh JOIN ids USING (s)
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM k a JOIN k b ON a.sid = b.sid AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(v, r) AS (
  SELECT a, a FROM both_ways UNION SELECT e.b, r FROM reach JOIN both_ways e ON e.a = v WHERE r < e.b
), comp AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON v = d.doc_id
"""


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"))


ORACLES["op5_line_dedup"] = r"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS line_no, trim(unnest(ls), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS c FROM raw
), k AS (SELECT doc_id, line_no, c, doc_id * 2147483648 + line_no AS place FROM l WHERE c <> ''
), d AS (SELECT c, min(place) AS first FROM k GROUP BY c
), v AS (
  SELECT DISTINCT c, first, i, substr(c, 1, i - 1) || substr(c, i + 1) AS s FROM (SELECT c, first, unnest(range(1, length(c) + 1)) AS i FROM d)
), sub AS (SELECT c, first, min(first) OVER (PARTITION BY i, length(c), s) AS near FROM v
), ins AS (
  SELECT a.c, a.first, b.first AS near FROM (SELECT DISTINCT c, first, s FROM v) a JOIN d b ON a.s = b.c
), near AS (
  SELECT c, min(near) AS near FROM (
    SELECT c, near FROM sub WHERE near < first
    UNION ALL SELECT c, near FROM ins WHERE near < first
    UNION ALL SELECT b.c, i.first FROM ins i JOIN d b ON b.first = i.near WHERE i.first < b.first) GROUP BY c
), r AS (
  SELECT k.doc_id, k.line_no, place, d.first, near.near FROM k JOIN d USING (c) LEFT JOIN near USING (c)
  WHERE place > d.first OR near.near IS NOT NULL
)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(least(first, coalesce(near, first)) // 2147483648 AS BIGINT) AS keep_doc_id,
  CAST(least(first, coalesce(near, first)) % 2147483648 AS INTEGER) AS keep_line_no, CASE WHEN near < first THEN 1 ELSE 0 END AS edits
FROM r
"""


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.chat_round_trip(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


ORACLES["op11_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn ' || replace(replace(role, '\', '\\'), chr(10), '\n') || '>' || chr(10) || '</turn>' || chr(10)) + length(regexp_replace(t, '<(\\*)(/?turn)', '<\\\1\2', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * list_unique(ws) < 80 * len(ws) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN l USING (doc_id)
), m AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o
), r AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS c,
    coalesce(sum(n) FILTER (NOT earlier AND NOT now), 0) AS kept, coalesce(sum(n) FILTER (NOT earlier AND now), 0) AS removed,
    coalesce(sum(n) FILTER (earlier AND now), 0) AS redundant, coalesce(sum(n) FILTER (fails = substr(filter_order, step, 1)), 0) AS unique_fails,
    coalesce(sum(n) FILTER (NOT earlier AND now AND good), 0) AS good_lost, coalesce(sum(n) FILTER (NOT earlier AND now AND toxic), 0) AS toxic_lost
  FROM (SELECT m.*, s.*, contains(fails, substr(filter_order, step, 1)) AS now,
      translate(fails, substr(filter_order, 1, step - 1), '') <> fails AS earlier FROM m, s)
  GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM r
"""


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of all documents; each tenth, by the checksum of its id, gets a periodic tail in place of its own. Null ids get none."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(whole(F.col("text")), r"[\x20\x09-\x0D]+"), "")
    picked = docs.select("doc_id", "text", F.coalesce(h % 10 == 0, F.lit(False)).alias("picked"), F.floor(h / 10).alias("g"))
    picked = picked.withColumn("words", F.when(F.col("picked"), words)).withColumn("n", F.greatest(F.size("words"), F.lit(1)))
    picked = picked.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    picked = picked.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(tail, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    whole_text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a"))), " ")
    return picked.select("doc_id", F.when(F.col("picked"), whole_text).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs.periodic_runs(planted(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    stronger = lambda r, s: s.isNull() | (r["length"] * s["period"] > s["length"] * r["period"])
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda s, r: F.when(stronger(r, s), r).otherwise(s))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
