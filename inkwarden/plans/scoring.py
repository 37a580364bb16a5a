"""Queries of chunking, scoring and language, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunk, score
from .privacy import docs, q
from .registry import query, table

SENTENCES = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace({t}, '^\s+', ''), '\s+$', ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 0)"
WORDS = r"regexp_extract_all({t}, '[\pL\pN_]+')"
LATIN = r"list_distinct(regexp_extract_all(regexp_replace(regexp_replace(lower({t}), '[^\x00-\x7F\pN\pP\pS\pZ\pC]', '0', 'g'), '[^\x00-\x7F]', ' ', 'g'), '\b[a-z]{{3,}}\b'))"


def lst(ws):
    return "[" + ", ".join(q(w) for w in ws) + "]"


# ------------------------------------------------------------------ chunking
FIXED_SQL = """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0), c AS (
  SELECT doc_id, text, n, unnest(CASE WHEN n <= {s} THEN [0] ELSE range(0, CAST(ceil((n - {s}) / {step}.0) AS BIGINT) + 1) END) AS i FROM d
), k AS (SELECT doc_id, text, n, i, i * {step} AS cs, CASE WHEN n <= {s} THEN n ELSE least(i * {step} + {s}, n) END AS ce FROM c
), b AS (SELECT doc_id, text, n, i, cs, ce, CASE WHEN i = 0 THEN cs ELSE greatest(0, cs - {o}) END AS sc, CASE WHEN ce >= n THEN ce ELSE least(n, ce + {o}) END AS ec FROM k)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(text, CAST(sc + 1 AS BIGINT), CAST(ec - sc AS BIGINT)) AS text, CAST(cs AS INTEGER) AS core_start, CAST(ce AS INTEGER) AS core_end, CAST(sc AS INTEGER) AS start_char, CAST(ec AS INTEGER) AS end_char,
  CAST(cs - sc AS INTEGER) AS overlap_start, CAST(ec - ce AS INTEGER) AS overlap_end FROM b"""


@query("chunk_fixed", FIXED_SQL.format(s=2000, o=200, step=1800))
def _(spark, sf_dir):
    return chunk.chunks(docs(spark, sf_dir), "fixed", 2000, 200)


@query("chunk_single", f"SELECT doc_id, chunk_index, text FROM ({FIXED_SQL.format(s=10000, o=500, step=9500)})")
def _(spark, sf_dir):
    """Texts up to the default size are one chunk; longer ones are cut at the default size and overlap."""
    return chunk.chunks(docs(spark, sf_dir), "fixed").select("doc_id", "chunk_index", "text")


def ends_sql(pattern: str) -> str:
    return f"""SELECT doc_id, text, list_distinct(list_concat(list_transform(range(1, len(h) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x)))), [length(text)])) AS e
FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS h, regexp_split_to_array(text, '{pattern}') AS g FROM {{source}} WHERE length(text) > 0)"""


SEGMENT_SQL = """WITH e AS ({ends}), u AS (SELECT doc_id, CAST(unnest(e) AS INTEGER) AS "end" FROM e)
SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS segment, CAST(coalesce(lag("end") OVER w, 0) AS INTEGER) AS "start", "end" FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY "end")"""
TALK = "(SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"


def talks(spark, sf_dir):
    """Conversations as documents with blank lines between turns."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


@query("seg_sentence", SEGMENT_SQL.format(ends=ends_sql(r"[.!?]+\s+").format(source="documents")))
def _(spark, sf_dir):
    return chunk.segments(docs(spark, sf_dir), "sentence")


@query("seg_paragraph", SEGMENT_SQL.format(ends=ends_sql(r"\n\s*\n").format(source=TALK)))
def _(spark, sf_dir):
    return chunk.segments(talks(spark, sf_dir), "paragraph")


@query("seg_fixed", """SELECT doc_id, CAST(i / 1800 AS INTEGER) AS segment, CAST(i AS INTEGER) AS "start", CAST(least(i + 2000, n) AS INTEGER) AS "end" FROM (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 1800)) AS i FROM documents)""")
def _(spark, sf_dir):
    return chunk.segments(docs(spark, sf_dir), "fixed", 2000, 200)


def merge_sql(pattern: str, source: str, size: int, overlap: int) -> str:
    return f"""WITH e AS ({ends_sql(pattern).format(source=source)}), s AS (SELECT doc_id, text, length(text) AS n, list_sort(e) AS e FROM e), m AS (
  SELECT doc_id, text, n, list_reduce(list_transform(e, lambda x: {{'f': CAST(0 AS BIGINT), 't': CAST(x AS BIGINT), 'd': CAST([] AS STRUCT(a BIGINT, b BIGINT)[])}}),
    lambda a, x: CASE WHEN x.t - a.f > {size} AND a.t > a.f THEN {{'f': a.t, 't': x.t, 'd': list_append(a.d, {{'a': a.f, 'b': a.t}})}} ELSE {{'f': a.f, 't': x.t, 'd': a.d}} END) AS r FROM s WHERE n > {size}
), c AS (SELECT doc_id, text, n, list_append(r.d, {{'a': r.f, 'b': r.t}}) AS l FROM m UNION ALL SELECT doc_id, text, n, [{{'a': CAST(0 AS BIGINT), 'b': CAST(n AS BIGINT)}}] FROM s WHERE n <= {size}
), u AS (SELECT doc_id, text, n, unnest(range(0, len(l))) AS i, unnest(l) AS x FROM c
), b AS (SELECT doc_id, text, n, i, x.a AS cs, x.b AS ce, CASE WHEN i = 0 THEN x.a ELSE greatest(0, x.a - {overlap}) END AS sc, CASE WHEN x.b >= n THEN x.b ELSE least(n, x.b + {overlap}) END AS ec FROM u)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(text, sc + 1, ec - sc) AS text, CAST(cs AS INTEGER) AS core_start, CAST(ce AS INTEGER) AS core_end, CAST(sc AS INTEGER) AS start_char, CAST(ec AS INTEGER) AS end_char,
  CAST(cs - sc AS INTEGER) AS overlap_start, CAST(ec - ce AS INTEGER) AS overlap_end FROM b"""


@query("chunk_sentence", merge_sql(r"[.!?]+\s+", "documents", 2000, 200))
def _(spark, sf_dir):
    return chunk.chunks(docs(spark, sf_dir), "sentence", 2000, 200)


@query("chunk_paragraph", merge_sql(r"\n\s*\n", TALK, 1000, 100))
def _(spark, sf_dir):
    return chunk.chunks(talks(spark, sf_dir), "paragraph", 1000, 100)


@query("chunk_roundtrip", "SELECT doc_id, TRUE AS same FROM documents WHERE length(text) > 0")
def _(spark, sf_dir):
    d = docs(spark, sf_dir)
    parts = chunk.chunks(d, "sentence", 1000, 100).select("doc_id", "chunk_index", chunk.core_text().alias("text"))
    return d.select("doc_id", F.col("text").alias("original")).join(chunk.reassemble(parts), "doc_id").select("doc_id", (F.col("text") == F.col("original")).alias("same"))


@query("reassemble", f"SELECT doc_id AS conv_id, text FROM {TALK}")
def _(spark, sf_dir):
    return chunk.reassemble(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "\n\n")


@query("chunk_id", "SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR) || ':0:' || substr(text, 1, 64)), 1, 16) AS chunk_id FROM documents")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", chunk.chunk_id(F.col("doc_id"), F.lit(0), F.col("text")).alias("chunk_id"))


@query("est_tokens", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS estimated_tokens FROM documents")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", chunk.estimated_tokens(F.col("text")).alias("estimated_tokens"))


# ------------------------------------------------------------------ scores
COHERENCE_SQL = f"""SELECT doc_id, CASE WHEN len(s) < 2 THEN 1.0 WHEN len(o) = 0 THEN 0.7 ELSE least(1.0, 0.3 + list_sum(o) / len(o) * 2.3) END AS coherence FROM (
  SELECT doc_id, s, list_filter(list_transform(range(1, len(w)), lambda i: CASE WHEN len(w[i]) > 0 AND len(w[i + 1]) > 0
    THEN len(list_intersect(w[i], w[i + 1])) / CAST(len(w[i]) + len(w[i + 1]) - len(list_intersect(w[i], w[i + 1])) AS DOUBLE) END), lambda x: x IS NOT NULL) AS o FROM (
    SELECT doc_id, s, list_transform(s, lambda x: list_filter({LATIN.format(t="x")}, lambda y: NOT list_contains({lst(tx.FUNCTION_WORDS)}, y))) AS w FROM (SELECT doc_id, {SENTENCES.format(t="text")} AS s FROM documents)))"""


@query("coherence", f"SELECT doc_id, round(CAST(coherence AS DOUBLE), 6) AS coherence FROM ({COHERENCE_SQL})")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(tx.coherence(F.col("text")), 6).alias("coherence"))


def syllables_sql(w: str) -> str:
    n = f"len(regexp_extract_all(lower({w}), '[aeiouy]+'))"
    return f"greatest(1, {n} - CASE WHEN ends_with(lower({w}), 'e') AND {n} > 1 THEN 1 ELSE 0 END + CASE WHEN ends_with(lower({w}), 'le') AND length({w}) > 2 AND substr(lower({w}), -3, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'y') THEN 1 ELSE 0 END)"


FLUENCY_SQL = f"""SELECT doc_id, CASE WHEN nw = 0 OR ns = 0 THEN 0.0 ELSE greatest(0.3, greatest(0.0, greatest(0.0, least(1.0, (206.835 - 1.015 * (nw / ns) - 84.6 * (sy / nw)) / 100.0))
  - CASE WHEN nw / ns > 50 THEN least(0.3, (nw / ns - 50) / 100.0) WHEN nw / ns < 5 THEN 0.2 ELSE 0.0 END)) END AS fluency FROM (
  SELECT doc_id, CAST(len(w) AS DOUBLE) AS nw, CAST(len(s) AS DOUBLE) AS ns, CAST(list_sum(list_transform(w, lambda x: {syllables_sql("x")})) AS DOUBLE) AS sy
  FROM (SELECT doc_id, {WORDS.format(t="text")} AS w, {SENTENCES.format(t="text")} AS s FROM documents))"""


@query("fluency", f"SELECT doc_id, round(CAST(fluency AS DOUBLE), 6) AS fluency FROM ({FLUENCY_SQL})")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(tx.fluency(F.col("text")), 6).alias("fluency"))


@query("syllables", f"SELECT p_partkey, CAST(list_sum(list_transform({WORDS.format(t='p_name')}, lambda x: {syllables_sql('x')})) AS INTEGER) AS syllables FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.aggregate(tx.words(F.col("p_name")), F.lit(0), lambda a, x: a + tx.syllables(x)).alias("syllables"))


DOMAIN_TEXT = "text || CASE doc_id % 3 WHEN 0 THEN ' breach of liability' WHEN 1 THEN ' Patient dosage' ELSE '' END"


@query("domain_quality", f"""SELECT doc_id, {", ".join(f"round(CAST(CASE WHEN len(w) = 0 THEN 0.0 ELSE greatest(0.3, least(1.0, len(list_filter(w, lambda x: list_contains({lst(v)}, x))) / CAST(len(w) AS DOUBLE) / 0.01)) END AS DOUBLE), 6) AS {k}" for k, v in tx.DOMAIN_TERMS.items() if v)}
FROM (SELECT doc_id, {WORDS.format(t=f"lower({DOMAIN_TEXT})")} AS w FROM documents)""")  # fmt: skip
def _(spark, sf_dir):
    k = F.col("doc_id") % 3
    t = F.concat("text", F.when(k == 0, " breach of liability").when(k == 1, " Patient dosage").otherwise(""))
    return docs(spark, sf_dir).select("doc_id", *[F.round(tx.domain_quality(t, d), 6).alias(d) for d, v in tx.DOMAIN_TERMS.items() if v])


@query("perplexity", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents
), b AS (SELECT doc_id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM w WHERE len(w) >= 3
), c2 AS (SELECT doc_id, a, b, count(*) AS n FROM b GROUP BY ALL), c1 AS (SELECT doc_id, a, sum(n) AS n FROM c2 GROUP BY ALL), v AS (SELECT doc_id, count(*) AS v FROM c1 GROUP BY ALL
), p AS (SELECT doc_id, least(1000.0, exp(-sum(c2.n * ln((c2.n + 1.0) / (c1.n + v))) / sum(c2.n))) AS p FROM c2 JOIN c1 USING (doc_id, a) JOIN v USING (doc_id) GROUP BY doc_id)
SELECT doc_id, round(CAST(coalesce(p, 50.0) AS DOUBLE), 4) AS perplexity FROM documents LEFT JOIN p USING (doc_id)""")  # fmt: skip
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(tx.perplexity(F.col("text")), 4).alias("perplexity"))


@query("text_stats", f"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS words, CAST(len({SENTENCES.format(t="text")}) AS INTEGER) AS sentences FROM documents""")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(tx.tokens(F.col("text"))).alias("words"), F.size(chunk.sentences(F.col("text"))).alias("sentences"))


DOT = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))"


def vector_pairs(spark, sf_dir):
    """Each vector beside the next one."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")


@query("cosine_pairs", f"SELECT a.vec_id, round(greatest(0.0, least(1.0, {DOT})), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf_dir):
    return vector_pairs(spark, sf_dir).select("vec_id", F.round(tx.similarity(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@query("quality_gate", f"SELECT a.vec_id FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE greatest(0.0, least(1.0, {DOT})) >= 0.1")
def _(spark, sf_dir):
    return score.gate(vector_pairs(spark, sf_dir), "embedding", "next", 0.1).select("vec_id")


@query("quality_report", f"""WITH c AS ({COHERENCE_SQL}), f AS ({FLUENCY_SQL}), s AS (SELECT a.vec_id AS doc_id, greatest(0.0, least(1.0, {DOT})) AS semantic FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT doc_id, round(CAST(semantic AS DOUBLE), 6) AS semantic, round(CAST(0.40 * semantic + 0.25 * coherence + 0.20 * fluency + 0.15 * 0.75 AS DOUBLE), 6) AS overall, semantic >= 0.65 AND coherence >= 0.60 AND fluency >= 0.55 AS passes
FROM documents JOIN s USING (doc_id) JOIN c USING (doc_id) JOIN f USING (doc_id)""")  # fmt: skip
def _(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text").join(vector_pairs(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return score.quality_report(d, "general", "text", "embedding", "next").select("doc_id", F.round("semantic", 6).alias("semantic"), F.round("overall", 6).alias("overall"), "passes")


@query("style_profile", f"""WITH w AS (SELECT doc_id, {WORDS.format(t="lower(text)")} AS w, {SENTENCES.format(t="text")} AS s FROM documents), m AS (
  SELECT doc_id, list(x ORDER BY n DESC, x)[1:5] AS domain_markers FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM w) WHERE length(x) >= 5 GROUP BY ALL) GROUP BY doc_id
), f AS (SELECT doc_id, round(len(w) / CAST(greatest(1, len(s)) AS DOUBLE), 6) AS avg_sentence_length, CASE WHEN len(w) = 0 THEN 0.5 ELSE len(list_filter(w, lambda x: length(x) >= 7)) / CAST(len(w) AS DOUBLE) END AS fs FROM w)
SELECT doc_id, avg_sentence_length, round(fs, 6) AS formality_score, array_to_string(coalesce(domain_markers, []), ' ') AS domain_markers, CASE WHEN fs >= 0.4 THEN 'formal' WHEN fs <= 0.15 THEN 'casual' ELSE 'neutral' END AS tone
FROM f LEFT JOIN m USING (doc_id)""")  # fmt: skip
def _(spark, sf_dir):
    return score.style_profile(docs(spark, sf_dir)).select("doc_id", F.round("avg_sentence_length", 6).alias("avg_sentence_length"), F.round("formality_score", 6).alias("formality_score"), F.array_join("domain_markers", " ").alias("domain_markers"), "tone")


@query("lang_detect", f"""WITH w AS (SELECT doc_id, lang, {WORDS.format(t="lower(text)")} AS w FROM documents), s AS (
  SELECT doc_id, lang, {", ".join(f"len(list_filter(w, lambda x: list_contains({lst(v)}, x))) AS {k}" for k, v in tx.STOP_WORDS.items())} FROM w)
SELECT doc_id, CASE greatest({", ".join(tx.STOP_WORDS)}) {" ".join(f"WHEN {k} THEN '{k}'" for k in tx.STOP_WORDS)} END AS detected FROM s""")  # fmt: skip
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.detect_language(F.col("text")).alias("detected"))
