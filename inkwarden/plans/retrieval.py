"""Queries of retrieval and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.recognizers import REGISTRY, Recognizer
from ..functions.spans import exploded, shadow
from ..operators import chunk, detect, evaluate, retrieve, similarity
from .privacy import docs, known, spans_sql
from ..sources import files
from .registry import query, table
from .scoring import LATIN, WORDS

KEYWORDS_SQL = f"""WITH a AS (SELECT item_id, {LATIN.format(t="text")} AS w FROM benchmark), b AS (SELECT doc_id, {LATIN.format(t="text")} AS w FROM documents), s AS (
  SELECT item_id, doc_id, count(*) / CAST(any_value(na) + any_value(nb) - count(*) AS DOUBLE) AS score FROM (SELECT item_id, len(w) AS na, unnest(w) AS w FROM a) JOIN (SELECT doc_id, len(w) AS nb, unnest(w) AS w FROM b) USING (w) GROUP BY item_id, doc_id
)"""


#: Chunks of a whole corpus: sentences with the sums of their lengths, then one recursion step per chunk. A chunk ends before the sentence
#: that would exceed 2048 characters; the next one begins with its closing sentences of at most 256 characters together.
CHUNKS_SQL = r"""WITH RECURSIVE sent AS (
  SELECT doc_id, source, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0) AS ls FROM documents
), each_sentence AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM sent
), sums AS (SELECT doc_id, list(total ORDER BY i) AS total FROM (SELECT doc_id, i, CAST(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS total FROM each_sentence) GROUP BY doc_id
), pre AS (SELECT doc_id, source, ls, len(ls) AS m, list_prepend(0, total) AS pre FROM sent JOIN sums USING (doc_id)
), cuts AS (
  SELECT doc_id, 0 AS idx, 0 AS a, greatest(0, len(list_filter(pre, lambda x: x <= 2048)) - 2) AS b FROM pre
  UNION ALL
  SELECT doc_id, idx + 1, f, greatest(i, len(list_filter(pre, lambda x: x - pre[f + 1] <= 2048)) - 2) FROM (
    SELECT c.doc_id, c.idx, c.b + 1 AS i, c.b + 1 - len(list_filter(range(c.a, c.b + 1), lambda j: p.pre[c.b + 2] - p.pre[j + 1] <= 256)) AS f, p.pre AS pre
    FROM cuts c JOIN pre p ON p.doc_id = c.doc_id WHERE c.b + 1 < p.m)
), chunk_texts AS (SELECT c.doc_id AS source_id, source AS source_name, idx, array_to_string(ls[a + 1:b + 1], ' ') AS text FROM cuts c JOIN pre p ON p.doc_id = c.doc_id
), chunks AS (
  SELECT substr(sha256(CAST(source_id AS VARCHAR) || ':' || idx || ':' || substr(text, 1, 64)), 1, 16) AS chunk_id, source_id, source_name, CAST(idx AS INTEGER) AS chunk_index, text,
    CAST(greatest(1, length(text) // 4) AS INTEGER) AS estimated_tokens FROM chunk_texts
)"""


def passages(spark, sf_dir):
    """The documents' retrieval chunks."""
    return chunk.retrieval_chunks(docs(spark, sf_dir), name_col="source")


@query("ctx_chunk", CHUNKS_SQL + " SELECT chunk_id, source_id, source_name, chunk_index, text, estimated_tokens FROM chunks")
def _(spark, sf_dir):
    return passages(spark, sf_dir)


def items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("keyword_rank", KEYWORDS_SQL + "SELECT item_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def _(spark, sf_dir):
    scores = retrieve.keyword_scores(table(spark, sf_dir, "benchmark"), docs(spark, sf_dir), "item_id", "doc_id")
    return retrieve.top_k(scores, "item_id", "doc_id", 10).withColumn("score", F.round("score", 6))


#: All chunks of each query's ranking, chunks without a common word included.
RANKED_SQL = CHUNKS_SQL + f""", q AS (SELECT item_id AS query_id, {LATIN.format(t="text")} AS w FROM benchmark), k AS (SELECT *, {LATIN.format(t="text")} AS w FROM chunks
), same AS (
  SELECT query_id, source_id, chunk_index, count(*) AS n FROM (SELECT query_id, unnest(w) AS w FROM q) JOIN (SELECT source_id, chunk_index, unnest(w) AS w FROM k) USING (w) GROUP BY ALL
), r AS (
  SELECT query_id, k.*, coalesce(n / CAST(len(q.w) + len(k.w) - n AS DOUBLE), 0.0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(n / CAST(len(q.w) + len(k.w) - n AS DOUBLE), 0.0) DESC, source_id, chunk_index) AS rank
  FROM q CROSS JOIN k LEFT JOIN same USING (query_id, source_id, chunk_index)
)"""


@query("ctx_rank", RANKED_SQL + " SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM r WHERE score > 0 AND rank <= 5")
def _(spark, sf_dir):
    parts = passages(spark, sf_dir).withColumn("place", F.struct("source_id", "chunk_index", "chunk_id"))
    return retrieve.keyword_top_k(items(spark, sf_dir), parts, "query_id", "place", 5).select("query_id", "place.chunk_id", "rank")


VEC_DOT = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(v.embedding[i] AS DOUBLE)))"


@query("vec_topk", f"""SELECT q.vec_id AS query_id, v.vec_id, round(greatest(0.0, {VEC_DOT}), 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY greatest(0.0, {VEC_DOT}) DESC, v.vec_id) AS INTEGER) AS rank
FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 QUALIFY rank <= 10""")  # fmt: skip
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.vector_top_k(q, e, "query_id", "vec_id", 10).withColumn("score", F.round("score", 6))


DEDUP_SQL = RANKED_SQL + """, l AS (
  SELECT query_id, list({'rank': rank, 'id': chunk_id, 'sid': source_id, 'at': chunk_index, 'w': w} ORDER BY rank) AS l FROM r GROUP BY query_id
), u AS (
  SELECT query_id, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(a) >= 10 OR len(list_filter(a, lambda y: y.id = x[1].id OR (len(y.w) > 0 AND len(x[1].w) > 0 AND
    len(list_intersect(y.w, x[1].w)) / CAST(len(y.w) + len(x[1].w) - len(list_intersect(y.w, x[1].w)) AS DOUBLE) >= 0.85))) > 0 THEN a ELSE list_concat(a, x) END) AS u FROM l
), uniques AS (
  SELECT x.query_id, x.position, r.source_id AS sid, r.chunk_id AS id, r.source_name AS src, r.score, CAST(r.estimated_tokens AS BIGINT) AS tokens, r.text
  FROM (SELECT query_id, unnest(u).rank AS rank, unnest(range(1, len(u) + 1)) AS position FROM u) x JOIN r ON r.query_id = x.query_id AND r.rank = x.rank
)"""  # fmt: skip


@query("dedup_greedy", DEDUP_SQL + " SELECT query_id, id AS chunk_id, CAST(position AS INTEGER) AS position FROM uniques")
def _(spark, sf_dir):
    return retrieve.first_unique(items(spark, sf_dir), passages(spark, sf_dir), 10, "query_id").select("query_id", "chunk_id", "position")


TAKEN_SQL = DEDUP_SQL + """, t AS (
  SELECT query_id, list_reduce(list_transform(l, lambda x: {'n': CAST(CASE WHEN x.tokens <= 2048 THEN 1 ELSE 0 END AS BIGINT), 'tok': CAST(CASE WHEN x.tokens <= 2048 THEN x.tokens ELSE 0 END AS BIGINT), 'all': x.tokens, 'o': CASE WHEN x.tokens <= 2048 THEN [x] ELSE [] END, 'x': [x]}),
    lambda a, b: CASE WHEN a.n < 5 AND a.tok + b.all <= 2048 THEN {'n': a.n + 1, 'tok': a.tok + b.all, 'all': a.all, 'o': list_concat(a.o, b.x), 'x': a.x} ELSE a END) AS t
  FROM (SELECT query_id, list({'tokens': tokens, 'sid': sid, 'src': src, 'score': score, 'text': text} ORDER BY position) AS l FROM uniques GROUP BY query_id)
)"""


def assembled(spark, sf_dir):
    return retrieve.assemble(items(spark, sf_dir), passages(spark, sf_dir), 5)


@query("ctx_assemble", TAKEN_SQL + "SELECT i.item_id AS query_id, CAST(coalesce(t.tok, 0) AS INTEGER) AS total_tokens, CAST(coalesce(t.n, 0) AS INTEGER) AS chunks_used, CAST((SELECT count(*) FROM chunks) AS INTEGER) AS chunks_available FROM benchmark i LEFT JOIN t ON query_id = item_id")
def _(spark, sf_dir):
    return assembled(spark, sf_dir).select("query_id", "total_tokens", "chunks_used", "chunks_available")


@query("ctx_format", TAKEN_SQL + """SELECT i.item_id AS query_id, coalesce(array_to_string(list_transform(range(1, len(t.o) + 1), lambda i: '[Source ' || i || ': ' || t.o[i].src || ']' || chr(10) || t.o[i].text), chr(10) || chr(10) || '---' || chr(10) || chr(10)), '') AS context_text
FROM benchmark i LEFT JOIN t ON query_id = item_id""")  # fmt: skip
def _(spark, sf_dir):
    return assembled(spark, sf_dir).select("query_id", "context_text")


@query("ctx_attribution", TAKEN_SQL + """, e AS (SELECT query_id, unnest(t.o).sid AS source_id, unnest(t.o).src AS source_name, unnest(t.o).score AS score, unnest(range(0, len(t.o))) AS pos FROM t)
SELECT query_id, source_id, source_name, round(score, 4) AS relevance_score FROM e QUALIFY row_number() OVER (PARTITION BY query_id, source_id ORDER BY pos) = 1""")  # fmt: skip
def _(spark, sf_dir):
    return assembled(spark, sf_dir).select("query_id", F.explode("attributions").alias("a")).select("query_id", "a.*")


# ------------------------------------------------------------------ alike word sets of the whole corpus
ALIKE_SQL = f"""WITH s AS (SELECT doc_id, list_sort({LATIN.format(t="text")}) AS w FROM documents), c AS (
  SELECT doc_id, w, min(doc_id) OVER (PARTITION BY w) AS class_id, count(*) OVER (PARTITION BY w) AS class_size FROM s WHERE len(w) > 0
), words AS (SELECT x, row_number() OVER () AS x_no FROM (SELECT DISTINCT unnest(w) AS x FROM c)
), f AS (SELECT doc_id, n, x_no FROM (SELECT doc_id, len(w) AS n, unnest(w) AS x FROM c WHERE doc_id = class_id) JOIN words USING (x)
), n AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, a.n + b.n - count(*) AS u FROM f a JOIN f b ON a.x_no = b.x_no AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n
), links AS (SELECT a, b, shared, shared / CAST(u AS DOUBLE) AS similarity FROM n WHERE 100 * shared >= 85 * u)"""


def alike(spark, sf_dir):
    return similarity.near_dup_links(docs(spark, sf_dir), "doc_id")


@query("near_dup_pairs", ALIKE_SQL + " SELECT a, b, CAST(shared AS INTEGER) AS shared, round(similarity, 6) AS similarity FROM links")
def _(spark, sf_dir):
    return alike(spark, sf_dir)[1].withColumn("similarity", F.round("similarity", 6))


@query("near_dup_classes", ALIKE_SQL + ", e AS (SELECT x, count(*) AS links FROM (SELECT a AS x FROM links UNION ALL SELECT b FROM links) GROUP BY x) SELECT doc_id AS id, class_id, CAST(class_size AS BIGINT) AS class_size, CAST(coalesce(links, 0) AS BIGINT) AS links FROM c LEFT JOIN e ON x = class_id")
def _(spark, sf_dir):
    return similarity.link_counts(*alike(spark, sf_dir))


# ------------------------------------------------------------------ evaluation: checked cards against all 16-digit runs, e-mails against a looser pattern
TRUTH = [Recognizer("CREDIT_CARD", r"\b[0-9]{16}\b", 0.9), Recognizer("EMAIL_ADDRESS", r"\b[A-Za-z0-9._]+@[A-Za-z0-9.]+\b", 0.9)]
FOUND_SQL = f"SELECT s.*, source AS domain FROM ({spans_sql('documents', *known('CREDIT_CARD', 'EMAIL_ADDRESS', 'IP_ADDRESS'))}) s JOIN documents USING (doc_id)"
TRUTH_SQL = f"SELECT s.*, source AS domain FROM ({spans_sql('documents', *[(r.entity_type, r.pattern, r.score, '') for r in TRUTH])}) s JOIN documents USING (doc_id)"


def _spans(spark, sf_dir, recognizers):
    d = docs(spark, sf_dir).select("doc_id", F.col("source").alias("domain"), "text")
    with_all = detect.with_spans(d, [r.entity_type for r in recognizers if r is REGISTRY.get(r.entity_type)], extra=None) if all(r is REGISTRY.get(r.entity_type) for r in recognizers) else None
    if with_all is None:
        with_all = d.withColumn("__seen", shadow(F.col("text"))).withColumn("spans", detect.spans_column(F.col("text"), F.col("__seen"), recognizers))
    return exploded(with_all, "spans", "doc_id", "domain").select("doc_id", "domain", "s.*")


def found_and_truth(spark, sf_dir):
    return _spans(spark, sf_dir, [REGISTRY[t] for t in ("CREDIT_CARD", "EMAIL_ADDRESS", "IP_ADDRESS")]), _spans(spark, sf_dir, TRUTH)


def corpus(spark, sf_dir):
    """The documents with their found spans, written as a labelled JSON corpus and read back."""
    d = detect.with_spans(docs(spark, sf_dir).select("doc_id", F.col("source").alias("domain"), "text"), ["EMAIL_ADDRESS", "IP_ADDRESS"])
    entities = F.transform("spans", lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end")))
    path = files.scratch(spark, "corpus")
    files.write_corpus(d.select("domain", "text", entities.alias("entities")), path)
    return files.partitioned_corpus(spark, path)


CORPUS_SQL = f"(SELECT source AS domain, text, coalesce(n, 0) AS n FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({spans_sql('documents', *known('EMAIL_ADDRESS', 'IP_ADDRESS'))}) GROUP BY doc_id) USING (doc_id))"


@query("corpus_scan", f"SELECT domain, text, CAST(n AS INTEGER) AS entities FROM {CORPUS_SQL}")
def _(spark, sf_dir):
    return corpus(spark, sf_dir).select("domain", "text", F.size("entities").alias("entities"))


@query("corpus_by_domain", f"SELECT d AS domain, CAST(coalesce(count(n), 0) AS BIGINT) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS entities FROM (SELECT unnest(['src0', 'src1', 'missing']) AS d) LEFT JOIN {CORPUS_SQL} ON domain = d GROUP BY d")
def _(spark, sf_dir):
    return files.by_domain(corpus(spark, sf_dir), ["src0", "src1", "missing"])


def confusion_sql(by: str) -> str:
    return f"""SELECT {by}, CAST(sum(CASE WHEN f AND t THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN f AND NOT t THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN t AND NOT f THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM (
  SELECT doc_id, domain, entity_type, "start", "end", bool_or(f) AS f, bool_or(t) AS t FROM (SELECT doc_id, domain, entity_type, "start", "end", TRUE AS f, FALSE AS t FROM ({FOUND_SQL}) UNION ALL SELECT doc_id, domain, entity_type, "start", "end", FALSE, TRUE FROM ({TRUTH_SQL})) GROUP BY ALL) GROUP BY {by}"""


SCORES_SQL = """SELECT *, CASE WHEN "precision" + recall = 0 THEN 0.0 ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1 FROM (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS "precision", CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall FROM ({c}))"""


@query("span_confusion", confusion_sql("doc_id, entity_type"))
def _(spark, sf_dir):
    return evaluate.span_confusion(*found_and_truth(spark, sf_dir), ["doc_id", "entity_type"])


@query("eval_by_type", confusion_sql("entity_type"))
def _(spark, sf_dir):
    return evaluate.span_confusion(*found_and_truth(spark, sf_dir), ["entity_type"])


ROUNDED = 'round(CAST("precision" AS DOUBLE), 6) AS "precision", round(CAST(recall AS DOUBLE), 6) AS recall, round(CAST(f1 AS DOUBLE), 6) AS f1'


def rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("prf", f"SELECT entity_type, {ROUNDED} FROM ({SCORES_SQL.format(c=confusion_sql('entity_type'))})")
def _(spark, sf_dir):
    return rounded(evaluate.with_scores(evaluate.span_confusion(*found_and_truth(spark, sf_dir), ["entity_type"])), "entity_type")


@query("eval_macro", f"SELECT domain, round(avg(\"precision\"), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1 FROM ({SCORES_SQL.format(c=confusion_sql('domain, entity_type'))}) GROUP BY domain")
def _(spark, sf_dir):
    return evaluate.macro(evaluate.span_confusion(*found_and_truth(spark, sf_dir), ["domain", "entity_type"]))


@query("top_f1", f"SELECT domain, entity_type, round(CAST(f1 AS DOUBLE), 6) AS f1 FROM ({SCORES_SQL.format(c=confusion_sql('domain, entity_type'))}) ORDER BY f1 DESC, domain, entity_type LIMIT 10")
def _(spark, sf_dir):
    scores = evaluate.with_scores(evaluate.span_confusion(*found_and_truth(spark, sf_dir), ["domain", "entity_type"]))
    return scores.orderBy(F.desc("f1"), "domain", "entity_type").limit(10).select("domain", "entity_type", F.round("f1", 6).alias("f1"))


@query("eval_rollup", f"""SELECT domain, entity_type, {ROUNDED} FROM ({SCORES_SQL.format(c=f"SELECT domain, entity_type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM ({confusion_sql('domain, entity_type')}) GROUP BY ROLLUP (domain, entity_type)")})""")
def _(spark, sf_dir):
    return rounded(evaluate.rollup(*found_and_truth(spark, sf_dir)), "domain", "entity_type")


@query("lexical_bertscore", f"""WITH t AS (SELECT doc_id, unnest({WORDS.format(t="lower(text)")}) AS w FROM documents), d AS (SELECT DISTINCT doc_id, w FROM t), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id
), b AS (SELECT t.doc_id - 1 AS doc_id, count(*) AS c FROM t JOIN d ON d.doc_id = t.doc_id - 1 AND d.w = t.w GROUP BY ALL), a AS (SELECT t.doc_id, count(*) AS c FROM t JOIN d ON d.doc_id = t.doc_id + 1 AND d.w = t.w GROUP BY ALL
), s AS (SELECT x.doc_id, coalesce(b.c / CAST(nb.n AS DOUBLE), 0.0) AS p, coalesce(a.c / CAST(na.n AS DOUBLE), 0.0) AS r FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1
  LEFT JOIN n na ON na.doc_id = x.doc_id LEFT JOIN n nb ON nb.doc_id = y.doc_id LEFT JOIN a ON a.doc_id = x.doc_id LEFT JOIN b ON b.doc_id = x.doc_id)
SELECT doc_id, round(CAST(p AS DOUBLE), 6) AS "precision", round(CAST(r AS DOUBLE), 6) AS recall, round(CAST(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS DOUBLE), 6) AS f1 FROM s""")
def _(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.col("text").alias("original"))
    pairs = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("original").alias("synthesized")), "doc_id")
    return rounded(evaluate.lexical_score(pairs), "doc_id")


CHECKPOINTS_SQL = "(SELECT user_id % 50 AS job_id, event_id AS ord, event_id AS step, CASE WHEN event_type = 'click' THEN NULL ELSE round(value, 2) END AS eval_loss FROM events)"


def checkpoints(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 50).alias("job_id"), F.col("event_id").alias("ord"), F.col("event_id").alias("step"), F.when(F.col("event_type") != "click", F.round("value", 2)).alias("eval_loss"))


@query("best_checkpoint", f"SELECT job_id, coalesce(min_by(step, (eval_loss, ord)) FILTER (eval_loss <> 0), max_by(step, ord)) AS best_step FROM {CHECKPOINTS_SQL} GROUP BY job_id")
def _(spark, sf_dir):
    return evaluate.best_checkpoint(checkpoints(spark, sf_dir))


@query("checkpoint_is_best", f"""WITH b AS (SELECT *, coalesce(eval_loss IS NOT NULL AND (least IS NULL OR eval_loss < least), FALSE) AS was_best FROM (SELECT *, min(eval_loss) OVER (PARTITION BY job_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM {CHECKPOINTS_SQL}))
SELECT job_id, step, was_best, was_best AND ord = max(CASE WHEN was_best THEN ord END) OVER (PARTITION BY job_id) AS is_best FROM b""")  # fmt: skip
def _(spark, sf_dir):
    return evaluate.flag_best(checkpoints(spark, sf_dir)).select("job_id", "step", "was_best", "is_best")


@query("list_checkpoints", f"SELECT job_id, list(step ORDER BY step) AS steps FROM {CHECKPOINTS_SQL} GROUP BY job_id")
def _(spark, sf_dir):
    return checkpoints(spark, sf_dir).groupBy("job_id").agg(F.array_sort(F.collect_list("step")).alias("steps"))


@query("batch_totals", """SELECT user_id % 20 AS job_id, CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS completed, count(*) AS documents, CAST(coalesce(sum(CASE WHEN event_type <> 'view' THEN CAST(floor(value) AS BIGINT) END), 0) AS BIGINT) AS found, CAST(coalesce(sum(CAST(floor(value / 2) AS BIGINT)), 0) AS BIGINT) AS replaced FROM events GROUP BY user_id % 20""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") % 20).alias("job_id"), F.when(F.col("event_type") != "error", "completed").otherwise("failed").alias("status"), F.when(F.col("event_type") != "view", F.floor("value").cast("bigint")).alias("found"), F.floor(F.col("value") / 2).cast("bigint").alias("replaced"))
    return evaluate.batch_totals(rows)


