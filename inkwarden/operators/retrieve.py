"""Retrieval: ranking, deduplication, budgets and context assembly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import jaccard, latin_words, let
from ..sources.files import stored

DEDUP_AT = 0.85
DEFAULT_BUDGET = 2048
MOST_QUERIES = 10_000
MOST_WORDS = 1_000_000
#: Vectors of one cell (`best_in_cells`).
MOST_VECTORS = 16_384


def budget_or_default(budget: Column, default: int = DEFAULT_BUDGET) -> Column:
    """A missing or zero budget means the default."""
    return F.coalesce(F.nullif(budget, F.lit(0)), F.lit(default))


def _blocks(queries: DataFrame, query_id: str, rows: int, most: int) -> list[DataFrame]:
    """The queries in blocks, so that what is broadcast of one (`rows` in all) stays within about `most` rows."""
    n = max(1, -(-rows // most))
    return [queries] if n == 1 else [queries.filter(F.pmod(F.xxhash64(query_id), F.lit(n)) == i) for i in range(n)]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _overlaps(a: DataFrame, b: DataFrame, query_id: str, keys: list[str], most_words: int) -> DataFrame:
    """(query, keys, score) of query words `a` (query, na, w) and the word arrays of `b` (keys, words), for all that share a word.

    Word arrays are dealt by their first key once; a block of the queries' words is broadcast, and all words of a key are counted
    in the task that has them. So no word is a join key in a shuffle, however many texts hold it, and pairs are never sent.
    """
    b = b.select(*keys, F.size("words").alias("nb"), "words").repartition(keys[0]).select(*keys, "nb", F.explode("words").alias("w"))

    def block(part):
        both = b.join(F.broadcast(part), "w").groupBy(query_id, *keys, "na", "nb").agg(F.count(F.lit(1)).alias("same"))
        return both.select(query_id, *keys, (F.col("same") / (F.col("na") + F.col("nb") - F.col("same"))).alias("score"))

    return _union([block(p) for p in _blocks(a, query_id, a.count(), most_words)])


def query_words(queries: DataFrame, query_id: str, text_col: str = "text") -> DataFrame:
    a = queries.select(query_id, latin_words(F.col(text_col)).alias("w"))
    return a.select(query_id, F.size("w").alias("na"), F.explode("w").alias("w"))


def keyword_scores(queries: DataFrame, chunks: DataFrame, query_id: str, chunk_id: str, text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """(query, chunk, score) for every pair with a word in common: Jaccard of their latin word sets by an inverted index of the queries."""
    b = chunks.select(chunk_id, latin_words(F.col(text_col)).alias("words"))
    return _overlaps(query_words(queries, query_id, text_col), b, query_id, [chunk_id], most_words)


class _Best:
    """The k best rows of each query that a task has met: score downwards, then the key; beyond a query's place (at, after)."""

    def __init__(self, queries: list, vocabulary: pa.Array, k: int, with_zero: bool):
        self.k, self.vocabulary, self.with_zero = k, vocabulary, with_zero
        self.size = np.array([len(q["w"]) for q in queries])
        self.at = np.array([np.inf if q["at"] is None else q["at"] for q in queries])
        self.after = [None if q["after"] is None else self.key(q["after"].asDict()) for q in queries]
        number = np.repeat(np.arange(len(queries)), self.size)
        code = pc.index_in(pa.array([w for q in queries for w in q["w"]], pa.string()), vocabulary).to_numpy().astype(np.int64)
        order = np.argsort(code, kind="stable")
        self.holders, self.ends = number[order], np.cumsum(np.bincount(code, minlength=len(vocabulary)))
        self.kept: list[list] = [[] for _ in queries]
        self.least = np.zeros(len(queries)) if with_zero else np.full(len(queries), 5e-324)

    @staticmethod
    def key(first: dict) -> tuple:
        return tuple((x is not None, x) for x in first.values())

    def cut(self, q: int) -> None:
        kept = self.kept[q]
        if len(kept) >= self.k:
            kept.sort(key=lambda x: x[:2])
            del kept[self.k :]
            self.least[q] = -kept[-1][0]

    def add(self, batch: pa.RecordBatch) -> None:
        """Scores of a batch (others, first, words): words shared with each query by an inverted index of the queries."""
        n = len(self.size)
        step = max(1, 200_000 // n)
        for begin in range(0, batch.num_rows, step):
            rows = batch.slice(begin, step)
            words = rows.column(rows.num_columns - 1)
            size = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            code = pc.fill_null(pc.index_in(words.flatten(), self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)[code >= 0]
            code = code[code >= 0]
            first = np.concatenate([[0], self.ends])[code]
            count = self.ends[code] - first
            holder = self.holders[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            same = np.bincount(np.repeat(row, count) * n + holder, minlength=len(size) * n).reshape(len(size), n)
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.where(same > 0, same / (self.size + size[:, None] - same), 0.0)
            wanted = (score <= self.at) & (score >= self.least) & ((same == 0) if self.with_zero else (same > 0))
            self.take(rows, score, wanted)

    def take(self, rows: pa.RecordBatch, score: np.ndarray, wanted: np.ndarray) -> None:
        firsts, keys = rows.column(rows.num_columns - 2), {}
        for r, q in np.argwhere(wanted).tolist():
            x = score[r, q]
            if x < self.least[q]:
                continue
            if r not in keys:
                value = firsts[r].as_py()
                keys[r] = (self.key(value), value, [c[r].as_py() for c in rows.columns[:-2]])
            key, value, others = keys[r]
            if x == self.at[q] and self.after[q] is not None and key <= self.after[q]:
                continue
            kept = self.kept[q]
            if len(kept) == self.k and x == self.least[q] and key >= kept[-1][1]:
                continue
            kept.append((-x, key, value, others))
            if len(kept) == self.k or len(kept) >= 2 * self.k:
                self.cut(q)


def best_overlaps(asked: DataFrame, held: DataFrame, query_id: str, k: int, most_words: int = MOST_WORDS, with_zero: bool = False) -> DataFrame:
    """(query, others, first, score): of each task, the k best rows of `held` (others, first, words) for each query of `asked`
    (query, w, and a place `at`, `after` beyond which to look, or null).

    The score is the Jaccard similarity of the word arrays, of rows that share a word, or with `with_zero` of those that share none;
    ties go to the smaller `first`. A block of the queries' words is sent to the tasks, which read `held` where it lies: neither
    words nor pairs are rows, and what a task holds is k rows for each query of the block.
    """
    words = asked.agg(F.coalesce(F.sum(F.size("w") + 1), F.lit(0))).first()[0]
    kept = held.schema.fields[:-1]
    schema = T.StructType([asked.schema[query_id], *kept, T.StructField("score", T.DoubleType())])
    context = held.sparkSession.sparkContext

    def block(part: DataFrame) -> DataFrame:
        rows = part.select(query_id, "w", "at", "after").collect()
        sent = context.broadcast((rows, sorted({w for r in rows for w in r["w"]})))
        kinds = [to_arrow_type(f.dataType) for f in schema.fields]

        def run(batches):
            rows, vocabulary = sent.value
            best = _Best(rows, pa.array(vocabulary, pa.string()), k, with_zero) if rows else None
            for batch in batches:
                if best:
                    best.add(batch)
            out = []
            for q, row in enumerate(rows):
                best.cut(q)
                out += [(row[query_id], *others, value, -x) for x, _, value, others in best.kept[q]]
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=schema.names)

        return held.mapInArrow(run, schema)

    return _union([block(p) for p in _blocks(asked, query_id, words, most_words)])


def keyword_top_k(queries: DataFrame, chunks: DataFrame, query_id: str, chunk_id: str, k: int, text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """(query, chunk, score, rank): the k best of `keyword_scores`; `chunk_id` names a struct. No pairs are made but those a task keeps (`best_overlaps`)."""
    none = F.lit(None).cast(chunks.schema[chunk_id].dataType)
    asked = queries.select(query_id, latin_words(F.coalesce(text_col, F.lit(""))).alias("w"), F.lit(None).cast("double").alias("at"), none.alias("after"))
    held = chunks.select(chunk_id, latin_words(F.coalesce(text_col, F.lit(""))).alias("words"))
    return top_k(best_overlaps(asked, held, query_id, k, most_words), query_id, chunk_id, k)


def top_k(scores: DataFrame, query_id: str, chunk_id: str, k: int) -> DataFrame:
    """The k best of each query; ties go to the smaller chunk id. The rank limit is applied before the shuffle too."""
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), chunk_id)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of doubles filled up to `dims`, lengths); null vectors, and those with a missing number, are rows of zeros of length -1."""
    arrays = column.combine_chunks()
    n = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out, row = np.zeros((len(n), dims)), np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = arrays.flatten().to_numpy(zero_copy_only=False).astype(float)
    bad = np.isnan(out).any(axis=1) | pc.is_null(arrays).to_numpy(zero_copy_only=False)
    out[bad], n[bad] = 0, -1
    return out, n


def _dots(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Dots of the rows of two matrices, number by number from the first, as `functions.text.dot` adds them."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += q[:, i] * v[:, i]
    return out


def _best_of_cell(asked: pa.Table, held: pa.Table, k: int, at_least: float | None) -> list[pa.Array]:
    """(query ids, vector ids, scores): the k best of a cell's vectors for each of its queries.

    A matrix product of blocks gives the scores but for rounding. What it leaves within that rounding of the k-th is scored again
    in the order of `_dots`, so equal vectors have equal scores and ties go to the smaller id. Equal vectors are scored once.
    """
    asked, held = asked.select(asked.column_names[-2:]), held.select(held.column_names[-2:])
    held = held.take(pc.sort_indices(held, [(held.column_names[0], "ascending")], null_placement="at_start"))
    dims = max([0, *(pc.max(pc.list_value_length(t.column(1))).as_py() or 0 for t in (asked, held))])
    (q, nq), (v, nv) = _matrix(asked.column(1), dims), _matrix(held.column(1), dims)
    keys = np.ascontiguousarray(np.column_stack([v, nv.astype(float)]))
    _, first, group = np.unique(keys.view(np.dtype((np.void, keys.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    u, nu, by_group, size = v[first], nv[first], np.argsort(group.ravel(), kind="stable"), np.bincount(group.ravel())
    begin, shown = np.cumsum(size) - size, np.minimum(size, k)
    mixed = len(np.unique(np.concatenate([nq, nu]))) > 1
    slack = 4 * (dims + 1) * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(u, axis=1).max()
    step, found = max(1, 1_000_000 // int(shown.sum())), []
    for a in range(0, len(q), step):
        near = q[a : a + step] @ u.T
        if mixed:
            near[(nq[a : a + step, None] != nu) | (nu < 0)] = 0
        np.maximum(near, 0, out=near)
        least = near.max(axis=1) if k == 1 else np.partition(near, max(0, len(u) - k), axis=1)[:, max(0, len(u) - k)]
        if at_least is not None:
            least = np.maximum(least, at_least)
        row, at = np.nonzero(near >= (least - slack[a : a + step])[:, None])
        if not len(row):
            continue
        score = np.concatenate([_dots(q[a + row[i : i + 100_000]], u[at[i : i + 100_000]]) for i in range(0, len(row), 100_000)])
        score = np.where((nq[a + row] == nu[at]) & (nu[at] >= 0), np.maximum(score, 0), 0)
        n = shown[at]
        place = by_group[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        row, score = np.repeat(row, n), np.repeat(score, n)
        order = np.lexsort((place, -score, row))
        row, place, score = row[order], place[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        found.append((a + row[rank < k], place[rank < k], score[rank < k]))
    row, place, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return [asked.column(0).take(pa.array(row)), held.column(0).take(pa.array(place)), pa.chunked_array([pa.array(score)])]


def best_in_cells(asked: DataFrame, held: DataFrame, k: int, at_least: float | None = None) -> DataFrame:
    """(query id, vector id, score) of the k best of each query by max(0, dot) in each cell; of `asked` (cell, query id, vector) and
    `held` (cell, vector id, vector). Vectors of different lengths, null ones and such with a missing number score 0.

    A cell is one task's group of queries and vectors; whoever deals them keeps it small.
    """
    names = [asked.columns[1], held.columns[1], "score"]
    schema = T.StructType([asked.schema[1], held.schema[1], T.StructField("score", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            columns = [left.column(1).slice(0, 0), right.column(1).slice(0, 0), pa.chunked_array([pa.array([], pa.float64())])]
        else:
            columns = _best_of_cell(left, right, k, at_least)
        return pa.table(columns, names=names)

    return asked.groupBy(asked.columns[0]).cogroup(held.groupBy(held.columns[0])).applyInArrow(run, schema)


def vector_top_k(queries: DataFrame, vectors: DataFrame, query_id: str, vector_id: str, k: int = 10, embedding: str = "embedding", most_queries: int = MOST_QUERIES, most_vectors: int = MOST_VECTORS) -> DataFrame:
    """The k nearest vectors of each query by max(0, dot).

    All pairs are compared, in cells of about `most_queries` queries and `most_vectors` vectors (`best_in_cells`), which are dealt
    over the tasks by a shuffle; each gives back only k rows for a query.
    """
    lots, parts = max(1, -(-queries.count() // most_queries)), max(1, -(-vectors.count() // most_vectors))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(every(parts).alias("p"), query_id, F.col(embedding).alias("__q"))
    held = vectors.select(every(lots).alias("l"), vector_id, F.col(embedding).alias("__v"))
    asked = asked.select((dealt(query_id, lots) * parts + F.col("p")).alias("cell"), query_id, "__q")
    held = held.select((F.col("l") * parts + dealt(vector_id, parts)).alias("cell"), vector_id, "__v")
    return top_k(best_in_cells(asked, held, k), query_id, vector_id, k)


def within_budget(ranked: Column, budget: Column, k: int) -> Column:
    """Greedy by a token budget: what does not fit is skipped, later ones may fit, at most k are taken."""
    init = F.struct(F.lit(0).alias("n"), F.lit(0).alias("tokens"), F.slice(ranked, F.lit(1), F.lit(0)).alias("out"))

    def step(a, x):
        fits = (a["n"] < k) & (a["tokens"] + x["tokens"] <= budget)
        return F.when(fits, F.struct((a["n"] + 1).alias("n"), (a["tokens"] + x["tokens"]).alias("tokens"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a)

    return F.aggregate(ranked, init, step, lambda a: a["out"])


def word_classes(chunks: DataFrame) -> DataFrame:
    """(class, words, first): a row for each word set of the chunks, with the first chunk that has it (source_id, chunk_index, chunk_id).

    Chunks with equal word sets have equal scores for any query, and of them only the first can be accepted, so the others never
    need a place in a ranking. A chunk without words is like nothing and is a class of its own.
    """
    first = F.struct("source_id", "chunk_index", "chunk_id")
    rows = chunks.select(first.alias("first"), F.sort_array(latin_words(F.col("text"))).alias("words"))
    alone = F.concat_ws(":", F.lit("#"), F.col("first.source_id").cast("string"), F.col("first.chunk_index").cast("string"), F.col("first.chunk_id"))
    key = F.sha2(F.when(F.size("words") == 0, alone).otherwise(F.array_join("words", " ")), 256)
    return rows.groupBy(key.alias("class")).agg(F.any_value("words").alias("words"), F.min("first").alias("first"))


def accept(accepted: Column, ranked: Column, wanted: int, at_least: float = DEDUP_AT) -> Column:
    """`accepted` and those of `ranked` that are like none accepted before them, in order, until there are `wanted`."""
    alike = lambda x, y: (x["chunk_id"] == y["chunk_id"]) | (jaccard(x["words"], y["words"]) >= at_least)
    return F.aggregate(ranked, accepted, lambda kept, x: F.when((F.size(kept) >= wanted) | F.exists(kept, lambda y: alike(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


ACCEPTED = "array<struct<score:double,source_id:{s},chunk_index:int,chunk_id:string,words:array<string>>>"


def first_unique(queries: DataFrame, chunks: DataFrame, wanted: int, query_id: str, block: int | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """(query, position from 1, score, source_id, chunk_index, chunk_id): the first `wanted` chunks of each ranking that are like none before them.

    The whole ranking counts: score downwards, ties by (source_id, chunk_index), chunks without a word in common last. It is
    drawn in blocks. Each round takes, for the queries that still lack chunks, the next `block` classes below the place
    reached, folds them into what is accepted and goes on with four times as many, until a query has enough or its ranking
    ends. A round scores all classes against the open queries (a given query set against all rows, in blocks of `most_words` words, which
    are sent to the tasks) and keeps `block` rows a task and query (`best_overlaps`). What is kept of a query is
    `wanted` word sets.
    """
    kind = chunks.schema["source_id"].dataType.simpleString()
    classes = stored(word_classes(chunks), "word-classes")
    asked = queries.dropDuplicates([query_id]).select(query_id, latin_words(F.coalesce("text", F.lit(""))).alias("w"))
    state = asked.select(query_id, "w", F.size("w").alias("na"), F.array().cast(ACCEPTED.format(s=kind)).alias("accepted"), F.lit(None).cast("double").alias("at"), F.lit(None).cast(classes.schema["first"].dataType).alias("after"), F.lit(False).alias("ended"))
    state = stored(state, "ranking-state")
    for with_zero in (False, True):  # chunks that share no word come after all others and are scored only for queries that get so far
        size = block or 4 * wanted
        while True:
            behind = (F.size("accepted") < wanted) & ~F.col("ended")
            open_queries = state.filter(behind)
            n = open_queries.count()
            if not n:
                break
            found = best_overlaps(open_queries, classes.select("class", "first", "words"), query_id, size, most_words, with_zero)
            ahead = Window.partitionBy(query_id).orderBy(F.desc("score"), "first")
            found = found.withColumn("rank", F.row_number().over(ahead)).filter(F.col("rank") <= size)
            found = classes.select("class", "words").join(F.broadcast(found) if n * size <= MOST_WORDS else found, "class")
            item = F.struct("score", "first.source_id", "first.chunk_index", "first.chunk_id", "words")
            drawn = found.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("x")))).alias("drawn"))
            rows = open_queries.join(drawn, query_id, "left").withColumn("n", F.coalesce(F.size("drawn"), F.lit(0)))
            last = F.element_at("drawn", -1)["x"]
            rows = rows.select(
                query_id, "w", "na",
                F.when(F.col("n") > 0, accept(F.col("accepted"), F.transform("drawn", lambda d: d["x"]), wanted)).otherwise(F.col("accepted")).alias("accepted"),
                F.when(F.col("n") > 0, last["score"]).otherwise(F.col("at")).alias("at"),
                F.when(F.col("n") > 0, F.struct(last["source_id"].alias("source_id"), last["chunk_index"].alias("chunk_index"), last["chunk_id"].alias("chunk_id"))).otherwise(F.col("after")).alias("after"),
                (F.col("n") < size).alias("ended"),
            )
            state = stored(state.filter(~behind).unionByName(rows), "ranking-state")
            size *= 4
        if not with_zero:
            none = F.lit(None)
            state = state.withColumns({"ended": F.lit(False), "at": none.cast("double"), "after": none.cast(classes.schema["first"].dataType)})
    rows = state.select(query_id, F.posexplode("accepted").alias("position", "x"))
    return rows.select(query_id, (F.col("position") + 1).alias("position"), "x.score", "x.source_id", "x.chunk_index", "x.chunk_id")


def assemble(queries: DataFrame, chunks: DataFrame, k: int = 5, query_id: str = "query_id", budget_col: str | None = None) -> DataFrame:
    """Context of each query: rank, drop similar, first 2k, greedy by budget, at most k.

    `chunks` are those of `chunk.retrieval_chunks`; the ranking goes as deep as 2k chunks that are not alike need it. Columns: context_text,
    attributions (source_id, source_name, score; the first chunk of each source, in order), total_tokens, chunks_used, chunks_available
    (chunks in all).
    """
    chunks = stored(chunks, "chunks")
    best = first_unique(queries, chunks, 2 * k, query_id)
    details = chunks.select("source_id", "chunk_index", "chunk_id", "source_name", "text", F.col("estimated_tokens").alias("tokens"))
    best = F.broadcast(best) if queries.count() * 2 * k <= MOST_WORDS else best  # so that the texts of all chunks stay where they are
    items = details.join(best, ["source_id", "chunk_index", "chunk_id"]).dropDuplicates([query_id, "position"]).groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "source_id", "source_name", "score", "tokens", "text"))).alias("unique"))
    rows = queries.join(items, query_id, "left").crossJoin(F.broadcast(chunks.agg(F.count(F.lit(1)).cast("int").alias("chunks_available"))))
    budget = budget_or_default(F.col(budget_col)) if budget_col else F.lit(DEFAULT_BUDGET)
    rows = rows.withColumn("__taken", within_budget(F.col("unique"), budget, k))
    first = lambda t: F.filter(t, lambda x, i: ~F.exists(F.slice(t, F.lit(1), i), lambda y: y["source_id"] == x["source_id"]))
    named = lambda t: F.transform(first(t), lambda x: F.struct(x["source_id"].alias("source_id"), x["source_name"].alias("source_name"), F.round(x["score"], 4).alias("relevance_score")))

    def outcome(t):
        return F.struct(context_text(t).alias("context_text"), named(t).alias("attributions"), F.aggregate(t, F.lit(0), lambda a, x: a + x["tokens"]).alias("total_tokens"), F.size(t).alias("chunks_used"))

    rows = rows.select(query_id, let(F.coalesce("__taken", F.slice("unique", 1, 0)), outcome).alias("o"), "chunks_available")
    count = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(0)).alias(c)
    return rows.select(query_id, F.coalesce("o.context_text", F.lit("")).alias("context_text"), F.col("o.attributions").alias("attributions"), count("total_tokens"), count("chunks_used"), "chunks_available")


def context_text(taken: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(taken, lambda x, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit(": "), x["source_name"], F.lit("]\n"), x["text"])), "\n\n---\n\n"), F.lit(""))
