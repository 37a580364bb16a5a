"""Ranking to full depth and alike word sets beside brute force: copies at the top, ties, nulls, repeated rows, clashing columns."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkwarden.operators import chunk, retrieve, similarity

WORDS = [f"{a}{b}{c}" for a in "abcdef" for b in "aeiou" for c in "nrst"]


def word_set(text):
    return set(re.findall(r"\b[a-z]{3,}\b", (text or "").lower()))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def brute_unique(query, chunks, wanted):
    """chunks: (source_id, chunk_index, chunk_id, text) in order."""
    q = word_set(query)
    ranked = sorted(((-jaccard(q, word_set(t)), s, i, c, t) for s, i, c, t in chunks), key=lambda r: r[:4])
    kept = []
    for r in ranked:
        w = word_set(r[4])
        if len(kept) < wanted and not any(r[3] == k[3] or jaccard(w, word_set(k[4])) >= 0.85 for k in kept):
            kept.append(r)
    return [(k[1], k[2], k[3]) for k in kept]


def corpus(spark, texts):
    rows = [(i, f"n{i % 3}", t, 1, "x", [2]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, rank int, class string, words array<int>")


def variants(rng, base, n):
    """Texts alike to `base`, with different word sets."""
    return [" ".join([*base, rng.choice(WORDS) + "x" * (k % 7 + 1)]) for k in range(n)]


def test_full_ranking_with_a_thousand_copies_at_the_top(spark):
    rng = random.Random(3)
    base = rng.sample(WORDS, 20)
    texts = [" ".join(base)] * 1000 + variants(rng, base, 60) + [" ".join(rng.sample(WORDS, 12)) for _ in range(40)]
    texts += ["12 34", "", None, "56 78.", "zzz yyy. " + "qqq " * 700 + ". " + " ".join(base)]
    docs = corpus(spark, texts)
    parts = chunk.retrieval_chunks(docs, name_col="source")
    rows = sorted((r["source_id"], r["chunk_index"], r["chunk_id"], r["text"]) for r in parts.collect())
    asked = {1: " ".join(base), 2: " ".join(base[:3]), 3: "", 4: "no such words at all", 5: "zzz yyy", 6: None}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    for wanted, block in ((10, 3), (10, None), (45, 8)):
        got = defaultdict(list)
        for r in sorted(retrieve.first_unique(queries, parts, wanted, "query_id", block).collect(), key=lambda r: r["position"]):
            got[r["query_id"]].append((r["source_id"], r["chunk_index"], r["chunk_id"]))
        assert dict(got) == {q: brute_unique(t, rows, wanted) for q, t in asked.items()}
    made = {r["query_id"]: r for r in retrieve.assemble(queries, parts, 5).collect()}
    assert {r["chunks_available"] for r in made.values()} == {len(rows)} and all(r["chunks_used"] == 5 for r in made.values())


def test_token_budget_of_each_query(spark):
    docs = corpus(spark, [" ".join(WORDS[i : i + 30]) for i in range(0, 90, 10)])
    parts = chunk.retrieval_chunks(docs)
    size = parts.agg(F.max("estimated_tokens")).first()[0]
    queries = spark.createDataFrame([(1, WORDS[0], 0), (2, WORDS[0], None), (3, WORDS[0], 2 * size), (4, WORDS[0], 1)], "query_id int, text string, budget int")
    used = {r["query_id"]: (r["chunks_used"], r["total_tokens"]) for r in retrieve.assemble(queries, parts, 5, budget_col="budget").collect()}
    assert used[1][0] == used[2][0] == 5 and used[3][0] == 2 and used[3][1] <= 2 * size and used[4] == (0, 0)


def test_ranking_of_empty_tables(spark):
    parts = chunk.retrieval_chunks(corpus(spark, ["", None]))
    queries = spark.createDataFrame([(1, "abc")], "query_id int, text string")
    assert retrieve.first_unique(queries, parts, 5, "query_id").count() == 0
    row = retrieve.assemble(queries, parts).first()
    assert (row["context_text"], row["chunks_used"], row["chunks_available"]) == ("", 0, 0)
    assert retrieve.assemble(queries.filter("false"), parts).count() == 0


def test_keyword_scores_send_no_pairs_and_no_words_as_keys(spark):
    queries = spark.createDataFrame([(1, "abc def")], "query_id int, text string")
    chunks = spark.createDataFrame([(1, "abc xyz")], "chunk_id int, text string")
    plan = retrieve.keyword_scores(queries, chunks, "query_id", "chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "Python" not in plan
    blocks = retrieve.keyword_scores(queries.unionByName(queries.withColumn("query_id", F.lit(2))), chunks, "query_id", "chunk_id", most_words=2)
    assert sorted(tuple(r) for r in blocks.collect()) == [(1, 1, 1 / 3), (2, 1, 1 / 3)]


def brute_links(rows):
    sets = defaultdict(list)
    for i, t in rows:
        if word_set(t):
            sets[frozenset(word_set(t))].append(i)
    named = {w: (min((i for i in ids if i is not None), default=None), len(ids)) for w, ids in sets.items()}
    links, keys = set(), list(sets)
    for k, a in enumerate(keys):
        for b in keys[:k]:
            if 100 * len(a & b) >= 85 * len(a | b) and None not in (named[a][0], named[b][0]):
                links.add((*sorted((named[a][0], named[b][0])), len(a & b)))
    return Counter((i, *named[frozenset(word_set(t))]) for i, t in rows if word_set(t)), links


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_alike_word_sets_brute_force(spark, seed):
    rng = random.Random(seed)
    base, texts = rng.sample(WORDS, 40), [None, "", "12", "ab", "abc", "abc", "abc def"]
    texts += [" ".join(base)] * 30 + variants(rng, base, 80) + [" ".join(rng.sample(base, rng.randrange(30, 41))) for _ in range(60)]
    texts += [" ".join(rng.sample(WORDS, rng.choice([1, 2, 6, 7, 13, 20]))) for _ in range(150)]
    small = rng.sample(WORDS, 8)
    texts += [" ".join(rng.sample(small, rng.choice([6, 7, 8]))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(None, texts[20]), (None, "only null here"), (12, texts[12]), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in rows], "chunk_id bigint, text string, word string, n int, set_key string")
    classes, links = similarity.near_dup_links(df)
    want_classes, want_links = brute_links(rows)
    got = [(r["a"], r["b"], r["shared"]) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want_links and len(want_links) > 500
    assert Counter(tuple(r) for r in classes.collect()) == want_classes
    ends = Counter(x for a, b, _ in want_links for x in (a, b))
    assert Counter(tuple(r) for r in similarity.link_counts(classes, links).collect()) == Counter({(i, c, n, ends[c]): k for (i, c, n), k in want_classes.items()})


def test_alike_prefixes_are_short_and_rare(spark):
    rng = random.Random(5)
    often = [f"often{c}" for c in "abcdefghij"]
    df = spark.createDataFrame([(i, " ".join([*often, *(f"rare{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(30))])) for i in range(300)], "chunk_id int, text string")
    sets = similarity.word_sets(df, "chunk_id").select(F.col("row").alias("v"), "words")
    ordered = similarity.by_rarity(sets).collect()
    ends = [tuple(r["words"][-10:]) for r in ordered]
    assert len(set(ends)) == 1 and all(r["words"] == sorted(r["words"]) for r in ordered)
    classes, links = similarity.near_dup_links(df)
    assert links.count() == 0 and classes.count() == 300
    empty, none = similarity.near_dup_links(df.filter("false"))
    assert empty.count() == 0 and none.count() == 0


def test_alike_sets_meet_once_in_bounded_cells(spark):
    """Words that many prefixes hold are dealt into chunks and families into blocks, and each pair is made once, without any join of pairs with sets."""
    rng = random.Random(6)
    base = rng.sample(WORDS, 60)
    kept = lambda: [w for w in base if rng.random() > 0.06]
    sets = [frozenset(kept() + [f"x{rng.randrange(30)}"]) for _ in range(150)] + [frozenset(rng.sample(WORDS, 20)) for _ in range(50)] + [frozenset(["a", "b"]), frozenset(["a", "c"]), frozenset(["d"])]
    sets = sorted(set(sets), key=sorted)
    ordered = similarity.by_rarity(spark.createDataFrame([(v, sorted(w)) for v, w in enumerate(sets)], "v bigint, words array<string>"))
    want = {(a, b, len(sets[a] & sets[b])) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    for chunk, block in ((1000, 500), (7, 9)):
        pairs = [frozenset((r["va"], r["vb"])) for r in similarity.set_pairs(ordered, chunk=chunk).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) >= {frozenset(x[:2]) for x in want}
        got = similarity.alike_sets(ordered, chunk=chunk, block=block)
        found = [(max(r["va"], r["vb"]), min(r["va"], r["vb"]), r["shared"]) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 500
    assert "array_intersect" not in got._jdf.queryExecution().toString()


def test_best_chunks_without_pairs_or_shuffled_texts(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.sample(WORDS, rng.randrange(3, 15))) for _ in range(150)] + [" ".join(WORDS[:8])] * 40 + ["", None, "12"]
    parts = chunk.retrieval_chunks(corpus(spark, texts), name_col="source").withColumn("place", F.struct("source_id", "chunk_index", "chunk_id")).repartition(5)
    queries = spark.createDataFrame([(i, " ".join(rng.sample(WORDS, 6))) for i in range(9)] + [(20, " ".join(WORDS[:8])), (21, ""), (22, None)], "query_id int, text string")
    want = retrieve.top_k(retrieve.keyword_scores(queries, parts, "query_id", "place"), "query_id", "place", 4)
    rows = lambda df: sorted((r["query_id"], r["rank"], tuple(r["place"]), r["score"]) for r in df.collect())
    for most in (10, 1000):
        assert rows(retrieve.keyword_top_k(queries, parts, "query_id", "place", 4, most_words=most)) == rows(want) and want.count() > 30
    plan = retrieve.keyword_top_k(queries, parts, "query_id", "place", 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" not in plan  # the one of the ranking
