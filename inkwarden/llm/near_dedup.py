"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, free_names, row_tag, settle, sliced, whole
from .components import components

WORDS = 5
PER_CENT = 75
BINS, BANDS = 128, 32
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S29, _S32 = np.uint64(29), np.uint64(32)


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str, known: dict, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    A-Z are lower-cased and words are runs of other than ASCII white space. A text with fewer than `size` words is one
    shingle, its whole sequence; one without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: both rules are ASCII only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(size, len(w))
    n = len(w) - span + 1
    h = np.full(n, span, dtype=np.uint64)
    for j in range(span):
        h = (h ^ w[j : j + n]) * _M1
        h ^= h >> _S32
    h *= _M2
    h ^= h >> _S29
    return np.unique(h)


def _orders(seed: int = 11) -> np.ndarray:
    """For each bin the order in which it looks for another to borrow from when empty: the same for all documents."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


def band_keys(shingles: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """BANDS bucket keys of a non-empty sorted set.

    The top bits of a hash choose its bin and the least hash of a bin is its minimum: one permutation for all bins. Empty
    bins borrow, each in its own random order, which keeps two sets' agreement in a bin equal to their similarity.
    """
    edges = (np.arange(BINS, dtype=np.uint64) << np.uint64(57)) if BINS == 128 else None
    at = np.minimum(np.searchsorted(shingles, edges), len(shingles) - 1)
    least = shingles[at]
    full = (least >> np.uint64(57)) == np.arange(BINS, dtype=np.uint64)
    empty = np.flatnonzero(~full)
    if len(empty):
        lender = orders[empty, np.argmax(full[orders[empty]], axis=1)]
        least[empty] = least[lender]
    rows = least.reshape(BANDS, BINS // BANDS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _M2
    for j in range(rows.shape[1]):
        h = (h ^ rows[:, j]) * _M1
        h ^= h >> _S32
    return h.view(np.int64)


def digest_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole shingle set, as two signed numbers."""
    d = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tag, n_shingles, a 128-bit digest (s0, s1) of the whole shingle set, and its bands (none for the empty set)."""

    def run(batches):
        known, orders = _WordHashes(), _orders()
        for batch in sliced(batches):
            n, s0, s1, bands = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, known)
                d = digest_of(s)
                n.append(len(s))
                s0.append(d[0])
                s1.append(d[1])
                bands.append(band_keys(s, orders) if len(s) else [])
            arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s0, pa.int64()), pa.array(s1, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "tag", "n_shingles", "s0", "s1", "bands"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_tag(F.col(text_col)).alias("tag"), whole(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, tag bigint, n_shingles bigint, s0 bigint, s1 bigint, bands array<bigint>")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(v, shingles) with the full shingle set as bytes, for the classes in `wanted` (v, first, s0, s1)."""

    def run(batches):
        known = _WordHashes()
        for batch in sliced(batches):
            v, found = [], []
            for node, s0, s1, text in zip(*[c.to_pylist() for c in batch.columns]):
                s = shingle_set(text, known)
                if digest_of(s) == (s0, s1):  # else another row with the id of the class's first
                    v.append(node)
                    found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(found, pa.binary())], names=["v", "shingles"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("first"), whole(F.col(text_col)).alias("text")).join(wanted, "first").select("v", "s0", "s1", "text")
    return texts.mapInArrow(run, "v bigint, shingles binary").dropDuplicates(["v"])


def confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy 100 * intersection >= per_cent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(p) + len(q)
                same = both - len(np.union1d(p, q))
                keep.append(100 * same >= per_cent * (both - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("v").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("v").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _alike(n: str, m: str):
    """Sizes that allow the similarity at all."""
    return 100 * F.least(n, m) >= PER_CENT * F.greatest(n, m)


def _family_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the outsiders (role 0) and all members (role 1) of one block of a family, one for each pair of components.

    Members are indexed by shingle; an outsider's intersections are counts over the lists of its shingles.
    """
    seekers, others = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
    sets = [np.frombuffer(x, dtype=np.uint64) for x in others["shingles"]]
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    if not len(seekers) or not len(sets):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    ids, comps = others["v"].to_numpy(), others["comp"].to_numpy()
    a, b = [], []
    for v, comp, data in zip(seekers["v"], seekers["comp"], seekers["shingles"]):
        x = np.frombuffer(data, dtype=np.uint64)
        lo, hi = np.searchsorted(every, x, "left"), np.searchsorted(every, x, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        same = np.bincount(owner[at], minlength=len(sets))
        (hit,) = np.nonzero((100 * same >= PER_CENT * (len(x) + sizes - same)) & (comps != comp))
        for k in hit[np.unique(comps[hit], return_index=True)[1]]:
            a.append(v)
            b.append(ids[k])
    return pd.DataFrame({"a": np.array(a, dtype="int64"), "b": np.array(b, dtype="int64")})


def family_links(members: DataFrame, nodes: DataFrame, comps: DataFrame, sets: DataFrame, seek: int = 200_000, index: int = 2_000_000) -> DataFrame:
    """(a, b): the links that stars may have left out, between members of one bucket in different components.

    A bucket that holds several components belongs to the family of its largest. Of a family, those outside the largest
    component are compared with all members, in blocks of about `seek` and `index` shingles. Pairs are never rows: a block
    gives only the links it finds, one for an outsider and component.
    """
    placed = members.join(comps, "v", "left").select("key", "v", "n", F.coalesce("comp", "v").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    split = sizes.groupBy("key").agg(F.max_by("comp", "size").alias("major"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("key", "major")
    family = settle(placed.join(split, "key").select("major", "v", "n", "comp").distinct(), "families", narrow=True)
    outside = F.col("comp") != F.col("major")
    total = family.groupBy("major").agg(F.sum(F.when(outside, F.col("n"))).alias("seek"), F.sum("n").alias("index"))
    total = total.select("major", F.ceil(F.col("seek") / seek).cast("int").alias("xs"), F.ceil(F.col("index") / index).cast("int").alias("ys"))
    rows = family.join(total, "major")
    spread = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    seekers = rows.filter(outside).select("major", "v", "comp", F.lit(0).alias("role"), spread("xs").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"))
    others = rows.select("major", "v", "comp", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), spread("ys").alias("y"))
    block = seekers.unionByName(others).join(sets, "v")
    return block.groupBy("major", "x", "y").applyInPandas(_family_links, "a bigint, b bigint")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Documents are linked when 100 * intersection >= 75 * union of their full sets of five-word shingles.

    1. Documents with equal sets form a class, known by the sets' digest and numbered once when it is stored.
    2. Classes fall into 32 buckets each (4 bins of 128 a band; a pair at 0.75 misses all with probability 5e-6).
    3. Stars: every member of a bucket is compared with the bucket's smallest number, then with the member that has most
       confirmed links so far. All comparisons are made on full sets.
    4. What stars cannot settle: where a bucket still holds members of several components, those outside its largest are
       compared with all members by an index of shingles, in blocks (`family_links`), so no link of a bucket is lost.
    5. Components of all links; a component is named by the smallest id of its classes, a document takes its class's.

    A text without words has no shingle, links to nothing and is its own component. Null text counts as empty. A row
    with a null id links to nothing and has a null component. Rows that repeat an id each have their own text's class and links.
    Extra columns are ignored. No rows in, no rows out.
    """
    return _near(docs, id_col, text_col).drop("tag", "comp")


def _near(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = settle(signatures(docs, id_col, text_col), "signatures")
    linkable = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy("s0", "s1").agg(F.min("doc_id").alias("first"))
    classes = settle(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
    renamed = classes.select("v", F.col("s0").alias("c0"), F.col("s1").alias("c1"), "first")
    nodes = linkable.join(renamed, (F.col("s0") == F.col("c0")) & (F.col("s1") == F.col("c1")) & (F.col("doc_id") == F.col("first"))).select("v", F.col("n_shingles").alias("n"), "bands").dropDuplicates(["v"])
    banded = settle(nodes.select("v", "n", F.posexplode("bands").alias("band", "key")), "banded")
    shared = settle(banded.groupBy("key").agg(F.min("v").alias("hub"), F.min_by("n", "v").alias("hub_n"), F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("n", "members"), "buckets")
    members = settle(banded.join(shared.drop("members"), "key").select("key", "band", "v", "n", "hub", "hub_n"), "members")
    sets = settle(sets_of(docs, classes.join(members.select("v").distinct(), "v", "left_semi"), id_col, text_col), "sets")

    def tested(pairs, name):
        pairs = settle(pairs.distinct(), f"pairs-{name}")
        return pairs, settle(confirmed(pairs, sets), f"links-{name}")

    first = members.filter("v <> hub").filter(_alike("n", "hub_n")).select(F.col("hub").alias("a"), F.col("v").alias("b"))
    pairs1, links1 = tested(first, "1")
    degree = settle(links1.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("links")), "degrees")
    rank = F.coalesce("links", F.lit(0)).cast("decimal(19,0)") * F.lit("18446744073709551616").cast("decimal(20,0)") - F.col("v").cast("decimal(19,0)")
    ranked = members.join(degree, "v", "left").select("key", "v", "n", rank.cast("decimal(38,0)").alias("rank"))
    centre = settle(ranked.groupBy("key").agg(F.max_by("v", "rank").alias("hub2"), F.max_by("n", "rank").alias("hub2_n")), "centres")
    second = (
        members.join(centre, "key")
        .filter("v <> hub2 and hub2 <> hub")
        .filter(_alike("n", "hub2_n"))
        .select(F.least("v", "hub2").alias("a"), F.greatest("v", "hub2").alias("b"))
        .distinct()
        .join(pairs1, ["a", "b"], "left_anti")
    )
    pairs2, links2 = tested(second, "2")
    comps = settle(components(links1.unionByName(links2)), "components-1")

    links3 = settle(family_links(members, nodes, comps, sets), "links-3")
    over = links3.join(comps.select(F.col("v").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comps.select(F.col("v").alias("b"), F.col("comp").alias("cb")), "b", "left")
    merged = components(over.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "stars-b")
    merged = merged.select(F.col("v").alias("comp"), F.col("comp").alias("final"))
    lone = classes.select("s0", "s1", "first", "v").join(comps, "v", "left").select("s0", "s1", "first", F.coalesce("comp", "v").alias("comp"))
    placed = settle(lone.join(merged, "comp", "left").select("s0", "s1", "first", F.coalesce("final", "comp").alias("comp")), "class-places")
    named = settle(placed.groupBy("comp").agg(F.min("first").alias("component_id")), "component-names")
    by_class = settle(placed.join(named, "comp").select("s0", "s1", "comp", "component_id"), "class-components")
    found = linkable.select("doc_id", "tag", "n_shingles", "s0", "s1").join(by_class, ["s0", "s1"]).select("doc_id", "tag", "n_shingles", "comp", "component_id")
    alone = rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "tag", "n_shingles", F.lit(None).cast("bigint").alias("comp"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group of `docs`, with all its columns; rows with a null id and texts without words stay.

    A group keeps the row with its smallest id. Rows are told apart by id and text: rows that share an id but are not alike all
    stay in their groups; of alike rows with the smallest id one stays. No rows in, no rows out.
    """
    key, tag, row = free_names(docs, "near_doc", "near_tag", "near_row")
    found = _near(docs, id_col, text_col).filter("kept and n_shingles > 0")
    best = found.groupBy("comp").agg(F.min("tag").alias("best"), F.min("component_id").alias("component"))  # two components may bear one repeated id
    best = settle(best.select("component", "best").distinct(), "near-kept").select(F.col("component").alias(key), F.col("best").alias(tag))
    own, mine = F.col(id_col).cast("bigint"), row_tag(F.col(text_col))
    words = F.length(F.btrim(whole(F.col(text_col)), F.lit(ASCII_SPACE))) > 0
    linkable = own.isNotNull() & words
    marked = docs.filter(linkable).join(best, (own == F.col(key)) & (mine == F.col(tag)))
    kept = marked.withColumn(row, F.row_number().over(Window.partitionBy(key, tag).orderBy(F.lit(1)))).filter(F.col(row) == 1).select(*docs.columns)
    return kept.unionByName(docs.filter(~linkable))
