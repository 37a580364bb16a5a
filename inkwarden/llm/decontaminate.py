"""Benchmark decontamination: latent semantic retrieval of passages, then common-subsequence and answer checks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, settle, whole
from .quality import summed
from .words import Vocabulary, hashed, hashes_of, slabs

MOST_WORDS = 48
#: Parts of at most so many words are sought in windows of as many words, one step apart.
WINDOWS = {4: 1, 8: 2, 16: 4, 24: 6, 32: 8, 40: 8, 48: 8}
SLOTS = "doc_id bigint, slots array<int>, counts array<bigint>"
#: Cells of the passages' Gram matrix that a task adds up at a time.
MOST_CELLS = 1 << 23
FOUND = "doc_id bigint, item_id bigint, similarity double, common_share double, answered boolean"


@dataclass
class Queries:
    """Benchmark items cut into parts of at most MOST_WORDS words. A slot is the number of a word in `vocabulary`."""

    item: list[int]
    parts: list[np.ndarray]  # slots
    answer: list[np.ndarray]
    vocabulary: Vocabulary


def queries_of(rows: list, answer_words: int) -> Queries:
    item, parts, answer = [], [], []
    for item_id, text in rows:
        w = hashes_of(text)
        n = math.ceil(len(w) / MOST_WORDS)
        for k in range(n):
            item.append(item_id)
            parts.append(w[len(w) * k // n : len(w) * (k + 1) // n])
            answer.append(w[-answer_words:])
    vocabulary = Vocabulary(np.concatenate(parts or [np.zeros(0, np.uint64)]))
    return Queries(item, [vocabulary(p) for p in parts], [vocabulary(a) for a in answer], vocabulary)


def lists(arrays: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]), kind))


def slots_of(docs: DataFrame, q: Queries) -> DataFrame:
    """Each document as the slots of its words in order.

    Each task adds a row with the number of its documents that hold each word, their number and that of their passages.
    """
    held = docs.sparkSession.sparkContext.broadcast(q.vocabulary)

    def run(batches):
        vocabulary = held.value
        size = len(vocabulary)
        counts = np.zeros(size + 2, np.int64)
        for batch in batches:
            done, last = [], -1
            ids = batch.column(0).to_pylist()

            def flush(done):
                slots = [np.concatenate(d) if len(d) > 1 else d[0] for d in done]
                number = np.repeat(np.arange(len(slots)), list(map(len, slots)))
                pairs = np.unique(number * (size + 1) + np.concatenate(slots))
                counts[:size] += np.bincount(pairs % (size + 1), minlength=size + 1)[:size]
                counts[size:] += len(slots), sum(-(-len(s) // MOST_WORDS) for s in slots)
                mine = [ids.pop(0) for _ in slots]
                columns = [pa.array(mine, pa.int64()), lists(slots, pa.int32()), pa.nulls(len(mine), pa.list_(pa.int64()))]
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "slots", "counts"])

            for numbers, pieces in slabs(x.as_py() for x in batch.column(1)):
                words, n = hashed(pieces)
                for k, s in zip(numbers, np.split(vocabulary(words), np.cumsum(n)[:-1])):
                    done.append([s]) if k != last else done[-1].append(s)
                    last = k
                if len(done) > 1:  # the last document may go on
                    yield flush(done[:-1])
                    done = done[-1:]
            if done:
                yield flush(done)
        columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "slots", "counts"])

    return settle(docs.select("doc_id", "text").mapInArrow(run, SLOTS), "word-slots")


def inverse_frequencies(slots: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """(idf of each slot, number of passages), counted over all documents. Words of no item, the last slot, have the root mean square of the others.

    `size` numbers come to the driver.
    """
    sums = slots.filter("counts is not null").select(F.posexplode("counts").alias("slot", "n")).groupBy("slot").agg(F.sum("n").alias("n"))
    n = np.zeros(size + 2)
    for r in sums.collect():
        n[r.slot] = r.n
    idf = np.log(1 + (n[size] + 1) / (n[: size + 1] + 1))
    idf[size] = np.sqrt((idf[:size] ** 2).mean())
    return idf, int(n[size + 1])


def passage_ends(ends: np.ndarray) -> np.ndarray:
    """`ends` are places between documents, from the first one's begin on; so are those returned, between the passages of MOST_WORDS
    words that all documents are cut into. A document's last passage may be shorter."""
    n = -(-np.diff(ends) // MOST_WORDS)
    doc = np.repeat(np.arange(len(n)), n)
    return np.append(ends[:1], np.minimum(ends[doc] + MOST_WORDS * (1 + ranges(np.zeros(len(n), np.int64), n)), ends[doc + 1]))


class Rows:
    """Passages as sparse rows of TF-IDF, scaled to length 1, and their products with dense matrices.

    Words of no item count in the length only, each as one occurrence of a word.
    """

    def __init__(self, slots: np.ndarray, ends: np.ndarray, idf: np.ndarray):
        none, number = len(idf) - 1, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        other = np.bincount(number[slots == none], minlength=len(ends)) * idf[none] ** 2
        entry, tf = np.unique((number * (none + 1) + slots)[slots < none], return_counts=True)
        number, self.slots = np.divmod(entry, none + 1)
        x = tf * idf[self.slots]
        self.norms = np.sqrt(np.bincount(number, x * x, len(ends)) + other)
        self.x = (x / self.norms[number]).astype(np.float32)[:, None]
        self.rows, self.first, self.number = np.unique(number, return_index=True, return_inverse=True)

    def times(self, o: np.ndarray) -> np.ndarray:
        """A o, for the rows that are not zero."""
        return np.add.reduceat(self.x * o[self.slots], self.first, axis=0) if len(self.x) else np.zeros((0, o.shape[1]), np.float32)

    def gram(self, o: np.ndarray) -> np.ndarray:
        """A'A o"""
        out = np.zeros(o.shape, np.float32)
        if len(self.x):
            order = np.argsort(self.slots, kind="stable")
            slot, first = np.unique(self.slots[order], return_index=True)
            out[slot] = np.add.reduceat((self.x * self.times(o)[self.number])[order], first, axis=0)
        return out

    def pairs(self, low: int, high: int):
        """(slot, slot, product) of all two entries of a row and of each with itself: the first slot from `low` to `high` - 1, the other not before it."""
        (mine,) = np.nonzero((self.slots >= low) & (self.slots < high))
        n = np.append(self.first[1:], len(self.x))[self.number[mine]] - mine
        i, j, x = np.repeat(mine, n), ranges(mine, n), self.x.ravel().astype(float)
        return self.slots[i], self.slots[j], x[i] * x[j]


def gram_rows(slots: DataFrame, idf: np.ndarray, most_cells: int = MOST_CELLS) -> DataFrame:
    """(slot, cells): A'A, each row from the diagonal on, where the rows of A are all passages of all documents (`passage_ends`).

    The pairs of words of each passage are added up, in as many tasks as there are cores, and the tasks' sums of a row meet in one.
    Slots are taken in bands of about `most_cells` cells, each a pass over the passages, so a task holds one band.
    """
    size, tasks = len(idf) - 1, slots.sparkSession.sparkContext.defaultParallelism
    starts = np.append(0, np.cumsum(size - np.arange(size)))
    held = slots.sparkSession.sparkContext.broadcast(idf)
    kind, names = "slot int, cells array<float>", ["slot", "cells"]

    def band(low, high):
        at = starts[low : high + 1] - starts[low]

        def partial(batches):
            sums = np.zeros(at[-1])
            for batch in batches:
                column = batch.column(0)
                ends, values = passage_ends(column.offsets.to_numpy().astype(np.int64)), column.values.to_numpy()
                for k in range(0, len(ends) - 1, 4000):
                    part = ends[k : k + 4001]
                    i, j, x = Rows(values[part[0] : part[-1]], part[1:] - part[0], held.value).pairs(low, high)
                    np.add.at(sums, at[i - low] + j - i, x)
            for k in range(0, high - low, 256):
                some = at[k : k + 257]
                cells = pa.ListArray.from_arrays(pa.array(some - some[0], pa.int32()), pa.array(sums[some[0] : some[-1]], pa.float64()).cast(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)) + low + k, pa.int32()), cells], names=names)

        def merge(batches):
            sums: dict = {}
            for batch in batches:
                for slot, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                    new = cells.values.to_numpy()
                    sums[slot] = sums[slot] + new if slot in sums else new.astype(float)
            for slot, cells in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), lists([cells], pa.float64()).cast(pa.list_(pa.float32()))], names=names)

        rows = slots.filter("size(slots) > 0").select("slots").coalesce(tasks)
        return settle(rows.mapInArrow(partial, kind).repartition(tasks, "slot").mapInArrow(merge, kind), "gram")

    out, low = None, 0
    while low < size:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + most_cells, "right")) - 1)
        new = band(low, high)
        out, low = new if out is None else out.unionByName(new), high
    held.destroy()
    return out


@dataclass
class Space:
    """Latent vectors of slots (idf times V; zero for words of no item), and of parts, scaled so that the inner product of a part
    with a unit passage equal to it is 1."""

    idf: np.ndarray
    vectors: np.ndarray
    parts: np.ndarray


def fit_space(q: Queries, slots: DataFrame, idf: np.ndarray, passages: int, dims: int, seed: int = 3) -> Space:
    """Randomised SVD of TF-IDF passages by distributed subspace iteration.

    The rows of A are all passages of all documents and the benchmark parts. The passages together weigh as much as the parts, so
    the space does not drift from the parts as the corpus grows. The passages are read once, for A'A (`gram_rows`). Each step adds up
    A'A o over its rows, a matrix of (benchmark words x dims) in single precision, which reaches the driver once; it is
    orthonormalised there, and the last step gives the eigenvectors of the small o'A'Ao.
    """
    size = len(q.vocabulary)
    dims = min(dims, size)
    own = Rows(np.concatenate(q.parts), np.cumsum([len(p) for p in q.parts]), idf)
    basis = np.append(np.linalg.qr(np.random.default_rng(seed).normal(size=(size, dims)))[0], np.zeros((1, dims)), axis=0).astype(np.float32)
    gram = gram_rows(slots, idf) if passages else None

    def product(o):
        if gram is None:
            return own.gram(o)
        held = slots.sparkSession.sparkContext.broadcast(o)

        def of_batch(slot, cells):
            o, slot, ends, values = held.value, slot.to_numpy(), cells.offsets.to_numpy(), cells.values.to_numpy()
            out = np.zeros(o.shape, np.float32)
            for k in range(0, len(slot), 256):
                mine, n = slot[k : k + 256], np.diff(ends[k : k + 257])
                rows = np.zeros((len(mine), size), np.float32)
                rows[np.repeat(np.arange(len(mine)), n), ranges(mine.astype(np.int64), n)] = values[ends[k] : ends[k + len(mine)]]
                out[mine] += rows @ o[:-1]
                rows[np.arange(len(mine)), mine] = 0  # the diagonal counts once
                out[:-1] += rows.T @ o[mine]
            return [out]

        (sums,) = summed(gram, of_batch)
        held.destroy()
        return own.gram(o) + sums * np.float32(len(q.parts) / passages)

    for _ in range(2):
        basis = np.linalg.qr(product(basis).astype(float))[0].astype(np.float32)
    _, turn = np.linalg.eigh(basis.T.astype(float) @ product(basis))
    v = (basis @ turn).astype(np.float32)
    low = own.times(v) * own.norms[:, None]
    # a passage equal to the part has the unit vector low / norm, so the product is 1
    return Space(idf, (idf[:, None] * v).astype(np.float32), (low * (own.norms / ((low**2).sum(1) + 1e-9))[:, None]).astype(np.float32))


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over `a`."""
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if w in masks:
            u = v & masks[w]
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Finder:
    """Windows of documents that are near to parts in the latent space, and the checks of their words."""

    def __init__(self, q: Queries, space: Space, cosine: float, copied: float, reworded: float):
        self.item, self.words, self.answer = q.item, [p.tolist() for p in q.parts], [a.tolist() for a in q.answer]
        self.space, self.cosine, self.copied, self.reworded = space, cosine, copied, reworded
        self.none, self.square = len(q.vocabulary), space.idf**2
        sizes, below, self.classes = np.array([len(p) for p in q.parts]), 0, []
        for width, step in WINDOWS.items():  # parts and windows of one width form a class
            which = np.flatnonzero((sizes > below) & (sizes <= width))
            below = width
            if len(which):
                gain = space.vectors @ space.parts[which].T  # what a word adds to the similarity of a window and a part
                holds = np.zeros(gain.shape, np.float32)
                for k, p in enumerate(which):
                    holds[q.parts[p], k] = 1
                # distinct words of the part that any subsequence long enough has
                need = np.ceil(reworded * sizes[which] - 1e-9) - (sizes[which] - holds.sum(0))
                self.classes.append((width, step, which, gain, gain.max(1).astype(float), holds, need))

    def near(self, slots: np.ndarray, ends: np.ndarray):
        """(document, begin and end of a region, part, similarity) of the windows that reach `cosine`, with the words around them.

        The inner product of a window and a part is the sum of those of the window's words, so it is at most the sum of their
        largest ones. Windows for which that stays below `cosine` are passed over, and regions with too few different words
        of the part for the least subsequence; neither loses any.
        """
        begins = np.concatenate([[0], ends[:-1]])
        (hit,) = np.nonzero(slots < self.none)
        kept, at = slots[hit], np.concatenate([[0], np.cumsum(slots < self.none)])
        squares = np.concatenate([[0.0], np.cumsum(self.square[slots])])
        for width, step, which, gain, most, holds, need in self.classes:
            n = np.maximum(1, -(-(ends - begins - width) // step) + 1)
            doc = np.repeat(np.arange(len(ends)), n)
            first = begins[doc] + step * ranges(np.zeros(len(n), np.int64), n)
            last = np.minimum(first + width, ends[doc])
            lo, hi, length = at[first], at[last], np.sqrt(squares[last] - squares[first])
            bound = np.concatenate([[0.0], np.cumsum(most[kept])])
            live = np.flatnonzero((hi > lo) & (bound[hi] - bound[lo] >= self.cosine * length - 1e-6))
            for some in np.array_split(live, 1 + len(live) // 1000):
                if not len(some):
                    continue
                n = hi[some] - lo[some]
                near = np.add.reduceat(gain[kept[ranges(lo[some], n)]], np.cumsum(n) - n, axis=0) / length[some][:, None].astype(np.float32)
                row = np.flatnonzero((near >= self.cosine).any(1))
                if not len(row):
                    continue
                some, near = some[row], near[row]
                left, right = np.maximum(begins[doc[some]], first[some] - width // 2), np.minimum(ends[doc[some]], last[some] + width // 2)
                n = at[right] - at[left]
                words = np.unique(np.repeat(np.arange(len(some)), n) * (self.none + 1) + kept[ranges(at[left], n)])
                number, words = np.divmod(words, self.none + 1)
                common = np.add.reduceat(holds[words], np.searchsorted(number, np.arange(len(some))), axis=0)
                for row, p in zip(*np.nonzero((near >= self.cosine) & (common >= need))):
                    yield int(doc[some[row]]), int(left[row]), int(right[row]), int(which[p]), float(near[row, p])

    def leaks(self, slots: np.ndarray, ends: np.ndarray):
        """(document, item) -> best (common share, similarity, answered)"""
        found: dict = {}
        for doc, left, right, part, near in self.near(slots, ends):
            w = self.words[part]
            share = common_subsequence(w, slots[left:right].tolist()) / len(w)
            if share >= self.reworded:
                goal = self.answer[part]
                answered = common_subsequence(goal, slots[left : min(ends[doc], right + len(goal) + MOST_WORDS)].tolist()) >= 0.8 * len(goal)
                key, new = (doc, self.item[part]), (round(share, 4), round(near, 4), answered)
                if (share >= self.copied or answered) and new > found.get(key, ()):
                    found[key] = new
        return found


def search(slots: DataFrame, q: Queries, space: Space, cosine: float, copied: float, reworded: float, words: int = 1 << 19) -> DataFrame:
    """(doc_id, item_id, similarity, common_share, answered) of each leak, the best part for each pair."""
    held = slots.sparkSession.sparkContext.broadcast((q, space))

    def run(batches):
        finder = Finder(*held.value, cosine, copied, reworded)
        for batch in batches:
            ids, column, out = batch.column(0), batch.column(1), []
            ends, values = column.offsets.to_numpy(), column.values.to_numpy()
            k = 0
            while k < len(ids):  # documents of about `words` words at a time
                stop = max(k + 1, int(np.searchsorted(ends, ends[k] + words)) - 1)
                found = finder.leaks(values[ends[k] : ends[stop]], (ends[k + 1 : stop + 1] - ends[k]).astype(np.int64))
                out += [(ids[k + int(doc)].as_py(), item, near, share, answered) for (doc, item), (share, near, answered) in found.items()]
                k = stop
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names=[f.split()[0] for f in FOUND.split(", ")])

    return slots.filter("size(slots) > 0").select("doc_id", "slots").mapInArrow(run, FOUND)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: int = 256, cosine: float = 0.3, copied: float = 0.7, reworded: float = 0.5, answer_words: int = 5, item_block: int = 1000
) -> DataFrame:
    """doc_id, item_id, similarity, common_share, answered: each document that holds a benchmark passage, with the item.

    Words are runs of letters, digits and underscores without case, known by 64-bit hashes. Every document is read once and
    written as its benchmark words by place; frequencies and the latent space come from all passages of all documents. Items, cut into parts of at most
    MOST_WORDS words, and overlapping windows of every whole text, as long as the part or the next width of WINDOWS, are compared
    in a latent space of `dims` dimensions (`fit_space`). Windows with a similarity of at least `cosine` to a part are checked
    on their words: it is a leak when the longest common subsequence covers `copied` of the part, or `reworded` of it while
    the item's last `answer_words` words follow too (4 of 5 in order). Items come to the driver in blocks of about
    `item_block`, each block a pass over the documents with a space of its own.

    Null and empty texts and items match nothing. Repeated rows give repeated results; rows with a null id are returned with
    null. Items with equal texts are all reported. Extra columns are ignored. No rows in, no rows out.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    out = texts.sparkSession.createDataFrame([], FOUND)
    blocks = math.ceil(items.count() / item_block)
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about item_block rows
        q = queries_of([(r.item_id, r.text) for r in rows], answer_words)
        if q.item:
            slots = slots_of(texts, q)
            space = fit_space(q, slots, *inverse_frequencies(slots, len(q.vocabulary)), dims)
            out = out.unionByName(search(slots, q, space, cosine, copied, reworded))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that hold a benchmark passage, all columns as they are.

    Each row is judged by its own text: the search runs over a key of id and text, so rows that share an id, or have none, do
    not share a fate. Equal rows stay or go together. Null and empty texts stay. No rows in, no rows out.
    """
    key, leaky = free_names(docs, "row_key", "leaky_key")
    rows = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("bigint"), whole(F.col(text_col))))
    bad = leaks(rows.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text")), benchmark).select(F.col("doc_id").alias(leaky)).distinct()
    return rows.join(bad, F.col(key) == F.col(leaky), "left_anti").select(*docs.columns)
