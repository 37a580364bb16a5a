"""Set-similarity self-join of texts: every pair of different word sets above a Jaccard threshold."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import latin_words
from ..sources.files import stored

#: The threshold as a fraction, so that all bounds are whole numbers.
AT_LEAST = Fraction(85, 100)
MOST_HOT = 1000
#: Sets that share a prefix word meet in cells of about two chunks of so many; a cell of the verification holds two blocks of BLOCK.
CHUNK, BLOCK = 1000, 500
#: Rows of a cell's small groups that are compared together, and pairs whose bits are counted at a time.
PACK, PAIRS = 64, 4096


def word_sets(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(row, id, words, set_key): distinct words and a digest of them; rows without words are left out, since they are like nothing.

    The table is stored, and `row` numbers it.
    """
    sets = rows.select(F.col(id_col).alias("id"), F.sort_array(latin_words(F.col(text_col))).alias("words")).filter(F.size("words") > 0)
    return stored(sets.select(F.monotonically_increasing_id().alias("row"), "id", "words", F.unhex(F.sha2(F.array_join("words", " "), 256)).alias("set_key")), "word-sets")


def set_classes(sets: DataFrame) -> DataFrame:
    """(set_key, v, class_id, class_size): rows with equal word sets are one class. v is its first row, class_id its smallest id."""
    return stored(sets.groupBy("set_key").agg(F.min("row").alias("v"), F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "set-classes")


def prefix_length(n: Column, at_least: Fraction) -> Column:
    """A set of n words shares one of its first n - ceil(t n) + 1 words, in any order that is the same for all, with each set it is alike to."""
    return n - F.ceil(n * at_least.numerator / F.lit(at_least.denominator)).cast("int") + 1


def shared_needed(na: Column, nb: Column, at_least: Fraction) -> Column:
    """Words that sets of these sizes share at least: the ceiling of t (na + nb) / (1 + t), in whole numbers."""
    num, den = at_least.numerator, at_least.numerator + at_least.denominator
    return F.floor(((na + nb) * num + (den - 1)) / F.lit(den)).cast("int")


def numbered_rows(counts: DataFrame) -> DataFrame:
    """`counts` with its row numbers `no` made gapless, and integers where that many fit; words seen once have negative ones in the same order."""
    part = F.shiftright("no", 33)
    sizes = sorted((r.p, r.n) for r in counts.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    starts, total = [], 0
    for p, n in sizes:
        starts += [F.lit(p), F.lit(total).cast("bigint")]
        total += n
    if not starts:
        return counts.withColumn("no", F.col("no").cast("int"))
    gapless = F.element_at(F.create_map(*starts), part) + F.col("no").bitwiseAND((1 << 33) - 1)
    fits = total < 1 << 31
    return counts.withColumn("no", (gapless - F.when(F.col("seen") == 1, F.lit(1 << 31 if fits else 1 << 62)).otherwise(0)).cast("int" if fits else "bigint"))


def by_rarity(sets: DataFrame, most_hot: int = MOST_HOT, without: DataFrame | None = None) -> DataFrame:
    """(v, words): each set (v, words) as word numbers from the rarest word to the most frequent, ties by the word.

    Words are numbered in that order by a distributed sort, so a set's words are ordered as plain numbers, equal words are equal
    numbers, and no later step carries strings. Words of one set only have negative numbers. Words that more than one in `most_hot` of all places hold are fewer than
    `most_hot`; they are broadcast. The others meet their numbers by a join that no word can dominate any more.
    Sets whose v is in `without` are counted and then left out, where they are rows of numbers.
    """
    places = sets.select("v", F.explode("words").alias("word"))
    seen = stored(places.groupBy("word").agg(F.count(F.lit(1)).alias("seen")), "word-counts")
    counts = numbered_rows(stored(seen.orderBy("seen", "word").withColumn("no", F.monotonically_increasing_id()), "word-numbers"))
    total = counts.agg(F.sum("seen")).first()[0] or 0
    hot = F.col("seen") * most_hot > total
    marked = places.join(F.broadcast(counts.filter(hot).select("word", F.col("no").alias("hot_no"))), "word", "left")
    rare = marked.filter("hot_no IS NULL").select("v", "word").join(counts.filter(~hot).select("word", "no"), "word").select("v", "no")
    numbered = marked.filter("hot_no IS NOT NULL").select("v", F.col("hot_no").alias("no")).unionByName(rare)
    ordered = numbered.groupBy("v").agg(F.sort_array(F.collect_list("no")).alias("words"))
    return stored(ordered if without is None else ordered.join(without, "v", "left_anti"), "rare-first")


def bits(owner: np.ndarray, words: np.ndarray, owners: int) -> np.ndarray:
    """A row of bits for each owner, a bit for each word that more than one has; (owner, word) are distinct."""
    _, at, seen = np.unique(words, return_inverse=True, return_counts=True)
    several = seen > 1
    column = (np.cumsum(several) - 1)[at]
    width = 1 + int(several.sum()) // 64
    out, kept = np.zeros(owners * width, np.uint64), several[at]
    np.add.at(out, owner[kept] * width + column[kept] // 64, np.left_shift(np.uint64(1), (column[kept] % 64).astype(np.uint64)))
    return out.reshape(owners, width)


def in_common(sets: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of bits that the rows i and j of `sets` share, pair by pair."""
    parts = [np.bitwise_count(sets[i[k : k + PAIRS]] & sets[j[k : k + PAIRS]]).sum(1, dtype=np.int64) for k in range(0, len(i), PAIRS)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def candidates(met: pa.RecordBatch, at_least: Fraction) -> pa.RecordBatch:
    """The pairs (va, vb) of whole cells of `set_pairs`, in order of cells."""
    c = {k: met.column(k).to_numpy() for k in ("word", "x", "y", "r", "v", "n", "place", "behind", "last")}
    ends, values = met.column("prefix").offsets.to_numpy(), met.column("prefix").values.to_numpy()
    new = np.append(True, (np.diff(c["word"]) != 0) | (np.diff(c["x"]) != 0) | (np.diff(c["y"]) != 0))
    cell, begins = np.cumsum(new), np.append(np.flatnonzero(new), len(new))
    num, den, out, k = at_least.numerator, at_least.denominator, [], 0
    while k < len(begins) - 1:
        stop = max(k + 1, int(np.searchsorted(begins, begins[k] + PACK, "right")) - 1)
        lo, hi = begins[k], begins[stop]
        k = stop
        if hi - lo < 2 or not (np.diff(cell[lo:hi]) == 0).any():
            continue
        of = {key: x[lo:hi] for key, x in c.items()}
        n, left, mine = of["n"].astype(np.int64), of["n"] - of["place"], cell[lo:hi]
        i, j = np.nonzero(
            (mine[:, None] == mine)
            & ((n[:, None] < n) | ((n[:, None] == n) & (of["v"][:, None] < of["v"])))
            & (n[:, None] * den >= n * num)
            & (np.minimum(left[:, None], left) >= ((n[:, None] + n) * num + num + den - 1) // (num + den))
            & ((of["x"] == of["y"]) | (of["r"][:, None] != of["r"]))
        )
        if not len(i):
            continue
        owner, words = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1])), values[ends[lo] : ends[hi]]
        before = words < of["word"][owner]
        first = in_common(bits(owner[before], words[before], hi - lo), i, j) == 0
        i, j = i[first], j[first]
        behind, last = of["behind"], of["last"]
        most = np.where(last[i] == last[j], np.minimum(behind[i], behind[j]), np.where(last[i] < last[j], behind[i], behind[j]))
        good = in_common(bits(owner, words, hi - lo), i, j) + most >= ((n[i] + n[j]) * num + num + den - 1) // (num + den)
        out.append((of["v"][i[good]], of["v"][j[good]]))
    va, vb = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(va, pa.int64()), pa.array(vb, pa.int64())], names=["va", "vb"])


def set_pairs(ordered: DataFrame, at_least: Fraction = AT_LEAST, chunk: int = CHUNK) -> DataFrame:
    """(va, vb), each once, of the ordered sets (v, words) that may have a Jaccard similarity of `at_least`.

    The prefix filter: two alike sets share one of their first words. Sets meet at each word of their prefix, with the prefix, in
    cells of bounded size: those of a word with more than `chunk` prefixes are dealt into chunks, and any two chunks meet. A pair
    counts only at the first word it shares, so it is made once and needs no grouping; the words behind must still suffice.
    Then the words two prefixes share are counted: of the set whose prefix ends earlier, all other shared words lie behind
    its prefix, so they are no more than it has there.
    """
    n = F.size("words")
    prefix = F.slice("words", F.lit(1), prefix_length(n, at_least))
    shared = F.filter("prefix", lambda w: w >= 0)
    rows = ordered.select("v", n.alias("n"), prefix.alias("prefix")).select("v", "n", (F.col("n") - F.size("prefix")).alias("behind"), F.element_at("prefix", -1).alias("last"), F.size("prefix").alias("length"), shared.alias("prefix"))
    # words of one set come first, so a word's place in the set is its place here and their number
    index = stored(rows.filter(F.size("prefix") > 0), "prefixes")
    seen = index.select(F.explode("prefix").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("seen"))
    many = stored(seen.filter(F.col("seen") > chunk).select("word", F.ceil(F.col("seen") / chunk).cast("int").alias("chunks")), "frequent-prefixes")
    alone = F.col("length") - F.size("prefix")
    places = index.select("v", "n", "behind", "last", "prefix", alone.alias("alone"), F.posexplode("prefix").alias("at", "word"))
    met = places.join(many, "word", "left").withColumn("c", F.coalesce("chunks", F.lit(1)))
    met = met.withColumn("r", F.pmod(F.xxhash64("v"), F.col("c")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    met = met.select("word", F.least("r", "k").alias("x"), F.greatest("r", "k").alias("y"), "r", "v", "n", (F.col("alone") + F.col("at")).alias("place"), "behind", "last", "prefix")

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not table.num_rows:
                continue
            held = table.to_batches()[0]
            same = np.logical_and.reduce([held.column(k).to_numpy() == held.column(k)[-1].as_py() for k in ("word", "x", "y")])
            whole = int(np.argmax(same))  # the last cell may go on
            if whole:
                yield candidates(held.slice(0, whole), at_least)
                held = held.slice(whole)
        if held is not None:
            yield candidates(held, at_least)

    cell = ["word", "x", "y"]
    return stored(met.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "va bigint, vb bigint"), "set-pairs")


def alike_sets(ordered: DataFrame, at_least: Fraction = AT_LEAST, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(va, vb, shared, similarity) of all two of the ordered sets (v, words) with a Jaccard similarity of `at_least`.

    The pairs of `set_pairs` are verified on the full sets in cells: sets are sorted by the first set among those they are paired
    with, so that a family lies in neighbouring places, and cut into blocks; a set goes once to each pair of blocks in which it has
    pairs, and no pair carries a set.
    """
    pairs = set_pairs(ordered, at_least, chunk)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("va").alias("v"), F.col("vb").alias("w")), F.struct(F.col("vb").alias("v"), F.col("va").alias("w")))).alias("e")).select("e.*")
    homes = ends.groupBy("v").agg(F.least("v", F.min("w")).alias("home")).orderBy("home", "v")
    blocks = stored(homes.select("v", F.floor(F.monotonically_increasing_id() / block).alias("block")), "set-blocks")
    side = lambda s, x: blocks.select(F.col("v").alias(f"v{s}"), F.col("block").alias(x))
    dealt = pairs.join(side("a", "p"), "va").join(side("b", "q"), "vb")
    dealt = stored(dealt.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "va", "vb"), "dealt-pairs")
    visits = dealt.select(F.col("x").alias("p"), F.col("y").alias("q"), F.explode(F.array("va", "vb")).alias("v")).distinct()
    num, den = at_least.numerator, at_least.denominator

    def verify(sets: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        v, size = sets["v"].to_numpy(), np.array([len(w) for w in sets["words"]])
        order = np.argsort(v)
        i, j = (order[np.searchsorted(v, pairs[c].to_numpy(), sorter=order)] for c in ("va", "vb"))
        shared = in_common(bits(np.repeat(np.arange(len(v)), size), np.concatenate(list(sets["words"])), len(v)), i, j)
        union = size[i] + size[j] - shared
        out = pd.DataFrame({"va": v[i], "vb": v[j], "shared": shared.astype("int32"), "similarity": shared / union})
        return out[shared * den >= union * num]

    return visits.join(ordered, "v").groupBy("p", "q").cogroup(dealt.groupBy("x", "y")).applyInPandas(verify, "va bigint, vb bigint, shared int, similarity double")


def near_dup_links(rows: DataFrame, id_col: str = "chunk_id", text_col: str = "text", at_least: Fraction = AT_LEAST) -> tuple[DataFrame, DataFrame]:
    """(classes, links). classes: id, class_id, class_size of every row with words. links: a, b, shared, similarity for every two
    classes whose word sets have a Jaccard similarity of `at_least`, a < b.

    Equal sets collapse first, so copies are never paired; the others are joined by `alike_sets`. Frequent words are in no
    prefix but those of sets that have nothing rarer. Work beyond the links themselves is bound by what shares a rare
    word. Of pairs only two numbers are rows; sets are shuffled with their prefixes and once for each pair of blocks.

    Null and empty texts have no words and no row. Rows are told apart by content: repeated ids may have several rows in `classes`. Null ids
    take part; a class of null ids only has a null name and its links are not returned. Extra columns are ignored.
    """
    sets = word_sets(rows, id_col, text_col)
    named = set_classes(sets)
    copies = sets.select("row", "set_key").join(named.filter("class_size > 1").select("set_key", "v"), "set_key").filter("row <> v").select(F.col("row").alias("v"))
    ordered = by_rarity(sets.select(F.col("row").alias("v"), "words"), without=copies)
    name = lambda s: named.select(F.col("v").alias(f"v{s}"), F.col("class_id").alias(f"id{s}"))
    alike = alike_sets(ordered, at_least).join(name("a"), "va").join(name("b"), "vb").filter("ida IS NOT NULL AND idb IS NOT NULL")
    links = alike.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"), "shared", "similarity")
    return sets.select("id", "set_key").join(named, "set_key").select("id", "class_id", "class_size"), links


def link_counts(classes: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each row of `classes`: id, class_id, class_size and links, the number of other classes it is alike to."""
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return classes.join(stored(ends, "link-counts"), "class_id", "left").select("id", "class_id", "class_size", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
