"""Repeated passages by hashing paragraphs of words that begin anywhere, gathered into groups by their content."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, looked_up, row_tag, settle

PIECES = "doc_id bigint, tag bigint, at int, words int, start int, stop int, anchor bigint, d0 bigint, d1 bigint"
#: Blocks of scripts that are written without blanks (Thai to Myanmar, Khmer, kana, Han). Each of their letters counts as a word.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
_BLANK_LINE = re.compile(r"\n\s*\n")
#: Odd multipliers of the two polynomial hashes; each is 3 modulo 8, so that powers differ in a low bit.
_BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _kinds() -> np.ndarray:
    """For each code point: 1 for letters, digits and the underscore, 2 for white space, 3 for letters that are words of their own, else 0."""
    kinds = np.fromiter((1 if c.isalnum() or c == "_" else 2 if c.isspace() else 0 for c in map(chr, range(0x110000))), np.uint8, 0x110000)
    for first, last in UNSPACED:
        kinds[first : last + 1] = np.where(kinds[first : last + 1] == 1, 3, kinds[first : last + 1])
    return kinds


@lru_cache(64)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Sums:
    """Polynomial hashes modulo 2^64 of any ranges of a sequence, from its prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        bits = max(10, len(values).bit_length())
        self.inverse = _powers(pow(base, -1, 1 << 64), bits)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(base, bits)[: len(values)], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


class _Words:
    """The words of a text: runs of letters and digits, lower-cased, as two hashes each, with code-point offsets."""

    def __init__(self, text: str):
        low = text.lower()
        if len(low) != len(text):  # one letter grows in lower case
            low = text.replace("İ", "i").lower()
        code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[code]
        run, alone = np.concatenate([[False], kind == 1, [False]]), kind == 3
        self.starts = np.flatnonzero(run[1:-1] & ~run[:-2] | alone)
        self.stops = np.flatnonzero(run[1:-1] & ~run[2:] | alone) + 1
        self.blanks, self.length = np.flatnonzero(kind == 2), len(code)
        self.n = len(self.starts)
        value = _mix(code.astype(np.uint64), 1)
        self.hashes = [_mix(_Sums(value, b).of(self.starts, self.stops), b >> 8) for b in _BASES]
        self.sums = [_Sums(h, b) for h, b in zip(self.hashes, _BASES)]

    def digests(self, first: np.ndarray, last: np.ndarray, salt: int = 2) -> list[np.ndarray]:
        """Two hashes of the words first..last-1."""
        return [_mix(s.of(first, last), salt).view(np.int64) for s in self.sums]

    def offsets(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words first..last-1 begin and end, with the punctuation that white space or an end of the text sets off."""
        ends = np.concatenate([[0], self.stops])
        blank = np.concatenate([[-1], self.blanks, [self.length]])
        start = self.starts[first]
        left = blank[np.searchsorted(blank, start) - 1] + 1
        start = np.where(left >= ends[first], left, start)
        stop = self.stops[last - 1]
        right = blank[np.searchsorted(blank, stop)]
        return start, np.where(right <= np.concatenate([self.starts, [self.length]])[last], right, stop)


def _slid(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    have = 1
    while have < width:
        by = min(have, width - have)
        x, have = np.minimum(x[:-by], x[by:]), have + by
    return x


def _batch(rows):
    """A batch of (doc_id, tag, at, words, start, stop, anchor, d0, d1), all but the id and tag arrays."""
    once = lambda k: pa.array([r[k] for r in rows for _ in range(len(r[2]))], pa.int64())
    many = lambda k, kind: pa.array(np.concatenate([r[k] for r in rows]).astype(np.int64)).cast(kind)
    columns = [once(0), once(1), *[many(k, pa.int32()) for k in range(2, 6)], *[many(k, pa.int64()) for k in range(6, 9)]]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PIECES.split(", ")])


def _paragraphs(text: str, w: _Words, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) words of the paragraphs between blank lines that have `least` words, but fewer than a window."""
    cuts = [m.span() for m in _BLANK_LINE.finditer(text)]
    if not cuts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.searchsorted(w.starts, [0, *[stop for _, stop in cuts]])
    last = np.searchsorted(w.starts, [*[start for start, _ in cuts], len(text)])
    right = (last - first >= least) & (last - first < width)
    return first[right], last[right]


def pieces(docs: DataFrame, id_col: str, text_col: str, width: int, paragraph_words: int) -> DataFrame:
    """All windows of `width` words, in groups, and shorter paragraphs between blank lines as they are.

    A group holds neighbouring windows with the same smallest hash of a few words, its `anchor`: those within the words
    at..at+words-1. Equal windows have equal anchors, whatever surrounds them. d0, d1 are a digest of a row's words.
    """
    gram = max(1, width // 5)

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, tag, text in zip(*[c.to_pylist() for c in batch.columns]):
                w = _Words(text)
                first, last = _paragraphs(text, w, paragraph_words, width)
                if len(first):
                    out.append((doc_id, tag, first, last - first, *w.offsets(first, last), np.zeros_like(first), *w.digests(first, last, 4)))
                if w.n >= width:
                    at = np.arange(w.n - gram + 1)
                    least = _slid(_mix(w.sums[0].of(at, at + gram), 3), width - gram + 1)
                    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                    last = np.concatenate([first[1:], [len(least)]]) + (width - 1)
                    out.append((doc_id, tag, first, last - first, *w.offsets(first, last), least[first].view(np.int64), *w.digests(first, last)))
            if out:
                yield _batch(out)

    return _texts(docs, id_col, text_col, min(width, paragraph_words)).mapInArrow(cut, PIECES)


def _texts(docs: DataFrame, id_col: str, text_col: str, chars: int) -> DataFrame:
    """(id, tag, text) of the rows with so many characters at least."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("__id"), row_tag(text).alias("__tag"), text.alias("__text")).filter(F.length("__text") >= chars)


def single_windows(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """The windows of `groups` (doc_id, tag, at, words), each a row with its own digest; anchors are 0."""
    by_doc = groups.groupBy("doc_id", "tag").agg(F.collect_list("at").alias("at"), F.collect_list("words").alias("words"))

    def cut(batches):
        for batch in batches:
            for doc_id, tag, text, at, words in zip(*[c.to_pylist() for c in batch.columns]):
                w = _Words(text)
                first = np.unique(np.concatenate([np.arange(a, a + n - width + 1) for a, n in zip(at, words)]))
                first = first[first <= w.n - width]
                if len(first):
                    last = first + width
                    yield _batch([(doc_id, tag, first, last - first, *w.offsets(first, last), np.zeros_like(first), *w.digests(first, last))])

    texts = _texts(docs, id_col, text_col, width)
    return texts.join(by_doc, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__tag") == F.col("tag"))).select("__id", "__tag", "__text", "at", "words").mapInArrow(cut, PIECES)


def place_code(doc_id, tag, unit):
    """One decimal that sorts by document, 32 bits of the row's tag, then unit; a null id comes last."""
    wide = lambda x, digits: x.cast(f"decimal({digits},0)")
    row = wide(F.coalesce(doc_id, F.lit(2**63 - 1)), 19) * wide(F.lit(2**32), 10) + wide(tag.bitwiseAND(F.lit(2**32 - 1)), 10)
    return wide(wide(row, 30) * wide(F.lit(2**31), 10) + wide(unit, 10), 38)


def place_doc(place):
    """The document of a place."""
    step = F.lit(str(2**63)).cast("decimal(38,0)")
    doc = ((place - F.pmod(place, step)) / F.lit(str(2**63)).cast("decimal(19,0)")).cast("bigint")
    return F.nullif(doc, F.lit(2**63 - 1))


def with_first(rows: DataFrame, width: int) -> DataFrame:
    """Stored `rows` with keep_doc_id, the document that has the row's digest first, and `repeat`: that place lies before, without overlap of windows."""
    rows = rows.withColumn("place", place_code(F.col("doc_id"), F.col("tag"), F.col("at")))
    firsts = rows.groupBy("d0", "d1").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    compared = looked_up(rows, settle(firsts, "piece-firsts"), ["d0", "d1"], ["doc_id", "tag", "at"]).withColumn("repeat", F.coalesce(F.col("place") - F.col("first") >= F.least(F.lit(width), F.col("words")), F.lit(False)))
    return compared.withColumn("keep_doc_id", place_doc(F.col("first"))).drop("place", "first", "met", "d0", "d1")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 40, paragraph_words: int = 10) -> DataFrame:
    """Spans to remove: doc_id, tag, start, stop (code points of the original text), words, units, keep_doc_id.

    Words are compared in lower case and without what stands between them; of scripts without blanks each letter is a word. The
    units are all paragraphs of `min_words` words, wherever they begin and end, and the shorter ones of `paragraph_words` words or
    more that stand between blank lines; one that occurs before, in an earlier document or further up in the same (without
    overlap), is a repeat. So every verbatim repeat of that many words is found whole, and nothing else is. Repeats that
    touch or overlap form a span. `units` is how many units fit in the span, keep_doc_id the document of an earlier
    occurrence of its longest part.

    Units are compared in two steps. Groups of them (see `pieces`) that occur before as a whole are repeats; inside
    long copies that is all there is. Of the other groups, those whose anchor several of them share are compared unit
    by unit. Groups left out of the second step are represented in it by the first of their kind, so nothing is lost.

    Digests are combined map-side, so a unit that a third of all rows share is one row a task; first occurrences are
    brought back by `looked_up`, which keeps hot digests and anchors from meeting in one task. The last step groups by
    document only. Null and empty texts have none; rows are told apart by id and text (`tag`), so rows that share an id, or have none,
    keep what is theirs; rows repeated whole are no repeats of each other; a null id comes last. Extra columns are ignored. No rows in, no rows out.
    """
    compared = settle(with_first(settle(pieces(docs, id_col, text_col, min_words, paragraph_words), "pieces"), min_words), "compared")
    rest = compared.filter(f"not repeat and words >= {min_words}").select("doc_id", "tag", "at", "words", "anchor")
    kinds = rest.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("words").alias("most")).filter(F.expr(f"n > 1 or most >= {2 * min_words}")).drop("most")
    rest = looked_up(rest, settle(kinds, "anchors"), ["anchor"], ["doc_id", "tag", "at"]).filter("met")
    windows = with_first(settle(single_windows(docs, rest, id_col, text_col, min_words), "windows"), min_words)
    found = compared.filter("repeat").unionByName(windows.filter("repeat")).withColumn("end", F.col("at") + F.col("words"))
    by_doc = Window.partitionBy("doc_id", "tag").orderBy("at", "end")
    before = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", F.when(F.col("at") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    long = F.max("end") - F.min("at")
    spans = runs.groupBy("doc_id", "tag", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), long.cast("bigint").alias("words"), F.greatest(long - (min_words - 1), F.lit(1)).cast("bigint").alias("units"), F.max_by("keep_doc_id", "words").alias("keep_doc_id"))
    return spans.drop("run")


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the spans cut out of their texts, and the cut spans of the original as an array column `removed`."""
    key, tag = free_names(docs, "span_doc", "span_tag")
    by_doc = spans.groupBy(F.col("doc_id").alias(key), F.col("tag").alias(tag)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("removed"))
    text = F.col(text_col)
    fold = F.aggregate(
        "removed",
        F.struct(F.lit("").alias("b"), F.lit(0).alias("p")),
        lambda a, x: F.struct(F.concat(a["b"], F.substring(text, a["p"] + 1, x["start"] - a["p"])).alias("b"), x["stop"].alias("p")),
        lambda a: F.concat(a["b"], F.substring(text, a["p"] + 1, F.length(text))),
    )
    joined = docs.join(by_doc, F.col(id_col).cast("bigint").eqNullSafe(F.col(key)) & (row_tag(text) == F.col(tag)), "left")
    return joined.select(*[F.when(F.col("removed").isNull(), text).otherwise(fold).alias(c) if c == text_col else F.col(c) for c in docs.columns], "removed")
