"""Periodic runs: stretches of words that repeat with a period, found inside repeated k-grams only."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole
from .words import Sums

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def overlap(least: int, times: int) -> int:
    """Words that a run of any period q shares at least with itself moved by q: the smallest max(least, times * q) - q."""
    return min(max(least, times * q) - q for q in range(1, least + 2))


def survivors(words: list[bytes], k: int) -> list[tuple[int, int]]:
    """The segments of words that lie in a k-gram which occurs again in the document.

    Each word of a run lies in a k-gram that occurs again one period on or back, if k is `overlap`, so no run leaves these segments.
    K-grams are compared by hash: a chance hit can only make a segment longer.
    """
    n = len(words)
    if n <= k:
        return []
    at = np.arange(n - k + 1)
    grams = Sums(np.fromiter(map(hash, words), np.int64, n).view(np.uint64)).of(at, at + k)
    ordered = np.sort(grams)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return []
    begin = np.flatnonzero(np.isin(grams, again))
    step = np.bincount(begin, minlength=n + 1) - np.bincount(begin + k, minlength=n + 1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(step) > 0).view(np.int8)]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def z_values(s: list[int]) -> list[int]:
    """For each place, how many elements from there on equal the beginning."""
    n, left, right = len(s), 0, 0
    z = [n] + [0] * (n - 1)
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def z_matches(p: list[int], z: list[int], t: list[int], upto: int) -> list[int]:
    """For each place of `t` before `upto`, how many elements from there on equal the beginning of `p`, whose `z_values` are z."""
    m, n, left, right, out = len(p), len(t), 0, 0, [0] * upto
    for i in range(upto):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while k < m and i + k < n and p[k] == t[i + k]:
                k += 1
            left, right = i, i + k
        out[i] = k
    return out


def across(a: list[int], lo: int, mid: int, hi: int, times: int, mirrored: bool = False):
    """(start, end, period) of the stretches in a[lo:hi] that cross `mid`, have at least a period behind it and `times` periods in all.

    For each period q: how far a[mid:] equals a[mid+q:] forwards, and a[:mid] equals a[:mid+q] backwards.
    """
    u, v = a[lo:mid], a[mid:hi]
    most = min(len(v), (hi - lo) // times)
    ahead = z_values(v)
    back_u = u[::-1]
    behind = z_matches(back_u, z_values(back_u), v[:most][::-1] + back_u, most)
    for q in range(1, most + 1):
        back, on = behind[most - q], ahead[q] if q < len(v) else 0
        if back + on >= (times - 1) * q:
            yield (mid - back, mid + q + on, q) if not mirrored else (len(a) - mid - q - on, len(a) - mid + back, q)


def runs_of(words: list[bytes], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal runs, by start, then period: at least `least` words and `times` periods.

    Main and Lorentz's division on each surviving segment: what crosses the middle is found from common extensions in linear
    time, then both halves are searched in the same way. A stretch that still goes on outside its part is left to the part that
    holds it whole.
    """
    found: dict[tuple[int, int], int] = {}
    for begin, stop in survivors(words, overlap(least, times)):
        if stop - begin < least:
            continue
        numbers: dict[bytes, int] = {}
        a = [numbers.setdefault(w, len(numbers)) for w in words[begin:stop]]
        n, mirror, parts = len(a), a[::-1], [(0, len(a))]
        while parts:
            lo, hi = parts.pop()
            if hi - lo < least:
                continue
            mid = (lo + hi) // 2
            parts += [(lo, mid), (mid, hi)]
            for some in (across(a, lo, mid, hi, times), across(mirror, n - hi, n - mid, n - lo, times, True)):
                for start, end, q in some:
                    if end - start >= least and not (start and a[start - 1] == a[start - 1 + q]) and not (end < n and a[end] == a[end - q]):
                        place = (begin + start, begin + end)
                        found[place] = min(q, found.get(place, q))
    return sorted(((start, end - start, q) for (start, end), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period in words) and collapsed, the text without what runs repeat.

    Words are runs of other than ASCII white space, numbered from 0. A word goes when some run holds it after that run's first
    period; the others are joined by one blank. The work is local to a row: no shuffle, no state beyond one document.

    Null and empty texts have no words, no runs and an empty collapsed text. Ties, null ids and repeated rows are returned as
    they are. Extra columns are ignored. No rows in, no rows out.
    """
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def batch(ids, counts, runs, texts):
        flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
        offsets = np.concatenate([[0], np.cumsum([len(rs) for rs in runs])])
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T.copy()], fields=list(kind)))
        return pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def search(batches):
        for b in batches:
            ids, column = b.column(0), b.column(1).cast(pa.binary())
            counts, runs, texts, size, begin = [], [], [], 0, 0
            for i, text in enumerate(column):
                words = text.as_py().split()
                rs = runs_of(words, least, times)
                counts.append(len(words))
                runs.append(rs)
                for start, length, q in rs:
                    words[start + q : start + length] = repeat(None, length - q)
                texts.append(b" ".join(w for w in words if w is not None) if rs else b" ".join(words))
                size += len(texts[-1])
                if size > 1 << 23:
                    yield batch(ids.slice(begin, i + 1 - begin), counts, runs, texts)
                    counts, runs, texts, size, begin = [], [], [], 0, i + 1
            if counts:
                yield batch(ids.slice(begin), counts, runs, texts)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    return rows.mapInArrow(search, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")
