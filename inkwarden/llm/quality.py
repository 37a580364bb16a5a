"""Document quality: ridge regression on random Fourier features of text statistics, with isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, settle, sliced, summed, whole

FEATURES = [
    "log_chars", "log_words", "log_lines", "word_length", "word_length_sd", "long_words", "short_words", "letters", "upper", "digits", "spaces",
    "stops_commas", "symbols", "bars", "non_ascii", "distinct_words", "top_word", "repeat_next", "repeat_pairs", "repeat_lines", "symbol_words", "capital_words",
    "words_per_line", "chars_per_stop", "byte_entropy",
]

_KIND = np.zeros(256, dtype=np.int64)  # 0 other symbol, 1 lower, 2 upper, 3 digit, 4 space, 5 stop or comma, 6 bar, 7 part of a non-ASCII character
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 1, 2, 3
_KIND[[9, 10, 11, 12, 13, 32]], _KIND[[ord(c) for c in ".,;:!?'\"-()"]], _KIND[ord("|")], _KIND[128:] = 4, 5, 6, 7


def statistics(text: str) -> list[float]:
    """FEATURES of a whole text; all zero for the empty one."""
    data = text.encode("utf-8", "replace")
    if not data:
        return [0.0] * len(FEATURES)
    octets = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=octets, minlength=8) / len(data)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    p = octets[octets > 0] / len(data)
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)), float(lengths.mean()), float(lengths.std()), float((lengths > 12).mean()), float((lengths <= 3).mean()),
        kinds[1] + kinds[2] + kinds[7], kinds[2], kinds[3], kinds[4], kinds[5], kinds[0], kinds[6], kinds[7],
        len(counts) / n, max(counts.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n, 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)), sum(not w[-1:].isalnum() and w[-1:] not in ".,;:!?" for w in words) / n, sum(w[:1].isupper() for w in words) / n,
        math.log1p(len(words) / max(1, len(lines))), math.log1p(len(text) / (1 + text.count(".") + text.count("!") + text.count("?"))), float(-(p * np.log(p)).sum()),
    ]


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and an array column `x` of FEATURES, computed from the text alone."""

    def run(batches):
        for batch in sliced(batches):
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(F.col(text_col))).mapInArrow(run, "doc_id bigint, x array<double>")


def fold(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4))


class Model:
    """Standardised statistics -> random Fourier features -> ridge score -> isotonic probability."""

    def __init__(self, mean, scale, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / width, (len(mean), features))
        self.b = rng.uniform(0, 2 * math.pi, features)
        self.theta, self.knots = None, None

    def phi(self, x: np.ndarray) -> np.ndarray:
        """A Gaussian kernel's random Fourier features, and the standardised statistics themselves with a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b), 0.1 * z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.phi(x) @ self.theta

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots)


def isotonic(positions: np.ndarray, rate: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the knots are the blocks' mean positions and rates."""
    blocks: list[list[float]] = []
    for x, y, w in zip(positions, rate, weight):
        blocks.append([x, y, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            x2, y2, w2 = blocks.pop()
            x1, y1, w1 = blocks.pop()
            w = w1 + w2
            blocks.append([(x1 * w1 + x2 * w2) / w, (y1 * w1 + y2 * w2) / w, w])
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def totals(labelled: DataFrame, of_arrays):
    """The sums over all rows of what `of_arrays(x, y)` gives for a batch of them."""
    return summed(labelled.select("x", "y"), lambda x, y: of_arrays(x.flatten().to_numpy().reshape(len(y), -1), y.to_numpy()))


def fit(labelled: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1.0, seed: int = 7, bins: int = 1000) -> Model | None:
    """Fit on `labelled` (x, y, calibrate): the ridge on rows to fit, the isotonic map on the others. None without both classes.

    What reaches the driver are sums whose size depends on `features` and `bins` only.
    """
    fit_rows, held = labelled.filter("not calibrate"), labelled.filter("calibrate")
    first = totals(fit_rows, lambda x, y: [np.array([len(y), y.sum()]), x.sum(0), (x * x).sum(0)])
    if first is None or not 0 < first[0][1] < first[0][0]:
        return None
    n, positive = first[0]
    mean = first[1] / n
    model = Model(mean, np.sqrt(np.maximum(first[2] / n - mean**2, 0)) + 1e-3, features, width, seed)
    balance = (0.5 * n / positive, 0.5 * n / (n - positive))

    def normal(x, y):
        p = model.phi(x)
        w = np.where(y > 0, *balance)[:, None]
        return [p.T @ (w * p), (w * p).T @ (2 * y - 1)]

    gram, right = totals(fit_rows, normal)
    model.theta = np.linalg.solve(gram + ridge * np.eye(len(gram)), right)

    def histogram(x, y):
        k = np.clip(((model.raw(x) + 2) * (bins / 4)).astype(int), 0, bins - 1)
        return [np.bincount(k, minlength=bins).astype(float), np.bincount(k, weights=y, minlength=bins)]

    got = totals(held, histogram) or totals(fit_rows, histogram)
    count, ones = got
    (k,) = np.nonzero(count)
    prior = positive / n
    # half a row of each end keeps the probabilities inside (0, 1)
    at = np.concatenate([[-2.0], (k + 0.5) * (4 / bins) - 2, [2.0]])
    model.knots = isotonic(at, np.concatenate([[0.0], ones[k] / count[k], [1.0]]), np.concatenate([[1 - prior], count[k], [prior]]))
    return model


def fitted(rows: DataFrame, labels: DataFrame) -> tuple[Model | None, float]:
    """(model, known rate) from the statistics of all documents and the labels of the folds that may be learnt from."""
    known = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    part = fold(F.col("doc_id"))
    labelled = settle(rows.join(known, "doc_id").filter(part != 2).select("x", "y", (part == 3).alias("calibrate")), "labelled")
    model = fit(labelled)
    rate = labelled.agg(F.avg("y")).first()[0] if model is None else None
    return model, 1.0 if rate is None else rate


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    The only inputs of a score are statistics of the row's whole text. Labels are learnt from rows whose
    crc32(doc_id as text) mod 4 is 0 or 1 (ridge) and 3 (isotonic map); rows with 2 are held out. Rows without a quality label
    are scored only. Without labels of both classes every row scores the known rate (1 without any label). Null and empty
    texts score like any text without characters. A null id falls in the fold of the empty string. Repeated rows get equal
    scores. Extra columns are ignored. No rows in, no rows out.
    """
    rows = settle(with_statistics(docs, id_col, text_col), "statistics")
    model, rate = fitted(rows, labels)
    held_out = (fold(F.col("doc_id")) == 2).alias("held_out")
    if model is None:
        scored = rows.select("doc_id", held_out, F.lit(rate).alias("score"))
    else:
        held = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            for batch in batches:
                x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.probability(x), pa.float64())], names=["doc_id", "score"])

        scored = rows.mapInArrow(run, "doc_id bigint, score double").select("doc_id", held_out, "score")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """The rows of `docs` that are not rejected, with all their columns, by the scores of `quality_scores`.

    Statistics are computed once and written beside the rows, so no text is shuffled. Nulls, empty texts, repeated rows and
    missing labels are treated as in `quality_scores`; without labels of both classes all rows stay or all go.
    """
    at, (extra,) = docs.columns.index(text_col), free_names(docs, "statistics")
    measured = T.StructType([*docs.schema.fields, T.StructField(extra, T.ArrayType(T.DoubleType()))])

    def measure(batches):
        for batch in sliced(batches):
            x = pa.array([statistics(t or "") for t in batch.column(at).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, x], names=[*batch.schema.names, extra])

    rows = settle(docs.mapInArrow(measure, measured), "measured")
    model, rate = fitted(rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(extra).alias("x")), labels)
    if model is None:
        return docs if rate >= cut else docs.limit(0)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(held.value.probability(x) >= cut))

    return rows.mapInArrow(run, docs.schema)
