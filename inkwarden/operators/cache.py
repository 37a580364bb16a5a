"""The prompt cache as a table: keys, lookups, misses, eviction and invalidation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import stored
from .retrieve import MOST_QUERIES, MOST_VECTORS, best_in_cells, top_k

TTL, CAPACITY, SIMILAR = 3600, 512, 0.92
#: Width of a ring around a pivot, in radians.
RING = 0.05


def cache_key(prompt: Column, config_json: Column, prefix: str = "prompt") -> Column:
    """prefix : 32 hex digits of the prompt's SHA-256 : 16 of the configuration's (JSON with sorted keys)."""
    return F.concat_ws(":", F.lit(prefix), F.substring(F.sha2(prompt, 256), 1, 32), F.substring(F.sha2(config_json, 256), 1, 16))


def latest(entries: DataFrame) -> DataFrame:
    """The last entry written under each key."""
    return entries.groupBy("cache_key").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "cache_key"]), F.struct("created_at", "entry_id")).alias("e")).select("cache_key", "e.*")


def exact(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests with the response of a live entry under their key; null where there is none."""
    live = latest(entries).select("cache_key", "response", "created_at", "ttl")
    hit = (requests["cache_key"] == live["cache_key"]) & (requests["at"] >= live["created_at"]) & (requests["at"] - live["created_at"] < live["ttl"])
    return requests.join(live, hit, "left").select(*[requests[c] for c in requests.columns], live["response"])


def pivot_vectors(entries: DataFrame, pivots: int) -> np.ndarray:
    """At most `pivots` unit vectors of the entries, picked by hash: what the index is fitted on. They are all that reaches the driver."""
    rows = entries.orderBy(F.xxhash64("entry_id"), "entry_id").limit(pivots).collect()
    if not rows:
        return np.zeros((0, 1))
    found = np.array([r.embedding for r in rows], float)
    norms = np.linalg.norm(found, axis=1)
    return found[norms > 0] / norms[norms > 0, None]


def _angles(batch: pa.RecordBatch, column: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angles to the pivots, norms) of a batch's vectors; a vector of zeros lies at a right angle to all."""
    x = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
    norm = np.linalg.norm(x, axis=1)
    return np.arccos(np.clip(x @ pivots.T / np.where(norm > 0, norm, 1)[:, None], -1, 1)), norm


def pivot_index(entries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Every entry (entry_id, embedding) under its nearest pivot, in the ring of its angle there: pivot, ring, angle, norm.

    Entries with equal vectors are one, the smallest id, which is the one that wins a tie; so many copies are no large ring.
    """

    def place(batches):
        for b in batches:
            if b.num_rows:
                angles, norm = _angles(b, 1, pivots)
                nearest = angles.argmin(1)
                angle = angles[np.arange(len(nearest)), nearest]
                extra = [pa.array(nearest.astype(np.int32)), pa.array((angle / RING).astype(np.int32)), pa.array(angle), pa.array(norm)]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "pivot", "ring", "angle", "norm"])

    distinct = entries.groupBy("embedding").agg(F.min("entry_id").alias("entry_id")).select("entry_id", "embedding")
    return distinct.mapInArrow(place, T.StructType([*distinct.schema.fields, *T.StructType.fromDDL("pivot int, ring int, angle double, norm double").fields]))


def _reached(batch: pa.RecordBatch, pivots: np.ndarray, rings: np.ndarray, longest: np.ndarray, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of a ring) of all rings (pivot, ring) that a request of the batch (request_id, q) has to visit."""
    angles, norm = _angles(batch, 1, pivots)
    with np.errstate(divide="ignore"):
        least = at_least / (norm[:, None] * longest)
    reach = np.where(least > 1 + 1e-6, -1.0, np.arccos(np.clip(least, -1, 1)) + 1e-5)
    at, low = angles[:, rings[:, 0]], rings[:, 1] * RING
    return np.nonzero((at + reach >= low) & (at - reach <= low + RING) & (reach > 0))


def _visits(requests: DataFrame, pivots: np.ndarray, seen: list, at_least: float, places: np.ndarray, names: list[str]) -> DataFrame:
    """(request_id, q, *names): each request with the distinct `places` (a row of numbers for each ring of `seen`) of the rings it visits.

    The triangle inequality of angles: an entry at angle t from its pivot is at least |t - p| from a request at angle p from that pivot,
    so a request visits only rings within its reach, the angle whose cosine, with its norm and the ring's largest, is `at_least`.
    The bound is exact: rings are passed over only where no entry can qualify.
    """
    rings, longest = np.array([(r.pivot, r.ring) for r in seen], int).reshape(-1, 2), np.array([r.norm for r in seen], float)
    kinds, which = np.unique(places, axis=0, return_inverse=True)

    def visit(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):  # so that requests times rings stay few
                b = whole.slice(begin, 256)
                row, ring = _reached(b, pivots, rings, longest, at_least)
                row, kind = np.divmod(np.unique(row * len(kinds) + which.ravel()[ring]), len(kinds))
                picked = [c.take(pa.array(row)) for c in b.columns]
                yield pa.RecordBatch.from_arrays([*picked, *(pa.array(c.astype(np.int32)) for c in kinds[kind].T)], names=[*b.schema.names, *names])

    asked = requests.select("request_id", F.col("embedding").alias("q"))
    return asked.mapInArrow(visit, T.StructType([*asked.schema.fields, *T.StructType.fromDDL(", ".join(f"{n} int" for n in names)).fields]))


def _rings(index: DataFrame) -> list:
    """Which rings exist, how many entries they have and their largest norm: as many rows as pivots times rings at most."""
    return index.groupBy("pivot", "ring").agg(F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")).collect()


def candidates(requests: DataFrame, index: DataFrame, pivots: np.ndarray, at_least: float) -> DataFrame:
    """(request_id, q, entry_id, embedding) of all pairs that can reach a dot of `at_least`, by rings (`_visits`)."""
    seen = _rings(index)
    places = np.array([(r.pivot, r.ring) for r in seen], int).reshape(-1, 2)
    visits = _visits(requests, pivots, seen, at_least, places, ["pivot", "ring"])
    return visits.join(index.select("pivot", "ring", "entry_id", "embedding"), ["pivot", "ring"]).select("request_id", "q", "entry_id", "embedding")


def _bins(seen: list, pivots: int, most: int) -> tuple[list[int], list[int]]:
    """(first bin, number of bins) of each pivot: neighbouring pivots share a bin of about `most` entries, a pivot with more has several."""
    n = np.zeros(pivots, int)
    for r in seen:
        n[r.pivot] += r.n
    first, parts, at, filled = [], [], 0, 0
    for x in n:
        if filled and filled + x > most:
            at, filled = at + 1, 0
        first.append(at)
        parts.append(max(1, int(-(-x // most))))
        filled += int(x)
        if parts[-1] > 1:
            at, filled = at + parts[-1], 0
    return first, parts


def semantic(requests: DataFrame, entries: DataFrame, at_least: float = SIMILAR, pivots: int = 64, most_requests: int = MOST_QUERIES, most_entries: int = MOST_VECTORS) -> DataFrame:
    """(request_id, entry_id, similarity): the most similar entry with a positive dot of at least `at_least`; ties go to the smaller id.

    Equal to a comparison of all pairs. Every entry is indexed under its nearest pivot (`pivot_index`), pivots are packed into bins,
    and a request goes to the bins it can reach an entry in (`_visits`). Requests and entries of a bin meet in cells of about
    `most_requests` by `most_entries`, as matrix products (`retrieve.best_in_cells`); pairs are no rows. Null vectors match nothing.
    """
    entries, requests = (x.filter(F.size("embedding") > 0) for x in (entries.select("entry_id", "embedding"), requests))
    chosen = pivot_vectors(entries, pivots)
    if not len(chosen):
        return requests.limit(0).select("request_id", F.lit(None).cast(entries.schema["entry_id"].dataType).alias("entry_id"), F.lit(0.0).alias("similarity"))
    index = stored(pivot_index(entries, chosen), "pivot-index")
    seen, lots = _rings(index), max(1, -(-requests.count() // most_requests))
    first, parts = _bins(seen, len(chosen), most_entries)
    visits = _visits(requests, chosen, seen, at_least, np.array([(first[r.pivot], parts[r.pivot]) for r in seen], int).reshape(-1, 2), ["bin", "parts"])
    visits = visits.select("request_id", "q", F.explode(F.sequence("bin", F.col("bin") + F.col("parts") - 1)).alias("bin"))
    cell = lambda lot: (F.col("bin").cast("bigint") * lots + lot).alias("cell")
    asked = visits.select(cell(F.pmod(F.xxhash64("request_id"), F.lit(lots))), "request_id", "q")
    of_pivot = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), F.col("pivot") + 1)
    held = index.select((of_pivot(first) + F.pmod(F.xxhash64("entry_id"), of_pivot(parts))).alias("bin"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), "entry_id", "embedding")
    scores = best_in_cells(asked, held.select(cell(F.col("lot")), "entry_id", "embedding"), 1, at_least)
    best = top_k(scores.filter((F.col("score") > 0) & (F.col("score") >= at_least)), "request_id", "entry_id", 1)
    return best.select("request_id", "entry_id", F.col("score").alias("similarity"))


def lookup(requests: DataFrame, entries: DataFrame, at_least: float = SIMILAR) -> DataFrame:
    """request_id, outcome (hit, semantic_hit or miss) and response: exact first, similar only for the rest."""
    first = exact(requests, entries).select("request_id", F.col("response").alias("exact"))
    open_requests = requests.join(first.filter("exact is null").select("request_id"), "request_id", "left_semi")
    near = semantic(open_requests, entries, at_least).join(entries.select("entry_id", F.col("response").alias("similar")), "entry_id")
    rows = first.join(near.select("request_id", "similar"), "request_id", "left")
    return rows.select("request_id", F.when(F.col("exact").isNotNull(), "hit").when(F.col("similar").isNotNull(), "semantic_hit").otherwise("miss").alias("outcome"), F.coalesce("exact", "similar").alias("response"))


def misses(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """The requests still to be generated; a hit is never generated again."""
    return exact(requests, entries).filter("response is null").drop("response")


def evict_lru(accesses: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Keys that stay: the `capacity` last used (key, last_used)."""
    used = accesses.groupBy("cache_key").agg(F.max(F.struct("at", "access_id")).alias("u"))
    return used.orderBy(F.desc("u"), "cache_key").limit(capacity).select("cache_key", F.col("u.at").alias("last_used"))


def invalidate_version(entries: DataFrame, version: str) -> DataFrame:
    return entries.filter(~F.col("template_version").eqNullSafe(F.lit(version)))


def invalidate_keys(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select("cache_key").distinct(), "cache_key", "left_anti")


def metrics(outcomes: DataFrame) -> DataFrame:
    """hits, semantic_hits, misses, hit_rate to four places, and response characters."""
    is_ = lambda x: F.count_if(F.col("outcome") == x)
    rate = F.when(F.count(F.lit(1)) == 0, 0.0).otherwise(F.round((is_("hit") + is_("semantic_hit")) / F.count(F.lit(1)), 4))
    return outcomes.agg(is_("hit").alias("hits"), is_("semantic_hit").alias("semantic_hits"), is_("miss").alias("misses"), rate.alias("hit_rate"), F.coalesce(F.sum(F.length("response")), F.lit(0)).cast("bigint").alias("characters"))



