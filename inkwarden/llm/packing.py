"""Sum-of-squares packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import settle, sliced, whole

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, lot bigint"
PLACED = PIECES + ", sequence_id bigint, offset bigint"


def pieces_of(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, capacity: int) -> DataFrame:
    """Tokenised documents cut into pieces. Only the id, cut points and a checksum leave the worker; a batch holds few texts."""

    def cut(batches):
        row, task = 0, TaskContext.get().partitionId()
        for batch in sliced(batches):
            enc, out = encoder(path), []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.ids(text)
                ids.append(end_id)
                n, data = len(ids), np.array(ids, dtype="<u4")
                start, piece = 0, 0
                end = n % capacity or min(n, capacity)
                while start < n:
                    row += 1
                    out.append((doc_id, piece, start, end - start, zlib.crc32(data[start:end].tobytes()), zlib.crc32(b"%d %d" % (task, row))))
                    start, end, piece = end, end + capacity, piece + 1
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names="doc_id piece start length ids_crc32 lot".split())

    return docs.select(F.col(id_col).cast("bigint"), whole(F.col(text_col))).mapInArrow(cut, PIECES)


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item by the sum-of-squares rule, largest items first.

    `open_bins[g]` counts bins with g tokens free, 0 < g < capacity. Of the open bins that can take an item it goes to one of the gap
    that leaves the sum of squares of these counts smallest; of equal choices the smallest gap wins. A bin is opened
    only where none can take the item: with items in falling order this keeps the gaps apart without spending bins on it.
    """
    open_bins = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, bins = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), 0
    far = np.iinfo(np.int64).max
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        gap = capacity
        counts = open_bins[size:capacity]
        if counts.any():
            grown = np.where(counts > 0, open_bins[: capacity - size] - counts, far)
            if counts[0]:
                grown[0] = -counts[0]  # the bin closes and no gap takes its place
            gap = size + int(np.argmin(grown))
        if gap == capacity:
            b, bins = bins, bins + 1
        else:
            b = stacks[gap].pop()
            open_bins[gap] -= 1
        where[i], offset[i] = b, capacity - gap
        if gap > size:
            stacks[gap - size].append(b)
            open_bins[gap - size] += 1
    return where, offset


def _filler(base: int, last: bool, capacity: int, tolerance: int):
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        where, offset = place(pdf["length"].to_numpy(), capacity)
        free = capacity - np.bincount(where, weights=pdf["length"].to_numpy()).astype(np.int64)
        kept = last | (free[where] <= tolerance)
        first = (base + int(pdf["block"].iloc[0])) << 24
        return pdf.drop(columns="block").assign(sequence_id=np.where(kept, first + where, -1), offset=offset)

    return fill


def pack(pieces: DataFrame, capacity: int = 1024, block_rows: int = 4096, tolerance: int = 4, rounds: int = 4) -> DataFrame:
    """Place pieces (columns PIECES) into sequences; adds sequence_id and offset.

    Whole-capacity pieces fill a sequence each. The rest are dealt by their lot number into blocks of about `block_rows`
    rows, each packed by itself, so a task's memory does not depend on the input. Sequences with more than `tolerance` free
    tokens are dissolved and their pieces dealt again, until one block takes the rest or `rounds` are over. Every round's
    result is written to the shared folder.
    """
    full = pieces.filter(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest, done, base = pieces.filter(F.col("length") < capacity), [full], 0
    for step in range(rounds):
        blocks = max(1, math.ceil(rest.count() / block_rows))
        last = blocks == 1 or step == rounds - 1

        dealt = rest.withColumn("block", F.pmod(F.xxhash64("lot", F.lit(step)), F.lit(blocks)))
        placed = settle(dealt.groupBy("block").applyInPandas(_filler(base, last, capacity, tolerance), PLACED), f"packed-{step}")
        done.append(placed.filter("sequence_id >= 0"))
        if last:
            break
        rest, base = placed.filter("sequence_id < 0").drop("sequence_id", "offset"), base + blocks
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens by the sum-of-squares rule.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document is its token ids and then
    `end_id`. Longer documents are cut into pieces of `capacity` tokens of which the first may be shorter; others are one
    piece. Null and empty texts are the end id alone. A repeated row is packed again as its own pieces; a null id is kept.
    Extra columns are ignored. No rows in, no rows out.
    """
    pieces = settle(pieces_of(docs, id_col, text_col, path or default_path(), end_id, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
