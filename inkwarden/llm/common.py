"""Helpers shared by the training-data operators: scratch tables and small text rules."""

from __future__ import annotations

import io
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}

#: The six ASCII white-space characters, U+0020 and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\f\r"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where none is set, a temporary one in local mode and an error on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="inkwarden-")
    return "file://" + _LOCAL_DIRS[app]


def settle(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: the lineage ends in files that outlive executors.

    A narrow frame, of a few numbers a row, gets a file for eight shuffle partitions.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores behind it as make it differ from all columns of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_tag(text: Column) -> Column:
    """64 bits of the text: with its id, what tells a row from others. Rows with equal ids and texts are alike in every respect that counts."""
    return F.xxhash64(whole(text))


def order_code(primary: Column, doc_id: Column) -> Column:
    """One decimal that sorts by `primary` descending, then `doc_id` ascending (its maximum is the winner).

    A decimal sits in a hash aggregate's mutable buffer, where a struct would force a sort. A null id ranks last.
    """
    step = F.lit("18446744073709551616").cast("decimal(20,0)")
    last = F.lit(2**63 - 1)
    return (primary.cast("decimal(10,0)") * step - F.coalesce(doc_id.cast("bigint"), last).cast("decimal(19,0)")).cast("decimal(38,0)")


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], deal: list[str], most_hot: int = 1000) -> DataFrame:
    """Left join of `rows` with `found`, which is stored, unique by `keys` and counts in `n` the rows each of its own meets.

    Keys of more than one in `most_hot` of the rows counted are less than `most_hot` many; they are broadcast, and the rows
    that meet them are dealt by the columns `deal`, so that no task receives a hot key.
    """
    others = [c for c in found.columns if c not in (*keys, "n")]
    hot = F.col("n") * most_hot > (found.agg(F.sum("n")).first()[0] or 0)
    renamed = lambda df, by: df.select(*[F.col(c).alias(f"__{by}_{c}") for c in [*keys, *others]], F.lit(True).alias(f"__{by}"))
    on = lambda by: [F.col(k) == F.col(f"__{by}_{k}") for k in keys]
    rows = rows.join(F.broadcast(renamed(found.filter(hot), "hot")), on("hot"), "left")
    rows = rows.withColumn("__deal", F.when(F.col("__hot"), F.xxhash64(*deal)).otherwise(F.lit(0)))
    cold = renamed(found.filter(~hot), "cold").withColumn("__none", F.lit(0).cast("bigint"))
    rows = rows.join(cold, [*on("cold"), F.col("__deal") == F.col("__none")], "left")
    own = [c for c in rows.columns if not c.startswith("__")]
    return rows.select(*own, *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in others], F.coalesce("__hot", "__cold", F.lit(False)).alias("met"))


def sliced(batches, rows: int = 256):
    """The batches in slices of at most so many rows, so that a worker turns few texts into Python strings at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def summed(rows: DataFrame, of_batch, fan_in: int = 32) -> list[np.ndarray] | None:
    """Add up the arrays that `of_batch(*arrow columns)` gives, in each task first, then in rounds of `fan_in` sums a task.

    No task reads more than `fan_in` sums and the driver gets one, whose size does not depend on the input; None without rows.
    """

    def pack(sums):
        with io.BytesIO() as f:
            np.savez(f, *sums)
            return pa.RecordBatch.from_arrays([pa.array([f.getvalue()], pa.binary())], names=["sums"])

    def unpack(data):
        with np.load(io.BytesIO(data)) as f:
            return [f[k] for k in f.files]

    def total(found):
        sums = None
        for new in found:
            sums = new if sums is None else [a + b for a, b in zip(sums, new)]
        if sums is not None:
            yield pack(sums)

    def partial(batches):
        return total(of_batch(*b.columns) for b in batches if b.num_rows)

    def merge(batches):
        return total(unpack(x.as_buffer()) for b in batches for x in b.column(0))

    parts = rows.mapInArrow(partial, "sums binary")
    tasks = rows.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        parts = parts.repartition(tasks).mapInArrow(merge, "sums binary")
    out = parts.collect()
    return unpack(bytes(out[0].sums)) if out else None
