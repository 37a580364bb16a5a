"""Fine-tuning data: formats, exact splits, adapter settings and adequacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Adapter modules by model family, tried in this order.
LORA_MODULES = {
    "llama": ["q_proj", "v_proj", "k_proj", "o_proj"], "mistral": ["q_proj", "v_proj", "k_proj", "o_proj"], "falcon": ["query_key_value", "dense"],
    "gpt-neox": ["query_key_value", "dense"], "bloom": ["query_key_value", "dense"],
}
DEFAULT_MODULES = ["q_proj", "v_proj"]
SAMPLES_PER_RANK = 50
FORMATS = ("instruct", "alpaca", "sharegpt")


def formatted(samples: DataFrame, kind: str = "instruct") -> DataFrame:
    """sample_id and the record of each sample with an output (its text where output is empty); others are left out."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in samples.columns else F.lit("")
    output = F.when(text("output") != "", text("output")).otherwise(text("text"))
    rows = samples.select("sample_id", text("instruction").alias("instruction"), text("input").alias("input"), output.alias("output")).filter("output <> ''")
    if kind != "sharegpt":
        return rows
    asked = F.when(F.col("instruction") != "", F.trim(F.concat("instruction", F.lit("\n\n"), "input"))).when(F.col("input") != "", F.col("input")).otherwise(F.col("output"))
    asked = F.regexp_replace(asked, r"^\s+|\s+$", "")
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    return rows.select("sample_id", F.array(turn("human", asked), turn("gpt", F.col("output"))).alias("conversations"))


def split(records: DataFrame, validation: float = 0.1, seed: int = 42, id_col: str = "sample_id") -> DataFrame:
    """`records` with `split`: exactly max(1, floor(n (1 - v))) train rows, the ones with the least hash of (seed, id).

    The cut is found from counts of hash prefixes, so no task sorts all rows: only the prefix in which it falls is ranked.
    """
    if not 0 <= validation <= 0.5:
        raise ValueError("validation share must lie in [0, 0.5]")
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")), 256)
    rows = records.withColumn("__h", h).withColumn("__p", F.substring("__h", 1, 3))
    counts = sorted((r["__p"], r["count"]) for r in rows.groupBy("__p").count().collect())  # 4096 rows at most
    n = sum(c for _, c in counts)
    left, at = max(1, int(n * (1 - validation))), "zzz"
    for p, c in counts:
        if left <= c:
            at = p
            break
        left -= c
    inside = rows.filter(F.col("__p") == at).select("__h").orderBy("__h").limit(left).agg(F.max("__h")).first()[0] if n else None
    return rows.withColumn("split", F.when(F.col("__h") <= F.lit(inside), "train").otherwise("validation")).drop("__h", "__p")


def lora_modules(model: Column) -> Column:
    out, name = None, F.lower(model)
    for family, modules in LORA_MODULES.items():
        value = F.array(*[F.lit(m) for m in modules])
        out = F.when(F.contains(name, F.lit(family)), value) if out is None else out.when(F.contains(name, F.lit(family)), value)
    return out.otherwise(F.array(*[F.lit(m) for m in DEFAULT_MODULES]))


def adequacy(splits: DataFrame, rank: int = 16) -> DataFrame:
    """train and validation counts, and whether each is enough for an adapter of this rank."""
    train, val = F.count_if(F.col("split") == "train"), F.count_if(F.col("split") == "validation")
    return splits.agg(train.alias("train"), val.alias("validation"), (train >= SAMPLES_PER_RANK * rank).alias("train_enough"), (val >= 10).alias("validation_enough"))


def write_jsonl(splits: DataFrame, path: str) -> None:
    """One JSON line a record under path/train and path/validation; other than ASCII stays as it is."""
    for name in ("train", "validation"):
        splits.filter(F.col("split") == name).drop("split").write.mode("overwrite").json(f"{path}/{name}")
