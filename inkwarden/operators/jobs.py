"""Tenant-scoped tables: templates, jobs, entity types, batches and the privacy budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import stored

EPSILON_REPLACE, EPSILON_SYNTHESIZE = 0.1, 0.5
#: Rows of a block and blocks of a group, as a power of two; states that a budget may have.
BLOCK_BITS, MOST_STATES = 10, 100_000


def list_domains(templates: DataFrame, tenant: int, with_defaults: bool = True) -> DataFrame:
    own = F.col("tenant_id") == tenant
    return templates.filter("is_active").filter(own | F.col("is_platform_default") if with_defaults else own)


def get(rows: DataFrame, key: str, value, tenant: int, tenant_col: str = "tenant_id") -> DataFrame:
    """The tenant's row with this key, at most one; two raise when read."""
    return rows.filter((F.col(key) == value) & (F.col(tenant_col) == tenant)).limit(2)


def one(rows: DataFrame):
    found = rows.take(2)
    if len(found) != 1:
        raise LookupError("not found" if not found else "not unique")
    return found[0]


def list_entity_types(types: DataFrame, tenant: int, enabled_only: bool = True) -> DataFrame:
    rows = types.filter(F.col("tenant_id") == tenant)
    return rows.filter("enabled") if enabled_only else rows


def create_entity_type(spark: SparkSession, types: DataFrame, row: dict) -> DataFrame:
    """`types` with one more row; a pattern that does not compile raises ValueError."""
    for p in row["patterns"]:
        try:
            spark.sql("SELECT regexp_like('', :p)", {"p": p}).first()
        except Exception as e:
            raise ValueError(f"pattern does not compile: {p}") from e
    return types.unionByName(spark.createDataFrame([row], types.schema))


def soft_delete(rows: DataFrame, key: str, value, flag: str = "enabled") -> DataFrame:
    return rows.withColumn(flag, F.when(F.col(key) == value, F.lit(False)).otherwise(F.col(flag)))


def validate_requests(requests: DataFrame) -> DataFrame:
    """`requests` with `problems`, the limits they break; those without any are the valid ones."""
    checks = {
        "text length": ~F.length("text").between(1, 500_000), "max_tokens": ~((F.col("max_tokens") > 0) & (F.col("max_tokens") <= 32768)),
        "temperature": ~F.col("temperature").between(0, 2), "top_p": ~F.col("top_p").between(0, 1), "concurrency": ~F.col("concurrency").between(1, 20),
    }
    found = [F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in checks.items()]
    return requests.withColumn("problems", F.filter(F.array(*found), lambda x: x.isNotNull()))


def in_order(rows: DataFrame, by: str, order: list[str], block_bits: int = BLOCK_BITS) -> DataFrame:
    """`rows` stored with `row`, a number that rises with (by, order), and `block`, which holds at most 2^block_bits neighbours.

    A distributed sort deals them by ranges of (by, order), so one `by` value that has a third of all rows spreads over tasks and
    blocks. Ties get an order once, when the table is written.
    """
    ranged = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("row", F.monotonically_increasing_id())
    return stored(ranged.withColumn("block", F.shiftright("row", block_bits)), "in-order")


def _entries(maps: DataFrame, by: str, start: Column, fan_bits: int) -> DataFrame:
    """(by, block, entry): the state before each block, from the maps (by, block, map) of states to states.

    Up: 2^fan_bits neighbouring maps are composed to one, until each `by` has so few that one row holds them. Down: a group's
    entry goes through its own maps in order. So the scan has a few rounds, and no row holds more than 2^fan_bits maps.
    """
    through = lambda m, state: F.get(m, state)
    levels = [maps]
    while (levels[-1].groupBy(by).count().agg(F.max("count")).first()[0] or 0) > 1 << fan_bits:
        up = levels[-1].groupBy(by, F.shiftright("block", fan_bits).alias("block")).agg(F.sort_array(F.collect_list(F.struct("block", "map"))).alias("m"))
        after = F.aggregate(F.slice("m", 2, 1 << fan_bits), F.col("m")[0]["map"], lambda f, g: F.transform(f, lambda x: through(g["map"], x)))
        levels.append(stored(up.select(by, "block", after.alias("map")), "composed"))

    def down(groups: DataFrame) -> DataFrame:  # (by, m, entry)
        first = F.struct(F.col("entry").alias("state"), F.array().cast("array<int>").alias("seen"))
        step = lambda a, g: F.struct(through(g["map"], a["state"]).alias("state"), F.concat(a["seen"], F.array(a["state"])).alias("seen"))
        states = F.aggregate("m", first, step, lambda a: a["seen"])
        each = groups.select(by, F.explode(F.arrays_zip(F.col("m.block").alias("block"), states.alias("entry"))).alias("x"))
        return each.select(by, F.col("x.block").alias("block"), F.col("x.entry").alias("entry"))

    gathered = F.sort_array(F.collect_list(F.struct("block", "map"))).alias("m")
    found = down(levels[-1].groupBy(by).agg(gathered).withColumn("entry", start))
    for level in reversed(levels[:-1]):
        groups = level.groupBy(by, F.shiftright("block", fan_bits).alias("up")).agg(gathered)
        found = stored(found, "entries").withColumnRenamed("block", "up")
        found = down(groups.join(found, [by, "up"]).select(by, "m", "entry"))
    return stored(found, "entries")


def ledger(uses: DataFrame, cap: float, order: list[str], grain: float = 0.1, by: str = "tenant_id", block_bits: int = BLOCK_BITS, fan_bits: int = BLOCK_BITS) -> DataFrame:
    """`uses` with `allowed` and `spent`: a use is checked against what its tenant has left and consumes it only when it is allowed and succeeds.

    Uses (epsilon, succeeded if the column exists) go in order. A refused or failed use costs nothing, so a later and smaller one may still fit,
    and what is spent is no running sum. Amounts are whole multiples of `grain`. A block of neighbouring uses is a map from what
    was spent before to what is spent after, a table of cap / grain + 1 numbers; maps are composed by a scan (`_entries`), and each block
    is replayed from its entry. No window or task holds a tenant.

    A null epsilon counts as 0 and a null `succeeded` as not succeeded; a null tenant is one of its own. No rows in, no rows out.
    """
    most = round(cap / grain)
    if most > MOST_STATES:
        raise ValueError(f"a budget of {most} grains has too many states; a coarser grain is needed")
    need = F.coalesce(F.round(F.col("epsilon") / grain), F.lit(0)).cast("int")
    done = F.coalesce(F.col("succeeded"), F.lit(False)) if "succeeded" in uses.columns else F.lit(True)
    rows = in_order(uses.select(F.coalesce(F.col(by).cast("string"), F.lit("\x00")).alias("owner"), need.alias("need"), F.when(done, need).otherwise(0).alias("take"), F.struct(*uses.columns).alias("use"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]), "owner", [f"o{i}" for i in range(len(order))], block_bits)
    blocks = rows.groupBy("owner", "block").agg(F.sort_array(F.collect_list(F.struct("row", "need", "take"))).alias("u"))
    after = lambda s, e: F.when(s + e["need"] <= most, s + e["take"]).otherwise(s)
    maps = blocks.select("owner", "block", F.transform(F.sequence(F.lit(0), F.lit(most)), lambda s: F.aggregate("u", s, after)).alias("map"))
    entries = _entries(stored(maps, "budget-maps"), "owner", F.lit(0), fan_bits)
    first = F.struct(F.col("entry").alias("s"), F.array().cast("array<struct<row:bigint,allowed:boolean,spent:int>>").alias("out"))

    def replay(a, e):
        allowed = a["s"] + e["need"] <= most
        spent = F.when(allowed, a["s"] + e["take"]).otherwise(a["s"])
        return F.struct(spent.alias("s"), F.concat(a["out"], F.array(F.struct(e["row"].alias("row"), allowed.alias("allowed"), spent.alias("spent")))).alias("out"))

    judged = blocks.join(entries, ["owner", "block"]).select(F.explode(F.aggregate("u", first, replay, lambda a: a["out"])).alias("x")).select("x.*")
    return rows.select("row", "use").join(judged, "row").select("use.*", "allowed", F.round(F.col("spent") * grain, 6).alias("spent"))


def epsilon(operation: Column) -> Column:
    return F.when(operation == "synthesize", F.lit(EPSILON_SYNTHESIZE)).otherwise(F.lit(EPSILON_REPLACE))


def manifest(results: DataFrame, by: str = "job_id") -> DataFrame:
    """One JSON document a job: {"job_id": ..., "documents": [...]} with documents in order."""
    docs = F.array_sort(F.collect_list(F.struct("document_id", "status")))
    return results.groupBy(by).agg(docs.alias("d")).select(by, F.to_json(F.struct(F.col(by).alias("job_id"), F.col("d").alias("documents"))).alias("manifest"))


def status_after(residuals: Column, error: Column) -> Column:
    return F.when(error.isNotNull() | (residuals > 0), "failed").otherwise("completed")
