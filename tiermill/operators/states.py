"""Quality states: what each batch adds to the checks, so that a run over everything reads small states only.

Counts of row-level checks add up. Means and squared deviations are merged by Chan's formula. Rows beyond three deviations
depend on the merged limits, so the states keep counts of amounts in bins of growing width: whole bins lie within or beyond
the limits, and the amounts themselves are read for the one bin that each limit falls in. A key is a failure from its second
row on, so a batch's keys are looked up among the stored ones of their slices once, when the batch comes.

A batch that comes again replaces its own states; then batches after it must come again, too, as for their keys it counts what
was there. Row-level checks judge a row as of the run that brings it.
"""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermill.operators import quality
from tiermill.reference import DATE_FLOOR
from tiermill.session import stored
from tiermill.sources.tables import Folder, replace_partitions

AMOUNT = "net_amount_usd"
BINS_PER_OCTAVE = 8
TABLES = ["checks", "moments", "bins", "amounts", "keys", "unique"]


def amount_bin(value: Column) -> Column:
    """Number of an amount's bin; larger amounts never have a smaller one."""
    size = F.floor(F.log2(F.abs(value) + 1) * BINS_PER_OCTAVE)
    return F.when(value < 0, -size).otherwise(size).cast("int")


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def add_batch(
    orders: DataFrame,
    root: str,
    batch: int,
    by: list[str],
    run_date: date,
    floor: date = DATE_FLOOR,
    key: list[str] | None = None,
    slices: int = 16,
) -> None:
    """Write the states of one batch of an order frame. Batches are numbered in the order in which they come."""
    key = key or quality.ORDER_KEY
    spark = orders.sparkSession
    needed = dict.fromkeys([*by, *quality.ORDER_COLUMNS, *key, "currency_code", "load_timestamp", "source_region"])
    rows = stored(orders.select(*needed), "batch-orders")

    def write(df: DataFrame, table: str, *partition: str) -> None:
        replace_partitions(df.withColumn("batch", F.lit(batch)), f"{root}/{table}", [*partition, "batch"])

    checks = [*quality.completeness(quality.ORDER_COLUMNS), *quality.validity(run_date, floor), *quality.timeliness(), *quality.consistency()]
    write(quality.counted(rows, by, checks), "checks")
    value = F.col(AMOUNT).cast("double")
    write(
        rows.groupBy(*by).agg(
            F.count("*").alias("rows"), F.count(value).alias("n"), F.avg(value).alias("mean"),
            (F.coalesce(F.var_pop(value), F.lit(0.0)) * F.count(value)).alias("m2"),
        ),
        "moments",
    )
    binned = rows.where(F.col(AMOUNT).isNotNull()).select(*by, AMOUNT, amount_bin(value).alias("bin"))
    write(binned.groupBy(*by, "bin").agg(F.count("*").alias("n")), "bins")
    write(binned, "amounts", "bin")
    slice_ = F.pmod(F.xxhash64(*key), F.lit(slices)).cast("int").alias("slice")
    keys = stored(rows.groupBy(*by, *key, slice_).agg(F.count("*").alias("n")), "batch-keys")
    earlier = None
    if Folder(spark, f"{root}/keys").exists():
        known = spark.read.parquet(f"{root}/keys").where(F.col("batch") < batch)
        names = [*by, *key, "slice"]
        seen = known.groupBy(*names).agg(F.sum("n").alias("_before")).withColumnsRenamed({c: f"_{c}" for c in names})
        earlier = keys.join(seen, _same(names, [f"_{c}" for c in names]), "left").select(*keys.columns, F.coalesce("_before", F.lit(0)).alias("_before"))
    earlier = earlier if earlier is not None else keys.withColumn("_before", F.lit(0))
    write(keys, "keys", "slice")
    became = (F.col("_before") <= 1) & (F.col("_before") + F.col("n") > 1)
    write(earlier.groupBy(*by).agg(F.sum("n").alias("total"), F.count_if(became).alias("failed")), "unique")


def limits(root: str, spark: SparkSession, by: list[str]) -> DataFrame:
    """Rows, mean and sample deviation of each group over all batches (Chan's formula, all batches of a group at once)."""
    parts = spark.read.parquet(f"{root}/moments")
    means = parts.groupBy(*by).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_mean"))
    means = means.withColumnsRenamed({c: f"_{c}" for c in by})
    gap = F.coalesce(F.col("mean") - F.col("_mean"), F.lit(0.0))
    merged = parts.join(means, _same(by, [f"_{c}" for c in by])).groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max("_mean").alias("mu"),
        F.sum(F.col("m2") + F.col("n") * gap * gap).alias("m2"),
    )
    spread = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return merged.select(
        *by, "rows", F.coalesce("mu", F.lit(0.0)).alias("mu"), F.when(spread.isNull() | (spread == 0), F.lit(1.0)).otherwise(spread).alias("sigma")
    )


def _outliers(root: str, spark: SparkSession, by: list[str]) -> DataFrame:
    """Rows of each group and those beyond three deviations."""
    edges = [F.col("mu") - 3 * F.col("sigma"), F.col("mu") + 3 * F.col("sigma")]
    bound = limits(root, spark, by).withColumns({"low": amount_bin(edges[0]), "high": amount_bin(edges[1])})
    bound = stored(bound, "limits").withColumnsRenamed({c: f"_{c}" for c in by})
    mine = _same(by, [f"_{c}" for c in by])
    whole = spark.read.parquet(f"{root}/bins").join(bound, mine)
    beyond = whole.where((F.col("bin") < F.col("low")) | (F.col("bin") > F.col("high"))).groupBy(*by).agg(F.sum("n").alias("failed"))
    # Two bins a group; there are few bins, however many groups.
    needed = sorted({b for r in bound.select("low", "high").distinct().collect() for b in (r.low, r.high)})
    near = spark.read.parquet(f"{root}/amounts").where(F.col("bin").isin(needed)).join(bound, mine)
    far = F.abs(F.col(AMOUNT).cast("double") - F.col("mu")) > 3 * F.col("sigma")
    at_edge = (F.col("bin") == F.col("low")) | (F.col("bin") == F.col("high"))
    within = near.where(at_edge & far).groupBy(*by).agg(F.count("*").alias("failed"))
    every = bound.select(*[F.col(f"_{c}").alias(c) for c in by], "rows", F.lit(0).cast("long").alias("failed"))
    none = F.lit(0).cast("long").alias("rows")
    parts = every.unionByName(beyond.withColumn("rows", none)).unionByName(within.withColumn("rows", none))
    return parts.groupBy(*by).agg(F.sum("rows").alias("_total"), F.sum("failed").alias("_failed"))


def results(
    spark: SparkSession, root: str, by: list[str], table: str = "SALES_ORDER", key: list[str] | None = None, min_rows: int = quality.MIN_ROWS_FOR_SIGMA
) -> DataFrame:
    """What ``quality.run_all`` gives over all batches at once."""
    names = [*by, "dama_dimension", "rule_name", "_policy", "_empty_rate"]
    checks = spark.read.parquet(f"{root}/checks").groupBy(*names).agg(F.sum("_total").alias("_total"), F.sum("_failed").alias("_failed"))
    sigma = _outliers(root, spark, by).where(F.col("_total") > min_rows).withColumns(quality.labels(quality.sigma_check(AMOUNT)))
    unique = spark.read.parquet(f"{root}/unique").groupBy(*by).agg(F.sum("total").alias("_total"), F.sum("failed").alias("_failed"))
    unique = unique.withColumns(quality.labels(quality.unique_check(key or quality.ORDER_KEY)))
    every = checks.unionByName(sigma.select(*checks.columns)).unionByName(unique.select(*checks.columns))
    return quality.outcome(every, by, table)
