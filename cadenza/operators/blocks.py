"""Time dealt into blocks with a halo, so that what looks back a few samples needs no window over a whole channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def looking_back(df: DataFrame, at: str, reach: int, keys: tuple[str, ...], values: dict[str, Column], size: int = 4096) -> DataFrame:
    """df with the given columns: aggregates over each row's own and the ``reach`` positions before it (column ``at``), by keys.

    Rows are dealt to blocks of ``size`` positions; the last ``reach`` of a block go to the next one too, where they only serve as
    its past. A window holds one block of one key.
    """
    size = max(size, 16 * reach)
    block = F.expr(f"{at} div {size}")
    dealt = F.when(F.col(at) % size >= size - reach, F.array(block, block + 1)).otherwise(F.array(block)) if reach else F.array(block)
    rows = df.withColumn("__block", F.explode(dealt))
    w = Window.partitionBy(*keys, "__block").orderBy(at).rangeBetween(-reach, 0)
    rows = rows.withColumns({name: c.over(w) for name, c in values.items()})
    return rows.filter(F.col("__block") == block).drop("__block")


def lower_median(rows: DataFrame, keys: tuple[str, ...], value: str, bins: int = 4096, rounds: int = 2) -> DataFrame:
    """(keys, median): the lower median of a column by keys, exact, without gathering a key's values.

    Each round counts the values of a key in ``bins`` equal intervals of what is left of their range and keeps the interval that holds the middle
    one; after the rounds, different values of that interval are counted and ranked.
    """
    left = rows.select(*keys, F.col(value).cast("double").alias("x"))
    n = left.groupBy(*keys).agg(F.expr("(count(x) + 1) div 2").alias("rank"))
    for _ in range(rounds):
        ends = left.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"))
        width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
        left = left.join(ends, list(keys)).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / width * bins))).drop("low", "high")
        at = _ranked(left.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")), n, keys, "bin")
        left = left.join(at.select(*keys, "bin"), [*keys, "bin"]).drop("bin")
        n = at.select(*keys, (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    return _ranked(left.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n")), n, keys, "x").select(*keys, F.col("x").alias("median"))


def _ranked(counts: DataFrame, ranks: DataFrame, keys: tuple[str, ...], by: str) -> DataFrame:
    """The row of counts(keys, by, n) with which the running total reaches the key's rank."""
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))
    return upto.join(ranks, list(keys)).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
