"""Ranks and running sums over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the first ordering column, of about equally many rows each.
RANGES = 256


def ranged(df: DataFrame, by: Column, out: str = "_b", n: int = RANGES) -> DataFrame:
    """Adds the range that `by` (a number, date or timestamp) falls in: how many of n - 1 quantiles of the table lie below.

    Quantiles come from a mergeable sketch. Their values need not be exact for the order of ranges to be right; equal
    values share a range, and nulls are in the first.
    """
    cuts = df.agg(F.percentile_approx(by, [i / n for i in range(1, n)], 10_000).alias("_q"))  # one row
    return df.crossJoin(F.broadcast(cuts)).withColumn(out, F.size(F.filter("_q", lambda q: q < by))).withColumn(out, F.greatest(F.coalesce(out, F.lit(0)), F.lit(0))).drop("_q")


def running_total(df: DataFrame, value: Column, order: list[Column], out: str, keys: list[str] | None = None, n: int = RANGES) -> DataFrame:
    """Adds the sum of `value` over the rows before a row and itself, by `order`, within `keys` if given.

    Rows are summed within ranges of order[0]; a range begins with the sum of those before it, a running sum over
    at most n rows for each key.
    """
    keys = keys or []
    d = ranged(df.withColumn("_v", value), order[0], "_b", n)
    sums = d.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_b")
    start = sums.withColumn("_o", F.sum("_s").over(w) - F.col("_s")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_rb"), "_o")
    cond = F.col("_b") == F.col("_rb")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.join(start, cond).withColumn(out, F.col("_o") + F.sum("_v").over(local)).select(*df.columns, out)


def ranked(df: DataFrame, order: list[Column], out: str, keys: list[str] | None = None, n: int = RANGES) -> DataFrame:
    """Adds the place of a row from 1, by `order`, within `keys` if given."""
    return running_total(df, F.lit(1).cast("long"), order, out, keys, n)
