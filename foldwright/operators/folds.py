"""Seeded folds: every row in exactly one, balanced, and the same for the same seed and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.scalars import seeded

#: Ranges of the hash whose rows are ranked apart, so that no task sorts the whole table.
RANGES = 4096


def hash_ranked(df: DataFrame, id_col: str, seed: int, by: str | None = None, out: str = "rank") -> DataFrame:
    """Adds the rank (from 0) by seeded hash and id, within `by` if given.

    Rows are ranked within ranges of the hash, and a range's first rank is the count of the rows before it: a
    running sum over at most RANGES rows for each class.
    """
    h = df.withColumn("_h", seeded(seed, F.col(id_col))).withColumn("_r", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    keys = [by] if by else []
    sizes = h.groupBy(*keys, "_r").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = sizes.withColumn("_o", F.sum("_n").over(w.orderBy("_r")) - F.col("_n")).drop("_n")
    cond = F.col("a._r") == F.col("b._r")
    if by:
        cond = cond & F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}"))
    joined = h.alias("a").join(offsets.alias("b"), cond)
    local = Window.partitionBy(*[F.col(f"a.{k}") for k in keys], F.col("a._r")).orderBy(F.col("a._h"), F.col(f"a.{id_col}"))
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in df.columns], (F.row_number().over(local) - 1 + F.col("b._o")).alias(out))


def assign_folds(df: DataFrame, id_col: str, k: int, seed: int = 0, stratify: str | None = None, out: str = "fold") -> DataFrame:
    """k folds; with `stratify` each class is dealt out by itself, so that its folds differ by one row at most."""
    if k < 2:
        raise ValueError(f"k must be at least 2, not {k}")
    return hash_ranked(df, id_col, seed, stratify, "_rank").withColumn(out, (F.col("_rank") % k).cast("int")).drop("_rank")


def check_k(df: DataFrame, k: int) -> None:
    """k may not be above the number of rows."""
    if df.limit(k).count() < k:
        raise ValueError(f"k={k} is more than the rows there are")


def analysis(df: DataFrame, fold: int, col: str = "fold") -> DataFrame:
    return df.where(F.col(col) != fold)


def assessment(df: DataFrame, fold: int, col: str = "fold") -> DataFrame:
    return df.where(F.col(col) == fold)


def analysis_counts(df: DataFrame, k: int, col: str = "fold") -> DataFrame:
    """Rows of every analysis set, in one pass rather than k."""
    of = df.groupBy(col).agg(F.count("*").alias("n"))
    total = of.agg(F.sum("n").alias("total"))
    return of.crossJoin(F.broadcast(total)).select(F.col(col), F.col("n").alias("n_assessment"), (F.col("total") - F.col("n")).alias("n_analysis"))


def prefix_sample(df: DataFrame, spec: str, outer: str = "outer_fold", inner: str = "fold") -> DataFrame:
    """out<M>in<N>, either part alone too: the first folds of the same partition."""
    import re

    m = re.fullmatch(r"(?:out(\d+))?(?:in(\d+))?", spec)
    if not m or not spec:
        raise ValueError(f"not a sample: {spec!r}")
    cond: Column = F.lit(True)
    for col, n in ((outer, m[1]), (inner, m[2])):
        if n is not None:
            if int(n) < 1:
                raise ValueError(f"a sample takes at least one fold: {spec!r}")
            cond = cond & (F.col(col) < int(n))
    return df.where(cond)
