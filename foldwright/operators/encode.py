"""Target encodings without leakage: no row's own label goes into its encoding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.scalars import seeded
from foldwright.operators.folds import assign_folds


def shrunk(total: Column, n: Column, prior: Column, m: float) -> Column:
    """(sum + m prior) / (n + m); nothing known gives the prior."""
    return F.when(n + F.lit(float(m)) > 0, (total + F.lit(float(m)) * prior) / (n + F.lit(float(m)))).otherwise(prior)


def _prior(fit: DataFrame, y: str) -> DataFrame:
    return fit.agg(F.avg(F.col(y).cast("double")).alias("prior"))  # one row


def cross_fit(df: DataFrame, y: str, k: int, stratify: bool = True) -> tuple[int, bool]:
    """The folds that a table allows: no more than its rows, and by class only if there are several and each fills them."""
    if k < 2:
        raise ValueError(f"k must be at least 2, not {k}")
    c = df.groupBy(y).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("classes"), F.min("n").alias("least")).first()
    k = min(k, c.rows)
    return k, stratify and c.classes > 1 and c.least >= k


def encode_kfold(df: DataFrame, key: str, y: str, id_col: str, m: float = 10.0, k: int = 5, seed: int = 0, stratify: bool = True, out: str = "enc") -> DataFrame:
    """A row gets its group's shrunk mean over the other folds; the prior is that of all rows.

    Sums of a group less those of the group's fold: two small aggregates and no pass for each fold. Null keys and
    groups that are only in one fold get the prior, and so does a single row, which can't be held out of itself.
    """
    k, stratify = cross_fit(df, y, k, stratify)
    if k < 2:
        return df.crossJoin(F.broadcast(_prior(df, y))).select(*[F.col(c) for c in df.columns], F.lit(0).alias("fold"), F.col("prior").alias(out))
    df = assign_folds(df, id_col, k, seed, y if stratify else None, "_fold")
    cell = df.where(F.col(key).isNotNull()).groupBy(key, "_fold").agg(F.coalesce(F.sum(F.col(y).cast("double")), F.lit(0.0)).alias("_s"), F.count(y).alias("_n"))
    w = Window.partitionBy(key)
    rest = cell.select(key, "_fold", (F.sum("_s").over(w) - F.col("_s")).alias("_s"), (F.sum("_n").over(w) - F.col("_n")).alias("_n"))
    j = df.join(rest, [key, "_fold"], "left").crossJoin(F.broadcast(_prior(df, y)))
    enc = F.when(F.coalesce(F.col("_n"), F.lit(0)) > 0, shrunk(F.col("_s"), F.col("_n"), F.col("prior"), m)).otherwise(F.col("prior"))
    return j.select(*[c for c in df.columns if c != "_fold"], F.col("_fold").alias("fold"), enc.alias(out))


def seeded_normal(seed: int, id_col: Column) -> Column:
    """A standard normal number for each id, the same in every run: two parts of its seeded hash by Box and Muller."""
    h = seeded(seed, id_col)
    u, v = ((F.conv(F.substring(h, i, 12), 16, 10).cast("double") + 1) / F.lit(float(16**12 + 1)) for i in (1, 13))
    return F.sqrt(-2 * F.ln(u)) * F.cos(v * F.lit(2 * math.pi))


def encode_loo(df: DataFrame, key: str, y: str, m: float = 10.0, out: str = "enc", noise: float = 0.0, seed: int = 0, id_col: str | None = None) -> DataFrame:
    """A row gets its group's shrunk mean without the row itself; alone in its group, or without a key, the prior.

    Rows without a label are no part of a mean; they get their group's. Noise of that standard deviation is drawn
    by seed and id.
    """
    if noise > 0 and id_col is None:
        raise ValueError("noise is drawn by id, so it needs the id's column")
    g = df.groupBy(key).agg(F.coalesce(F.sum(F.col(y).cast("double")), F.lit(0.0)).alias("_s"), F.count(y).alias("_n"))
    j = df.join(g, key, "left").crossJoin(F.broadcast(_prior(df, y)))
    own = F.coalesce(F.col(y).cast("double"), F.lit(0.0))
    others = F.coalesce(F.col("_n"), F.lit(0)) - F.when(F.col(y).isNull(), 0).otherwise(1)
    enc = F.when(others <= 0, F.col("prior")).otherwise(shrunk(F.col("_s") - own, others, F.col("prior"), m))
    if noise > 0:
        enc = enc + F.lit(float(noise)) * seeded_normal(seed, F.col(id_col))
    return j.select(*[F.col(c) for c in df.columns], enc.alias(out))


def encode_nonfit(df: DataFrame, fit: Column, key: str, y: str, m: float = 10.0, out: str = "enc") -> DataFrame:
    """Rows that don't fit get their group's shrunk mean over those that do; unseen groups the prior."""
    base = df.where(fit)
    g = base.where(F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.sum(F.col(y).cast("double")), F.lit(0.0)).alias("_s"), F.count(y).alias("_n"))
    j = df.where(~fit).join(g, key, "left").crossJoin(F.broadcast(_prior(base, y)))
    enc = F.when(F.col("_n").isNull(), F.col("prior")).otherwise(shrunk(F.col("_s"), F.col("_n"), F.col("prior"), m))
    return j.select(*[F.col(c) for c in df.columns], enc.alias(out))
