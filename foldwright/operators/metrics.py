"""Scores and guards over predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def balanced_accuracy(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """The mean over classes of their recalls."""
    recall = df.groupBy(*by, y).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("_r"))
    return recall.groupBy(*by).agg(F.avg("_r").alias("balanced_accuracy"))


def rmse(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), F.lit(2.0)))).alias("rmse"))


SCORERS = {"accuracy": (accuracy, True), "balanced_accuracy": (balanced_accuracy, True), "rmse": (rmse, False)}


def scorer(name: str):
    """The scorer of that name, and whether more is better."""
    if name not in SCORERS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(sorted(SCORERS))}")
    return SCORERS[name]


def cv_score(df: DataFrame, metric: str, fold: str = "fold", y: str = "y", p: str = "p") -> DataFrame:
    """The mean of the folds' scores, not the score of all rows."""
    f, _ = scorer(metric)
    return f(df, y, p, [fold]).agg(F.avg(metric).alias("cv_score"), F.count("*").alias("n_folds"))


def class_counts(df: DataFrame, y: str) -> DataFrame:
    return df.groupBy(y).agg(F.count("*").alias("n"))


def balanced_weights(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    """n / (classes * n of the class), by joining counts rather than a window over a class."""
    c = class_counts(df, y).withColumnRenamed(y, "_y")
    t = c.agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    w = c.crossJoin(F.broadcast(t)).select("_y", (F.col("_n") / (F.col("_k") * F.col("n"))).alias(out))
    return df.join(w, F.col(y).eqNullSafe(F.col("_y"))).drop("_y")
