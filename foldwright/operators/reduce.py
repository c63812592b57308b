"""From fold scores to means and standard errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions.scalars import canonical_map


def standard_error(x: Column | str) -> Column:
    """Sample standard deviation / sqrt(n); 0 for one value."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0)) / F.sqrt(F.count(x))


def mean_se(df: DataFrame, by: Sequence[str], score: str = "score", complexity: str = "complexity", fold: str = "fold") -> DataFrame:
    """mean, se, n, mean complexity (null unless every fold has one), has_complexity and the folds told, in order."""
    return df.groupBy(*by).agg(
        F.avg(score).alias("mean"),
        standard_error(score).alias("se"),
        F.count(score).alias("n"),
        F.when(F.bool_and(F.col(complexity).isNotNull()), F.avg(complexity)).alias("mean_complexity"),
        F.bool_and(F.col(complexity).isNotNull()).alias("has_complexity"),
        F.array_join(F.sort_array(F.collect_set(F.col(fold).cast("string"))), ",").alias("told"),
    )


def aggregate_view(ledger: DataFrame, objective: str) -> DataFrame:
    """Folds to configurations: a row for each fingerprint, level, configuration and metric.

    Means are over the folds that have the metric; se and n are for the objective only. A failed fold fails its
    configuration. The first row by append order gives the address. Rows without a fold pass through, so the view
    of a view is itself.
    """
    keyed = ledger.withColumn("config_key", canonical_map(F.col("free_params")))
    of_folds = keyed.where(F.col("fold").isNotNull())
    group = ["code_fingerprint", "level", "config_key"]
    head = of_folds.groupBy(*group).agg(F.min_by("point_addr", "append_ord").alias("point_addr"), F.max(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("_failed"))
    stats = of_folds.select(*group, F.explode("metrics").alias("metric", "v")).groupBy(*group, "metric").agg(F.avg("v").alias("mean"), standard_error("v").alias("_se"), F.count("v").alias("_n"))
    is_objective = F.col("metric") == objective
    out = stats.join(head, group).select(
        *group, "metric", "mean", F.when(is_objective, F.col("_se")).alias("se"), F.when(is_objective, F.col("_n")).alias("n"), F.when(F.col("_failed") == 1, F.lit("failed")).otherwise(F.lit("ok")).alias("status"), "point_addr"
    )
    through = keyed.where(F.col("fold").isNull()).select(*group, F.explode("metrics").alias("metric", "mean"), F.lit(None).cast("double").alias("se"), F.lit(None).cast("long").alias("n"), "status", "point_addr")
    return out.unionByName(through)


def family_estimate(ledger: DataFrame, metric: str) -> DataFrame:
    """Outer rows that didn't fail and have the metric, by family, whatever their configurations."""
    rows = ledger.where((F.col("level") == "outer") & (F.col("status") != "failed")).withColumn("v", F.col("metrics")[metric]).where(F.col("v").isNotNull())
    return rows.groupBy("family").agg(F.avg("v").alias("mean"), standard_error("v").alias("se"), F.count("v").alias("n"))


def without_complexity(stats: DataFrame) -> DataFrame:
    """Families that a rule by complexity can't rank, as some configuration has none."""
    return stats.where(~F.col("has_complexity")).select("family").distinct()


def guard_complexity(stats: DataFrame) -> DataFrame:
    lacking = [r[0] for r in without_complexity(stats).orderBy("family").limit(20).collect()]
    if lacking:
        raise ValueError(f"no complexity for {', '.join(lacking)}: choose a rule that doesn't need it")
    return stats
