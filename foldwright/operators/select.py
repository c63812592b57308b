"""Selection rules over configurations, within families and across them. Ties go to the smaller ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.scalars import t95

EPSILON_BIN = 1.10


def _better(col: Column, direction: str) -> Column:
    """Any direction but minimize maximises."""
    return col.asc() if direction == "minimize" else col.desc()


def first_by(stats: DataFrame, key: Column, direction: str, by: str = "family") -> DataFrame:
    w = Window.partitionBy(by).orderBy(_better(key, direction), "ord")
    return stats.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def argmax_mean(stats: DataFrame, direction: str = "maximize") -> DataFrame:
    return first_by(stats, F.col("mean"), direction)


def mean_std(stats: DataFrame, lam: float = 1.0, direction: str = "maximize") -> DataFrame:
    """Mean less lam standard deviations (plus, to minimise); the deviation is se * sqrt(n)."""
    spread = F.lit(float(lam)) * F.col("se") * F.sqrt(F.col("n"))
    key = F.col("mean") + spread if direction == "minimize" else F.col("mean") - spread
    return first_by(stats, key, direction)


def in_band(stats: DataFrame, width: Column, direction: str) -> DataFrame:
    """Rows within the band below the family's best, its edge included; `width` may use _best and _best_se."""
    w = Window.partitionBy("family").orderBy(_better(F.col("mean"), direction), "ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = stats.withColumn("_best", F.first("mean").over(w)).withColumn("_best_se", F.first("se").over(w)).withColumn("_width", width)
    edge = F.col("mean") <= F.col("_best") + F.col("_width") if direction == "minimize" else F.col("mean") >= F.col("_best") - F.col("_width")
    return s.where(edge).drop("_best", "_best_se", "_width")


def parsimony(band: DataFrame, direction: str) -> DataFrame:
    """The least complex, all within ten per cent of the least being alike; of those the best mean."""
    least = F.min("mean_complexity").over(Window.partitionBy("family"))
    limit = F.when(F.col("_least") > 0, F.col("_least") * EPSILON_BIN).otherwise(F.col("_least"))
    return first_by(band.withColumn("_least", least).where(F.col("mean_complexity") <= limit).drop("_least"), F.col("mean"), direction)


def one_std_err(stats: DataFrame, direction: str = "maximize") -> DataFrame:
    return parsimony(in_band(stats, F.col("_best_se"), direction), direction)


def pct_loss(stats: DataFrame, tolerance: float = 0.02, direction: str = "maximize") -> DataFrame:
    return parsimony(in_band(stats, F.abs("_best") * F.lit(float(tolerance)), direction), direction)


RULES = {"argmax-mean": argmax_mean, "mean-std": mean_std, "one-std-err": one_std_err, "pct-loss": pct_loss}


def two_level(stats: DataFrame, rule: str, direction: str = "maximize", **options: float) -> DataFrame:
    """Each family's winner by the rule, and is_ship for the best mean among them; complexities don't cross families."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; known: {', '.join(sorted(RULES))}")
    won = RULES[rule](stats, direction=direction, **options)
    w = Window.partitionBy(F.lit(0)).orderBy(_better(F.col("mean"), direction), "family", "ord")  # a row for each family
    return won.withColumn("is_ship", F.row_number().over(w) == 1)


def family_select(estimates: DataFrame, direction: str = "maximize") -> DataFrame:
    """(family, mean, se): of those within a standard error of the best the one with the least; with none at all the best mean."""
    w = Window.partitionBy(F.lit(0)).orderBy(_better(F.col("mean"), direction), "se", "family").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = estimates.withColumn("_best", F.first("mean").over(w)).withColumn("_se", F.first("se").over(w)).withColumn("_none", F.max("se").over(w) == 0)
    near = F.col("mean") <= F.col("_best") + F.col("_se") if direction == "minimize" else F.col("mean") >= F.col("_best") - F.col("_se")
    pick = Window.partitionBy(F.lit(0)).orderBy(F.when(F.col("_none"), F.lit(0.0)).otherwise(F.col("se")), _better(F.col("mean"), direction), "family")
    return s.where(near | F.col("_none")).withColumn("_i", F.row_number().over(pick)).where("_i = 1").select(*estimates.columns)


def auto_stop(outer: DataFrame, k: int, incumbent: Column, direction: str = "maximize") -> DataFrame:
    """(family, score): of each family mean, n and whether it stops: its final mean is unlikely to reach the incumbent."""
    g = outer.groupBy("family").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("s"), F.count("score").alias("n"))
    r = F.lit(k) - F.col("n")
    pred = F.col("s") * F.sqrt(r / F.lit(k * k) * (1 + r / F.col("n")))
    far = t95(F.col("n") - 1) * pred
    lost = F.col("mean") - far > incumbent if direction == "minimize" else F.col("mean") + far < incumbent
    return g.withColumn("stop", (F.col("n") >= 2) & (r > 0) & F.when((F.col("n") >= 2) & (r > 0), lost).otherwise(False)).select("family", "mean", "n", "stop")


def mark_stopped(ledger: DataFrame, stopped: DataFrame) -> DataFrame:
    """Outer rows of stopped families get stopped = auto."""
    s = stopped.where("stop").select(F.col("family").alias("_f")).distinct()
    j = ledger.join(s, F.col("family") == F.col("_f"), "left")
    mark = F.when((F.col("level") == "outer") & F.col("_f").isNotNull(), F.lit("auto")).otherwise(F.col("stopped") if "stopped" in ledger.columns else F.lit(None))
    return j.withColumn("stopped", mark.cast("string")).drop("_f")


def active_families(stats: DataFrame, stopped: DataFrame) -> DataFrame:
    """Rows of families that are not stopped; all rows if that would leave none."""
    s = stopped.where("stop").select("family").distinct()
    left = stats.join(s, "family", "left_anti")
    return stats if left.isEmpty() else left
