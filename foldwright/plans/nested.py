"""Cross-validation over configurations: nested for an honest estimate, flat for a single one."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.operators import decide, estimators, folds, identity, metrics, reduce, select
from foldwright.plans.control import Control, Stopped


def fold_score(train: DataFrame, held: DataFrame, features: list[str], y: str, id_col: str, spec: Any, metric: str, seed: int = 0, rule: object = None) -> tuple[float | None, float | None]:
    """Score on held, after the decision rule, and realised complexity, both of one fit on train."""
    f, _ = metrics.scorer(metric)
    classifies = estimators.parse_model(spec)[0] in estimators.CLASSIFIERS
    holdout = decide.parse_decide(rule, not classifies)
    model = estimators.fit(train, features, y, spec, seed)
    if holdout is None:
        p = estimators.predictions(model, held, id_col).withColumnRenamed("prediction", "p")
    else:
        offsets = estimators.tuned_on_holdout(train, features, y, id_col, spec, holdout, seed)
        p = decide.apply_offsets(estimators.probabilities(model, held, id_col), offsets, "p")
    truth = held.select(F.col(id_col).alias("id"), F.col(y).cast("string").alias("y") if classifies else F.col(y).alias("y"))
    return f(truth.join(p, "id")).first()[0], estimators.complexity(model, spec)


class Scores:
    """Scores of fits that are known, by what they are of; none are known at first.

    `base` names data, code and settings. `known` has those of earlier runs; `added` what this one adds.
    """

    def __init__(self, base: Any = None, known: dict[str, tuple] | None = None):
        self.base, self.known, self.added, self.fits = base, known or {}, {}, 0

    def of(self, what: list, fit: Any) -> tuple[float | None, float | None]:
        key = identity.canonical_hash([self.base, what])
        if key not in self.known:
            self.fits += 1
            self.known[key] = self.added[key] = fit()
        return self.known[key]


def flat_cv(df: DataFrame, features: list[str], y: str, id_col: str, spec: Any, k: int, metric: str, stratify: str | None = None, seed: int = 0, rule: object = None, first: int | None = None, control: Control | None = None, scores: Scores | None = None) -> DataFrame:
    """fold, score, complexity of one configuration, for all folds or the first so many."""
    control, scores = control or Control(df.sparkSession), scores or Scores()
    d = folds.assign_folds(df, id_col, k, seed, stratify).cache()

    def job(i: int):
        fit = lambda: fold_score(folds.analysis(d, i), folds.assessment(d, i), features, y, id_col, spec, metric, seed, rule)
        return lambda: (i, *scores.of(["flat", k, i, spec, rule], fit))

    try:
        rows = control.run([job(i) for i in range(min(k, first or k))])
    finally:
        d.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, score double, complexity double")


def nested_cv(
    df: DataFrame,
    features: list[str],
    y: str,
    id_col: str,
    configs: list[tuple],
    k: int,
    metric: str,
    inner_k: int | None = None,
    rule: str = "argmax-mean",
    stratify: str | None = None,
    seed: int = 0,
    first: tuple[int | None, int | None] = (None, None),
    incumbent: float | None = None,
    control: Control | None = None,
    scores: Scores | None = None,
    **options: float,
) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, estimate). configs: (family, model) or (family, model, decision); their order settles ties.

    Each outer fold is held out of an inner choice over the rest; every family's winner is then fitted on all of
    the rest and scored on the fold. The estimate is over the folds' ship families, which may differ. Rows held out
    never reach a fit: analysis sets are filters on the fold. `first` takes only the first outer and inner folds of
    the same partitions. With an incumbent, families that are unlikely to reach it stop after an outer fold and
    their outer rows are marked; the last family never stops.

    The fits of an outer fold run side by side, as `control` allows; what it stops in the middle of an outer fold is
    left out, and the estimate is over the folds before. `scores` keeps and gives the scores of fits.
    """
    control, scores = control or Control(df.sparkSession), scores or Scores()
    spark: SparkSession = df.sparkSession
    _, more = metrics.scorer(metric)
    direction = "maximize" if more else "minimize"
    outer = folds.assign_folds(df, id_col, k, seed, stratify, "outer_fold").cache()
    active = {c[0] for c in configs}
    rows: list[tuple] = []
    ships: list[float] = []
    for o in range(min(k, first[0] or k)):
        rest, held = folds.analysis(outer, o, "outer_fold"), folds.assessment(outer, o, "outer_fold")
        ik = inner_k or k
        inner = folds.assign_folds(rest, id_col, ik, seed + 1, stratify).cache()

        def score(train: DataFrame, test: DataFrame, config: tuple, where: list):
            _, spec, *choice = config
            fit = lambda: fold_score(train, test, features, y, id_col, spec, metric, seed, *choice)
            return lambda: scores.of([k, ik, *where, spec, *choice], fit)

        todo = [(c, n, i) for n, c in enumerate(configs) if c[0] in active for i in range(min(ik, first[1] or ik))]
        try:
            made = control.run([score(folds.analysis(inner, i), folds.assessment(inner, i), c, [o, i]) for c, n, i in todo])
            own = [(c[0], n, i, *m) for (c, n, i), m in zip(todo, made, strict=True)]
            stats = reduce.mean_se(spark.createDataFrame(own, "family string, ord int, fold int, score double, complexity double"), ["family", "ord"])
            if rule in ("one-std-err", "pct-loss"):
                reduce.guard_complexity(stats)
            won = select.two_level(stats, rule, direction, **options).collect()  # a row for each family
            told = control.run([score(rest, held, configs[w.ord], [o, None]) for w in won])
        except Stopped:
            break
        finally:
            inner.unpersist()
        rows += [("inner", f, c, o, i, s, x) for f, c, i, s, x in own]
        for w, (s, c) in zip(won, told, strict=True):
            rows.append(("outer", w.family, w.ord, o, None, s, c))
            if w.is_ship:
                ships.append(s)
        if incumbent is not None:
            told = spark.createDataFrame([(r[1], r[5]) for r in rows if r[0] == "outer"], "family string, score double")
            lost = {r.family for r in select.auto_stop(told, k, F.lit(float(incumbent)), direction).where("stop").collect()}  # families only
            active = active - lost or active
    outer.unpersist()
    ledger = spark.createDataFrame(rows, "level string, family string, ord int, outer_fold int, fold int, score double, complexity double")
    halted = {c[0] for c in configs} - active
    ledger = ledger.withColumn("stopped", F.when((F.col("level") == "outer") & F.col("family").isin(*halted), "auto") if halted else F.lit(None).cast("string"))
    est = spark.createDataFrame([(s,) for s in ships], "score double").agg(F.avg("score").alias("mean"), reduce.standard_error("score").alias("se"), F.count("score").alias("n"))
    return ledger, est
