"""Model kinds on MLlib, and ridge regression by sufficient statistics for all folds and penalties in one scan."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.sources.dataset import read_text, write_text

CLASSIFIERS = ("logreg", "rf", "hist_gbm", "catboost", "ensemble")
REGRESSORS = ("ridge", "rf_reg", "hist_gbm_reg")


def parse_model(spec: Any) -> tuple[str, dict]:
    """A name, or a map of one name to its parameters."""
    if isinstance(spec, str):
        kind, params = spec, {}
    elif isinstance(spec, dict) and len(spec) == 1:
        kind, params = next(iter(spec.items()))
        params = params or {}
    else:
        raise ValueError(f"a model is a name or a map of one name, not {spec!r}")
    if kind not in CLASSIFIERS + REGRESSORS:
        raise ValueError(f"unknown model {kind!r}")
    if not isinstance(params, dict):
        raise ValueError(f"parameters of {kind} are a map, not {params!r}")
    return kind, params


def estimator(kind: str, params: dict, n: int, y_sd: float = 1.0, n_classes: int = 2, seed: int = 0, **cols: Any):
    """The MLlib estimator. n and y_sd turn penalties on sums into MLlib's on means; unbounded depth is its 30."""
    seed = int(params.get("seed", seed))
    cols = {"featuresCol": "features", "labelCol": "label"} | cols
    depth = lambda d: 30 if d is None else min(30, int(d))
    if kind == "logreg":
        return LogisticRegression(regParam=1.0 / (float(params.get("C", 1.0)) * n), elasticNetParam=0.0, standardization=False, maxIter=int(params.get("max_iter", 1000)), tol=1e-8, **cols)
    if kind == "ridge":
        return LinearRegression(solver="normal", standardization=False, regParam=float(params.get("alpha", 1.0)) * y_sd / n, **cols)
    if kind in ("rf", "rf_reg"):
        of = RandomForestClassifier if kind == "rf" else RandomForestRegressor
        return of(numTrees=int(params.get("n_estimators", 100)), maxDepth=depth(params.get("max_depth")), bootstrap=bool(params.get("bootstrap", True)), seed=seed, **cols)
    if kind in ("hist_gbm", "hist_gbm_reg", "catboost"):
        if kind == "catboost":
            opts = {"maxIter": int(params.get("iterations", 100)), "maxDepth": depth(params.get("depth", 6)), "stepSize": float(params.get("learning_rate", 0.1))}
        else:
            d = params.get("max_depth") or math.ceil(math.log2(int(params.get("max_leaf_nodes") or 31)))
            opts = {"maxIter": int(params.get("max_iter", 100)), "maxDepth": depth(d), "stepSize": float(params.get("learning_rate", 0.1))}
        if kind == "hist_gbm_reg":
            return GBTRegressor(seed=seed, **opts, **cols)
        one = GBTClassifier(seed=seed, **opts, **{k: v for k, v in cols.items() if k != "weightCol" or n_classes == 2})
        return one if n_classes == 2 else OneVsRest(classifier=one, **cols)  # hands the weights on to each of its fits
    raise ValueError(f"no estimator for {kind!r}")


def fit(df: DataFrame, features: list[str], y: str, spec: Any, seed: int = 0):
    """A fitted pipeline from the raw columns to predictions; class labels are in order of their names."""
    kind, params = parse_model(spec)
    if kind == "ensemble":
        return Ensemble.fit(df, features, y, params, seed)
    stats = df.agg(F.count("*").alias("n"), F.count_distinct(y).alias("k"), (F.stddev_pop(F.col(y).cast("double")) if kind in REGRESSORS else F.lit(1.0)).alias("sd")).first()
    steps: list = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")]
    cols: dict[str, Any] = {}
    if kind in CLASSIFIERS:
        steps.append(StringIndexer(inputCol=y, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"))
        if params.get("class_weight") == "balanced" or params.get("auto_class_weights"):
            from foldwright.operators.metrics import balanced_weights

            df, cols = balanced_weights(df, y, "_weight"), {"weightCol": "_weight"}
    else:
        cols = {"labelCol": y}
    steps.append(estimator(kind, params, stats.n, stats.sd or 1.0, stats.k, seed, **cols))
    return Pipeline(stages=steps).fit(df)


def classes_of(model: Any) -> list[str]:
    return model.classes if isinstance(model, Ensemble) else list(model.stages[1].labels)


def probabilities(model: Any, df: DataFrame, id_col: str) -> DataFrame:
    """id, class, p in order of classes."""
    if isinstance(model, Ensemble):
        return model.probabilities(df, id_col)
    labels = F.array(*[F.lit(c) for c in classes_of(model)])
    # only features go in, so that a table without a target can be scored
    scored = model.stages[-1].transform(model.stages[0].transform(df))
    p = vector_to_array("probability") if "probability" in scored.columns else F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-x)))
    out = scored.select(F.col(id_col).alias("id"), F.posexplode(p).alias("i", "p")).withColumn("class", F.get(labels, F.col("i")))
    return out.select("id", "class", "p")


class Ensemble:
    """Soft vote: the members' weighted mean probabilities."""

    def __init__(self, members: list, weights: list[float], classes: list[str]):
        self.members, self.weights, self.classes = members, weights, classes

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], y: str, params: dict, seed: int) -> Ensemble:
        from foldwright.operators.decide import weights_of

        specs = params.get("members") or []
        if not specs:
            raise ValueError("an ensemble has members")
        members = [fit(df, features, y, s, int(params.get("seed", seed))) for s in specs]
        return cls(members, weights_of(params.get("weights"), len(specs)), classes_of(members[0]))

    def probabilities(self, df: DataFrame, id_col: str) -> DataFrame:
        u = None
        for m, w in zip(self.members, self.weights, strict=True):
            part = probabilities(m, df, id_col).withColumn("p", F.col("p") * w)
            u = part if u is None else u.unionByName(part)
        return u.groupBy("id", "class").agg(F.sum("p").alias("p"))


def save(model: Any, spark: SparkSession, path: str) -> None:
    """A fitted model, an ensemble with all its members, under a path that Spark opens."""
    members = model.members if isinstance(model, Ensemble) else [model]
    for i, m in enumerate(members):
        m.write().overwrite().save(f"{path}/{i}")
    told = {"weights": model.weights, "classes": model.classes} if isinstance(model, Ensemble) else {}
    write_text(spark, f"{path}/model.json", json.dumps({"members": len(members)} | told))


def load(spark: SparkSession, path: str) -> Any:
    """What save() wrote."""
    told = json.loads(read_text(spark, f"{path}/model.json"))
    members = [PipelineModel.load(f"{path}/{i}") for i in range(told["members"])]
    return Ensemble(members, told["weights"], told["classes"]) if "weights" in told else members[0]


def predictions(model: Any, df: DataFrame, id_col: str) -> DataFrame:
    """id, prediction: the class with the highest probability, the first of equals; a regressor's value."""
    if not isinstance(model, Ensemble) and len(model.stages) == 2:
        return model.transform(df).select(F.col(id_col).alias("id"), "prediction")
    p = probabilities(model, df, id_col)
    return p.groupBy("id").agg(F.min(F.struct((-F.col("p")).alias("s"), "class")).alias("b")).select("id", F.col("b.class").alias("prediction"))


def tuned_on_holdout(df: DataFrame, features: list[str], y: str, id_col: str, spec: Any, holdout: float, seed: int = 0, metric: str = "balanced_accuracy") -> DataFrame:
    """(class, offset): offsets tuned for the metric on a stratified slice that an auxiliary fit on the rest has not seen."""
    from foldwright.operators import decide, folds, metrics

    k = decide.holdout_folds(holdout)
    if metrics.class_counts(df, y).where(F.col("n") < k).limit(1).count():
        raise ValueError(f"a class has fewer than {k} rows, so no slice of {holdout} holds every class")
    d = folds.assign_folds(df, id_col, k, seed, y, "_tune")
    model, held = fit(folds.analysis(d, 0, "_tune"), features, y, spec, seed), folds.assessment(d, 0, "_tune")
    classes = classes_of(model)
    truth = held.select(F.col(id_col).alias("id"), F.col(y).cast("string").alias("y"))
    best = decide.tune_offsets(probabilities(model, held, id_col), truth, classes, metric).first()
    return df.sparkSession.createDataFrame([(c, best[f"offset_{c}"]) for c in classes], "class string, offset double")


def leaves(model: Any) -> int:
    return sum((t.numNodes + 1) // 2 for t in model.trees)


def complexity(model: Any, spec: Any) -> float | None:
    """Mean leaves of a forest, all leaves of boosting, trees * 2 ** depth if trees are oblivious, coefficients of a linear model, the sum of members."""
    kind, params = parse_model(spec)
    if kind == "ensemble":
        own = [complexity(m, s) for m, s in zip(model.members, params["members"], strict=True)]
        return None if any(x is None for x in own) else sum(own)
    last = model.stages[-1]
    of = last.models if hasattr(last, "models") else [last]
    if kind in ("logreg", "ridge"):
        return float(sum(m.numFeatures * (1 if getattr(m, "numClasses", 2) <= 2 else m.numClasses) for m in of))
    if kind == "catboost":
        return float(sum(m.getNumTrees * 2 ** int(params.get("depth", 6)) for m in of))
    total = sum(leaves(m) for m in of)
    return total / of[0].getNumTrees if kind in ("rf", "rf_reg") else float(total)


def ridge_cv(df: DataFrame, x: str, y: str, fold: str, alphas: list[float]) -> DataFrame:
    """alpha, fold, rmse, n: ridge of one feature, held-out error, from sums by fold; one scan for all folds and penalties."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(fold).alias("fold"))
    s = d.groupBy("fold").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    names = ("n", "sx", "sy", "sxx", "sxy", "syy")
    total = s.agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    j = s.crossJoin(F.broadcast(total)).withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    a = {c: F.col(f"t_{c}") - F.col(c) for c in names}
    b = (a["sxy"] - a["sx"] * a["sy"] / a["n"]) / (a["sxx"] - a["sx"] * a["sx"] / a["n"] + F.col("alpha"))
    j = j.withColumn("b", b).withColumn("a", (a["sy"] - F.col("b") * a["sx"]) / a["n"])
    sse = F.col("syy") - 2 * F.col("a") * F.col("sy") - 2 * F.col("b") * F.col("sxy") + F.col("n") * F.col("a") * F.col("a") + 2 * F.col("a") * F.col("b") * F.col("sx") + F.col("b") * F.col("b") * F.col("sxx")
    return j.select("alpha", "fold", F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("n")).alias("rmse"), "n")
