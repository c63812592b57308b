"""Runs documents: an experiment's steps in order, or a shape's whole sweep into the ledger.

A step is a function of a context and its configuration. A document names it as layer/type: a step registered under
that very name comes first, then the built-in one of the type. Tables stay DataFrames; only scores, a row for each
family and small documents come to the driver. Everything is read and written by Spark's own file systems.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.operators import decide, estimators, folds, identity, ledger, metrics, reduce, select, space
from foldwright.plans import documents, nested
from foldwright.plans.control import Control
from foldwright.plans.dag import topo_sort, validate
from foldwright.sources import dataset as data

LEDGER = (
    "code_fingerprint string, point_addr string, status string, level string, fold int, outer_fold int, stopped string, "
    "family string, free_params map<string,string>, metrics map<string,double>, append_ord long"
)


@dataclass
class Output:
    metrics: dict[str, float] = field(default_factory=dict)
    dataset: data.Dataset | None = None
    folds: DataFrame | None = None
    model: Any = None
    offsets: DataFrame | None = None


@dataclass(frozen=True)
class Context:
    spark: SparkSession
    root: str
    out: str
    seed: int
    outputs: dict[str, Output]

    def dataset(self, ref: str) -> data.Dataset:
        """What an upstream step made under that name, else a path beside the document."""
        found = self.outputs.get(ref)
        if found is not None and found.dataset is not None:
            return found.dataset
        return data.load_dataset(self.spark, data.beneath(self.root, ref))

    def folder(self, step: str) -> str:
        """Where a step of the same run leaves its files."""
        return f"{os.path.dirname(self.out)}/{step}"

    def of(self, step: str, what: str) -> Any:
        found = getattr(self.outputs.get(step), what, None)
        if found is None:
            raise ValueError(f"step {step!r} has left no {what}")
        return found


Step = Callable[[Context, dict], Output]
BUILT_IN: dict[str, Step] = {}
STEPS: dict[str, Step] = {}


def step(uses: str) -> Callable[[Step], Step]:
    """Registers a function under layer/type, before any built-in one of the type."""

    def add(f: Step) -> Step:
        STEPS[uses] = f
        return f

    return add


def _built_in(kind: str) -> Callable[[Step], Step]:
    def add(f: Step) -> Step:
        BUILT_IN[kind] = f
        return f

    return add


def resolved(uses: str) -> Step:
    found = STEPS.get(uses) or BUILT_IN.get(uses.rsplit("/", 1)[-1])
    if found is None:
        raise ValueError(f"no step {uses!r}; built in: {', '.join(sorted(BUILT_IN))}")
    return found


@dataclass(frozen=True)
class Columns:
    id: str
    y: str
    features: list[str]

    @classmethod
    def of(cls, ds: data.Dataset) -> Columns:
        i, y = ds.schema.one("id"), ds.schema.one("target")
        if i is None or y is None:
            raise ValueError("folds and fits need an id and a target")
        return cls(i, y, ds.schema.of("feature"))


@_built_in("echo")
def _echo(ctx: Context, w: dict) -> Output:
    if w.get("fail"):
        raise RuntimeError(str(w["fail"]))
    return Output({"echoed": 1.0})


@_built_in("cv-split")
def _cv_split(ctx: Context, w: dict) -> Output:
    """k folds of the training rows: k and n are the metrics, the folds an artifact."""
    ds = ctx.dataset(w["dataset"])
    k, id_col = int(w["k"]), ds.schema.one("id")
    folds.check_k(ds.train, k)
    f = folds.assign_folds(ds.train, id_col, k, ctx.seed, ds.schema.one("target") if w.get("stratify") else None)
    return Output(data.write_folds(f.select(id_col, "fold"), f"{ctx.out}/folds.parquet"), folds=ctx.spark.read.parquet(f"{ctx.out}/folds.parquet"))


@_built_in("outer-split")
def _outer_split(ctx: Context, w: dict) -> Output:
    """The training rows as one table with a fold; analysis sets are filters on it, and the test table is as it was."""
    ds = ctx.dataset(w["dataset"])
    k = int(w["k"])
    folds.check_k(ds.train, k)
    f = folds.assign_folds(ds.train, ds.schema.one("id"), k, ctx.seed, ds.schema.one("target") if w.get("stratify") else None)
    made = data.write_folds(f, f"{ctx.out}/dataset")
    return Output(made, data.Dataset(ds.schema, ctx.spark.read.parquet(f"{ctx.out}/dataset"), ds.test))


@_built_in("train")
def _train(ctx: Context, w: dict) -> Output:
    """One fold's score and complexity where the configuration names a fold; else a model of all rows, and a score by folds."""
    metric, spec, rule = w.get("metric", "accuracy"), w["model"], w.get("decide")
    metrics.scorer(metric)  # what is wrong with the configuration is told before any fit
    holdout = decide.parse_decide(rule, estimators.parse_model(spec)[0] not in estimators.CLASSIFIERS)
    ds = ctx.dataset(w["dataset"])
    c = Columns.of(ds)
    by_fold = ds.train.join(ctx.of(w["folds"], "folds"), c.id) if "folds" in w else None

    def score(i: int) -> tuple[float | None, float | None]:
        return nested.fold_score(folds.analysis(by_fold, i), folds.assessment(by_fold, i), c.features, c.y, c.id, spec, metric, ctx.seed, rule)

    one = w.get("_fold")
    if isinstance(one, dict) and "idx" in one:
        if by_fold is None:
            raise ValueError("a fold's score needs folds")
        s, size = score(int(one["idx"]))
        return Output({"fold_score": s} | ({} if size is None else {"complexity": size}))
    out = Output(model=estimators.fit(ds.train, c.features, c.y, spec, ctx.seed))
    estimators.save(out.model, ctx.spark, f"{ctx.out}/model")
    if holdout is not None:
        out.offsets = estimators.tuned_on_holdout(ds.train, c.features, c.y, c.id, spec, holdout, ctx.seed)
        rows = out.offsets.collect()  # a row for each class
        data.write_text(ctx.spark, f"{ctx.out}/offsets.json", json.dumps({"rule": "offsets", "offsets": [r.offset for r in rows], "classes": [r["class"] for r in rows]}))
    if by_fold is not None:
        scores = [score(r.fold)[0] for r in by_fold.select("fold").distinct().orderBy("fold").collect()]  # a row for each fold
        out.metrics["cv_score"] = sum(scores) / len(scores)
    return out


@_built_in("predict")
def _predict(ctx: Context, w: dict) -> Output:
    """Predictions of the test rows, or of the training rows if there are none, and a classifier's probabilities."""
    ds, model = ctx.dataset(w["dataset"]), ctx.of(w["model"], "model")
    offsets = ctx.outputs[w["model"]].offsets
    frame, id_col = ds.test if ds.test is not None else ds.train, ds.schema.one("id")
    if not isinstance(model, estimators.Ensemble) and len(model.stages) == 2:
        p = estimators.predictions(model, frame, id_col)
    else:
        probs = estimators.probabilities(model, frame, id_col)
        if offsets is not None and not decide.uncovered(probs, offsets).isEmpty():
            raise ValueError("the offsets were tuned for other classes")
        p = estimators.predictions(model, frame, id_col) if offsets is None else decide.apply_offsets(probs, offsets, "prediction")
        wide = probs.groupBy("id").agg(*[F.max(F.when(F.col("class") == c, F.col("p"))).alias(f"proba_{c}") for c in estimators.classes_of(model)])
        wide.withColumnRenamed("id", id_col).write.mode("overwrite").option("header", True).csv(f"{ctx.out}/probabilities.csv")
    p.withColumnRenamed("id", id_col).write.mode("overwrite").option("header", True).csv(f"{ctx.out}/predictions.csv")
    return Output({"n_predictions": float(frame.count()), "has_offsets": float(offsets is not None)})


def code_files() -> dict[str, str]:
    """sha256 of the sources that results come from: this module, what it uses of the package, and registered steps."""
    found: dict[str, Any] = {}
    todo = [inspect.getmodule(code_files)]
    while todo:
        m = todo.pop()
        if m.__name__ not in found:
            found[m.__name__] = m
            used = (v if inspect.ismodule(v) else inspect.getmodule(v) for v in vars(m).values() if inspect.ismodule(v) or inspect.isfunction(v) or inspect.isclass(v))
            todo += [u for u in used if u is not None and u.__name__.startswith("foldwright.")]
    return {n: hashlib.sha256(inspect.getsource(x).encode()).hexdigest() for n, x in [*found.items(), *STEPS.items()]}


def code_fingerprint() -> str:
    return identity.canonical_hash(code_files())


def changed_code(spark: SparkSession, out: str, fingerprint: str) -> list[str]:
    """What differs between the code that made rows and the code as it is: module and state, by name."""
    path = f"{out}/code/{fingerprint}.json"
    if not data.exists(spark, path):
        return ["(its files were not recorded)"]
    of = lambda d: spark.createDataFrame([("code", n, h) for n, h in d.items()], "repo string, path string, hash string")
    gone = identity.drift(of(json.loads(data.read_text(spark, path))), of(code_files()))
    return [f"{r.path} {r.state}" for r in gone.orderBy("path").collect()]  # a row for each module


def run_steps(spark: SparkSession, steps: list[dict], seed: int, root: str, out: str, experiment: str = "") -> dict:
    """Runs a validated graph; the record is written whatever happens, and the first failure stops the run."""
    order = topo_sort(steps)
    done: dict[str, Output] = {}
    address = identity.point_address({s["id"]: s.get("with") or {} for s in steps}, identity.canonical_hash([(s["id"], s["uses"]) for s in steps]), seed)
    record: dict[str, Any] = {"run_id": address[:12], "experiment": experiment, "seed": seed, "point_address": address, "code_fingerprint": code_fingerprint(), "steps": [], "status": "ok", "started": _now()}
    failure = None
    for i, s in enumerate(order):
        here = f"{out}/{address[:12]}/{s['id']}"
        try:
            done[s["id"]] = resolved(s["uses"])(Context(spark, root, here, seed, done), s.get("with") or {})
        except Exception as e:  # told again below, once the record is there
            failure = e
            record |= {"status": "failed", "error": f"{s['id']}: {e}"}
            break
        record["steps"].append({"step": s["id"], "uses": s["uses"], "with": s.get("with") or {}, "ord": i, "metrics": done[s["id"]].metrics})
    record["finished"] = _now()
    record["metrics"] = {f"{s['step']}.{m}": v for s in record["steps"] for m, v in s["metrics"].items()}
    data.write_text(spark, f"{out}/{address[:12]}/run.json", json.dumps(record, default=str))
    if failure is not None:
        raise RunFailed(record) from failure
    return record


class RunFailed(RuntimeError):
    def __init__(self, record: dict):
        super().__init__(record["error"])
        self.record = record


def _now() -> str:
    return datetime.now(UTC).isoformat()


def run_experiment(spark: SparkSession, path: str, out: str) -> dict:
    e = documents.parse_experiment(data.read_text(spark, path))
    validate(e.steps)
    return run_steps(spark, e.steps, e.seed, os.path.dirname(path), out, os.path.basename(path))


@dataclass(frozen=True)
class Sweep:
    """A shape's configurations, in order, and the step of its pipeline that is scored."""

    shape: documents.Shape
    blob: str
    train: dict
    points: list[tuple[str, dict[str, str], dict]]

    @classmethod
    def of(cls, text: str) -> Sweep:
        shape = documents.parse_shape(text)
        scored = shape.metric.split(".", 1)[0]
        train = next((s for s in shape.phases["pipeline"] if s["id"] == scored), None)
        if train is None or "model" not in (train.get("with") or {}):
            raise documents.DocumentError(f"the objective {shape.metric!r} names no step of the pipeline that has a model")
        declared = {s["id"]: s.get("with") or {} for s in shape.phases["pipeline"]}
        points = []
        for value, coords in space.expand(declared):
            free = {p: v if isinstance(v, str) else json.dumps(v) for p, v in coords}
            points.append((space.family_of(declared, coords), free, value))
        return cls(shape, identity.canonical_hash(text), train, points)

    def frame(self, spark: SparkSession) -> DataFrame:
        """ord, family, config_key: as the ledger tells configurations apart."""
        from foldwright.functions.scalars import canonical_map

        rows = spark.createDataFrame([(i, f, free) for i, (f, free, _) in enumerate(self.points)], "ord int, family string, free_params map<string,string>")
        return rows.select("ord", "family", canonical_map(F.col("free_params")).alias("config_key"))


def sample_of(text: str) -> tuple[int | None, int | None]:
    """out<M>in<N>: how many of the first outer and inner folds are run."""
    import re

    m = re.fullmatch(r"(?:out([1-9]\d*))?(?:in([1-9]\d*))?", text)
    if m is None:
        raise ValueError(f"not a sample: {text!r}")
    return (int(m[1]) if m[1] else None, int(m[2]) if m[2] else None)


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    path = f"{out}/ledger.parquet"
    return spark.read.schema(LEDGER).parquet(path) if data.exists(spark, path) else spark.createDataFrame([], LEDGER)


def digest(df: DataFrame) -> str:
    """Tells tables apart by their columns and by the multiset of their rows, in one scan."""
    r = df.agg(F.count("*").alias("n"), *[F.sum(F.xxhash64(F.lit(i), *[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias(f"s{i}") for i in (0, 1)]).first()
    return identity.canonical_hash([df.dtypes, r.n, str(r.s0), str(r.s1)])


KNOWN = "base string, key string, score double, complexity double"


def known_scores(spark: SparkSession, out: str, base: list) -> nested.Scores:
    """Scores that earlier runs in this folder made from the same data, code and settings: a row for each fit."""
    name, path = identity.canonical_hash(base), f"{out}/scores.parquet"
    rows = spark.read.schema(KNOWN).parquet(path).where(F.col("base") == name).collect() if data.exists(spark, path) else []
    return nested.Scores(name, {r.key: (r.score, r.complexity) for r in rows})


def keep_scores(spark: SparkSession, out: str, scores: nested.Scores) -> None:
    if scores.added:
        spark.createDataFrame([(scores.base, k, *v) for k, v in scores.added.items()], KNOWN).coalesce(1).write.mode("append").parquet(f"{out}/scores.parquet")


def request_stop(spark: SparkSession, out: str) -> None:
    """Asks the sweep that runs in this folder to end; it keeps the outer folds that are done, and all scores."""
    data.write_text(spark, f"{out}/STOP", "")


def run_shape(spark: SparkSession, path: str, out: str, sample: str = "", auto_stop: bool = False, parallel: int = 4) -> DataFrame:
    """mean, se, n: the honest estimate of the sweep. Its rows are appended to the ledger, none of them twice.

    Several configurations are nested, one is cross-validated flat. The data phase runs once, before any fold. What
    an earlier run has fitted, on the same data with the same code, is not fitted again, however that run ended.
    """
    data.remove(spark, f"{out}/STOP")
    sweep = Sweep.of(data.read_text(spark, path))
    shape, root = sweep.shape, os.path.dirname(path)
    made: dict[str, Output] = {}
    for s in topo_sort(shape.phases["data"]):
        made[s["id"]] = resolved(s["uses"])(Context(spark, root, f"{out}/data/{s['id']}", shape.seed, made), s.get("with") or {})
    withs = [value[sweep.train["id"]] for _, _, value in sweep.points]
    fixed = {(w["dataset"], w.get("metric", "accuracy")) for w in withs}
    if len(fixed) > 1:
        raise documents.DocumentError("configurations differ in their dataset or metric, so their scores can't be compared")
    ref, metric = next(iter(fixed))
    ds = Context(spark, root, out, shape.seed, made).dataset(ref)
    c = Columns.of(ds)
    stratify = c.y if shape.stratify else None
    first = sample_of(sample)
    old = read_ledger(spark, out)
    control = Control(spark, parallel, lambda: data.exists(spark, f"{out}/STOP"))
    scores = known_scores(spark, out, [digest(ds.train), code_fingerprint(), shape.seed, c.features, c.y, c.id, shape.stratify, metric])
    try:
        rows, est = _sweep(spark, sweep, ds, c, withs, metric, stratify, first, incumbent_of(old, shape) if auto_stop else None, control, scores)
    finally:
        keep_scores(spark, out, scores)
    append(spark, out, old, ledger_rows(spark, sweep, rows.collect()))  # a row for each configuration and fold
    data.write_text(spark, f"{out}/code/{code_fingerprint()}.json", json.dumps(code_files()))
    return est


def _sweep(spark: SparkSession, sweep: Sweep, ds: data.Dataset, c: Columns, withs: list[dict], metric: str, stratify: str | None, first: tuple, best: float | None, control: Control, scores: nested.Scores) -> tuple[DataFrame, DataFrame]:
    shape = sweep.shape
    if documents.resample_mode(len(withs)) == "nested":
        configs = [(f, w["model"], w.get("decide")) for (f, _, _), w in zip(sweep.points, withs, strict=True)]
        return nested.nested_cv(ds.train, c.features, c.y, c.id, configs, shape.k, metric, shape.inner_k, shape.rule, stratify, shape.seed, first, best, control, scores, **shape.options)
    flat = nested.flat_cv(ds.train, c.features, c.y, c.id, withs[0]["model"], shape.k, metric, stratify, shape.seed, withs[0].get("decide"), first[0], control, scores)
    rows = flat.select(F.lit("").alias("level"), F.lit(sweep.points[0][0]).alias("family"), F.lit(0).alias("ord"), F.lit(None).cast("int").alias("outer_fold"), "fold", "score", "complexity", F.lit(None).cast("string").alias("stopped"))
    return rows, flat.agg(F.avg("score").alias("mean"), reduce.standard_error("score").alias("se"), F.count("score").alias("n"))


def ledger_rows(spark: SparkSession, sweep: Sweep, rows: list) -> DataFrame:
    code, name = code_fingerprint(), sweep.train["id"]
    made = []
    for i, r in enumerate(rows):
        _, free, value = sweep.points[r.ord]
        where = {"level": r.level, "outer": r.outer_fold, "fold": r.fold}
        found = {f"{name}.fold_score": r.score, f"{name}.complexity": r.complexity}
        address = identity.point_address({"config": value, "_fold": where}, sweep.blob, sweep.shape.seed)
        status = "failed" if r.score is None else "ok"
        made.append((code, address, status, r.level, r.fold, r.outer_fold, r.stopped, r.family, free, {k: v for k, v in found.items() if v is not None}, i))
    return spark.createDataFrame(made, LEDGER)


def append(spark: SparkSession, out: str, old: DataFrame, new: DataFrame) -> None:
    """Writes what the ledger does not have yet; the rows that are there are never touched."""
    last = old.agg(F.coalesce(F.max("append_ord"), F.lit(-1)).alias("m")).first().m
    rows = ledger.append(new.limit(0), new).withColumn("append_ord", F.col("append_ord") + last + 1)
    rows = rows.join(old.select("point_addr", "code_fingerprint"), ["point_addr", "code_fingerprint"], "left_anti")
    rows.select(*new.columns).write.mode("append").parquet(f"{out}/ledger.parquet")


def incumbent_of(rows: DataFrame, shape: documents.Shape) -> float | None:
    """The mean of the family that all outer rows so far would choose."""
    est = select.family_select(reduce.family_estimate(rows, shape.metric).drop("n"), shape.direction).first()
    return est["mean"] if est else None


def choose(spark: SparkSession, path: str, out: str, cohort: str = "", point: str = "") -> DataFrame:
    """family, ord, config_key, mean, se, n, estimate, estimate_se, is_ship: each family's winner and its honest estimate.

    Inner rows choose within a family by the shape's rule, outer rows among families. A ledger of several code
    versions is refused unless a cohort is named. `point` names a configuration instead of the rule.
    """
    sweep = Sweep.of(data.read_text(spark, path))
    shape, rows = sweep.shape, read_ledger(spark, out)
    if cohort:
        rows = ledger.of_cohort(rows, ledger.resolve_prefix(rows, "code_fingerprint", cohort))
    elif ledger.cohort_count(rows).first()[0] > 1:
        raise ValueError("the ledger holds several code versions: name a cohort")
    if point:
        rows = ledger.point_rows(rows, point)
    inner = reduce.aggregate_view(rows.where("coalesce(level, '') <> 'outer'"), shape.metric)
    size = shape.metric.split(".", 1)[0] + ".complexity"
    stats = inner.groupBy("config_key").agg(
        *[F.max(F.when(F.col("metric") == shape.metric, F.col(c))).alias(c) for c in ("mean", "se", "n")],
        F.max(F.when(F.col("metric") == size, F.col("mean"))).alias("mean_complexity"),
        F.bool_and(F.col("status") == "ok").alias("ok"),
    )
    stats = ledger.match_points(stats.where("ok").drop("ok"), sweep.frame(spark)).withColumn("has_complexity", F.col("mean_complexity").isNotNull())
    if shape.rule in ("one-std-err", "pct-loss"):
        reduce.guard_complexity(stats)
    won = select.two_level(stats, shape.rule, shape.direction, **shape.options)
    est = reduce.family_estimate(rows, shape.metric).drop("n")
    ship = select.family_select(est, shape.direction).select("family", F.lit(True).alias("_ship"))
    est = est.select("family", F.col("mean").alias("estimate"), F.col("se").alias("estimate_se")).join(ship, "family", "left")
    out_rows = won.withColumnRenamed("is_ship", "_inner").join(est, "family", "left")
    # without outer rows, as of a flat run, the inner choice holds
    is_ship = F.coalesce(F.col("_ship"), F.lit(False)) if not ship.isEmpty() else F.col("_inner")
    return out_rows.select("family", "ord", "config_key", "mean", "se", "n", "estimate", "estimate_se", is_ship.alias("is_ship"))


def promote(spark: SparkSession, path: str, out: str, cohort: str = "", point: str = "", changed: bool = False) -> dict:
    """Runs the ship configuration on all rows, without folds, then the ship phase.

    Refused, with the names of what differs, if the code is not what made the rows; `changed` allows it.
    """
    sweep = Sweep.of(data.read_text(spark, path))
    won = choose(spark, path, out, cohort, point).where("is_ship").first()
    if won is None:
        raise ValueError("nothing to promote")
    rows = read_ledger(spark, out)
    stored = ledger.resolve_prefix(rows, "code_fingerprint", cohort)
    if stored != code_fingerprint() and not changed:
        raise ValueError(f"the code has changed since these rows were made: {', '.join(changed_code(spark, out, stored))}")
    value = sweep.points[won.ord][2]
    steps = [*sweep.shape.phases["data"], *[{**s, "with": value[s["id"]]} for s in sweep.shape.phases["pipeline"]], *sweep.shape.phases["ship"]]
    label = won.family.rsplit("=", 1)[-1] or "point"
    return run_steps(spark, steps, sweep.shape.seed, os.path.dirname(path), f"{out}/best-{label}-{identity.canonical_hash(value)[:8]}", os.path.basename(path))


def show(spark: SparkSession, out: str, objective: str, direction: str = "maximize", n: int = 20, cohort: str = "") -> DataFrame:
    """The ledger by configuration, best first; rows that failed or lack the metric come last, and none goes before the limit."""
    rows = read_ledger(spark, out)
    if cohort:
        rows = ledger.of_cohort(rows, ledger.resolve_prefix(rows, "code_fingerprint", cohort))
    v = reduce.aggregate_view(rows, objective).where(F.col("metric") == objective)
    better = F.col("mean") if direction == "minimize" else -F.col("mean")
    return v.orderBy(F.when(F.col("status") == "failed", 1).otherwise(0), better, "point_addr").limit(max(0, n))


def fingerprints(spark: SparkSession, out: str) -> DataFrame:
    rows = read_ledger(spark, out)
    return rows.groupBy("code_fingerprint").agg(F.count("*").alias("rows"), F.count_if(F.col("level") == "inner").alias("inner_rows"), F.count_if(F.col("level") == "outer").alias("outer_rows"), F.max("append_ord").alias("last")).orderBy("last", "code_fingerprint")


def ship_steps(ship: list[dict]) -> tuple[dict, dict]:
    """The step that predicts, the first that takes a model, and the one that submits, the last that takes predictions."""
    of = lambda what: [s for s in ship if what in (s.get("with") or {})]
    predicts, submits = of("model"), of("predictions")
    if not predicts or not submits:
        raise ValueError("the ship phase needs a step with a model and a step with predictions")
    return predicts[0], submits[-1]


def _member(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame | None, tuple | None]:
    """Probabilities, offsets where its model has them, and what made it: the experiment and the code."""
    run, name = os.path.split(folder.rstrip("/"))
    probs = data.read_probabilities(spark, f"{folder}/probabilities.csv")
    if not data.exists(spark, f"{run}/run.json"):
        return probs, None, None
    record = json.loads(data.read_text(spark, f"{run}/run.json"))
    made = (record.get("experiment"), record.get("code_fingerprint"))
    model = next((s["with"].get("model") for s in record["steps"] if s["step"] == name), None)
    path = f"{run}/{model}/offsets.json"
    if model is None or not data.exists(spark, path):
        return probs, None, made
    told = json.loads(data.read_text(spark, path))
    offsets = spark.createDataFrame(list(zip(map(str, told["classes"]), told["offsets"], strict=True)), "class string, offset double")
    if not decide.uncovered(probs, offsets).isEmpty():
        raise ValueError(f"the offsets of {folder} are for other classes than its probabilities")
    return probs, offsets, made


def blend(spark: SparkSession, runs: list[str], out: str, weights: list[float] | None = None, mixed: bool = False, path: str = "") -> str:
    """Blends the probabilities of runs' predict steps (folders with probabilities.csv) into out; the blend's id.

    Each member's own offsets count. Members of several experiments or code versions are refused unless `mixed`.
    With a shape's path, its submission step runs on the blend.
    """
    shape = documents.parse_shape(data.read_text(spark, path)) if path else None
    predicts, submits = ship_steps(shape.phases["ship"]) if shape else ({"id": "predict"}, None)
    members, offsets, made = map(list, zip(*[_member(spark, r) for r in runs], strict=True))
    shares = decide.weights_of(weights, len(members))
    if len({m for m in made if m is not None}) > 1 and not mixed:
        raise ValueError("members come from several experiments or code versions, which is not one procedure")
    if not decide.misaligned(members).isEmpty():
        raise ValueError("members have other ids or classes than one another")
    pairs = list(zip(runs, shares, strict=True))
    name = decide.blend_id(pairs)
    here = f"{out}/{name}/{predicts['id']}"
    decide.blend(members, shares, offsets).withColumnRenamed("label", "prediction").write.mode("overwrite").option("header", True).csv(f"{here}/predictions.csv")
    if submits is not None:
        done = {predicts["id"]: Output()}
        resolved(submits["uses"])(Context(spark, os.path.dirname(path), f"{out}/{name}/{submits['id']}", shape.seed, done), submits.get("with") or {})
    record = {"run_id": name, "experiment": os.path.basename(path), "status": "ok", "members": pairs, "code_fingerprint": code_fingerprint(), "finished": _now()}
    data.write_text(spark, f"{out}/{name}/run.json", json.dumps(record))
    return name
