"""Expansion of declared hyperparameter spaces: on the driver for documents, as DataFrames for products."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANY, LINEAR, LOG = "$any", "$linear-range", "$log-range"


class SpaceError(ValueError):
    pass


def range_values(kind: str, bounds: list, default_steps: int = 0) -> list[float]:
    """lo + t (hi - lo), or lo (hi / lo) ** t; one step gives lo."""
    if not isinstance(bounds, list) or len(bounds) not in (2, 3):
        raise SpaceError(f"{kind} takes [lo, hi] or [lo, hi, steps]")
    lo, hi, steps = float(bounds[0]), float(bounds[1]), int(bounds[2]) if len(bounds) == 3 else default_steps
    if steps < 1:
        raise SpaceError(f"{kind} needs a number of steps")
    if kind == LOG and min(lo, hi) <= 0:
        raise SpaceError("bounds of a log range are above 0")
    ts = [i / (steps - 1) if steps > 1 else 0.0 for i in range(steps)]
    return [lo * (hi / lo) ** t if kind == LOG else lo + t * (hi - lo) for t in ts]


def expand(node: Any, path: str = "", default_steps: int = 0) -> Iterator[tuple[Any, list[tuple[str, Any]]]]:
    """Every value that a declaration stands for, with its coordinates (path, value) in order."""
    if not isinstance(node, dict):
        yield node, []
        return
    marks = [k for k in node if str(k).startswith("$")]
    if not marks:
        keys = sorted(node)
        for combo in itertools.product(*[list(expand(node[k], f"{path}.{k}" if path else k, default_steps)) for k in keys]):
            yield {k: v for k, (v, _) in zip(keys, combo, strict=True)}, [c for _, cs in combo for c in cs]
        return
    if len(marks) > 1 or len(node) > 1:
        raise SpaceError(f"{path or 'the root'}: a descriptor stands alone, not among {sorted(map(str, node))}")
    kind, body = marks[0], node[marks[0]]
    if kind in (LINEAR, LOG):
        for v in range_values(kind, body, default_steps):
            yield v, [(path, v)]
    elif kind == ANY and isinstance(body, list):
        if not body:
            raise SpaceError(f"{path}: {ANY} of nothing")
        for item in body:
            for v, coords in expand(item, path, default_steps):
                yield v, coords or [(path, v)]  # an element's own coordinates stand for the leaf's
    elif kind == ANY and isinstance(body, dict):
        if not body:
            raise SpaceError(f"{path}: {ANY} of nothing")
        for label in sorted(body):
            for v, coords in expand(body[label], f"{path}.{label}" if path else label, default_steps):
                yield {label: v}, [(path, label), *coords]
    else:
        raise SpaceError(f"{path}: unknown descriptor {kind}")


def expanded(spark: SparkSession, space: dict) -> DataFrame:
    """ord, config (JSON), free_params, family: a row for each point, in order."""
    import json

    rows = []
    for i, (value, coords) in enumerate(expand(space)):
        family = family_of(space, coords)
        rows.append((i, json.dumps(value, sort_keys=True), {p: v if isinstance(v, str) else json.dumps(v) for p, v in coords}, family))
    return spark.createDataFrame(rows, "ord int, config string, free_params map<string,string>, family string")


def family_of(space: dict, coords: list[tuple[str, Any]]) -> str:
    """step.key=label of each tagged sum at depth two, in order; empty if there is none."""
    tagged = {f"{s}.{k}" for s, body in space.items() if isinstance(body, dict) for k, d in body.items() if isinstance(d, dict) and isinstance(d.get(ANY), dict)}
    return ",".join(sorted(f"{p}={v}" for p, v in coords if p in tagged))


def product(*dims: DataFrame) -> DataFrame:
    """The product of sets of values, as of parameters or of configurations and folds; Catalyst broadcasts a side it knows to be small."""
    out = dims[0]
    for d in dims[1:]:
        out = out.crossJoin(d)
    return out


def linear_range(spark: SparkSession, lo: float, hi: float, steps: int, out: str = "value") -> DataFrame:
    t = _steps(steps)
    return spark.range(steps).select(F.col("id").alias("i"), (F.lit(float(lo)) + t * F.lit(float(hi) - float(lo))).alias(out))


def log_range(spark: SparkSession, lo: float, hi: float, steps: int, out: str = "value") -> DataFrame:
    if min(lo, hi) <= 0:
        raise SpaceError("bounds of a log range are above 0")
    return spark.range(steps).select(F.col("id").alias("i"), (F.lit(float(lo)) * F.pow(F.lit(hi / lo), _steps(steps))).alias(out))


def _steps(steps: int) -> Column:
    if steps < 1:
        raise SpaceError("a range has at least one step")
    return F.col("id").cast("double") / F.lit(float(max(1, steps - 1)))


def overlay(config: dict, folds: str, partition: str, idx: int) -> dict:
    return {**config, "folds": folds, "_fold": {"partition": partition, "idx": idx}}
