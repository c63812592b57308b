"""Results of steps, kept by what they were made from and read again while nothing of it changed.

A step's key is known before it runs: its configuration, the seed and the keys of what it needs. Beside the result
lies its closure, the files that it and all steps before it read, with their hashes. The closure is written last, so
a result whose writing was cut short is a miss. Both are Parquet under a root that Spark opens.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from foldwright.operators import identity
from foldwright.plans.dag import topo_sort, validate

READ_SET = "repo string, path string, hash string"
#: Takes the session, the step's configuration and the results of what it needs, by step.
Function = Callable[[SparkSession, dict, dict[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Outcome:
    key: str
    hit: bool
    result: DataFrame
    closure: DataFrame


def source_of(spark: SparkSession, function: Function, repo: str = "steps") -> DataFrame:
    """The read set of a step: its module's source. A source that can't be read has no hash, which is a miss later."""
    module = inspect.getmodule(function)
    try:
        digest = hashlib.sha256(inspect.getsource(module or function).encode()).hexdigest()
    except (OSError, TypeError):
        digest = None
    return spark.createDataFrame([(repo, getattr(module, "__name__", repr(function)), digest)], READ_SET)


def stored(spark: SparkSession, root: str, key: str) -> tuple[DataFrame, DataFrame] | None:
    """(result, closure), or None where either is missing or wiped."""
    try:
        return spark.read.parquet(f"{root}/{key}/result"), spark.read.schema(READ_SET).parquet(f"{root}/{key}/closure")
    except AnalysisException:
        return None


def record(spark: SparkSession, root: str, key: str, result: DataFrame, closure: DataFrame) -> tuple[DataFrame, DataFrame]:
    closure.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{root}/{key}/closure")  # a miss until all is written
    result.write.mode("overwrite").parquet(f"{root}/{key}/result")
    closure.coalesce(1).write.mode("overwrite").parquet(f"{root}/{key}/closure")
    found = stored(spark, root, key)
    if found is None:
        raise RuntimeError(f"{root}/{key} went while it was written")
    return found


def is_hit(closure: DataFrame, current: DataFrame) -> bool:
    """Whether all files of a stored closure are what they were; an empty closure or a missing hash is a miss."""
    return not closure.isEmpty() and closure.where("hash is null").isEmpty() and identity.unchanged(closure, current)


def run_cached(spark: SparkSession, root: str, steps: list[dict], functions: dict[str, Function], seed: int = 0, read_sets: dict[str, DataFrame] | None = None) -> dict[str, Outcome]:
    """Runs a step graph, needs first; `uses` names a step's function, `with` configures it.

    read_sets gives a function's files (repo, path, hash) as they are now; by default its module's source. A step
    marked `immutable` that needs nothing is a hit as soon as it is stored, and adds no files to later closures.
    """
    validate(steps)
    now = {u: (read_sets or {}).get(u) or source_of(spark, functions[u]) for u in {s["uses"] for s in steps}}
    current = identity.merge_read_sets(*now.values()) if now else None
    nothing = spark.createDataFrame([], READ_SET)
    done: dict[str, Outcome] = {}
    for s in topo_sort(steps):
        needs = list(dict.fromkeys(n for n in s.get("needs") or [] if n != s["id"]))
        config = s.get("with") or {}
        key = identity.step_key(s["id"], s["uses"], config, seed, [done[n].key for n in needs])
        found = stored(spark, root, key)
        leaf = bool(s.get("immutable")) and not needs
        hit = found is not None and (leaf or is_hit(found[1], current))
        if not hit:
            result = functions[s["uses"]](spark, config, {n: done[n].result for n in needs})
            closure = nothing if leaf else identity.merge_read_sets(*[done[n].closure for n in needs], now[s["uses"]])
            found = record(spark, root, key, result, closure)
        done[s["id"]] = Outcome(key, hit, *found)
    return done
