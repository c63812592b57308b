"""Identity by content: hashes, read sets, drift, and eviction."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.operators.ranges import running_total


def canonical_hash(value: Any) -> str:
    """sha256 of JSON with sorted keys; numbers that aren't finite are errors."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def point_address(resolved: dict, shape_blob: str, seed: int) -> str:
    return canonical_hash({"seed": seed, "shape": shape_blob, "with": resolved})


def step_key(step: str, uses: str, config: dict, seed: int, upstream: list[str]) -> str:
    """Known before a step runs: its own configuration and the keys of what it needs."""
    return canonical_hash({"seed": seed, "step": step, "upstream": sorted(upstream), "uses": uses, "with": config})


def manifest_hash(files: DataFrame, by: list[str]) -> DataFrame:
    """(path, hash) in order of paths to one hash for each group. A manifest is one run's, so its rows meet in one task."""
    line = F.concat_ws(" ", "path", "hash")
    return files.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("manifest"), F.count("*").alias("files"))


def merge_read_sets(*sets: DataFrame) -> DataFrame:
    """(repo, path, hash) by (repo, path); a later set's hash holds."""
    u = None
    for i, s in enumerate(sets):
        part = s.select("repo", "path", "hash", F.lit(i).alias("_i"))
        u = part if u is None else u.unionByName(part)
    return u.groupBy("repo", "path").agg(F.max_by("hash", "_i").alias("hash"))


def drift(captured: DataFrame, current: DataFrame) -> DataFrame:
    """Captured files that changed or went."""
    j = captured.join(current.select("repo", "path", F.col("hash").alias("now")), ["repo", "path"], "left")
    return j.where(~F.col("hash").eqNullSafe(F.col("now"))).select("repo", "path", "hash", "now", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("state"))


def unchanged(stored: DataFrame, current: DataFrame) -> bool:
    return drift(stored, current).isEmpty()


def pool_size(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def evicted(blobs: DataFrame, max_bytes: int, keep: list[str] | None = None) -> DataFrame:
    """(hash, size, mtime): oldest first, by hash among equals, until the rest fits; none if max_bytes is not above 0.

    The running sum goes by ranges of mtime, so no task holds the whole index.
    """
    total = blobs.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    may = blobs.where(~F.col("hash").isin(keep)) if keep else blobs
    out = running_total(may, F.col("size"), [F.col("mtime"), F.col("hash")], "_with").withColumn("_prior", F.col("_with") - F.col("size")).crossJoin(F.broadcast(total)).where((F.col("total") - F.col("_prior") > max_bytes) & F.lit(max_bytes > 0))
    return out.select(*blobs.columns)
