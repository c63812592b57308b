"""Class offsets and blends, on long frames: id, class, p."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-12
LOW, HIGH, POINTS = -4.0, 4.0, 41


def apply_offsets(probs: DataFrame, offsets: DataFrame, out: str = "label") -> DataFrame:
    """The class with the highest log(max(p, 1e-12)) + offset; the first class of equals. offsets: class, offset.

    A class without an offset has 0; uncovered() names such classes where that is an error.
    """
    j = probs.join(F.broadcast(offsets), "class", "left")  # offsets: a row for each class
    score = F.ln(F.greatest(F.col("p"), F.lit(FLOOR))) + F.coalesce(F.col("offset"), F.lit(0.0))
    return j.groupBy("id").agg(F.min(F.struct((-score).alias("s"), F.col("class").alias("c"))).alias("b")).select("id", F.col("b.c").alias(out))


def uncovered(probs: DataFrame, offsets: DataFrame) -> DataFrame:
    """Classes of the probabilities that the offsets don't have."""
    return probs.select("class").distinct().join(offsets, "class", "left_anti")


def tune_offsets(probs: DataFrame, labels: DataFrame, classes: list[str], metric: str = "balanced_accuracy") -> DataFrame:
    """One row: offset_<class> and the metric, accuracy or balanced_accuracy, of the best point of the grid.

    The first class is pinned at 0; nothing beats no offsets on a tie, and an earlier point beats a later one. For each
    pair of classes a row tells only how many steps of the grid leave the one ahead of the other. Rows are counted by
    these numbers, whose combinations are bounded whatever the table, and only the counts meet the grid, which has
    POINTS ** (classes - 1) points.
    """
    if len(classes) < 2:
        raise ValueError("offsets are tuned for two classes or more")
    if metric not in ("accuracy", "balanced_accuracy"):
        raise ValueError(f"offsets are tuned for accuracy or balanced_accuracy, not {metric!r}")
    k, step = len(classes), (HIGH - LOW) / (POINTS - 1)
    wide = probs.groupBy("id").agg(*[F.max(F.when(F.col("class") == c, F.col("p"))).alias(f"p{i}") for i, c in enumerate(classes)]).join(labels, "id")
    log = [F.ln(F.greatest(F.col(f"p{i}"), F.lit(FLOOR))) for i in range(k)]
    axis = F.array(*[F.lit(LOW + i * step) for i in range(POINTS)])
    gaps = F.array(*[F.lit(round(i * step, 12)) for i in range(1 - POINTS, POINTS)])
    # of the pinned class: the points of the other's axis that leave it ahead; of two others: the gaps between theirs that do
    of_pinned = lambda p: F.size(F.filter(axis, lambda a: p + a <= log[0]))
    of_others = lambda d: F.size(F.filter(gaps, lambda g: g <= F.round(d, 12)))
    ahead = {(0, j): of_pinned(log[j]) for j in range(1, k)} | {(i, j): of_others(log[i] - log[j]) for i in range(1, k) for j in range(i + 1, k)}
    cells = wide.select("y", *[c.alias(f"c{i}_{j}") for (i, j), c in ahead.items()]).groupBy("y", *[f"c{i}_{j}" for i, j in ahead]).agg(F.count("*").alias("n"))
    d = cells.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(POINTS ** (k - 1)))))
    at = {j: F.when(F.col("ord") == 0, F.lit((POINTS - 1) // 2)).otherwise(F.expr(f"cast((ord - 1) div {POINTS ** (k - 1 - j)} % {POINTS} as int)")) for j in range(1, k)}
    leads = {(i, j): (at[j] if i == 0 else at[j] - at[i] + POINTS - 1) < F.col(f"c{i}_{j}") for i, j in ahead}
    label = F.lit(None)
    for j in reversed(range(k)):
        won = F.lit(True)
        for i in range(k):
            won = won & (leads[j, i] if j < i else ~leads[i, j]) if i != j else won
        label = F.when(won, F.lit(classes[j])).otherwise(label)
    hits = d.groupBy("ord", "y").agg(F.sum(F.when(label == F.col("y"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("of"))
    score = F.avg(F.col("hit") / F.col("of")) if metric == "balanced_accuracy" else F.sum("hit") / F.sum("of")
    best = hits.groupBy("ord").agg(F.round(score, 12).alias(metric)).orderBy(F.col(metric).desc(), "ord").limit(1)
    offset = lambda j: F.when(F.col("ord") == 0, F.lit(0.0)).otherwise(F.lit(LOW) + at[j] * F.lit(step))
    return best.select(F.lit(0.0).alias(f"offset_{classes[0]}"), *[offset(j).alias(f"offset_{classes[j]}") for j in range(1, k)], metric)


def parse_decide(spec: object, regressor: bool = False) -> float | None:
    """None for argmax, or the share held out for offsets."""
    if spec in (None, "argmax"):
        return None
    if not isinstance(spec, dict) or set(spec) != {"offsets"} or not isinstance(spec["offsets"], dict) or set(spec["offsets"]) != {"holdout"}:
        raise ValueError(f"decide is argmax or {{offsets: {{holdout: h}}}}, not {spec!r}")
    if regressor:
        raise ValueError("a regressor decides nothing, so it has no offsets")
    h = spec["offsets"]["holdout"]
    if isinstance(h, bool) or not isinstance(h, int | float) or not 0 < h <= 0.5:
        raise ValueError(f"holdout is above 0 and at most 0.5, not {h!r}")
    return float(h)


def holdout_folds(holdout: float) -> int:
    return round(1 / holdout)  # half to even


def weights_of(weights: list[float] | None, n: int) -> list[float]:
    w = weights or [1.0 / n] * n
    if len(w) != n or not all(math.isfinite(x) and x > 0 for x in w):
        raise ValueError("a blend has one positive, finite weight for each member")
    return [x / sum(w) for x in w]


def blend(members: list[DataFrame], weights: list[float] | None = None, offsets: list[DataFrame | None] | None = None) -> DataFrame:
    """id, label: the class with the highest weighted sum of log(max(p, 1e-12)) + offset over members (id, class, p).

    Ids and classes must be the same in all members. Each member has offsets (class, offset) of its own, or none.
    """
    if offsets is not None and len(offsets) != len(members):
        raise ValueError("a blend has offsets, or None, for each member")
    w = weights_of(weights, len(members))
    all_of = None
    for i, m in enumerate(members):
        part = m.select("id", "class", "p", F.lit(w[i]).alias("w"))
        own = offsets[i] if offsets else None
        if own is None:
            part = part.withColumn("offset", F.lit(0.0))
        else:  # a row for each class
            part = part.join(F.broadcast(own), "class", "left").select("id", "class", "p", "w", F.coalesce("offset", F.lit(0.0)).alias("offset"))
        all_of = part if all_of is None else all_of.unionByName(part)
    sums = all_of.groupBy("id", "class").agg(F.sum(F.col("w") * (F.ln(F.greatest(F.col("p"), F.lit(FLOOR))) + F.col("offset"))).alias("s"), F.count("*").alias("n"))
    return sums.groupBy("id").agg(F.min(F.struct((-F.round("s", 12)).alias("s"), "class")).alias("b")).select("id", F.col("b.class").alias("label"))


def misaligned(members: list[DataFrame]) -> DataFrame:
    """(id, class) that not every member has exactly once."""
    u = None
    for i, m in enumerate(members):
        part = m.select("id", "class", F.lit(i).alias("m"))
        u = part if u is None else u.unionByName(part)
    return u.groupBy("id", "class").agg(F.count_distinct("m").alias("k"), F.count("*").alias("n")).where((F.col("k") != len(members)) | (F.col("n") != len(members))).select("id", "class")


def blend_id(pairs: list[tuple[str, float]]) -> str:
    return "blend-" + hashlib.sha256(json.dumps(pairs, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()[:8]
