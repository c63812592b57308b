"""Step graphs: order, closure and validation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.functions.lineage import settled

USES = re.compile(r"[a-z0-9][a-z0-9-]*(/[a-z0-9][a-z0-9-]*)+")


class GraphError(ValueError):
    pass


def topo_sort(steps: list[dict]) -> list[dict]:
    """Needs first, otherwise as declared. Unknown needs and a step's need of itself are no edges; a cycle is an error."""
    known = {s["id"] for s in steps}
    left = {s["id"]: {n for n in s.get("needs") or [] if n in known and n != s["id"]} for s in steps}
    out: list[dict] = []
    while left:
        ready = [s for s in steps if s["id"] in left and not left[s["id"]]]
        if not ready:
            raise GraphError(f"a cycle among {', '.join(sorted(left))}")
        out.append(ready[0])
        del left[ready[0]["id"]]
        for needs in left.values():
            needs.discard(ready[0]["id"])
    return out


def validate(steps: list[dict]) -> None:
    """Unique ids, known needs, well-formed types, no cycle; all violations are told together."""
    found, ids = [], [s.get("id") for s in steps]
    found += [f"id {i!r} twice" for i in sorted({i for i in ids if ids.count(i) > 1}, key=str)]
    found += [f"step without an id: {s}" for s in steps if not s.get("id")]
    found += [f"{s.get('id')}: no step {n!r}" for s in steps for n in s.get("needs") or [] if n not in ids]
    found += [f"{s.get('id')}: uses {s.get('uses')!r} is no layer/type" for s in steps if not USES.fullmatch(str(s.get("uses") or ""))]
    try:
        topo_sort([s for s in steps if s.get("id")])
    except GraphError as e:
        found.append(str(e))
    if found:
        raise GraphError("; ".join(found))


def phase_violations(phases: dict[str, int], steps: list[dict]) -> list[str]:
    """Needs of a step in a later phase than its own."""
    return [f"{s['id']} needs {n} of a later phase" for s in steps for n in s.get("needs") or [] if n in phases and phases[n] > phases[s["id"]]]


def rewired(step: dict, dropped: set[str], added: str) -> dict:
    """Needs without those dropped, and with the partition step at the end."""
    needs = [n for n in step.get("needs") or [] if n not in dropped and n != added]
    return {**step, "needs": [*needs, added]}


def closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(child, parent) to all (child, ancestor), cycles or not.

    Ways are doubled each round, so a chain takes as many rounds as its length has binary digits, and only pairs that
    are new go on.
    """
    known = new = settled(edges.select("child", F.col("parent").alias("ancestor")).distinct())
    while not new.isEmpty():
        a, b = new.alias("a"), known.alias("b")
        on = lambda x, y: x.join(y, F.col("a.ancestor") == F.col("b.child")).select(F.col("a.child").alias("child"), F.col("b.ancestor").alias("ancestor"))
        longer = on(a, b).unionByName(on(known.alias("a"), new.alias("b"))).distinct()
        new = settled(longer.join(known, ["child", "ancestor"], "left_anti"))
        known = settled(known.unionByName(new))
    return known


def levels(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, level): the longest way up to a node without parents, which has level 0. A cycle is an error."""
    ways = settled(edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("n")).distinct())
    ends = edges.select(F.col("child").alias("node")).union(edges.select("parent"))
    most, size = ends.distinct().count(), None
    while (now := tuple(ways.agg(F.count("*"), F.sum("n"), F.max("n")).first())) != size:
        if (now[2] or 0) >= max(most, 1):
            raise GraphError("the edges have a cycle")
        size = now
        a, b = ways.alias("a"), ways.alias("b")
        twice = a.join(b, F.col("a.ancestor") == F.col("b.child")).select(F.col("a.child").alias("child"), F.col("b.ancestor").alias("ancestor"), (F.col("a.n") + F.col("b.n")).alias("n"))
        ways = settled(ways.unionByName(twice).groupBy("child", "ancestor").agg(F.max("n").alias("n")))
    top = ways.groupBy(F.col("child").alias("node")).agg(F.max("n").alias("level"))
    return ends.distinct().join(top, "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))
