"""Exact top-k by inner product: tiled matrix products, selection within tiles, and a tree of merges.

Vectors are packed into tiles, a row each. Every tile of queries meets every tile of candidates as one product of
matrices; of each product only k candidates a query go on. Lists of a query are merged a few tiles at a time,
level by level, so that no task holds more than FAN lists of it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.llm.common import cut, ship, table

ship(__name__)

QUERY_TILE, TILE, FAN = 1024, 8192, 16
LONG = np.iinfo(np.int64)


def whole_components(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component x as double; null where any component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    y = lambda x: x.cast("double") * scale
    # floor() of a double gives a long; from 2 ** 52 on a double is whole already
    whole = lambda x: F.when(F.abs(y(x)) < 2.0**52, F.floor(y(x)).cast("double")).otherwise(y(x))
    return F.when(fine, F.transform(vector, whole))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: by float64 where no sum can pass 2 ** 53, else by Python's integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in c], object).reshape(c.shape).T
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, query_tile: int = QUERY_TILE, tile: int = TILE) -> DataFrame:
    """(id, v) each, v an array of whole doubles: query_id, rank, vec_id, score of each query's k best candidates.

    A candidate with the query's id is its own and left out. Ties go to the smaller id. Null ids or vectors take
    no part. Repeated rows count once; of rows with one id and different vectors each is a candidate, and the k best
    of a query are those of all its vectors. Only vectors of equal length meet. Scores beyond a long are cut to its
    ends. Empty tables give no rows; other columns take no part.
    """
    one = lambda df: df.where("id is not null and v is not null").select("id", "v").distinct()
    q, c = cut(one(queries)), cut(one(candidates))
    n_q, n_c = max(1, math.ceil(q.count() / query_tile)), max(1, math.ceil(c.count() / tile))

    def pack(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        ids = t.column("id").to_numpy()[order].astype(np.int64)
        dim = t.column("dim")[0].as_py()
        m = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)[order]
        return pa.table({"dim": pa.array([dim], pa.int32()), "tile": pa.array([t.column("tile")[0].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "m": pa.array([m.astype(np.float64).tobytes()], pa.binary())})

    def tiles(df: DataFrame, n: int) -> DataFrame:
        df = df.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int").alias("tile"))
        return df.groupBy("dim", "tile").applyInArrow(pack, "dim int, tile int, ids binary, m binary")

    # both sides are repeated by tile, never by row; a pair of tiles is a task's work
    left = tiles(q, n_q).select("dim", F.col("tile").alias("qt"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("ct"), "ids", "m")
    right = tiles(c, n_c).select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qt"), F.col("tile").alias("ct"), "ids", "m")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        ct = 0
        if a.num_rows and b.num_rows:
            ct, dim = b.column("ct")[0].as_py(), b.column("dim")[0].as_py()
            get = lambda t, n, kind: np.frombuffer(t.column(n)[0].as_py(), kind)
            qi, ci = get(a, "ids", np.int64), get(b, "ids", np.int64)
            qm, cm = get(a, "m", np.float64).reshape(len(qi), dim), get(b, "m", np.float64).reshape(len(ci), dim)
            for at in range(0, len(qi), 128):
                s = _products(qm[at : at + 128], cm)
                for i, row in enumerate(s):
                    keep = ci != qi[at + i]
                    if keep.sum() > k:  # all that reach the k-th score; ties are cut by id
                        keep &= row >= np.partition(row[keep], -k)[-k]
                    at_c = np.flatnonzero(keep)
                    at_c = at_c[np.lexsort((ci[at_c], -row[at_c].astype(object) if row[at_c].min(initial=0) == LONG.min else -row[at_c]))][:k]
                    out["query_id"].append(np.full(len(at_c), qi[at + i])), out["vec_id"].append(ci[at_c]), out["score"].append(row[at_c])
        cols = {n: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for n, v in out.items()}
        return pa.table({**cols, "part": pa.array(np.full(len(cols["score"]), ct), pa.int32())})

    lists = left.groupBy("dim", "qt", "ct").cogroup(right.groupBy("dim", "qt", "ct")).applyInArrow(best, "query_id long, vec_id long, score long, part int")
    n = n_c
    while True:
        n = math.ceil(n / FAN)
        lists = lists.withColumn("part", (F.col("part") / FAN).cast("int")) if n > 1 else lists.withColumn("part", F.lit(0))
        w = Window.partitionBy("query_id", "part").orderBy(F.col("score").desc(), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if n <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best of every row of embeddings for each id divisible by 20."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), whole_components(F.col("embedding")).alias("v"))
    return top_k(v.where(F.col("id") % 20 == 0), v, 20)


OP6_SQL = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 20
"""
