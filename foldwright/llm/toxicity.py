"""Toxicity by a factorization machine over hashed terms.

A document's features are its distinct terms, hashed. The machine adds a weight for each term and, for each pair
of terms in a document, the product of their factors, so that an insult next to a group's name can count for more
than both alone; the sum over pairs takes one pass over the terms. It is fitted on a bounded sample of labelled
rows (the bound is SAMPLE rows a class) in one task, and its parameters, bounded by TERMS, go to every scoring task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import SPACE, Aside, cut, ship, small_batches, table

ship(__name__)

#: Labelled rows of a class that the machine is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 6000
#: Terms with parameters, at most: those whose presence tells most about the label in the sample.
TERMS, MIN_DOCS = 2000, 3
BITS, FACTORS, EPOCHS, BATCH, RATE, DECAY = 40, 4, 40, 256, 0.2, 3e-4
#: Log odds that a document must show beyond even ones.
CAUTION = 0.5
EDGE = b".,;:!?\"'()[]{}<>*#$%&|-_"


def terms_of(text: str) -> list[bytes]:
    """Distinct words without marks at their ends, A-Z in lower case."""
    return list({w.strip(EDGE) for w in text.encode().lower().split()} - {b""})


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) >> (64 - BITS)


class FactorizationMachine:
    """Logistic; x_j is 1 for each known term of a document."""

    def __init__(self, ids: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.ids, self.bias, self.w, self.v = ids, bias, w, v

    @classmethod
    def fit(cls, docs: list[np.ndarray], y: np.ndarray) -> FactorizationMachine:
        """docs: hashed terms. Both classes weigh the same, however common they are; CAUTION is then taken off the bias."""
        y = y.astype(float)
        flat = np.concatenate([np.empty(0, np.int64), *docs])
        ids, at, df = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        pos = np.bincount(at, weights=y[owner], minlength=len(ids)) if len(flat) else np.zeros(0)
        n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
        told = np.abs(pos / n1 - (df - pos) / n0) / np.sqrt(df / len(docs) / len(docs) + 1e-12) if len(ids) else np.zeros(0)
        keep = np.sort(np.lexsort((ids, -told, df < MIN_DOCS))[:TERMS])
        keep = keep[df[keep] >= MIN_DOCS]
        place = np.full(len(ids), -1)
        place[keep] = np.arange(len(keep))
        rows = [place[x] for x in np.split(at, np.cumsum([len(d) for d in docs])[:-1])] if len(flat) else [np.zeros(0, int) for _ in docs]
        rows = [r[r >= 0] for r in rows]
        rng = np.random.default_rng(7)
        weigh = np.where(y == 1, len(y) / n1 / 2, len(y) / n0 / 2) if y.any() and not y.all() else np.ones(len(y))
        m = cls(ids[keep], 0.0 if y.any() and not y.all() else float(np.log(n1 / n0)), np.zeros(len(keep)), rng.normal(0, 0.01, (len(keep), FACTORS)))
        gw, gv, gb = np.full(len(keep), 1e-2), np.full((len(keep), FACTORS), 1e-2), 1e-2
        for _ in range(EPOCHS if len(keep) else 0):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                j = np.concatenate([rows[k] for k in part])
                if not len(j):
                    continue
                of = np.repeat(np.arange(len(part)), [len(rows[k]) for k in part])
                s, q = m._sums(j, of, len(part))
                z = m.bias + np.bincount(of, weights=m.w[j], minlength=len(part)) + 0.5 * (s * s - q).sum(1)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weigh[part] / len(part)
                uniq, inv = np.unique(j, return_inverse=True)
                dw = np.bincount(inv, weights=err[of], minlength=len(uniq)) + DECAY * m.w[uniq]
                dv = np.stack([np.bincount(inv, weights=err[of] * (s[of, f] - m.v[j, f]), minlength=len(uniq)) for f in range(FACTORS)], 1) + DECAY * m.v[uniq]
                gw[uniq] += dw * dw
                gv[uniq] += dv * dv
                gb += err.sum() ** 2
                m.w[uniq] -= RATE * dw / np.sqrt(gw[uniq])
                m.v[uniq] -= 0.3 * RATE * dv / np.sqrt(gv[uniq])
                m.bias -= RATE * err.sum() / np.sqrt(gb)
        m.bias -= CAUTION
        return m

    def _sums(self, j: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each document the sums of factors and of their squares."""
        v = self.v[j]
        col = lambda x: np.stack([np.bincount(of, weights=x[:, f], minlength=n) for f in range(x.shape[1])], 1)
        return col(v), col(v * v)

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Probabilities; docs: places of known terms."""
        j = np.concatenate([np.empty(0, np.int64), *docs]).astype(np.int64)
        of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        s, q = self._sums(j, of, len(docs))
        z = self.bias + np.bincount(of, weights=self.w[j], minlength=len(docs)) + 0.5 * (s * s - q).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fitted(docs: DataFrame, labels: DataFrame) -> FactorizationMachine:
    """docs (id, text), labels (id, y), both without held-out rows. Without labelled rows every score is 0.5."""
    y = labels.where("id is not null and y is not null").groupBy("id").agg(F.max(F.col("y").cast("int")).alias("y"))
    y = cut(y.where("y in (0, 1)"))
    some = lambda k: y.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = cut(some(0).unionByName(some(1)))  # at most 2 * SAMPLE rows, so it may be broadcast

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [np.array(sorted(map(term_hash, terms_of(x))), np.int64) for x in b.column("text").to_pylist()]
            at = pa.array(np.cumsum([0, *map(len, t)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.empty(0, np.int64), *t])))], names=["id", "y", "t"])

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")  # the order in which rows arrive is no part of the result
        m = FactorizationMachine.fit([np.asarray(x, np.int64) for x in t.column("t").to_numpy(zero_copy_only=False)], t.column("y").to_numpy())
        return pa.table({"bias": [m.bias], "ids": pa.array([m.ids.tobytes()], pa.binary()), "w": pa.array([m.w.tobytes()], pa.binary()), "v": pa.array([m.v.tobytes()], pa.binary())})

    used = docs.join(F.broadcast(sample), "id").mapInArrow(hashed, f"id {docs.schema['id'].dataType.simpleString()}, y int, t array<long>")
    model = cut(used.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(fit, "bias double, ids binary, w binary, v binary")).first()
    if model is None:
        return FactorizationMachine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    return FactorizationMachine(np.frombuffer(model.ids, np.int64), model.bias, np.frombuffer(model.w), np.frombuffer(model.v).reshape(-1, FACTORS))


def scored(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """docs without their text, with `_score`, which replaces a column of that name.

    A null text is empty; an empty one has the bias for its score. Repeated rows repeat; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.ids, model.bias, model.w, model.v))  # at most TERMS terms
    all_of = Aside(docs)
    text = all_of.of(text_col)
    names = [n for n in all_of.names if n != text]
    own = all_of.df.select(*names, F.coalesce(text, F.lit("")).alias("text"))
    kinds = "".join(f"{n} {own.schema[n].dataType.simpleString()}, " for n in names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = FactorizationMachine(*shared.value)
        place, known = {int(h): i for i, h in enumerate(m.ids)}, {}
        for b in batches:
            docs = []
            for text in b.column("text").to_pylist():
                out = set()  # marks may differ, so two words of a text may be one term
                for w in set(text.encode().lower().split()):
                    k = known.get(w)
                    if k is None:
                        if len(known) > 500_000:
                            known.clear()
                        s = w.strip(EDGE)
                        k = known[w] = place.get(term_hash(s), -1) if s else -1
                    if k >= 0:
                        out.add(k)
                docs.append(np.array(sorted(out), np.int64))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(m.score(docs))], names=[*names, "score"])

    out = own.mapInArrow(score, f"{kinds}score double")
    return all_of.back(out, {"_score": "score"}, (text_col,))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out: rows whose crc32 of the id as text leaves 0 by 5; a null id is not held out."""
    small_batches(spark)
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = docs.where(~held("doc_id")).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    labels = table(spark, sf_dir, "labels").where(~held("doc_id")).select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))
    out = scored(docs, fitted(train, labels))
    return out.select("doc_id", held("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
