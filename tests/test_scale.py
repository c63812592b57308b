"""Plans that replace a task with all rows: the same results, on shapes that the registered queries don't have."""

import random

import pytest
from pyspark.sql import functions as F

from foldwright.functions import scalars
from foldwright.operators import decide, encode, identity, ranges
from foldwright.plans import dag
from foldwright.streaming import progress


def test_running_totals_of_ties_nulls_and_keys(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.choice([None, 1, 2, 2, 2, 50]), rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, t int, v long")
    order = [F.col("t"), F.col("id")]
    got = {r.id: (r.s, r.n) for r in ranges.ranked(ranges.running_total(df, F.col("v"), order, "s", ["k"], 8), order, "n", None, 8).collect()}
    key = lambda r: (r[2] is not None, r[2] or 0, r[0])
    rows.sort(key=key)
    for i, r in enumerate(rows):
        assert got[r[0]] == (sum(x[3] for x in rows[: i + 1] if x[1] == r[1]), i + 1)
    assert ranges.ranked(df.where("false"), order, "n").count() == 0


def test_eviction_by_ranges(spark):
    blobs = spark.createDataFrame([(f"h{i:03d}", 1 + i % 7, i // 5) for i in range(200)], "hash string, size long, mtime long")
    total, gone = sum(1 + i % 7 for i in range(200)), []
    for i in range(200):
        if total <= 300:
            break
        gone.append(f"h{i:03d}")
        total -= 1 + i % 7
    assert sorted(r.hash for r in identity.evicted(blobs, 300).collect()) == gone
    assert identity.evicted(blobs, 0).count() == 0


def test_rates_over_chunks(spark, monkeypatch):
    df = spark.createDataFrame([(i, "r", 1.7e9 + i * (1 + i % 3)) for i in range(400)], "event_id long, run string, s double").withColumn("ts", F.timestamp_seconds("s"))
    want = {r.event_id: r.rate for r in progress.moving_rate(df, ["run"]).collect()}
    monkeypatch.setattr(progress, "CHUNK", 100)
    assert {r.event_id: r.rate for r in progress.moving_rate(df, ["run"]).collect()} == want and want[399] is not None


def test_deep_and_diamond_graphs(spark):
    chain = spark.range(500).select((F.col("id") + 1).cast("int").alias("child"), F.col("id").cast("int").alias("parent"))
    assert dag.closure(spark, chain).count() == 500 * 501 // 2
    assert {r.node: r.level for r in dag.levels(spark, chain).collect()} == {i: i for i in range(501)}
    diamonds = spark.createDataFrame([(3 * i + k, 3 * i) for i in range(30) for k in (1, 2)] + [(3 * i + 3, 3 * i + k) for i in range(30) for k in (1, 2)] + [(3, 0)], "child int, parent int")
    got = {r.node: r.level for r in dag.levels(spark, diamonds).collect()}
    assert got[90] == 60 and got[3] == 2 and dag.closure(spark, diamonds).where("child = 90").count() == 90
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "child int, parent int")
    assert dag.closure(spark, ring).count() == 9
    with pytest.raises(dag.GraphError):
        dag.levels(spark, ring)


def test_offsets_of_four_classes(spark, monkeypatch):
    monkeypatch.setattr(decide, "POINTS", 5)
    rng = random.Random(3)
    classes = list("abcd")
    rows = [(i, [rng.random() for _ in classes], rng.choice(classes)) for i in range(60)]
    probs = spark.createDataFrame([(i, c, p) for i, ps, _ in rows for c, p in zip(classes, ps)], "id int, class string, p double")
    got = decide.tune_offsets(probs, spark.createDataFrame([(i, y) for i, _, y in rows], "id int, y string"), classes, "accuracy").first()
    import itertools
    import math

    def score(off):
        return sum(classes[max(range(4), key=lambda k: (round(math.log(ps[k]) + off[k], 12), -k))] == y for _, ps, y in rows) / 60

    best, at = score((0,) * 4), (0.0,) * 4
    for p in itertools.product([-4.0, -2.0, 0.0, 2.0, 4.0], repeat=3):
        if round(score((0, *p)), 12) > round(best, 12):
            best, at = score((0, *p)), (0.0, *p)
    assert got.accuracy == pytest.approx(best) and tuple(got[f"offset_{c}"] for c in classes) == at


def test_a_class_without_an_offset_stays(spark):
    probs = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.8)], "id int, class string, p double")
    assert decide.apply_offsets(probs, spark.createDataFrame([("a", 0.1)], "class string, offset double")).first().label == "b"


def test_rows_without_a_label_are_no_part_of_a_mean(spark):
    df = spark.createDataFrame([(1, "g", 1.0), (2, "g", 0.0), (3, "g", None), (4, "h", None)], "id int, k string, y double")
    got = {r.id: r.enc for r in encode.encode_loo(df, "k", "y", 0.0).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 0.5, 4: 0.5}


def test_whole_numbers_are_one_key(spark):
    df = spark.createDataFrame([({"a": "1", "b": "x"},), ({"b": "x", "a": "1.0"},), ({"b": "x", "a": "1.5"},)], "m map<string,string>")
    assert [r[0] for r in df.select(scalars.canonical_map(F.col("m"))).collect()] == ["a=1,b=x", "a=1,b=x", "a=1.5,b=x"]
