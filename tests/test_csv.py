"""The ledger as CSV, cross-fit guards and seeded noise."""

import pytest
from pyspark.sql import functions as F

from foldwright.operators import encode, ledger

COLUMNS = "code_fingerprint string, point_addr string, status string, level string, fold int, free_params map<string,string>, metrics map<string,double>, append_ord long"


def test_a_ledger_comes_back_from_csv(spark, tmp_path):
    rows = [
        ("v1", "p1", "ok", None, None, {"model": "linear", "cols": '["x, y", "z"]'}, {"t.s": 0.125}, 4),
        ("v1", "p2", "ok", None, None, {"model": 'a "b"\nc', "depth": "3"}, {"t.s": 1e-9, "t.n": 2.0}, 9),
        ("v1", "p3", "failed", None, None, {}, {}, 12),
    ]
    path = str(tmp_path / "led")
    ledger.write_csv(spark.createDataFrame(rows[::-1], COLUMNS), path)
    back = ledger.read_csv(spark, path).orderBy("append_ord").collect()
    assert "level" not in spark.read.option("header", True).csv(path).columns
    assert [(r.point_addr, r.status, r.free_params, r.metrics, r.append_ord) for r in back] == [(r[1], r[2], r[5], r[6], i) for i, r in enumerate(rows)]


def test_folds_that_a_table_allows(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b", float(i == 0)) for i in range(6)], "id long, k string, y double")
    assert encode.cross_fit(df, "y", 9) == (6, False)
    assert encode.cross_fit(df, "k", 2) == (2, False)
    assert encode.cross_fit(df.union(df), "k", 2) == (2, True)
    one = encode.encode_kfold(df.where("id = 0"), "k", "y", "id").collect()
    assert [(r.id, r.enc) for r in one] == [(0, 1.0)]
    with pytest.raises(ValueError):
        encode.encode_kfold(df, "k", "y", "id", k=1)


def test_noise_is_normal_and_the_same_again(spark):
    df = spark.range(20000).select("id", encode.seeded_normal(3, F.col("id")).alias("z"))
    m = df.agg(F.avg("z").alias("m"), F.stddev("z").alias("s"), F.avg((F.abs("z") < 1).cast("double")).alias("in1")).first()
    assert abs(m.m) < 0.03 and abs(m.s - 1) < 0.03 and abs(m.in1 - 0.6827) < 0.02
    assert df.agg(F.sum("z")).first() == df.agg(F.sum("z")).first()
    with pytest.raises(ValueError):
        encode.encode_loo(df, "id", "z", noise=0.1)
