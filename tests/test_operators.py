import pytest
from pyspark.sql import functions as F

from foldwright.operators import decide, encode, folds, identity, ledger, metrics, reduce, select, space
from foldwright.plans import dag, documents


def stats(spark, rows):
    return spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows)], "family string, ord int, mean double, se double, n int, mean_complexity double")


def picked(df):
    return [r.ord for r in df.collect()]


def test_rules_on_known_numbers(spark):
    s = stats(spark, [(0.92, 0.0, 5, 31.0), (0.912, 0.0, 5, 9.0), (0.905, 0.0, 5, 9.0)])
    assert picked(select.pct_loss(s, 0.02)) == [1]
    assert picked(select.argmax_mean(s)) == [0]
    s = stats(spark, [(0.61, 0.004, 5, 22.0), (0.603, 0.004, 5, 8.0)])
    assert picked(select.one_std_err(s)) == [0]
    s = stats(spark, [(0.7, 0.03, 5, 1.0), (0.69, 0.0, 5, 1.0)])
    assert picked(select.mean_std(s)) == [1]
    assert picked(select.parsimony(stats(spark, [(0.5, 0.0, 5, 20.0), (0.6, 0.0, 5, 21.5)]), "maximize")) == [1]
    assert picked(select.parsimony(stats(spark, [(0.5, 0.0, 5, 20.0), (0.6, 0.0, 5, 25.0)]), "maximize")) == [0]


def test_folds_cover_and_balance(spark):
    df = spark.range(100).withColumn("y", F.col("id") % 3)
    f = folds.assign_folds(df, "id", 4, 1, "y")
    counts = {(r.y, r.fold): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    assert f.count() == 100 and len(counts) == 12 and all(max(v for (y, _), v in counts.items() if y == k) - min(v for (y, _), v in counts.items() if y == k) <= 1 for k in range(3))
    with pytest.raises(ValueError):
        folds.assign_folds(df, "id", 1)


def test_leave_one_out_closed_form(spark):
    df = spark.createDataFrame([(i, "a", y) for i, y in enumerate([1.0, 1.0, 0.0, 0.0])], "id int, k string, y double")
    assert [round(r.enc, 9) for r in encode.encode_loo(df, "k", "y", 0.0).orderBy("id").collect()] == [round(x, 9) for x in (1 / 3, 1 / 3, 2 / 3, 2 / 3)]


def test_nonfit_takes_prior_for_unseen(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 1.0, True), ("a", 0.0, True), ("b", 0.0, True), ("b", 0.0, True), ("zzz", None, False), ("a", None, False), (None, None, False)], "k string, y double, fit boolean")
    got = {r.k: r.enc for r in encode.encode_nonfit(df, F.col("fit"), "k", "y", 0.0).collect()}
    assert got["zzz"] == pytest.approx(0.4) and got["a"] == pytest.approx(2 / 3) and got[None] == pytest.approx(0.4)


def test_scores(spark):
    df = spark.createDataFrame([("a", "a")] * 9 + [("b", "a")], "y string, p string")
    assert metrics.accuracy(df).first()[0] == pytest.approx(0.9) and metrics.balanced_accuracy(df).first()[0] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        metrics.scorer("nope")


def test_levels_stay_apart_in_the_view(spark):
    rows = [("c", "p1", "ok", "inner", 0, {"n": "1"}, {"s": 0.8}, 1), ("c", "p2", "ok", "outer", 0, {"n": "1"}, {"s": 0.72}, 2)]
    led = spark.createDataFrame(rows, "code_fingerprint string, point_addr string, status string, level string, fold int, free_params map<string,string>, metrics map<string,double>, append_ord int")
    assert sorted(r["mean"] for r in reduce.aggregate_view(led, "s").collect()) == [0.72, 0.8]
    assert ledger.append(led, led).count() == 2
    with pytest.raises(ValueError):
        ledger.resolve_prefix(led, "point_addr", "p")


def test_cells(spark):
    df = spark.createDataFrame([("true",), ('["a"]',), ("12",), ("1.5",), ("x",), ("",)], "s string")
    assert [r[0] for r in df.select(ledger.cell_kind(F.col("s"))).collect()] == ["bool", "json", "int", "float", "string", None]


def test_expansion():
    s = {"a": {"x": {"$any": [1, 2, 3, 4]}, "m": {"$any": {"p": {"q": {"$any": [1, 2, 3]}}, "r": {"$any": [1, 2, 3, 4, 5, 6]}}}}}
    assert len(list(space.expand(s))) == 36
    assert space.range_values("$log-range", [1, 1000, 4]) == pytest.approx([1, 10, 100, 1000])
    assert space.range_values("$linear-range", [0, 10, 3]) == [0, 5, 10]
    for bad in ({"$any": []}, {"$any": [1], "$log-range": [1, 2]}, {"$what": 1}, {"$linear-range": [0, 1]}):
        with pytest.raises(space.SpaceError):
            list(space.expand({"a": bad}))


def test_graphs_and_documents():
    steps = [{"id": "b", "uses": "x/b", "needs": ["a"]}, {"id": "a", "uses": "x/a"}]
    assert [s["id"] for s in dag.topo_sort(steps)] == ["a", "b"]
    with pytest.raises(dag.GraphError):
        dag.validate([{"id": "a", "uses": "x/a", "needs": ["b"]}, {"id": "b", "uses": "bad", "needs": ["a", "c"]}])
    with pytest.raises(documents.DocumentError):
        documents.parse_experiment("no front matter")
    assert documents.parse_rule({"pct-loss": 0.02}) == ("pct-loss", {"tolerance": 0.02})
    assert decide.holdout_folds(0.4) == 2 and decide.parse_decide({"offsets": {"holdout": 0.2}}) == 0.2


def test_tuned_offsets_never_lose(spark):
    p = spark.createDataFrame([(i, c, v) for i in range(40) for c, v in (("a", 0.6 if i % 4 else 0.55), ("b", 0.4 if i % 4 else 0.45))], "id int, class string, p double")
    y = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(40)], "id int, y string")
    best = decide.tune_offsets(p, y, ["a", "b"]).first()
    assert best.balanced_accuracy == pytest.approx(1.0) and best.offset_a == 0.0


def test_identity(spark):
    assert identity.canonical_hash({"b": 1, "a": [1.5]}) == identity.canonical_hash({"a": [1.5], "b": 1})
    with pytest.raises(ValueError):
        identity.canonical_hash(float("nan"))
    blobs = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 3)], "hash string, size int, mtime int")
    assert [r.hash for r in identity.evicted(blobs, 9).collect()] == ["a", "b"] and identity.evicted(blobs, 0).count() == 0
