import shutil

import pytest

from foldwright.plans import cache
from foldwright.plans.dag import GraphError

STEPS = [
    {"id": "sum", "uses": "x/sum", "needs": ["make"]},
    {"id": "make", "uses": "x/make", "with": {"n": 5}},
]


@pytest.fixture
def ran():
    return []


@pytest.fixture
def functions(ran):
    def make(spark, config, needs):
        ran.append("make")
        return spark.range(config["n"])

    def total(spark, config, needs):
        ran.append("sum")
        return needs["make"].groupBy().sum("id").toDF("s")

    return {"x/make": make, "x/sum": total}


def files(spark, **hashes):
    return {f"x/{k}": spark.createDataFrame([("r", f"{k}.py", h)], cache.READ_SET) for k, h in hashes.items()}


def test_hits_while_nothing_changed(spark, tmp_path, functions, ran):
    go = lambda steps=STEPS, seed=0, **h: cache.run_cached(spark, str(tmp_path), steps, functions, seed, files(spark, **({"make": "1", "sum": "1"} | h)))
    first = go()
    assert first["sum"].result.first().s == 10 and ran == ["make", "sum"] and not first["sum"].hit
    assert sorted(tuple(r) for r in first["sum"].closure.collect()) == [("r", "make.py", "1"), ("r", "sum.py", "1")]
    again = go()
    assert all(o.hit for o in again.values()) and again["sum"].result.first().s == 10 and len(ran) == 2
    assert {k: o.hit for k, o in go(sum="2").items()} == {"make": True, "sum": False}
    # a change before a step is in its closure, too
    assert {k: o.hit for k, o in go(sum="2", make="2").items()} == {"make": False, "sum": False}
    assert not any(o.hit for o in go(seed=1, sum="2", make="2").values())
    wider = [STEPS[0], STEPS[1] | {"with": {"n": 6}}]
    assert go(wider, sum="2", make="2")["sum"].result.first().s == 15


def test_wiped_results_and_missing_hashes_are_made_again(spark, tmp_path, functions, ran):
    read = files(spark, make="1", sum="1")
    one = cache.run_cached(spark, str(tmp_path), STEPS, functions, 0, read)
    shutil.rmtree(tmp_path / one["make"].key / "result")
    two = cache.run_cached(spark, str(tmp_path), STEPS, functions, 0, read)
    assert not two["make"].hit and two["sum"].hit and ran == ["make", "sum", "make"]
    shutil.rmtree(tmp_path / one["sum"].key / "closure")
    assert not cache.run_cached(spark, str(tmp_path), STEPS, functions, 0, read)["sum"].hit
    none = files(spark, make=None, sum="1")
    cache.run_cached(spark, str(tmp_path), STEPS, functions, 0, none)
    assert not any(o.hit for o in cache.run_cached(spark, str(tmp_path), STEPS, functions, 0, none).values())


def test_immutable_leaves_and_bad_graphs(spark, tmp_path, functions, ran):
    steps = [STEPS[0], STEPS[1] | {"immutable": True}]
    cache.run_cached(spark, str(tmp_path), steps, functions, 0, files(spark, make="1", sum="1"))
    out = cache.run_cached(spark, str(tmp_path), steps, functions, 0, files(spark, make="2", sum="1"))
    assert out["make"].hit and out["sum"].hit and ran == ["make", "sum"]
    assert [tuple(r) for r in out["sum"].closure.collect()] == [("r", "sum.py", "1")]
    with pytest.raises(GraphError):
        cache.run_cached(spark, str(tmp_path), [{"id": "a", "uses": "x/make", "needs": ["b"]}], functions)


def test_source_is_the_default_read_set(spark, tmp_path, functions):
    assert cache.source_of(spark, functions["x/make"]).first().hash
    cache.run_cached(spark, str(tmp_path), STEPS, functions)
    assert all(o.hit for o in cache.run_cached(spark, str(tmp_path), STEPS, functions).values())
