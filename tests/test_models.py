"""Models as files, and paths that stay beside their document."""

import pytest

from foldwright.operators import estimators
from foldwright.sources import dataset


def test_a_model_comes_back_from_its_files(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 4), "abc"[i % 4 % 3]) for i in range(80)], "id long, x double, t string")
    tree = {"rf": {"n_estimators": 1, "bootstrap": False}}
    for i, spec in enumerate((tree, {"ensemble": {"members": [tree, {"logreg": {"max_iter": 5}}], "weights": [2.0, 1.0]}})):
        model = estimators.fit(df, ["x"], "t", spec)
        estimators.save(model, spark, str(tmp_path / str(i)))
        again = estimators.load(spark, str(tmp_path / str(i)))
        assert estimators.classes_of(again) == ["a", "b", "c"]
        p, q = ({(r.id, r["class"]): r.p for r in estimators.probabilities(m, df, "id").collect()} for m in (model, again))
        assert p.keys() == q.keys() and all(abs(p[k] - q[k]) < 1e-12 for k in p)


def test_paths_stay_beside_the_document(tmp_path):
    (tmp_path / "a").mkdir()
    assert dataset.beneath(str(tmp_path), "a") == str((tmp_path / "a").resolve())
    assert dataset.beneath("x://b/c", "d/../e") == "x://b/c/e" and dataset.beneath("x://b/c", "y://z") == "y://z"
    for root, ref in ((str(tmp_path), "../other"), (str(tmp_path), "/etc"), ("x://b/c", "../cc"), ("x://b/c", "/etc")):
        with pytest.raises(PermissionError):
            dataset.beneath(root, ref)
