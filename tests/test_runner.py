import json
import os

import pytest

from foldwright import __main__ as cli
from foldwright.plans import documents, nested, runner

SHAPE = """---
type: experiment-shape
id: s
seed: 3
pipeline:
  - id: train
    uses: any/train
    with:
      dataset: toy
      model:
        $any:
          logreg: {C: {$any: [0.1, 10.0]}, max_iter: 20}
          rf: {n_estimators: 3, max_depth: 2}
ship:
  - id: predict
    uses: any/predict
    needs: [train]
    with: {dataset: toy, model: train}
sweeper:
  sampler: grid
  resample: {cv: {k: 2, stratify: true}}
  objective: {metric: train.fold_score, direction: maximize, select: {one-std-err: {}}}
---
"""

EXPERIMENT = """---
type: experiment
seed: 3
status: active
steps:
  - id: split
    uses: any/cv-split
    with: {dataset: toy, k: 2, stratify: true}
  - id: train
    uses: any/train
    needs: [split]
    with: {dataset: toy, folds: split, model: {logreg: {max_iter: 20}}, decide: {offsets: {holdout: 0.5}}}
  - id: predict
    uses: any/predict
    needs: [train]
    with: {dataset: toy, model: train}
---
"""


@pytest.fixture
def root(spark, tmp_path):
    d = tmp_path / "toy"
    d.mkdir()
    (d / "schema.json").write_text(json.dumps({"columns": {"id": "id", "a": "feature", "b": "feature", "t": "target"}, "dtypes": {"id": "int64", "a": "float64", "b": "float64", "t": "int64"}}))
    rows = [(i, (i * 7 % 11) / 11, (i * 5 % 13) / 13, int((i * 7 % 11) > 5)) for i in range(60)]
    (d / "train.csv").write_text("id,a,b,t\n" + "".join(f"{i},{a},{b},{t}\n" for i, a, b, t in rows[:44]))
    (d / "test.csv").write_text("id,a,b\n" + "".join(f"{i},{a},{b}\n" for i, a, b, _ in rows[44:]))
    (tmp_path / "shape.md").write_text(SHAPE)
    (tmp_path / "experiment.md").write_text(EXPERIMENT)
    return str(tmp_path)


def test_an_experiment_runs_to_predictions(spark, root):
    r = runner.run_experiment(spark, f"{root}/experiment.md", f"{root}/runs")
    assert r["status"] == "ok" and r["metrics"]["split.n"] == 44 and r["metrics"]["train.cv_score"] > 0.8 and r["metrics"]["predict.has_offsets"] == 1
    here = f"{root}/runs/{r['run_id']}/predict"
    assert spark.read.option("header", True).csv(f"{here}/predictions.csv").count() == 16
    name = runner.blend(spark, [here, here], f"{root}/runs", [1.0, 2.0])
    blended = spark.read.option("header", True).csv(f"{root}/runs/{name}/predict/predictions.csv")
    alone = spark.read.option("header", True).csv(f"{here}/predictions.csv")
    assert blended.count() == 16 and blended.exceptAll(alone).isEmpty()  # the member's offsets count in the blend too


def test_a_failure_is_recorded(spark, root):
    steps = [{"id": "a", "uses": "x/echo"}, {"id": "b", "uses": "x/echo", "needs": ["a"], "with": {"fail": "no"}}, {"id": "c", "uses": "x/echo", "needs": ["b"]}]
    with pytest.raises(runner.RunFailed) as e:
        runner.run_steps(spark, steps, 0, root, f"{root}/runs")
    assert e.value.record["status"] == "failed" and [s["step"] for s in e.value.record["steps"]] == ["a"]
    assert json.loads(spark.read.text(f"{root}/runs/{e.value.record['run_id']}/run.json").first()[0])["status"] == "failed"


def test_a_sweep_is_chosen_and_promoted(spark, root):
    out = f"{root}/runs"
    est = runner.run_shape(spark, f"{root}/shape.md", out).first()
    rows = runner.read_ledger(spark, out)
    assert est.n == 2 and rows.where("level = 'inner'").count() == 2 * 3 * 2 and rows.where("level = 'outer'").count() == 2 * 2
    again = runner.run_shape(spark, f"{root}/shape.md", out).first()
    assert again == est and runner.read_ledger(spark, out).count() == rows.count()  # nothing is there twice
    won = runner.choose(spark, f"{root}/shape.md", out).collect()
    assert {w.family for w in won} == {"train.model=logreg", "train.model=rf"} and sum(w.is_ship for w in won) == 1
    assert runner.show(spark, out, "train.fold_score").count() == 3 + 2 * 2 and runner.fingerprints(spark, out).count() == 1
    r = runner.promote(spark, f"{root}/shape.md", out)
    assert r["experiment"] == "shape.md"
    assert r["status"] == "ok" and r["metrics"]["predict.n_predictions"] == 16


def test_only_the_first_folds_of_a_sample(spark, root):
    runner.run_shape(spark, f"{root}/shape.md", f"{root}/runs", "out1in1")
    assert {(r.outer_fold, r.fold) for r in runner.read_ledger(spark, f"{root}/runs").collect()} == {(0, 0), (0, None)}
    with pytest.raises(ValueError):
        runner.sample_of("in0")


def test_verbs(capsys):
    a = cli.parser().parse_args(["select", "x.md", "--promote", "--cohort", "ab"])
    assert a.promote and a.cohort == "ab" and a.out == "runs"
    with pytest.raises(documents.DocumentError):
        runner.Sweep.of(SHAPE.replace("train.fold_score", "other.fold_score"))


def test_what_is_known_is_not_fitted_again(spark, root, monkeypatch):
    out, fits = f"{root}/runs", []
    real = nested.fold_score
    monkeypatch.setattr(nested, "fold_score", lambda *a, **k: fits.append(1) or real(*a, **k))
    runner.run_shape(spark, f"{root}/shape.md", out, "out1in1")
    first = len(fits)
    assert first == 3 + 2
    runner.run_shape(spark, f"{root}/shape.md", out, "out1in1")
    assert len(fits) == first
    monkeypatch.setattr(runner, "code_files", lambda: {"m": "other"})
    runner.run_shape(spark, f"{root}/shape.md", out, "out1in1")
    assert len(fits) == 2 * first  # other code, other scores


def test_a_stop_keeps_the_outer_folds_that_are_done(spark, root, monkeypatch):
    out, real = f"{root}/runs", nested.fold_score
    n = []

    def score(*a, **k):
        n.append(1)
        if len(n) == 9:  # the first outer fold takes 6 inner fits and 2 outer ones
            runner.request_stop(spark, out)
        return real(*a, **k)

    monkeypatch.setattr(nested, "fold_score", score)
    est = runner.run_shape(spark, f"{root}/shape.md", out, parallel=1).first()
    assert est.n == 1 and {r.outer_fold for r in runner.read_ledger(spark, out).collect()} == {0} and len(n) == 9
    assert runner.run_shape(spark, f"{root}/shape.md", out, parallel=1).first().n == 2 and len(n) == 16


def test_promotion_names_the_code_that_changed(spark, root, monkeypatch):
    out = f"{root}/runs"
    runner.run_shape(spark, f"{root}/shape.md", out, "out1in1")
    now = runner.code_files()
    assert {"foldwright.operators.decide", "foldwright.plans.nested", "foldwright.functions.scalars"} <= set(now)
    monkeypatch.setattr(runner, "code_files", lambda: now | {"foldwright.plans.nested": "other"})
    with pytest.raises(ValueError, match="foldwright.plans.nested changed"):
        runner.promote(spark, f"{root}/shape.md", out)
    assert runner.promote(spark, f"{root}/shape.md", out, changed=True)["status"] == "ok"


def test_a_blend_is_of_one_procedure_and_is_submitted(spark, root):
    seen = []
    runner.STEPS["any/submission"] = lambda ctx, w: seen.append(ctx.folder(w["predictions"])) or runner.Output()
    try:
        shape = SHAPE.replace("sweeper:", "  - id: hand_in\n    uses: any/submission\n    needs: [predict]\n    with: {predictions: predict}\nsweeper:")
        with open(f"{root}/hand.md", "w") as f:
            f.write(shape)
        for code in ("a", "b"):
            d = f"{root}/{code}/predict"
            os.makedirs(d)
            with open(f"{root}/{code}/run.json", "w") as f:
                json.dump({"experiment": "hand.md", "code_fingerprint": code, "steps": [{"step": "predict", "with": {"model": "train"}}]}, f)
            with open(f"{d}/probabilities.csv", "w") as f:
                f.write("id,proba_0,proba_1\n1,0.6,0.4\n2,0.2,0.8\n")
        both = [f"{root}/a/predict", f"{root}/b/predict"]
        with pytest.raises(ValueError, match="one procedure"):
            runner.blend(spark, both, f"{root}/runs")
        name = runner.blend(spark, both, f"{root}/runs", mixed=True, path=f"{root}/hand.md")
        assert seen == [f"{root}/runs/{name}/predict"]
        os.makedirs(f"{root}/a/train")
        with open(f"{root}/a/train/offsets.json", "w") as f:
            json.dump({"offsets": [0.0], "classes": [0]}, f)
        with pytest.raises(ValueError, match="other classes"):
            runner.blend(spark, both, f"{root}/runs", mixed=True)
    finally:
        del runner.STEPS["any/submission"]
