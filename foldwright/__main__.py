"""python -m foldwright run | stop | select | ledger | blend."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from foldwright.plans import documents, runner
from foldwright.sources.dataset import read_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foldwright", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    run = verbs.add_parser("run", help="an experiment, or the sweep of a shape")
    run.add_argument("document")
    run.add_argument("--sample", default="", help="out<M>in<N>: only the first folds")
    run.add_argument("--auto-stop", action="store_true", help="stop families that are unlikely to reach the incumbent")
    run.add_argument("--parallel", type=int, default=4, help="how many fits run side by side")
    stop = verbs.add_parser("stop", help="end the sweep that runs, after the fits that run")
    choose = verbs.add_parser("select", help="each family's winner, and the one to ship")
    choose.add_argument("document")
    choose.add_argument("--point", default="", help="the beginning of a point's address, instead of the rule")
    choose.add_argument("--promote", action="store_true", help="run the one to ship on all rows")
    choose.add_argument("--changed", action="store_true", help="promote although the code has changed")
    led = verbs.add_parser("ledger", help="what runs have left")
    led.add_argument("what", choices=("show", "fingerprints"))
    led.add_argument("--metric", default="train.fold_score")
    led.add_argument("--direction", choices=("maximize", "minimize"), default="maximize")
    led.add_argument("-n", type=int, default=20)
    mix = verbs.add_parser("blend", help="a soft vote of runs")
    mix.add_argument("runs", nargs="+", help="folders of predict steps")
    mix.add_argument("--weights", type=float, nargs="+")
    mix.add_argument("--mixed", action="store_true", help="members may come from several experiments or code versions")
    mix.add_argument("--shape", default="", help="a shape whose submission step runs on the blend")
    for v in (run, stop, choose, led, mix):
        v.add_argument("--out", default="runs", help="folder of runs and the ledger")
    for v in (choose, led):
        v.add_argument("--cohort", default="", help="the beginning of a code fingerprint")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("foldwright").getOrCreate()
    try:
        if a.verb == "run" and documents.front_matter(read_text(spark, a.document)).get("type") == "experiment-shape":
            runner.run_shape(spark, a.document, a.out, a.sample, a.auto_stop, a.parallel).show()
        elif a.verb == "run":
            print(json.dumps(runner.run_experiment(spark, a.document, a.out), default=str))
        elif a.verb == "stop":
            runner.request_stop(spark, a.out)
        elif a.verb == "select" and a.promote:
            print(json.dumps(runner.promote(spark, a.document, a.out, a.cohort, a.point, a.changed), default=str))
        elif a.verb == "select":
            runner.choose(spark, a.document, a.out, a.cohort, a.point).orderBy("family").show(100, False)
        elif a.verb == "ledger" and a.what == "show":
            runner.show(spark, a.out, a.metric, a.direction, a.n, a.cohort).show(a.n, False)
        elif a.verb == "ledger":
            runner.fingerprints(spark, a.out).show(100, False)
        else:
            print(runner.blend(spark, a.runs, a.out, a.weights, a.mixed, a.shape))
    except (ValueError, OSError, RuntimeError) as e:
        print(f"foldwright: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
