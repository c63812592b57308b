"""Fits that run side by side: in order of their folds, until the first failure or a stop."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


class Stopped(Exception):
    """A stop was asked for before all of a batch had run."""


class Control:
    """Runs batches of jobs from at most `parallel` threads; the cluster's executors are shared among their Spark jobs.

    Jobs start in the order given, so what is submitted first (an earlier outer fold) gets a slot first. The first
    failure holds: no later job starts, and it is the error that is raised. A stop that was asked for lets running
    jobs end and starts no other. `asked` is looked at before each job, so that another process can ask too.
    """

    def __init__(self, spark: SparkSession, parallel: int = 4, asked: Callable[[], bool] | None = None):
        self.spark, self.parallel, self.asked = spark, max(1, parallel), asked
        self.error: BaseException | None = None
        self._stop, self._lock = threading.Event(), threading.Lock()

    def stop(self) -> None:
        self._stop.set()

    @property
    def stopped(self) -> bool:
        if not self._stop.is_set() and self.asked is not None and self.asked():
            self._stop.set()
        return self._stop.is_set()

    def fail(self, error: BaseException) -> None:
        with self._lock:
            self.error = self.error or error

    def run(self, jobs: list[Callable[[], Any]]) -> list[Any]:
        """Their results, in order."""
        left = object()

        def one(job: Callable[[], Any]) -> Any:
            if self.error is not None or self.stopped:
                return left
            try:
                return job()
            except BaseException as e:  # raised below, by whoever was first
                self.fail(e)
                return left

        if self.parallel == 1 or len(jobs) < 2:
            found = [one(j) for j in jobs]
        else:
            with ThreadPoolExecutor(min(self.parallel, len(jobs))) as pool:
                found = [f.result() for f in [pool.submit(inheritable_thread_target(self.spark)(one), j) for j in jobs]]
        if self.error is not None:
            raise self.error
        if any(f is left for f in found):
            raise Stopped
        return found


def totals(outer: int, configs: int, folds: int) -> dict[str, int]:
    """What a sweep will run: a single configuration is scored by folds alone; several once in each outer fold."""
    return {"folds": folds} if configs == 1 else {"outer": outer, "configs": outer * configs, "folds": outer * configs * folds}
