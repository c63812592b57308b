"""Blobs by content, batches of jobs, and samplers."""

import os
import threading
import time

import pytest

from foldwright.plans.control import Control, Stopped, totals
from foldwright.plans.sampler import Fixed, run
from foldwright.sources.store import Corrupt, Store


def test_blobs_come_back_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "pool")
    s = Store(spark, root)
    name = s.put(b"some \x00 bytes")
    assert s.put(b"some \x00 bytes") == name and s.get(name) == b"some \x00 bytes" and s.has(name)
    assert not s.has("../" + name[3:]) and not s.has(name.upper()) and not s.has("0" * 64)
    with pytest.raises(KeyError):
        s.get("../../etc")
    at = os.path.join(root, name[:2], name)
    for extra in (f".{name}.crc",):  # the file system's own sum of the file
        if os.path.exists(os.path.join(root, name[:2], extra)):
            os.unlink(os.path.join(root, name[:2], extra))
    with open(at, "wb") as f:
        f.write(b"broken")
    with pytest.raises(Corrupt):
        s.get(name)
    assert s.put(b"some \x00 bytes") == name and s.get(name) == b"some \x00 bytes"


def test_the_oldest_blobs_go_first(spark, tmp_path):
    clock = iter(range(1000, 2000, 100))
    s = Store(spark, str(tmp_path / "pool"), max_bytes=25, now=lambda: next(clock))
    a, b = s.put(b"a" * 10), s.put(b"b" * 10)
    s.get(a)
    c = s.put(b"c" * 10)
    assert s.has(a) and not s.has(b) and s.has(c)
    big = s.put(b"d" * 100)
    assert s.has(big) and s.index().count() == 1  # what was just put stays


def test_jobs_side_by_side(spark):
    met = threading.Barrier(2, timeout=20)
    assert Control(spark, 2).run([lambda i=i: met.wait() is None or i for i in range(4)]) is not None
    started = []

    def job(i):
        started.append(i)
        if i == 1:
            raise KeyError("first")
        time.sleep(0.01)

    c = Control(spark, 1)
    with pytest.raises(KeyError, match="first"):
        c.run([lambda i=i: job(i) for i in range(5)])
    assert started == [0, 1]
    with pytest.raises(KeyError):  # the first failure holds
        c.run([lambda: 1])
    stopping = Control(spark, 1)
    with pytest.raises(Stopped):
        stopping.run([stopping.stop, lambda: 1])


def test_what_a_sweep_will_run():
    assert totals(5, 3, 4) == {"outer": 5, "configs": 15, "folds": 60} and totals(5, 1, 4) == {"folds": 4}


def test_samplers(spark):
    c = Control(spark, 2)
    assert run(Fixed([3, 1, 2], lambda told: [o for _, o in told]), lambda p: p * p, c) == [9, 1, 4]
    assert run(Fixed([]), lambda p: p, c) == [] and Fixed([1, 2]).size([]) == 2

    class Halving:  # asks again from what it was told
        begin = lambda self: 40
        ask = lambda self, s: ([s], s < 8)
        tell = lambda self, s, p, o: o
        result = lambda self, s: s
        size = lambda self, s: None

    assert run(Halving(), lambda p: p // 2, c) == 2

    class Silent(Halving):
        ask = lambda self, s: ([], False)

    with pytest.raises(RuntimeError, match="Silent"):
        run(Silent(), lambda p: p, c)
