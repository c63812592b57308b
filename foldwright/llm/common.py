"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import threading
import time
import types
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WS = r"\x20\x09-\x0D"
SPACE = " \t\n\v\f\r"
WORD = rf"[^{WS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of at most so many rows and bytes may be broadcast; both are measured first.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
SALTS = 16
#: Setting of the session: a job's shuffle files go when it ends. It holds for DataFrames made while it is set.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds after which an idle Python worker lets go of what it remembers.
REST = 20.0


def ship(module: str) -> None:
    """Sends a module's functions to executors by value, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def kept_by_worker(make: Callable, *args):
    """make(*args), once for each Python worker: what it remembers serves the worker's next tasks too.

    After REST seconds without a call the worker lets it go, so that other stages have its memory. Call it for
    each batch; who still holds the object keeps it.
    """
    store = sys.modules.setdefault("_foldwright_kept", types.ModuleType("_foldwright_kept")).__dict__
    lock = store.setdefault("_lock", threading.Lock())
    key = f"{make.__name__}{args}"
    with lock:
        kept = store.setdefault("_kept", {})
        store["_used"] = time.monotonic()
        if key not in kept:
            kept[key] = make(*args)
        if "_watch" not in store:
            store["_watch"] = threading.Thread(target=_let_go, args=(store, REST), daemon=True)
            store["_watch"].start()
        return kept[key]


def _let_go(store: dict, rest: float) -> None:
    """Waits for rest, then empties the store and gives the memory back to the system."""
    while True:
        time.sleep(rest / 4)
        with store["_lock"]:
            if time.monotonic() - store["_used"] >= rest:
                store["_kept"].clear()
                del store["_watch"]
                break
    gc.collect()
    trim()


def trim() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    It is ``spark.checkpoint.dir``; where that is unset and everything runs in one process (tests), a temporary
    folder is set once. On a cluster without the setting this is an error: executors share no local folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there; lineage ends here."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_freed(df: DataFrame) -> DataFrame:
    """As cut(); the shuffle files of df's job go as soon as it is written, whatever the JVM still refers to."""
    conf = df.sparkSession.conf
    was = conf.get(FREES, None)
    conf.set(FREES, "true")
    try:
        return cut(df.select("*"))  # a DataFrame of its own, as the setting is read when one is made
    finally:
        conf.unset(FREES) if was is None else conf.set(FREES, was)


def written(df: DataFrame) -> DataFrame:
    """As cut(), but as Parquet: for whole texts, as what reads it reads no columns but those it needs."""
    path = f"{checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the JVM collect what no frame refers to any more, so that Spark removes finished rounds' shuffle files.

    For jobs of several rounds, after a cut(): else those files stay until the driver's heap happens to fill. What
    the first collection frees still refers to some of them, so there are two.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


class Aside:
    """A caller's columns under names of no meaning (c0, c1, ...), so that no operator's names clash with them."""

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.names = [f"c{i}" for i in range(len(self.columns))]
        self.df = docs.toDF(*self.names)

    def of(self, column: str) -> str:
        """The name that a column of the caller goes by."""
        return self.names[self.columns.index(column)]

    def back(self, df: DataFrame, made: dict[str, Column | str], without: Sequence[str] = ()) -> DataFrame:
        """The caller's columns under their own names, then those made, which replace a caller's of the same name."""
        gone = {m.lower() for m in made} | {w.lower() for w in without}
        rest = [(n, c) for n, c in zip(self.names, self.columns, strict=True) if c.lower() not in gone]
        # names are given last: an alias beside an expression would be seen by it
        out = df.select(*[F.col(n) for n, _ in rest], *[(F.col(v) if isinstance(v, str) else v).alias(f"m{i}") for i, v in enumerate(made.values())])
        return out.toDF(*[c for _, c in rest], *made)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bounds an Arrow batch: whole texts differ in length by orders of magnitude.

    The settings are read when a plan runs, so they stay set in the session; smaller ones are left as they are.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def settled(df: DataFrame, made: Sequence[str]) -> DataFrame:
    """Keeps filters from above from going below the columns `made`, where they would work them out again and again."""
    rest = [c for c in df.columns if c not in made]
    one = df.select(*rest, F.explode(F.array(F.struct(*made))).alias("_made"))
    return one.select(*rest, *[F.col(f"_made.{c}") for c in made])


def eq_join(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on columns of the same names; nulls match nulls; df's columns, then those of other not joined on."""
    cond = F.lit(True)
    for i, k in enumerate(on):
        other = other.withColumnRenamed(k, f"_on{i}")
    for i, k in enumerate(on):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_on{i}"))
    return df.join(other, cond, how).drop(*[f"_on{i}" for i in range(len(on))])


def may_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether df, which is materialised, has at most so many rows and bytes."""
    wide = [c for c, t in df.dtypes if t in ("string", "binary")]
    other = 16 * (len(df.columns) - len(wide))
    size = F.lit(other).cast("long")
    for c in wide:
        size = size + F.coalesce(F.octet_length(F.col(c)), F.lit(0)) + 16
    n, b = df.agg(F.count("*"), F.sum(size)).first()
    return n <= rows and (b or 0) <= most


def sized_join(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins with a side that is usually small: broadcast if at most `limit` rows and BROADCAST_BYTES, else salted.

    `small` is materialised once and measured. Beyond the limits it is repeated SALTS times and df's rows are
    spread over the salts, so that one hot key is split. Null keys match null keys.
    """
    small = cut(small)
    if may_broadcast(small, limit):
        other, salts = F.broadcast(small), []
    else:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
        other, salts = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_salt"]
    return eq_join(df, other, [*on, *salts], how).drop(*salts)


ship(__name__)
