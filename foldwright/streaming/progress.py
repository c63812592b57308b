"""Progress from completion events, and the ledger as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldwright.operators import ledger
from foldwright.operators.ranges import ranked

LAST, MIN_EVENTS, MIN_SECONDS = 64, 16, 15
#: Events of a run that are looked at in one piece.
CHUNK = 16_384


def moving_rate(events: DataFrame, by: list[str], ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Completions a minute over the last 64 events of a run; null before 16 of them span 15 seconds.

    Events are numbered by ranges of time and cut into chunks of CHUNK; each chunk gets the last events of the one
    before it too, so a run of any length is spread over tasks.
    """
    e = ranked(events, [F.col(ts), F.col(order)], "_i", by).withColumn("_i", F.col("_i") - 1).withColumn("_own", F.expr(f"_i div {CHUNK}"))
    lent = F.when(F.col("_i") % CHUNK > CHUNK - LAST, F.col("_own") + 1)
    e = e.withColumn("_c", F.explode(F.array_compact(F.array(F.col("_own"), lent))))
    w = Window.partitionBy(*by, "_c").orderBy("_i").rowsBetween(-(LAST - 1), 0)
    e = e.withColumn("_n", F.count("*").over(w)).withColumn("_t0", F.min(ts).over(w)).where("_c = _own")
    span = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))) / F.lit(1e6)
    rate = F.when((F.col("_n") >= MIN_EVENTS) & (span >= MIN_SECONDS), (F.col("_n") - 1) * 60 / span)
    return e.withColumn("rate", rate).drop("_n", "_t0", "_i", "_own", "_c")


def eta_minutes(remaining: int, rate: float | None) -> float | None:
    return remaining / rate if rate else None


def occupancy(samples: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The mean over the last four samples, rounded half away from zero."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-3, 0)
    return samples.withColumn("occupancy", F.round(F.avg(value).over(w)).cast("long"))


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch of a stream of ledger rows to a Parquet ledger, leaving out rows that it has already.

    A batch that runs again after a failure adds nothing twice, as its rows are looked up by address and code.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = ledger.append(batch.limit(0), batch)
        try:
            old = spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            new = new.join(old.select("point_addr", "code_fingerprint"), ["point_addr", "code_fingerprint"], "left_anti")
        new.select(*batch.columns).write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
