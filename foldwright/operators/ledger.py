"""The run ledger: append, rank, filter, look up, join with records, and its CSV form.

Columns: code_fingerprint, point_addr, status, level, fold, outer_fold, stopped, free_params (map of strings),
metrics (map of doubles), append_ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.functions.scalars import canonical_map
from foldwright.operators.ranges import ranked


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """The first row of each (point_addr, code_fingerprint) stays; old rows come before new ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("point_addr", "code_fingerprint").orderBy("_new", "append_ord")
    return both.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i", "_new")


def union_keys(df: DataFrame, map_col: str) -> DataFrame:
    """The union of all rows' keys, in order of the rows' keys."""
    return df.select(F.explode(F.map_keys(map_col)).alias("key")).distinct()


def wide(df: DataFrame, params: list[str], metrics: list[str]) -> DataFrame:
    """The CSV form: fixed columns, fp.<param> and metric.<name>; what is absent is null."""
    fixed = [c for c in ("code_fingerprint", "point_addr", "status", "level", "fold", "outer_fold", "stopped") if c in df.columns]
    return df.select(*fixed, *[F.col("free_params")[p].alias(f"fp.{p}") for p in sorted(params)], *[F.col("metrics")[m].alias(f"metric.{m}") for m in sorted(metrics)])


def names_of(df: DataFrame, map_col: str) -> list[str]:
    """The names that a ledger's maps hold, in order: as many as a document's parameters or a step's scores."""
    return [r.key for r in union_keys(df, map_col).orderBy("key").collect()]


def write_csv(df: DataFrame, path: str) -> None:
    """The CSV form in append order; what a row lacks is blank, and a fixed column that no row has is left out."""
    w = wide(df.orderBy("append_ord"), names_of(df, "free_params"), names_of(df, "metrics"))
    maybe = [c for c in ("level", "fold", "outer_fold", "stopped") if c in w.columns]
    has = w.agg(*[F.count(F.when(F.col(c).cast("string") != "", 1)).alias(c) for c in maybe]).first() if maybe else {}
    gone = [c for c in maybe if not has[c]]
    # parts follow one another in append order; a quote within a cell is doubled, as in any CSV
    w.drop(*gone).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What write_csv wrote: blank cells are keys that are absent, and append_ord is the order of the rows."""
    cells = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    of = lambda head: [c for c in cells.columns if c.startswith(head)]
    cell = lambda c: F.col(f"`{c}`")

    def filled(head: str, kind: str):
        pairs = [F.struct(F.lit(c.removeprefix(head)).alias("k"), cell(c).try_cast(kind).alias("v")) for c in of(head)]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["v"].isNotNull())) if pairs else F.create_map().cast(f"map<string,{kind}>")

    fixed = {"code_fingerprint": "string", "point_addr": "string", "status": "string", "level": "string", "fold": "int", "outer_fold": "int", "stopped": "string"}
    read = [(cell(c).try_cast(kind) if c in cells.columns else F.lit(None).cast(kind)).alias(c) for c, kind in fixed.items()]
    # parts are numbered in order, and a part that may hold line ends within cells is read by one task
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("int"), F.lit(0))
    place = [part.alias("_part"), F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_line")]
    rows = cells.select(*read, filled("fp.", "string").alias("free_params"), filled("metric.", "double").alias("metrics"), *place)
    placed = ranked(rows, [F.col(c) for c in ("_part", "_file", "_line")], "append_ord")
    return placed.withColumn("append_ord", F.col("append_ord") - 1).drop("_part", "_file", "_line")


def cell_kind(s: Column) -> Column:
    """bool, json, int, float or string, tried in that order; null for a blank cell."""
    return (
        F.when(s.isNull() | (s == ""), None)
        .when(s.isin("true", "false"), "bool")
        .when(F.try_parse_json(s).isNotNull() & s.rlike(r"^\s*[\[{]"), "json")
        .when(s.rlike(r"^[+-]?[0-9]+$"), "int")
        .when(s.try_cast("double").isNotNull(), "float")
        .otherwise("string")
    )


def qualified(metric: str) -> Column:
    v = F.col("metrics")[metric]
    return (F.col("status") != "failed") & v.isNotNull() & ~F.isnan(v)


def _key(metric: str, direction: str) -> Column:
    v = F.col("metrics")[metric]
    return v if direction == "minimize" else -v


def best(df: DataFrame, metric: str, direction: str = "maximize") -> DataFrame:
    return top(df, metric, 1, direction)


def top(df: DataFrame, metric: str, n: int, direction: str = "maximize") -> DataFrame:
    """The n best rows that qualify, ties in append order; none for n below 1."""
    return df.where(qualified(metric)).orderBy(_key(metric, direction), "append_ord").limit(max(0, n))


def ranked_all(df: DataFrame, metric: str, direction: str = "maximize", out: str = "place") -> DataFrame:
    """Places: rows that qualify by the metric, then all others in append order. For display; no row goes."""
    ok = F.coalesce(qualified(metric), F.lit(False))
    first = ranked(df.where(ok), [_key(metric, direction), F.col("append_ord")], out)
    rest = ranked(df.where(~ok), [F.col("append_ord")], out)
    n = df.agg(F.count_if(ok).alias("_n"))  # one row
    rest = rest.crossJoin(F.broadcast(n)).withColumn(out, F.col(out) + F.col("_n")).drop("_n")
    return first.unionByName(rest).withColumn(out, F.col(out).cast("int"))


def of_level(df: DataFrame, outer: bool) -> DataFrame:
    level = F.coalesce(F.col("level"), F.lit(""))
    return df.where((level == "outer") & (F.col("status") != "failed")) if outer else df.where(level != "outer")


def of_cohort(df: DataFrame, fingerprint: str) -> DataFrame:
    return df.where(F.col("code_fingerprint") == fingerprint) if fingerprint else df


def resolve_prefix(df: DataFrame, col: str, prefix: str) -> str:
    """The one value that begins so; an error for none or several."""
    found = [r[0] for r in df.where(F.col(col).startswith(prefix)).select(col).distinct().orderBy(col).limit(6).collect()]
    if len(found) != 1:
        raise ValueError(f"{prefix!r} is the beginning of {'no' if not found else 'several'} {col}" + (f": {', '.join(map(str, found))}" if found else ""))
    return found[0]


def point_rows(df: DataFrame, prefix: str) -> DataFrame:
    """All rows of the one configuration that a row with such an address has."""
    keyed = df.withColumn("_key", canonical_map(F.col("free_params")))
    keys = keyed.where(F.col("point_addr").startswith(prefix)).select("_key").distinct()
    found = [r[0] for r in keys.limit(6).collect()]
    if len(found) != 1:
        raise ValueError(f"{prefix!r} is the beginning of {len(found)} configurations: {'; '.join(found)}")
    return keyed.where(F.col("_key") == found[0]).drop("_key")


def cohort_count(df: DataFrame) -> DataFrame:
    return df.where("code_fingerprint <> ''").agg(F.count_distinct("code_fingerprint").alias("cohorts"))


def cohort_summary(df: DataFrame, records: DataFrame) -> DataFrame:
    """records: point_addr, started, finished, commit, and perhaps dirty and record_status.

    Commit, dirty and record_status are those of the record that finished last, of equals the one appended last.
    """
    j = df.join(records, "point_addr", "left")
    last = F.struct("finished", "append_ord")
    found = F.when(F.col("finished").isNotNull(), last)
    return j.groupBy("code_fingerprint").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("level") == "inner").alias("inner_rows"),
        F.count_if(F.col("level") == "outer").alias("outer_rows"),
        F.min("started").alias("first_start"),
        F.max("finished").alias("last_finish"),
        F.max_by("commit", found).alias("commit"),
        F.greatest(F.count_distinct("commit") - 1, F.lit(0)).alias("more_commits"),
        F.count("finished").alias("records"),
        *[F.max_by(c, found).alias(c) for c in ("dirty", "record_status") if c in records.columns],
    )


def match_points(aggregated: DataFrame, points: DataFrame) -> DataFrame:
    """Aggregated rows with the first expanded point of the same configuration; others go."""
    first = points.groupBy("config_key").agg(F.min("ord").alias("ord"), F.min_by("family", "ord").alias("family"))
    return aggregated.join(first, "config_key")


def with_family(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Rows with their point's family, or an empty one."""
    first = points.groupBy("config_key").agg(F.min_by("family", "ord").alias("family"))
    return rows.join(first, "config_key", "left").withColumn("family", F.coalesce("family", F.lit("")))


def with_records(manifest: DataFrame, records: DataFrame) -> DataFrame:
    return manifest.join(records, "run_id", "left")


def namespaced(steps: DataFrame) -> DataFrame:
    """(run_id, steps: array of step, ord, metrics) to a row for each <step>.<metric>."""
    s = steps.select("run_id", F.explode("steps").alias("s"))
    return s.select("run_id", F.col("s.step").alias("step"), F.explode("s.metrics").alias("m", "value")).select("run_id", F.concat_ws(".", "step", "m").alias("metric"), "value")


def merged(steps: DataFrame) -> DataFrame:
    """One value a metric and run: that of the last step in topological order."""
    s = steps.select("run_id", F.explode("steps").alias("s"))
    return s.select("run_id", F.col("s.ord").alias("ord"), F.explode("s.metrics").alias("metric", "value")).groupBy("run_id", "metric").agg(F.max_by("value", "ord").alias("value"))
