"""Datasets: a schema with roles, a train and perhaps a test table; and the other files of a run."""

from __future__ import annotations

import json
import os
import posixpath
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("id", "feature", "target", "weight", "source")
TYPES = {"int64": "bigint", "int32": "int", "float64": "double", "float32": "float", "object": "string", "bool": "boolean", "string": "string"}


@dataclass(frozen=True)
class Schema:
    """Roles and types by column, in the order of the features."""

    columns: dict[str, str]
    dtypes: dict[str, str]

    def __post_init__(self) -> None:
        if bad := sorted(set(self.columns.values()) - set(ROLES)):
            raise ValueError(f"unknown roles {', '.join(bad)}")
        if len(self.of("target")) > 1:
            raise ValueError("more than one target")

    def of(self, role: str) -> list[str]:
        return [c for c, r in self.columns.items() if r == role]

    def one(self, role: str) -> str | None:
        return next(iter(self.of(role)), None)


@dataclass(frozen=True)
class Dataset:
    schema: Schema
    train: DataFrame
    test: DataFrame | None = None

    def x(self, df: DataFrame) -> DataFrame:
        return df.select(*self.schema.of("feature"))

    def y(self, df: DataFrame) -> DataFrame:
        t = self.schema.one("target")
        if t is None:
            raise ValueError("the dataset has no target")
        return df.select(t)


def within(root: str, path: str) -> str:
    """The real path, if it lies in the root."""
    full, top = os.path.realpath(path), os.path.realpath(root)
    if full != top and not full.startswith(top.rstrip(os.sep) + os.sep):
        raise PermissionError(f"{path} is outside {root}")
    return full


def beneath(root: str, ref: str) -> str:
    """What a document names by a path beside itself: a whole address as it is, else a path that stays in the root."""
    if "://" in ref:
        return ref
    if "://" not in root:
        return within(root, os.path.join(root, ref))
    head, _, top = root.partition("://")
    full = posixpath.normpath(posixpath.join("/" + top, ref))
    if full != posixpath.normpath("/" + top) and not full.startswith(posixpath.normpath("/" + top) + "/"):
        raise PermissionError(f"{ref} is outside {root}")
    return f"{head}://{full[1:]}"


def exists(spark: SparkSession, path: str) -> bool:
    """By Spark's own file systems, so that a remote path works too."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())  # one small document


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small document, by Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def load_dataset(spark: SparkSession, path: str) -> Dataset:
    """schema.json, train.parquet or train.csv, and test likewise where there is one."""
    d = json.loads(read_text(spark, f"{path}/schema.json"))
    schema = Schema(d["columns"], d.get("dtypes") or {})

    def read(name: str) -> DataFrame | None:
        if exists(spark, f"{path}/{name}.parquet"):
            return spark.read.parquet(f"{path}/{name}.parquet")
        if exists(spark, f"{path}/{name}.csv"):
            df = spark.read.option("header", True).csv(f"{path}/{name}.csv")
            return df.select(*[F.col(c).cast(TYPES.get(schema.dtypes.get(c, "object"), "string")).alias(c) for c in df.columns])
        return None

    train = read("train")
    if train is None:
        raise FileNotFoundError(f"{path} has no train table")
    return Dataset(schema, train, read("test"))


def save_dataset(ds: Dataset, path: str) -> None:
    for name, df in (("train", ds.train), ("test", ds.test)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    write_text(ds.train.sparkSession, f"{path}/schema.json", json.dumps({"columns": ds.schema.columns, "dtypes": ds.schema.dtypes}, indent=2))


def resolve(spark: SparkSession, captured: dict[str, str], ref: str, root: str) -> Dataset:
    """What an upstream step captured under that name, else a path under the root."""
    return load_dataset(spark, captured[ref] if ref in captured else within(root, os.path.join(root, ref)))


def write_folds(df: DataFrame, path: str, fold: str = "fold") -> dict[str, int]:
    """One table, partitioned by fold, serves all analysis and assessment sets; k and n are the metrics."""
    df.write.mode("overwrite").partitionBy(fold).parquet(path)
    r = df.agg(F.count_distinct(fold).alias("k"), F.count("*").alias("n")).first()
    return {"k": r.k, "n": r.n}


def read_analysis(spark: SparkSession, path: str, fold: int, col: str = "fold") -> DataFrame:
    """Without the held-out fold: a filter on partitions, so its files are not read."""
    return spark.read.parquet(path).where(F.col(col) != fold)


def read_records(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Run records; what can't be parsed is left out, or is an error if strict."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return df


def read_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of id, proba_<class>... to (id, class, p)."""
    df = spark.read.option("header", True).csv(path)
    first, rest = df.columns[:1], df.columns[1:]
    if not first or not rest or any(not c.startswith("proba_") for c in rest):
        raise ValueError(f"{path}: an id column, then proba_ columns")
    return unpivot(df, first[0])


def unpivot(df: DataFrame, id_col: str) -> DataFrame:
    cols = [c for c in df.columns if c.startswith("proba_")]
    long = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double") for c in cols]).unpivot(["id"], cols, "class", "p")
    return long.withColumn("class", F.expr("substring(class, 7)"))


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of a run's files, without its own with, metrics and reads documents at the top."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rel = F.regexp_replace("path", r"^file:/+", "/")
    rel = F.substring_index(rel, path.rstrip("/") + "/", -1)
    return df.select(rel.alias("path"), "length", F.sha2("content", 256).alias("hash")).where(~F.col("path").isin("with.json", "metrics.json", "reads.json"))
