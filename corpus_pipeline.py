"""A corpus pipeline of five of the training-data operators: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm import bpe, common, line_dedup, mixing, near_dup, quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Columns of docs; null and empty texts are rejected."""
    all_of = common.Aside(docs)
    out = quality.apply_quality(all_of.df, *map(all_of.of, ("text", "lang", "source")))
    return all_of.back(out.where("_kept"), {})


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every text; n_chars, where there is one, follows the text."""
    all_of = common.Aside(docs)
    out = line_dedup.dedup_lines(all_of.df, id_col=all_of.of("doc_id"), text_col=all_of.of("text"))
    return _texts(docs, all_of, out.withColumn(all_of.of("text"), F.col("_kept")))


def _texts(docs: DataFrame, all_of: common.Aside, out: DataFrame) -> DataFrame:
    """The columns of docs, n_chars counted anew."""
    if "n_chars" in docs.columns:
        out = out.withColumn(all_of.of("n_chars"), F.char_length(all_of.of("text")).cast(docs.schema["n_chars"].dataType))
    return all_of.back(out, {})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, of rows of one id one row.

    Rows without an id stay. Empty texts are no duplicates of one another.
    """
    all_of = common.Aside(docs)
    id_, text = all_of.of("doc_id"), all_of.of("text")
    parts = common.cut(near_dup.near_components(all_of.df, percent=80, id_col=id_, text_col=text))
    gone = parts.where("id is not null and id <> component").select(F.col("id").alias(id_)).distinct()
    again = common.cut(parts.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias(id_)))
    out = common.sized_join(all_of.df, gone, [id_], "left_anti")
    if not again.isEmpty():
        one = common.sized_join(out, again, [id_], "left_semi")
        # the first of an id's rows by text; partial before a shuffle, so many rows of one id are no burden
        one = one.groupBy(id_).agg(F.min_by(F.struct(*all_of.names), F.struct(text, F.to_json(F.struct(*all_of.names)))).alias("r")).select("r.*")
        out = common.sized_join(out, again, [id_], "left_anti").unionByName(one)
    return all_of.back(out, {})


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole copy that the mix takes of a document, and one for the words of its partial pass."""
    all_of = common.Aside(docs)
    text = all_of.of("text")
    mixed = mixing.mix(all_of.df, text, all_of.of("source"), all_of.of("doc_id"))
    return _texts(docs, all_of, mixing.mixed_texts(mixed, all_of.names, text))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every row of the mix, as count and hashes, beside what else the row has but its text."""
    all_of = common.Aside(docs)
    out = bpe.encoded(all_of.df, bpe.vocabulary(bpe.WORD_BPE), all_of.of("text"))
    return _without(all_of, out, {"n_tokens": "_n", "ids_sha256": "_ids_sum", "decoded_sha256": "_text_sum"}, "text")


def _without(all_of: common.Aside, out: DataFrame, made: dict[str, str], gone: str) -> DataFrame:
    """All columns but `gone`, and those made, which replace others of their names."""
    at = all_of.columns.index(gone)
    out = out.withColumn(all_of.names[at], F.lit(None).cast("string"))
    return all_of.back(out, made, (gone,))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules),
    ("line_dedup", drop_lines),
    ("near_dup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Byte-pair encoding has no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared checkpoint folder before the next."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs)
    return docs
