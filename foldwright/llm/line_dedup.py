"""Line dedup: lines found in many documents leave every document.

Normalised lines are exploded and hashed, the documents of each hash are counted (each document once), hashes
over the threshold are joined back to the line positions they take, and texts are put together again by
position. Only hashes and positions are shuffled; a text moves once, to meet the positions it loses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import SPACE, Aside, cut, eq_join, ship, sized_join, small_batches, table

ship(__name__)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: str) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(SPACE).encode().lower()  # lower() of bytes knows A-Z only


def hashed_lines(own: DataFrame) -> DataFrame:
    """(_id, _sum, text) to a row for each line with a key: position, 128 bits of the key, first of its key in the text."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, pos, key, first = [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                seen = set()
                for p, line in enumerate(t.split("\n")):
                    if k := line_key(line):
                        h = xxhash.xxh128_digest(k)
                        doc.append(i), pos.append(p), key.append(h), first.append(h not in seen)
                        seen.add(h)
            ab = np.frombuffer(b"".join(key), "<i8").reshape(-1, 2)
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("_id").take(at), b.column("_sum").take(at), pa.array(pos, pa.int32()), pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy()), pa.array(first, pa.bool_())], names=["_id", "_sum", "pos", "a", "b", "first"]
            )

    return own.mapInArrow(lines, f"_id {own.schema['_id'].dataType.simpleString()}, _sum long, pos int, a long, b long, first boolean")


def dedup_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `_n_lines`, `_n_dropped` and `_kept`: the text without lines whose key is in >= min_docs documents.

    Rows of one id are one document, which counts once for a line; rows without an id count for none, as in
    OP1_SQL, and lose lines like any other. Null or empty texts have one empty line, whose key is empty and never
    dropped. Lines longer than any other are hashed whole. Repeated rows repeat; an empty table gives an empty table.
    A column of docs with an output's name is replaced by the output; all others are kept.
    """
    small_batches(docs.sparkSession)
    all_of = Aside(docs)
    id_, text = all_of.of(id_col), all_of.of(text_col)
    own = all_of.df.select(F.col(id_).alias("_id"), F.xxhash64(text).alias("_sum"), F.coalesce(text, F.lit("")).alias("text"))
    at = hashed_lines(own)
    common = cut(at.where("first").groupBy("a", "b", "_id").agg(F.lit(1)).groupBy("a", "b").agg(F.count("_id").alias("n")).where(F.col("n") >= min_docs).select("a", "b"))
    hits = sized_join(at.select("_id", "_sum", "pos", "a", "b"), common, ["a", "b"], "left_semi")
    lost = hits.groupBy("_id", "_sum").agg(F.sort_array(F.collect_set("pos")).alias("_lost"))
    # positions to flags: false for each line kept, true for each lost, as far as the last one lost
    gap = F.transform("_lost", lambda p, i: F.concat(F.array_repeat(F.lit(False), (p - F.when(i == 0, -1).otherwise(F.get("_lost", i - 1)) - 1).cast("int")), F.array(F.lit(True))))
    lost = lost.select("_id", "_sum", F.flatten(gap).alias("_flags"))
    out = eq_join(all_of.df.withColumns({"_id": F.col(id_), "_sum": F.xxhash64(text)}), lost, ["_id", "_sum"])
    lines = lines_of(F.col(text))
    kept = F.filter(lines, lambda x, i: ~F.coalesce(F.get("_flags", i), F.lit(False)))
    return all_of.back(
        out,
        {
            "_n_lines": F.size(lines).cast("long"),
            "_n_dropped": F.coalesce(F.size(F.filter("_flags", lambda x: x)), F.lit(0)).cast("long"),
            "_kept": F.when(F.col("_flags").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(kept, "\n")),
        },
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before, lines dropped, and a hash of what stays, of every document."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.encode("_kept", "UTF-8"), 256).alias("kept_sha256"))


OP1_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
hot as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where key in (select key from hot)) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where key not in (select key from hot)), '')) as kept_sha256
from k group by doc_id
"""
