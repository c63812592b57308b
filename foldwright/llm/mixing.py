"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Sources get targets by weight, none above a number of passes over its words. Blocks of equally many words are
allocated to sources by the highest quotients target / (2 k + 1), each source's blocks to its shards by the
quotients of the shards' words, and a shard takes its quota as whole passes and one partial pass: seeded, evenly
spaced blocks of its documents laid end to end in seeded order. A document's share of the blocks is counted in
closed form, so no row is made for a block, and a window never holds more than a shard's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.llm.common import Aside, cut, eq_join, sized_join, table, words_of

WEIGHTS = (5, 2, 1)
TOTAL, MAX_PASSES = 1.5, 2
BLOCK_WORDS, SHARD_WORDS, SEED = 64, 1 << 18, 17


def apportion(df: DataFrame, seats: str, value: str, by: list[str], order: list[str], out: str) -> DataFrame:
    """Adds the seats that Sainte-Lague gives each row: per group `by`, the `seats` highest of value / (2 k + 1).

    A row's seats lie between those for (seats - n) and (seats + n) at the mean price of a seat, n rows in the
    group; only quotients between the two are listed, about three for a row, whatever the number of seats.
    Ties go by `order`, then to the lower k. Values are at least 0; a group without any value gets no seat.
    """
    g = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    d = df.withColumn("_n", F.count("*").over(g)).withColumn("_v", F.sum(value).over(g)).withColumn("_s", F.col(seats).cast("double"))
    at = lambda s: F.when(F.col("_v") > 0, F.floor(F.col(value) * F.greatest(s, F.lit(0.0)) / F.col("_v") + 0.5)).otherwise(F.lit(0)).cast("long")
    d = d.withColumn("_lo", at(F.col("_s") - F.col("_n"))).withColumn("_hi", at(F.col("_s") + F.col("_n"))).withColumn("_rest", F.col(seats) - F.sum("_lo").over(g))
    q = d.where(F.col("_hi") > F.col("_lo")).withColumn("_k", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy((F.col(value) / (2 * F.col("_k") + 1)).desc(), *order, "_k")
    won = q.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("_rest")).groupBy(*by, *[c for c in order if c not in by]).agg(F.count("*").alias("_won"))
    keys = list(dict.fromkeys([*by, *order]))
    return eq_join(d, won, keys).select(*df.columns, (F.col("_lo") + F.coalesce("_won", F.lit(0))).alias(out))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size) to (source, source_size, ord, weight, target); a row for each source.

    Sources by code point, null last, take the weights in turn. A target is a common rate times the weight, or
    `passes` times the size where that is less: the fixed point of resharing what is above the limit.
    """
    one = Window.partitionBy(F.lit(0))
    s = sizes.withColumn("ord", F.row_number().over(one.orderBy(F.col("source").isNull(), "source")))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("ord") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * passes).withColumn("pool", F.sum("source_size").over(one).cast("double") * total)
    # by the rate at which they reach their limits; those before the first that does not reach it are at theirs
    w = one.orderBy(F.col("cap") / F.col("weight"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(w), F.lit(0))).withColumn("w_left", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(w), F.lit(0)))
    s = s.withColumn("rate", (F.col("pool") - F.col("capped")) / F.col("w_left"))
    by_rate = one.orderBy(F.col("cap") / F.col("weight"), "ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("rate", F.first(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.col("rate")), ignorenulls=True).over(by_rate))
    return s.select("source", "source_size", "ord", "weight", F.least(F.coalesce(F.col("rate") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def _before(x: Column) -> Column:
    """Words of the partial pass among the first x words of a shard; _m of _nb blocks, the start seeded."""
    chosen = lambda j: F.floor((j + F.col("_off")) * F.col("_m") / F.col("_nb")) - F.floor(F.col("_off") * F.col("_m") / F.col("_nb"))
    j = F.floor(x / F.lit(BLOCK_WORDS))
    return chosen(j) * BLOCK_WORDS + (chosen(j + 1) - chosen(j)) * (x - j * BLOCK_WORDS)


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """docs with _size, _source_size, _target, _taken, _passes (whole copies) and _start, _m, _nb, _off (the partial one).

    Null or empty texts have size 0 and take nothing. A null source is a source, the last. Repeated rows and rows
    without an id are documents like any other; rows equal in id and text may change places in a shard, which
    changes nothing in the result's rows. An empty table gives an empty table. A column of docs with an output's name
    is replaced by the output; all others are kept, but for the text without keep_text.

    All sources meet in one task, a row each, and so do the shards of a source: they are as many as its words by
    SHARD_WORDS. Repeated rows share a shard, whose window holds no text.
    """
    all_of = Aside(docs)
    text, kind, id_ = all_of.of(text_col), all_of.of(source_col), all_of.of(id_col)
    sized = all_of.df.withColumn("_size", F.size(words_of(F.col(text))).cast("long")).withColumn("_h", F.xxhash64(F.lit(SEED), F.col(id_), F.col(text)))
    sized = sized if keep_text else cut(sized.drop(text))
    slim = sized.select(F.col(kind).alias("source"), F.col(id_).alias("_id"), "_size", "_h")
    src = source_targets(slim.groupBy("source").agg(F.sum("_size").alias("source_size")))
    src = src.withColumn("_seats", F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / BLOCK_WORDS + 0.5).cast("long"))
    src = cut(apportion(src, "_seats", "target", [], ["ord"], "_quota").drop("_seats").withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long")))
    placed = sized_join(slim, src.drop("ord", "weight"), ["source"]).withColumn("_shard", F.pmod(F.col("_h"), F.col("_shards")))
    shards = placed.groupBy("source", "_shard", "_quota").agg(F.sum("_size").alias("_words")).withColumn("_nb", F.ceil(F.col("_words") / BLOCK_WORDS).cast("long"))
    shards = apportion(shards.withColumn("_value", F.col("_words").cast("double")), "_quota", "_value", ["source"], ["_shard"], "_q")
    shards = shards.withColumn("_q", F.least(F.col("_q"), F.col("_nb") * MAX_PASSES)).withColumn("_passes", F.when(F.col("_nb") > 0, F.expr("_q div _nb")).otherwise(F.lit(0))).withColumn(
        "_m", F.when(F.col("_nb") > 0, F.col("_q") % F.col("_nb")).otherwise(F.lit(0))
    )
    shards = shards.withColumn("_nb", F.greatest("_nb", F.lit(1))).withColumn("_off", F.pmod(F.xxhash64(F.lit(SEED), F.col("source"), F.col("_shard")), F.col("_nb")))
    shards = shards.select("source", "_shard", "_passes", "_m", "_nb", "_off")
    w = Window.partitionBy("source", "_shard").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = sized.withColumn("source", F.col(kind)).withColumn("_id", F.col(id_))
    laid = sized_join(laid, src.select("source", "source_size", "target", "_shards"), ["source"]).withColumn("_shard", F.pmod(F.col("_h"), F.col("_shards")))
    laid = laid.withColumn("_start", F.coalesce(F.sum("_size").over(w), F.lit(0)))
    laid = sized_join(laid, shards, ["source", "_shard"])
    taken = F.col("_passes") * F.col("_size") + F.when(F.col("_m") > 0, _before(F.col("_start") + F.col("_size")) - _before(F.col("_start"))).otherwise(F.lit(0))
    made = {"_size": "_size", "_source_size": "source_size", "_target": "target", "_taken": taken.cast("long")}
    return all_of.back(laid, made | {c: c for c in ("_passes", "_start", "_m", "_nb", "_off")}, () if keep_text else (text_col,))


def mixed_texts(mixed: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The mix itself: a row for each whole copy, and one with the words of the partial pass where it takes any."""
    chosen = lambda j: F.floor((j + F.col("_off")) * F.col("_m") / F.col("_nb"))
    block = lambda i: F.floor((F.col("_start") + i) / F.lit(BLOCK_WORDS))
    pieces = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.regexp_replace(F.array_join(F.filter(pieces, lambda x, i: chosen(block(i) + 1) > chosen(block(i))), ""), r"^[\x20\x09-\x0D]+", "")
    partial = F.col("_taken") - F.col("_passes") * F.col("_size")
    copies = F.when(F.col("_passes") > 0, F.array_repeat(F.col(text_col), F.col("_passes").cast("int"))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(copies, F.when(partial > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    return mixed.withColumn("_text", F.explode(texts)).select(*[F.col("_text").alias(c) if c == text_col else F.col(c) for c in columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, its source's size and target, and the words taken of every document."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))
