"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of half keys, A and B, are made of a document's minhashes; the key of table (i, j) pairs
A_i with B_j. So m * m tables need 2 * m half keys: about a square root of the minhash work; and of the tables only
those are made whose two half keys other documents have too. A pair at the
threshold is missed in all tables with a probability of about 2 * (1 - s ** r) ** m; m is as large as keeps that
at MISS or less at any threshold (12 for 80 percent, 9 for 85).

Equal sets are one class, whose smallest id stands for it, so copies never meet each other. In a bucket each
member is first held against the bucket's smallest id alone. Only members that are still in another component
than some other member of their bucket go on, and of those only pairs that share a shingle rare enough to make
the similarity possible (bounds by prefix, position and signature, which lose no pair). All links are confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.llm.common import BROADCAST_ROWS, cut, release, ship, small_batches, table

ship(__name__)

SHINGLE = 5
#: Percent of similarity that links documents, where a contract names no other.
PERCENT = 80
ROWS, MISS = 2, 2e-5
SEED = 2024
#: Bits of a set's signature.
SIG_BITS = 512
#: Pairs of one document whose sets may meet in one key.
SPLIT = 512
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class Shingler:
    """Sets of 64-bit hashes of word shingles."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.words = size, {}

    def _hashes(self, text: str) -> np.ndarray:
        words = self.words
        if len(words) > 500_000:
            words.clear()
        out = []
        for w in text.encode().lower().split():  # of bytes: A-Z, and the six white characters
            h = words.get(w)
            if h is None:
                h = words[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)

    def set_of(self, text: str) -> np.ndarray:
        w, k = self._hashes(text), self.size
        if not len(w):
            return w
        n = max(1, len(w) - k + 1)
        h = np.full(n, min(len(w), k), np.uint64)  # fewer words than k: one shingle that knows its length
        for i in range(min(k, len(w))):
            h = (h ^ w[i : i + n]) * MIX[i % len(MIX)]
            h ^= h >> np.uint64(29)
        h *= MIX[1]
        return np.unique(h ^ (h >> np.uint64(32)))


def halves_for(percent: int, rows: int = ROWS) -> int:
    """The fewest half keys with which a pair at the threshold is missed with a probability of at most MISS."""
    low = 1 - (percent / 100) ** rows
    return max(1, math.ceil(math.log(MISS / 2) / math.log(low))) if low > 0 else 1


def half_keys(s: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """`rows` minhashes to a half key; a and b are the hash functions' factors and terms."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, (s[i : i + 2048, None] * a + b).min(axis=0))
    out = np.zeros(len(a) // rows, np.uint64)
    for r in range(rows):
        out = (out ^ low[r::rows]) * MIX[r % len(MIX)]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def sketches(docs: DataFrame, shingle: int, halves: int, rows: int) -> DataFrame:
    """(id, text) to (id, n, d1, d2, a, b): size and 128 bits of the set, the two collections of half keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, maker = np.random.default_rng(SEED), Shingler(shingle)
        fa = rng.integers(0, 1 << 63, 2 * halves * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        fb = rng.integers(0, 1 << 63, 2 * halves * rows, np.uint64)
        for batch in batches:
            n, digest, keys = [], [], []
            for t in batch.column("text").to_pylist():
                s = maker.set_of(t)
                n.append(len(s)), digest.append(xxhash.xxh128_digest(s.tobytes())), keys.append(half_keys(s, fa, fb, rows))
            d = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            k = np.array(keys, np.int64).reshape(len(n), 2 * halves)
            at = pa.array(np.arange(0, len(n) * halves + 1, halves), pa.int32())
            half = lambda x: pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), half(k[:, :halves]), half(k[:, halves:])], names=["id", "n", "d1", "d2", "a", "b"])

    return docs.mapInArrow(sketch, "id long, n long, d1 long, d2 long, a array<long>, b array<long>")


def signature(s: np.ndarray) -> np.ndarray:
    return np.packbits((np.bincount(s & (SIG_BITS - 1), minlength=SIG_BITS) & 1).astype(np.uint8)).view(np.int64)


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, s, sig) for the ids: whole sets, made anew from the texts rather than kept for every document.

    sig has SIG_BITS bits: of how many of the set's shingles fall on a bit, whether they are odd. So two sets differ
    in as many shingles at least as their bits differ, and no more.
    The ids are broadcast if there are few of them; beyond that both sides are shuffled.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Shingler(shingle)
        for b in batches:
            s = [maker.set_of(t).view(np.int64) for t in b.column("text").to_pylist()]
            at = np.cumsum([0, *map(len, s)])
            sig = np.concatenate([np.empty(0, np.int64), *map(signature, s)])
            lists = lambda to, x: pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists(at, np.concatenate([np.empty(0, np.int64), *s])), lists(np.arange(len(s) + 1) * (SIG_BITS // 64), sig)], names=["id", "s", "sig"])

    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return docs.join(ids, "id", "left_semi").mapInArrow(sets, "id long, s array<long>, sig array<long>")


def tables_of(classes: DataFrame, halves: int) -> DataFrame:
    """(id, n, a, b) to (id, n, key): a row for each table in which the class may meet another one.

    Table (i, j) can only hold two classes if both A_i and B_j do, so half keys are counted first, 2 * halves for a class
    rather than halves ** 2, and tables are made of those that other classes have too. None that matters is lost.
    """
    half = lambda c, side: F.transform(c, lambda x, i: F.struct((i + side * halves).alias("t"), F.xxhash64(i + side * halves, x).alias("h")))
    one = classes.select("id", F.explode(F.concat(half("a", 0), half("b", 1))).alias("x")).select("id", "x.t", "x.h")
    both = one.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    held = one.join(both, "h", "left_semi").groupBy("id").agg(F.collect_list("t").alias("ts"))
    tables = F.flatten(F.transform(F.filter("ts", lambda t: t < halves), lambda i: F.transform(F.filter("ts", lambda t: t >= halves), lambda j: F.xxhash64(i, j, F.get("a", i), F.get("b", j - halves)))))
    return classes.join(held, "id").select("id", "n", F.explode(tables).alias("key"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y) to (x, y, common, either): sizes of intersection and union of the full sets.

    A y of many pairs, as the smallest id of a large bucket, is repeated once for each SPLIT of them, and they are
    dealt out to its copies, so that no key gathers more than about SPLIT sets.
    """
    often = pairs.groupBy("y").agg(F.count("*").alias("k")).select("y", F.expr(f"1 + k div {SPLIT}").alias("copies"))
    dealt = pairs.join(often, "y").select("x", "y", F.pmod(F.xxhash64("x"), F.col("copies")).alias("copy"))
    x = sets.select(F.col("id").alias("x"), F.col("s").alias("sx"))
    y = sets.select(F.col("id").alias("y"), F.col("s").alias("sy")).join(often, "y").select("y", "sy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    t = dealt.join(x, "x").join(y, ["y", "copy"]).withColumn("common", F.size(F.array_intersect("sx", "sy")).cast("long"))
    return t.select("x", "y", "common", (F.size("sx") + F.size("sy") - F.col("common")).alias("either"))


def components(links: DataFrame) -> DataFrame:
    """(x, y) to (id, component): the smallest id that links reach, for every id with a link.

    Each round takes the least label of an id's neighbours, then the label's own label; rounds end when nothing
    changes. Minima are partial before a shuffle, and each round is written to the shared checkpoint folder.
    """
    edges = cut(links.select(F.col("x").alias("u"), F.col("y").alias("v")).union(links.select("y", "x")).distinct())
    labels = cut(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("l")))
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        new = labels.join(near, "u").select("u", "l", F.least("l", "m").alias("m"))
        jump = labels.select(F.col("u").alias("m"), F.col("l").alias("j"))
        new = cut(new.join(jump, "m", "left").select("u", F.col("l").alias("old"), F.least("m", "j").alias("l")))
        moved = new.where("l <> old").limit(1).count()
        labels = new.select("u", "l")
        if not moved:
            return labels.select(F.col("u").alias("id"), F.col("l").alias("component"))


def sharing_rare(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, part, s, sig) to the pairs (x, y) of different parts whose sets may be as similar as that; none is lost.

    A set's shingles are ordered by how few of the sets hold them. Two sets of that similarity have a shingle in
    common near the beginnings of both, and what lies behind it must suffice for the overlap they need. Nor may they
    differ in more shingles than that overlap leaves, and they do so in one for each bit at least that is not the same
    in their signatures: of sets just below the threshold hardly a pair is left to be confirmed.
    """
    one = sets.select("id", "n", "part", F.explode("s").alias("t"))
    held = one.groupBy("t").agg(F.count("*").alias("df"))
    w = Window.partitionBy("id").orderBy("df", "t")
    head = one.join(held, "t").withColumn("i", F.row_number().over(w)).where((F.col("df") > 1) & (100 * (F.col("i") - 1) <= (100 - percent) * F.col("n")))
    head = head.join(sets.select("id", "sig"), "id")  # few rows are left by now
    l, r = head.alias("l"), head.alias("r")
    size = F.col("l.n") + F.col("r.n")
    behind = 1 + F.least(F.col("l.n") - F.col("l.i"), F.col("r.n") - F.col("r.i"))
    cond = (F.col("l.t") == F.col("r.t")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.part") != F.col("r.part"))
    cond &= (100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")) & ((100 + percent) * behind >= percent * size)
    apart = F.lit(0)
    for k in range(SIG_BITS // 64):
        apart = apart + F.bit_count(F.get("l.sig", F.lit(k)).bitwiseXOR(F.get("r.sig", F.lit(k))))
    cond &= (100 + percent) * apart <= (100 - percent) * size  # size - apart is twice the overlap at most
    return l.join(r, cond).select(F.col("l.id").alias("x"), F.col("r.id").alias("y")).distinct()


def near_components(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, halves: int | None = None, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component) for every row of docs; ids are whole numbers.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of word shingles. Texts without
    words, or null, have empty sets and no links. Rows of one id are one document, whatever their texts: what any
    of them is linked with, the id is. A null id is linked with nothing and its component is null. An empty table
    gives an empty table. Without halves, halves_for(percent, rows) are made. Columns other than the two take no part.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} holds {docs.schema[id_col].dataType.simpleString()}; near duplicates take whole-number ids")
    halves = halves or halves_for(percent, rows)
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    all_docs = cut(sketches(own, shingle, halves, rows))
    real = all_docs.where("id is not null and n > 0")
    classes = cut(real.groupBy("d1", "d2").agg(F.min(F.struct("id", "n", "a", "b")).alias("r")).select("d1", "d2", "r.id", "r.n", "r.a", "r.b"))
    keys = cut(tables_of(classes, halves))
    release(docs.sparkSession)
    full = keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("size")).where("size > 1").select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n"))
    members = cut(keys.join(full, "key"))
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    ids = cut(members.select("id").distinct())
    sets = cut(full_sets(own, ids, shingle))
    release(docs.sparkSession)
    linked = 100 * F.col("common") >= percent * F.col("either")

    first = members.where((F.col("id") != F.col("pivot")) & fits(F.col("n"), F.col("pivot_n"))).select(F.col("id").alias("x"), F.col("pivot").alias("y")).distinct()
    tried = cut(confirmed(first, sets))
    links = tried.where(linked).select("x", "y")
    parts = components(links)

    # members of buckets that hold several components still
    left = members.select("key", "id", "n").join(parts, "id", "left").withColumn("part", F.coalesce("component", "id"))
    mixed = left.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    left = cut(left.join(mixed, "key", "left_semi").select("id", "n", "part").distinct())
    rest = cut(sharing_rare(left.join(sets, "id"), percent))
    if not rest.isEmpty():
        links = cut(links.union(confirmed(rest, sets).where(linked).select("x", "y")))
        parts = components(links)
    of_class = classes.select("d1", "d2", "id").join(parts, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    least = cut(of_class.groupBy("d1", "d2").agg(F.min("component").alias("component")))
    out = all_docs.select("id", "n", "d1", "d2").join(least, ["d1", "d2"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id")).alias("component"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and whether it is its first, of every document; 85 percent links."""
    out = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


OP7_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(generate_series(1, len(w) - 4), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]) end) as g from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 85 * (p.n + q.n - k)),
e as (select x, y from l union select y, x from l),
r(doc_id, m) as (select doc_id, doc_id from d union select e.y, r.m from r join e on e.x = r.doc_id where r.m < e.y)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, (select min(m) from r where r.doc_id = d.doc_id) as component_id, d.doc_id = (select min(m) from r where r.doc_id = d.doc_id) as kept
from d left join n using (doc_id)
"""
