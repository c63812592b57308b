"""Language-model scores by a weighted backoff automaton.

The model is a trigram model smoothed by a prior: p(w | h) = (c(h, w) + k p(w | h')) / (c(h) + k) with k = PRIOR +
SHARE c(h), where h' is the context h without its first word, and p(w) the unigram estimate with 0.1 added to each
count. As an automaton: a state for each context of two words or one, and a root; from each state arcs with weights
for the n-grams seen, and a failure arc of weight k / (c(h) + k) to the state of the shorter context. A text is read
once from left to right; the traversal carries its state, follows failure arcs until there is an arc for the word, and
adds up the log-probabilities.

The automaton grows with the corpus and is in no one place. Each task packs the documents that it reads into blocks
of bounded size. A block names the n-grams it holds, cut into buckets by hash; a bucket's task adds up their counts
over all blocks and answers each block; and a block builds, from the totals for its own n-grams, the part of the
automaton that its documents can reach. Words are told apart by their bytes, pairs and triples by hashes of 64 bits.
A triple is asked for only if both of its pairs occur in another block too; else its count is known in the block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import Aside, cut, cut_freed, ship, small_batches, table, trim

ship(__name__)

PRIOR, SHARE = 1.0, 1.0
ADD = 0.1
#: Bytes of text in a block, and n-grams in a bucket, on average.
BLOCK_BYTES, BUCKET_GRAMS = 8 << 20, 1 << 20
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
END = b""


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes each as the largest takes, equal bytes together."""
    n = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T
    return bytes([n]) + zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(x[1:]), np.uint8).reshape(x[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : x[0]] = planes.T
    return out.reshape(-1).view("<u8").astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the gaps after it, each in as few bytes as the widest gap takes."""
    gaps = np.diff(keys)
    n = max(1, (int(gaps.max(initial=1)).bit_length() + 7) // 8)
    return bytes([n]) + keys[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def unpacked_keys(x: bytes) -> np.ndarray:
    n = x[0]
    gaps = np.zeros(((len(x) - 9) // n, 8), np.uint8)
    gaps[:, :n] = np.frombuffer(x, np.uint8, offset=9).reshape(-1, n)
    return np.cumsum(np.r_[np.frombuffer(x[1:9], np.uint64), gaps.reshape(-1).view(np.uint64)], dtype=np.uint64)


def packed_texts(texts: list[str], train: list[bool]) -> dict[str, bytes]:
    """Texts as tokens: the words, the more frequent the lower their number, and the numbers of the texts' words."""
    ids = _Ids({END: 0})
    flat, size = [], []
    for t in texts:
        words = t.encode().lower().split()  # of bytes: A-Z, and the six white characters
        words.append(END)
        flat.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        size.append(len(words))
    cur = np.concatenate(flat)
    order = np.argsort(-np.bincount(cur, minlength=len(ids)), kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    words = list(ids)
    return {"words": zlib.compress(b" ".join([words[i] for i in order]), 1), "cur": packed(rank[cur]), "size": packed(np.array(size)), "train": packed(np.array(train).astype(np.int64))}


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes; a and b are used up."""
    a *= M1
    b *= M2
    b += M1
    a ^= b
    del b
    a ^= a >> np.uint64(31)
    a *= M1
    a ^= a >> np.uint64(29)
    return a


class Block:
    """Tokens of a block's documents end to end, and its words and pairs of words with their counts in training."""

    def __init__(self, row: dict):
        words = zlib.decompress(row["words"]).split(b" ")
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        order = sorted(range(len(words)), key=lambda i: (hashes[i], words[i])) if len(np.unique(hashes)) < len(words) else np.argsort(hashes)
        self.words, self.hashes = [words[i] for i in order], hashes[order]
        at = np.empty(len(words), np.int32)
        at[order] = np.arange(len(words), dtype=np.int32)
        self.cur = at[unpacked(row["cur"])]  # numbers of words in order of their hashes
        self.size = unpacked(row["size"])
        self.first = np.cumsum(self.size) - self.size
        self.train = np.repeat(unpacked(row["train"]).astype(bool), self.size)
        self.word_counts = np.bincount(self.cur[self.train], minlength=len(words))
        end = at[words.index(END)]
        self.last = np.r_[end, self.cur[:-1]].astype(np.int32)  # a text begins in the state of an end
        self.pairs, pair_at = np.unique(mixed(self.hashes[self.last], self.hashes[self.cur]), return_inverse=True)
        self.pair_at = pair_at.astype(np.int32)
        self.pair_counts = np.bincount(pair_at[self.train], minlength=len(self.pairs))

    def triples(self, shared: np.ndarray) -> None:
        """Makes the triples; shared: of each pair, whether another block holds it. `asked` are those that others may hold."""
        inner = np.ones(len(self.cur), bool)
        inner[self.first] = False  # a text's first word has one word of context
        inner = np.flatnonzero(inner)
        self.keys, first, at = np.unique(mixed(self.pairs[self.pair_at[inner - 1]], self.pairs[self.pair_at[inner]]), return_index=True, return_inverse=True)
        self.triple_counts = np.bincount(at[self.train[inner]], minlength=len(self.keys))
        self.triple_at = np.full(len(self.cur), -1, np.int32)
        self.triple_at[inner] = at
        first = inner[first]
        self.asked = np.flatnonzero(shared[self.pair_at[first - 1]] & shared[self.pair_at[first]])


def edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where buckets, equal ranges of the hash, begin and end in sorted keys."""
    return np.r_[np.searchsorted(keys, np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)), len(keys)]


def traverse(b: Block, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, root: np.ndarray, prior: float, share: float) -> np.ndarray:
    """log10 probability of each text by the automaton of a block, read from left to right.

    c1, c2, c3: counts of its words, pairs and triples; root: weights of the root's arcs. The state is a pair of words,
    one word or the root; it is a pair's after an arc for a pair or a triple, and a word's after one of the root.
    """
    k1, k2 = prior + share * c1, prior + share * c2
    fail_1, fail_2 = np.log10(k1 / (c1 + k1)), np.log10(k2 / (c2 + k2))
    c3 = np.r_[c3, 0]  # a text's first word, triple_at -1, ends no triple
    out = np.zeros(len(b.size))
    ends = np.cumsum(b.size)
    d = 0
    while d < len(out):  # documents of some 100,000 tokens at once: weights of their arcs, none being nan
        e = max(d + 1, int(np.searchsorted(ends, b.first[d] + 100_000, "right")))
        part = slice(int(b.first[d]), int(ends[e - 1]))
        w, h, pair, context = b.cur[part], b.last[part], b.pair_at[part], np.r_[0, b.pair_at][part]
        n2, n3 = c2[pair], c3[b.triple_at[part]]
        arc1, fail1, fail2 = root[w], fail_1[h], fail_2[context]
        arc2 = np.log10((n2 + k1[h] * 10**arc1) / (c1[h] + k1[h]))
        arc3 = np.where(n3 > 0, np.log10((n3 + k2[context] * 10**arc2) / (c2[context] + k2[context])), np.nan)
        steps = zip(*[x.tolist() for x in (arc1, np.where(n2 > 0, arc2, np.nan), arc3, fail1, fail2)], strict=True)
        for i in range(d, e):
            total, deep = 0.0, False  # deep: the state is a pair's
            for x1, x2, x3, f1, f2 in islice(steps, int(b.size[i])):
                if deep:
                    if x3 <= 0:  # the pair has an arc for the word
                        total += x3
                        continue
                    total += f2  # failure arc to the last word's state
                if x2 <= 0:
                    total += x2
                    deep = True
                else:
                    total += f1 + x1  # failure arc to the root, whose arcs are all words
                    deep = False
            out[i] = total
        d = e
    return out


KEYS = "block long, bucket int, kind int, keys binary, counts binary"
TOLD = "block long, bucket int, kind int, counts binary"


def _told(t: pa.Table) -> pa.Table:
    """A bucket's n-grams of all blocks to their totals for each block, and one row (block -1) of what the bucket holds."""
    kind, bucket = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
    keys = t.column("keys").to_pylist()
    if kind == 1:
        lists = [zlib.decompress(k).split(b" ") for k in keys]
        ids, size = _Ids(), [len(x) for x in lists]
        at = np.fromiter((ids[w] for x in lists for w in x), np.int64, sum(size))
    else:
        arrays = [unpacked_keys(k) for k in keys]
        size = [len(x) for x in arrays]
        at = np.unique(np.concatenate(arrays), return_inverse=True)[1]
    total = np.bincount(at, weights=np.concatenate([unpacked(c) for c in t.column("counts").to_pylist()])).astype(np.int64)
    value = total if kind != 2 else 2 * total + (np.bincount(at) > 1)  # a block names a pair once
    parts = np.split(value[at], np.cumsum(size)[:-1])
    stats = np.array([(total > 0).sum(), total.sum()])
    n = len(keys) + 1
    return pa.table({"block": pa.array([*t.column("block").to_pylist(), -1], pa.int64()), "bucket": pa.array([bucket] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "counts": pa.array([*map(packed, parts), packed(stats)], pa.binary())})


def _answers(t: pa.Table) -> dict[int, np.ndarray]:
    """Totals by kind, in order of the block's n-grams."""
    t = t.sort_by([("kind", "ascending"), ("bucket", "ascending")])
    kinds, counts = t.column("kind").to_pylist(), t.column("counts").to_pylist()
    return {k: np.concatenate([np.empty(0, np.int64), *[unpacked(c) for c, kind in zip(counts, kinds, strict=True) if kind == k]]) for k in (1, 2, 3)}


def lm_scores(docs: DataFrame, prior: float = PRIOR, share: float = SHARE, text_col: str = "text", train_col: str = "train", block_bytes: int = BLOCK_BYTES, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """docs without text_col and train_col, with `_n_tokens`, `_n_known`, `_train_tokens`, `_base_score`, `_score`.

    Counts are those of all rows with train_col true, a repeated row counting again; null is false. A null text is
    empty: one token, the end. Without training rows every word has the same probability. An empty table gives an
    empty table. A column of docs with an output's name is replaced by the output.
    """
    spark = docs.sparkSession
    small_batches(spark)
    all_of = Aside(docs)
    text, train = all_of.of(text_col), all_of.of(train_col)
    names = [n for n in all_of.names if n not in (text, train)]
    own = all_of.df.select(*names, F.coalesce(text, F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kinds = "".join(f"{n} {own.schema[n].dataType.simpleString()}, " for n in names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, TaskContext.get().partitionId() << 32

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            row = packed_texts(t.column("text").to_pylist(), t.column("train").to_pylist())
            sink = pa.BufferOutputStream()
            rest = t.select(names).combine_chunks()
            with pa.ipc.new_stream(sink, rest.schema) as out:
                out.write_table(rest)
            return pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int64()), "n": pa.array([size], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in row.items()}, "rest": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for b in batches:
            lengths = np.array([len(x) for x in b.column("text").to_pylist()], np.int64) + 1
            for i in range(b.num_rows):  # a row at a time, so that a block ends where it is full
                held.append(b.slice(i, 1))
                size += int(lengths[i])
                if size >= block_bytes:
                    yield made()
                    held, size, at = [], 0, at + 1
                    trim()
        if held:
            yield made()

    dealt = cut(own.mapInArrow(blocks, "block long, n long, words binary, cur binary, size binary, train binary, rest binary"))
    n_buckets = max(1, round((dealt.agg(F.sum("n")).first()[0] or 1) / 6 / bucket_grams))
    PARTS = ["block", "words", "cur", "size", "train"]

    def rows_of(block: int, kind: int, keys: np.ndarray, pack, counts: np.ndarray) -> pa.RecordBatch:
        at = edges(keys, n_buckets)
        some = np.flatnonzero(np.diff(at))
        parts = [slice(at[i], at[i + 1]) for i in some]
        n = len(some)
        return pa.RecordBatch.from_pydict({"block": pa.array([block] * n, pa.int64()), "bucket": pa.array(some, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "keys": pa.array([pack(p) for p in parts], pa.binary()), "counts": pa.array([packed(counts[p]) for p in parts], pa.binary())})

    # freed arrays would stay with the worker, and workers of other tasks need the room
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                yield rows_of(row["block"], 1, b.hashes, lambda p, b=b: zlib.compress(b" ".join(b.words[p]), 1), b.word_counts)
                yield rows_of(row["block"], 2, b.pairs, lambda p, b=b: packed_keys(b.pairs[p]), b.pair_counts)
                del b
                trim()

    def triples(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        b = Block(row)
        b.triples((_answers(right)[2] & 1).astype(bool))
        keys, counts = b.keys[b.asked], b.triple_counts[b.asked]
        del b
        trim()
        return pa.Table.from_batches([rows_of(row["block"], 3, keys, lambda p: packed_keys(keys[p]), counts)])

    # each round's shuffle files go before the next one writes its own
    told = cut_freed(dealt.select(*PARTS).mapInArrow(grams, KEYS).groupBy("kind", "bucket").applyInArrow(_told, TOLD))
    asked = dealt.select(*PARTS).groupBy("block").cogroup(told.where("block >= 0 and kind = 2").groupBy("block")).applyInArrow(triples, KEYS)
    told = told.unionByName(cut_freed(asked.groupBy("kind", "bucket").applyInArrow(_told, TOLD)))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([unpacked(x) for x in b.column("counts").to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy())], names=["v", "n"])

    stats = told.where("block = -1 and kind = 1").select("counts").mapInArrow(both, "v long, n long").agg(F.sum("v"), F.sum("n")).first()
    n_words, n_train = stats[0] or 0, stats[1] or 0

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        b, of = Block(row), _answers(right)
        c1, c2 = of[1], of[2] >> 1
        b.triples((of[2] & 1).astype(bool))
        c3 = b.triple_counts.copy()
        c3[b.asked] = of[3]
        root = np.log10((c1 + ADD) / (n_train + ADD * (n_words + 1)))
        add = lambda x: np.add.reduceat(x, b.first)
        with pa.ipc.open_stream(row["rest"]) as rest:
            t = rest.read_all()
        cols = {
            "n_tokens": b.size,
            "n_known": add((c1 > 0)[b.cur].astype(np.int64)),
            "base_score": add(root[b.cur]),
            "score": traverse(b, c1, c2, c3, root, prior, share),
        }
        del b, of, c1, c2, c3, root
        trim()
        return pa.table({**{n: t.column(n) for n in names}, **cols})

    out = dealt.select(*PARTS, "rest").groupBy("block").cogroup(told.where("block >= 0").groupBy("block")).applyInArrow(score, f"{kinds}n_tokens long, n_known long, base_score double, score double")
    made = {f"_{c}": c for c in ("n_tokens", "n_known")} | {"_train_tokens": F.lit(n_train).cast("long"), "_base_score": "base_score", "_score": "score"}
    return all_of.back(out, made, (text_col, train_col))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out: rows whose crc32 of the id as text leaves 0 by 10; a null id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False)).alias("held_out"))
    out = lm_scores(docs.withColumn("train", ~F.col("held_out")))
    return out.select("doc_id", "held_out", *[F.col(f"_{c}").alias(c) for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")])
