"""BPE encoding and decoding by tree concatenation.

The library's splitting never reaches across white space, so a text is its runs between white space, one after
another. Short runs are asked of the library once a worker (a bounded memory). A long run is cut in halves until
the parts are short, wherever the cuts fall; parts are encoded on their own, and a tree of joins puts them together.
At a join a window around it is encoded anew and grown until it agrees with both sides: until AGREE successive
tokens of the window are the same, at the same places, as in the left part, and as many in the right part. There
the left part's tokens go over into the window's, and these into the right part's. Tokens are valid together if each
two neighbours are, and every two neighbours of the result are neighbours in one of the three encodings.

Very long texts are cut into rows of their own first, so that many tasks encode one text; only what is open at a
row's ends, the runs that the cuts may have parted, takes part in the last joins.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import SPACE, Aside, kept_by_worker, ship, small_batches, table

ship(__name__)

WORD_BPE = "word_bpe_49k.json"
#: Characters of a run that the library encodes in one piece, and of a join's first window on either side.
LEAF, WINDOW = 4096, 64
#: Successive tokens that a window and a side must have in common; two would do.
AGREE = 4
#: Texts of more characters are cut into rows of so many.
ROW_CHARS = 1 << 17
#: Half of the runs that a worker remembers, and characters of the longest; with its encoder some 250 MB.
MEMORY, MEMORY_RUN = 300_000, 64


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Spans:
    """Tokens of a part of a run: ids, and where each begins and ends in characters from the part's start."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.ids, self.start, self.end = ids, start, end

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, i: int, j: int | None = None, shift: int = 0) -> Spans:
        return Spans(self.ids[i:j], self.start[i:j] + shift, self.end[i:j] + shift)

    @classmethod
    def joined(cls, parts: list[Spans]) -> Spans:
        return cls(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("ids", "start", "end")))

    def packed(self) -> bytes:
        return b"".join(x.astype("<u4").tobytes() for x in (self.ids, self.start, self.end))

    @classmethod
    def unpacked(cls, x: bytes) -> Spans:
        ids, start, end = np.frombuffer(x, "<u4").reshape(3, -1)
        return cls(ids, start.astype(np.int64), end.astype(np.int64))


def agreement(a: Spans, b: Spans, last: bool) -> tuple[int, int] | None:
    """Places i, j of AGREE successive tokens that a has from i and b from j: the first or last such; None if there are none."""
    keys = [np.stack([x.ids.astype(np.int64), x.start, x.end], 1) for x in (a, b)]
    # tokens are in order of their places, so equal ones stand in the same order in both
    both = np.concatenate(keys)
    _, code = np.unique(both, axis=0, return_inverse=True)
    code = code.reshape(-1)
    at = {int(c): j for j, c in reversed(list(enumerate(code[len(a) :])))}
    pairs = [(i, at[int(c)]) for i, c in enumerate(code[: len(a)]) if int(c) in at]
    run = 0
    found = None
    for k, (i, j) in enumerate(pairs):
        run = run + 1 if k and pairs[k - 1] == (i - 1, j - 1) else 1
        if run >= AGREE:
            found = (i - AGREE + 1, j - AGREE + 1)
            if not last:
                return found
    return found


class TreeEncoder:
    """Ids of texts, as little-endian unsigned 32-bit integers, and their decoding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.strings = {i: s for s, i in self.lib.get_vocab(with_added_tokens=True).items()}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.work = 0  # characters of long runs that the library was given

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        runs = _split(text)
        if len(self.known) > MEMORY:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        more: dict[str, bytes] = {}  # what is not remembered
        new = []
        for r in set(runs):
            if r not in known:
                if r in old:
                    known[r] = old[r]
                elif len(r) <= LEAF:
                    new.append(r)
                else:
                    more[r] = self.run(r).ids.astype("<u4").tobytes()
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for r, e in zip(part, self.lib.encode_batch_fast(part, add_special_tokens=False), strict=True):
                (known if len(r) <= MEMORY_RUN else more)[r] = np.array(e.ids, "<u4").tobytes()
        return b"".join([known[r] if r in known else more[r] for r in runs])

    def leaf(self, text: str) -> Spans:
        self.work += len(text)
        e = self.lib.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2)
        return Spans(np.array(e.ids, np.uint32), at[:, 0], at[:, 1])

    def run(self, text: str) -> Spans:
        """Tokens of a run of text without white space."""
        if len(text) <= LEAF:
            return self.leaf(text)
        mid = len(text) // 2
        return self.join(text, self.run(text[:mid]), mid, self.run(text[mid:]))

    def join(self, text: str, left: Spans, mid: int, right: Spans) -> Spans:
        """left and right are the tokens of text[:mid] and text[mid:], alone."""
        size = WINDOW
        while True:
            # the window begins and ends where a token of its side does, so that no token's phase is lost
            i = int(np.searchsorted(left.start, mid - size, "right")) - 1 if mid > size else 0
            a = int(left.start[i]) if i > 0 else 0
            j = int(np.searchsorted(right.end, size)) + 1
            b = mid + int(right.end[j - 1]) if j < len(right) else len(text)
            w = self.leaf(text[a:b]).part(0, None, a)
            before = left.part(i if a else 0)
            after = right.part(0, j if b < len(text) else None, mid)
            head = (0, 0) if a == 0 else agreement(before, w, False)
            tail = (len(w), len(after)) if b == len(text) else agreement(w, after, True)
            if head is not None and tail is not None:
                lead = left.part(0, 0 if a == 0 else i + head[0] + 1)
                body = w.part(0 if a == 0 else head[1] + 1, tail[0] + (b < len(text)))
                rest = right.part(len(right) if b == len(text) else tail[1] + 1, None, mid)
                if a == 0 or b == len(text) or head[1] < tail[0]:
                    return Spans.joined([lead, body, rest])
            size *= 2

    def decode(self, ids: bytes) -> str:
        s = self.strings
        return " ".join([s[i] for i in np.frombuffer(ids, "<u4").tolist()])


class Piece:
    """A row's share of a long text: the runs open at its ends, and the ids of all between them."""

    def __init__(self, head: tuple[str, Spans], mid: bytes | None, tail: tuple[str, Spans]):
        self.head, self.mid, self.tail = head, mid, tail  # mid is None where the piece is one run, the head

    @classmethod
    def of(cls, enc: TreeEncoder, text: str) -> Piece:
        spaces = [i for i in (min((k for k in map(text.find, SPACE) if k >= 0), default=-1), max(map(text.rfind, SPACE))) if i >= 0]
        none = ("", NO_SPANS)
        run = lambda t: (t, enc.run(t)) if t else none
        if not spaces:
            return cls(run(text), None, none)
        return cls(run(text[: spaces[0]]), enc.encode(text[spaces[0] : spaces[1]]), run(text[spaces[1] + 1 :]))

    def plus(self, enc: TreeEncoder, other: Piece) -> Piece:
        """This piece and the one after it as one."""
        t, left = self.tail if self.mid is not None else self.head
        u, right = other.head
        met = (t + u, enc.join(t + u, left, len(t), right) if t and u else left if t else right)
        if self.mid is None:
            return Piece(met, other.mid, other.tail)
        if other.mid is None:
            return Piece(self.head, self.mid, met)
        return Piece(self.head, self.mid + met[1].ids.astype("<u4").tobytes() + other.mid, other.tail)

    def ids(self) -> bytes:
        of = lambda x: x[1].ids.astype("<u4").tobytes()
        return of(self.head) + (self.mid or b"") + of(self.tail)

    @classmethod
    def whole(cls, enc: TreeEncoder, pieces: list[Piece]) -> bytes:
        """Ids of pieces in order, put together in a tree."""
        while len(pieces) > 1:
            pieces = [pieces[i].plus(enc, pieces[i + 1]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0].ids()


NO_SPANS = Spans(np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64))


def _split(text: str) -> list[str]:
    """Runs between the six white characters; others than these are for the library to see."""
    return [r for r in text.translate(_BLANKS).split(" ") if r]


_BLANKS = str.maketrans(SPACE, " " * len(SPACE))


OPEN = [("head", pa.string()), ("head_spans", pa.binary()), ("mid", pa.binary()), ("tail", pa.string()), ("tail_spans", pa.binary())]


def encoded(docs: DataFrame, path: str, text_col: str = "text", with_text: bool = False, row_chars: int = ROW_CHARS) -> DataFrame:
    """docs without their text, with `_ids` (binary, 4 bytes a token) and `_decoded` or, by default, hashes of both.

    Null texts are empty, and empty texts have no tokens. Strings of special tokens inside a text get the special
    ids, as the library does by default. Rows are independent of one another: repeated rows give repeated results,
    and an empty table gives an empty table. A column of docs with an output's name is replaced by the output.
    """
    small_batches(docs.sparkSession)
    all_of = Aside(docs)
    text = all_of.of(text_col)
    names = [n for n in all_of.names if n != text]
    own = all_of.df.select(*names, F.coalesce(text, F.lit("")).alias("text"))
    kinds = "".join(f"{n} {own.schema[n].dataType.simpleString()}, " for n in names)
    outs = [("ids", pa.binary()), ("decoded", pa.string())] if with_text else [("n", pa.int64()), ("ids_sum", pa.string()), ("text_sum", pa.string())]

    def results(enc: TreeEncoder, ids: list[bytes]) -> list[pa.Array]:
        if with_text:
            return [pa.array(ids, pa.binary()), pa.array([enc.decode(x) for x in ids], pa.string())]
        sums = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(enc.decode(x).encode()).hexdigest()) for x in ids]
        return [pa.array([s[k] for s in sums], t) for k, (_, t) in enumerate(outs)]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enc = kept_by_worker(TreeEncoder, path)
            ids = [enc.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *results(enc, ids)], names=[*names, *[n for n, _ in outs]])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enc = kept_by_worker(TreeEncoder, path)
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                p = Piece.of(enc, row.column("text")[0].as_py())
                cells = [p.head[0], p.head[1].packed(), p.mid, p.tail[0], p.tail[1].packed()]
                yield pa.RecordBatch.from_arrays([row.column("_row"), row.column("part"), *[pa.array([x], k) for x, (_, k) in zip(cells, OPEN, strict=True)]], names=["_row", "part", *[n for n, _ in OPEN]])

    def joined(t: pa.Table) -> pa.Table:
        enc = kept_by_worker(TreeEncoder, path)
        t = t.sort_by("part")
        cells = [t.column(n).to_pylist() for n, _ in OPEN]
        pieces = [Piece((h, Spans.unpacked(hs)), m, (e, Spans.unpacked(es))) for h, hs, m, e, es in zip(*cells, strict=True)]
        return pa.Table.from_arrays([t.column("_row").slice(0, 1), *[pa.chunked_array([x]) for x in results(enc, [Piece.whole(enc, pieces)])]], names=["_row", *[n for n, _ in outs]])

    sql = {"binary": "binary", "string": "string", "int64": "bigint"}
    made = ", ".join(f"{n} {sql[str(t)]}" for n, t in outs)
    n = F.char_length("text")
    short = own.where(n <= row_chars).mapInArrow(whole, f"{kinds}{made}")
    long = own.where(n > row_chars)
    if long.isEmpty():
        out = short
    else:
        keyed = long.withColumn("_row", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")))
        cuts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / row_chars)), lambda i: F.struct(i.cast("int").alias("part"), F.substring("text", (i * row_chars + 1).cast("int"), row_chars).alias("text")))
        pieces = keyed.select("_row.a", "_row.b", cuts.alias("cut")).distinct().select(F.concat_ws(":", "a", "b").alias("_row"), F.explode("cut").alias("cut")).select("_row", "cut.part", "cut.text")
        spread = pieces.repartition(F.col("_row"), F.col("part"))
        met = spread.mapInArrow(parts, "_row string, part int, head string, head_spans binary, mid binary, tail string, tail_spans binary").groupBy("_row").applyInArrow(joined, f"_row string, {made}")
        out = short.unionByName(keyed.drop("text").withColumn("_row", F.concat_ws(":", "_row.a", "_row.b")).join(met, "_row").drop("_row"))
    return all_of.back(out, {f"_{n}": n for n, _ in outs}, (text_col,))


def op9_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Counts and hashes of the ids, and of the text that they decode to, of every document."""
    out = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path or vocabulary(WORD_BPE))
    return out.select("doc_id", F.col("_n").alias("n_tokens"), F.col("_ids_sum").alias("ids_sha256"), F.col("_text_sum").alias("decoded_sha256"))
