"""Token counts by rank-synchronous merging of arrays.

A text's pre-tokens (runs that no piece of the vocabulary reaches across) are held for a whole batch as one
ragged array: symbols end to end, with the sequence each belongs to. In a round, every sequence applies its
lowest-rank pair, the leftmost of equals, all at once; rounds end when no pair has a rank. What survives is
counted, unknown characters as their bytes. Counts of pre-tokens are remembered in a bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.bpe import vocabulary
from foldwright.llm.common import Aside, kept_by_worker, ship, small_batches, table

ship(__name__)

PIECE_BPE = "piece_bpe_32k.model"
LIMIT = 4096
#: Half of the counts that a task remembers, and characters of the longest pre-token remembered.
MEMORY, MEMORY_WORD = 300_000, 64
BLANK = "▁"
NO_RANK = np.iinfo(np.int64).max


class RankMerger:
    """Token counts by a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece as spm

        sp = spm.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in normal]
        scores = np.array([sp.get_score(i) for i in normal])
        rank = np.unique(-scores, return_inverse=True)[1]  # equal scores, equal ranks
        self.ids = {p: k for k, p in enumerate(pieces)}
        self.chars = {p: k for p, k in self.ids.items() if len(p) == 1}
        left, right, made = [], [], []
        for p, k in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is None and cut == 1:
                    a = self._extra(p[:1], len(pieces))
                if b is None and cut == len(p) - 1:
                    b = self._extra(p[cut:], len(pieces))
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(k)
        self.size = 1 << 32
        key = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.made = key[order], np.array(made, np.int64)[order]
        self.rank = rank[self.made].astype(np.int64)
        self.n_pieces = len(pieces)
        inner = [p for p in pieces if len(p) > 1]
        self.alone = {c for c in "\n\t\r" if not any(c in p for p in inner)}
        if any(BLANK in p.lstrip(BLANK) for p in inner):
            raise ValueError("a piece holds a blank after another character; texts can't be split at blanks")
        runs = [len(p) for p in inner if set(p) == {BLANK}]
        self.run = max(runs, default=1)
        # a long run of blanks loses a longest piece at a time from its left, if nothing else merges blanks
        blanks = {rank[self.ids[BLANK * k]] for k in runs}
        self.reducible = False
        if blanks == {rank.max()} and not any(p.startswith(BLANK * 2) and set(p) != {BLANK} for p in inner):
            n = self._merged([BLANK * k for k in range(self.run + 1, 5 * self.run)])
            self.reducible = bool((n[self.run :] == n[: -self.run] + 1).all())
        own = "".join(re.escape(c) for c in sorted(self.alone))
        self.split = re.compile(f"{BLANK}*[^{BLANK}{own}]+|{BLANK}+" + (f"|[{own}]" if own else ""))
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _extra(self, char: str, base: int) -> int | None:
        """Id of a character that is no piece but may be part of one."""
        return self.chars.setdefault(char, base + len(self.chars))

    def _merged(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        extra = np.zeros(len(words), np.int64)
        if self.reducible:
            short = []
            for i, w in enumerate(words):
                k = len(w) - len(w.lstrip(BLANK))
                cut = max(0, (k - self.run - 1) // self.run)
                extra[i] = cut
                short.append(w[cut * self.run :])
            words = short
        size = np.array([len(w) for w in words], np.int64)
        chars, unknown = self.chars, {}
        base = self.n_pieces + len(chars) + 1
        flat = np.array([chars[c] if c in chars else unknown.setdefault(c, base + len(unknown)) for w in words for c in w], np.int64)
        cost = {v: len(c.encode()) for c, v in unknown.items()} | {v: len(c.encode()) for c, v in chars.items() if v >= self.n_pieces}
        seq = np.repeat(np.arange(len(words)), size)
        total = np.zeros(len(words), np.int64)
        while len(flat):
            key = flat[:-1] * self.size + flat[1:]
            at = np.searchsorted(self.key, key)
            at[at == len(self.key)] = 0
            ok = (self.key[at] == key) & (seq[:-1] == seq[1:]) if len(self.key) else np.zeros(len(key), bool)
            rank = np.full(len(flat), NO_RANK)
            rank[:-1][ok] = self.rank[at[ok]]
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(flat)])
            live = best != NO_RANK
            done = np.repeat(~live, count)
            if done.any():  # sequences without a pair are counted and leave
                ids = flat[done]
                n = np.ones(len(ids), np.int64)
                for k in np.flatnonzero(ids >= self.n_pieces):
                    n[k] = cost[int(ids[k])]
                np.add.at(total, seq[done], n)
            hit = np.flatnonzero((rank == np.repeat(best, count)) & ~done)
            if not len(hit):
                break
            hit = self._together(flat, seq, hit, self.made[at[hit]], rank[hit])
            flat[hit] = self.made[at[hit]]
            stay = ~done
            stay[hit + 1] = False
            flat, seq = flat[stay], seq[stay]
        return total + extra

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], NO_RANK)

    def _together(self, flat: np.ndarray, seq: np.ndarray, hit: np.ndarray, made: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of the places with a sequence's best rank, those that merge now.

        The leftmost always does. The others do so too, every second one where they overlap, if no pair that the
        new symbols form has a rank as good: then one after the other would give the same.
        """
        n = len(hit)
        start = np.r_[True, (hit[1:] != hit[:-1] + 1) | (seq[hit[1:]] != seq[hit[:-1]])]
        within = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
        new = np.r_[True, seq[hit][1:] != seq[hit][:-1]]
        before, after = np.maximum(hit - 1, 0), np.minimum(hit + 2, len(flat) - 1)
        bad = (self._ranks(flat[before], made) <= rank) & (hit > 0) & (seq[before] == seq[hit])
        bad |= (self._ranks(made, flat[after]) <= rank) & (hit + 2 < len(flat)) & (seq[after] == seq[hit])
        bad |= self._ranks(made, made) <= rank
        bad = np.repeat(np.logical_or.reduceat(bad, np.flatnonzero(new)), np.diff(np.r_[np.flatnonzero(new), n]))
        return hit[new | (~bad & (within % 2 == 0))]

    def _learn(self, words: set[str]) -> dict[str, int]:
        """Counts of the words that are too long to be remembered; the others are, from now on."""
        if len(self.known) > MEMORY:
            self.old, self.known = self.known, {}
        self.known.update({w: self.old[w] for w in words if w in self.old and w not in self.known})
        new = sorted((w for w in words if w not in self.known), key=len)
        long: dict[str, int] = {}
        i = 0
        while i < len(new):  # ragged batches of bounded size
            j, n = i, 0
            while j < len(new) and (n == 0 or n + len(new[j]) <= 400_000):
                n += len(new[j])
                j += 1
            for w, k in zip(new[i:j], self._merged(new[i:j]).tolist(), strict=True):
                (self.known if len(w) <= MEMORY_WORD else long)[w] = k
            i = j
        return long

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.split.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        long = self._learn(set().union(*split))
        known = self.known
        if not long:
            return [sum([known[w] for w in s]) for s in split]
        return [sum([known[w] if w in known else long[w] for w in s]) for s in split]


def token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs without their text, with `_n_bytes`, `_n_tokens`, `_over_limit`. Null texts are empty and have no tokens.

    Strings of special tokens inside a text are ordinary text. Rows are independent, so repeated rows repeat, and an
    empty table gives an empty table. A column of docs with an output's name is replaced by the output.
    """
    small_batches(docs.sparkSession)
    all_of = Aside(docs)
    text = all_of.of(text_col)
    names = [n for n in all_of.names if n != text]
    own = all_of.df.select(*names, F.coalesce(text, F.lit("")).alias("text"))
    kinds = "".join(f"{n} {own.schema[n].dataType.simpleString()}, " for n in names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            merger = kept_by_worker(RankMerger, path)
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(merger.counts(texts), pa.int64())], names=[*names, "n_bytes", "n_tokens"])

    out = own.mapInArrow(count, f"{kinds}n_bytes bigint, n_tokens bigint")
    return all_of.back(out, {"_n_bytes": "n_bytes", "_n_tokens": "n_tokens", "_over_limit": F.col("n_tokens") > limit}, (text_col,))


def op10_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Bytes, tokens and whether these are more than LIMIT, of every document."""
    out = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), path or vocabulary(PIECE_BPE))
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_bytes", "n_tokens", "over_limit")])
