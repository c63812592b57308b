import glob
import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.llm import bpe, common, lm, line_dedup, mixing, near_dup, pii, quality, token_counts, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ce di fo gu ha je".split() for b in "ra se ti no lu".split()]


def docs_of(spark, texts, **extra):
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 7 else None, 0) for i, t in enumerate(texts)], SCHEMA)
    return df


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(5, 90))) for _ in range(40)]
    near = [" ".join([*b.split()[:-1], "zzz"]) for b in base[:12]]
    return [*base, *base[:5], *near, "", None, "a b", "a b", "a  b c", "x\n" * 30, "shared line\n" + base[0]] + [f"Shared Line \nown {i}" for i in range(12)]


OPERATORS = {
    "lines": line_dedup.dedup_lines,
    "quality": quality.apply_quality,
    "mix": mixing.mix,
    "near": near_dup.near_components,
    "bpe": lambda d: bpe.encoded(d, bpe.vocabulary(bpe.WORD_BPE)),
    "count": lambda d: token_counts.token_counts(d, bpe.vocabulary(token_counts.PIECE_BPE)),
    "pii": pii.personal_data,
    "lm": lambda d: lm.lm_scores(d.withColumn("train", F.lit(True))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_empty_tables_and_repeated_rows(spark, name):
    f = OPERATORS[name]
    rows = [(None, "a b c", None, None, None), (1, None, "en", "s", 1), (1, None, "en", "s", 1), (2, "", None, "s", 0), (3, "x " * 3000, "en", None, 2)]
    odd = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("id", F.lit("x"))
    odd = odd.drop("id") if name == "near" else odd
    assert len(f(odd).collect()) == 5
    assert f(odd.where("false")).count() == 0


def test_line_dedup_is_brute_force(spark, texts):
    got = {r.doc_id: (r._n_lines, r._n_dropped, r._kept) for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    keys = [[line_dedup.line_key(x) for x in (t or "").split("\n")] for t in texts]
    seen = Counter(k for ks in keys for k in set(ks) if k)
    for i, t in enumerate(texts):
        kept = [x for x, k in zip((t or "").split("\n"), keys[i]) if seen[k] < 10]
        assert got[i] == (len(keys[i]), len(keys[i]) - len(kept), "\n".join(kept))


def test_near_duplicates_are_brute_force(spark, texts):
    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    part = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                lo, hi = sorted((part[i], part[j]))
                part = [lo if p == hi else p for p in part]
    got = {r.id: (r.n_shingles, r.component) for r in near_dup.near_components(docs_of(spark, texts)).collect()}
    assert got == {i: (len(s), part[i]) for i, s in enumerate(sets)}


def common_hash(x):
    return (x * 0x9E3779B97F4A7C15 % (1 << 64)) >> 8


def test_prefix_bounds_lose_no_pair(spark):
    rng = random.Random(1)
    base = list(range(100))
    sets = [sorted(set(base[rng.randint(0, 9) :]) - set(rng.sample(base, rng.randint(0, 12))) | {1000 + 20 * i + k for k in range(rng.randint(0, 8))}) for i in range(40)]
    hashed = [[common_hash(x) for x in s] for s in sets]
    df = spark.createDataFrame([(i, len(s), i, s, near_dup.signature(np.array(s)).tolist()) for i, s in enumerate(hashed)], "id long, n long, part long, s array<long>, sig array<long>")
    got = {(r.x, r.y) for r in near_dup.sharing_rare(df, 85).collect()}
    true = {(i, j) for j in range(40) for i in range(j) if 100 * len(set(sets[i]) & set(sets[j])) >= 85 * len(set(sets[i]) | set(sets[j]))}
    assert true and true <= got and len(got) < len(sets) * (len(sets) - 1) // 4


def test_mixing_keeps_its_limits(spark, texts):
    m = mixing.mix(docs_of(spark, texts * 8))
    rows = m.collect()
    assert all(0 <= r._taken <= 2 * r._size for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r._taken for r in own) - own[0]._target) <= 3 * mixing.BLOCK_WORDS and own[0]._target <= 2 * own[0]._source_size
    assert sum({r.source: r._target for r in rows}.values()) == pytest.approx(1.5 * sum(r._size for r in rows))
    assert sorted(rows, key=str) == sorted(mixing.mix(docs_of(spark, texts * 8)).collect(), key=str)
    out = mixing.mixed_texts(m, ["doc_id", "text"])
    assert sum(len((r.text or "").split()) for r in out.collect()) == sum(r._taken for r in rows)


def test_apportionment_is_highest_quotients(spark):
    v = [53.0, 24.0, 23.0, 0.0, 7.5]
    df = spark.createDataFrame([(i, x, 37) for i, x in enumerate(v)], "i int, v double, seats long")
    got = {r.i: r.won for r in mixing.apportion(df, "seats", "v", [], ["i"], "won").collect()}
    q = sorted(((-x / (2 * k + 1), i) for i, x in enumerate(v) for k in range(40)))[:37]
    assert got == {i: sum(j == i for _, j in q) for i in range(5)}


def test_bpe_trees_equal_the_library(spark, texts):
    enc = bpe.TreeEncoder(bpe.vocabulary(bpe.WORD_BPE))
    old, bpe.LEAF = bpe.LEAF, 7
    try:
        for t in [*[t or "" for t in texts], "aaaa" * 99, "x<|endoftext|>y é🙂", " \t\n"]:
            ids = enc.lib.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == ids and enc.decode(enc.encode(t)) == enc.lib.decode(ids, skip_special_tokens=False)
    finally:
        bpe.LEAF = old
    d = docs_of(spark, texts).select("doc_id", "text")
    path = bpe.vocabulary(bpe.WORD_BPE)
    assert sorted(bpe.encoded(d, path, row_chars=16).collect()) == sorted(bpe.encoded(d, path).collect())


def test_token_counts_equal_the_library(texts):
    import sentencepiece

    path = bpe.vocabulary(token_counts.PIECE_BPE)
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.RankMerger(path)
    odd = [*[t or "" for t in texts], " " * 77 + "x", "ab1" * 500, "<s> é🙂\x00", "▁▁ a"]
    assert m.counts(odd) == [len(x) for x in sp.encode(odd)]


def test_top_k_is_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(-3, 4, (200, 4))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None)], "id long, v array<double>")
    got = sorted(map(tuple, topk.top_k(df.where("id % 20 = 0"), df, 5, 4, 16).collect()))
    s = v @ v.T
    assert got == sorted((q, r + 1, c, int(s[q, c])) for q in range(0, 200, 20) for r, c in enumerate(sorted((c for c in range(200) if c != q), key=lambda c: (-s[q, c], c))[:5]))


@pytest.mark.parametrize("block", [1, 500, 1 << 20])
def test_lm_is_brute_force(spark, texts, block):
    texts = [*texts, texts[0] + " é\x1cİ " + texts[1], texts[0]]
    d = docs_of(spark, texts).select("doc_id", "text", (F.col("doc_id") % 10 != 0).alias("train"))
    got = lm.lm_scores(d, block_bytes=block, bucket_grams=200).collect()
    toks = [[*(t or "").encode().lower().split(), b""] for t in texts]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for i, t in enumerate(toks):
        if i % 10:
            c1.update(t), c2.update(zip([b"", *t], t)), c3.update(zip([b"", *t], t, t[1:]))
    n, v = sum(c1.values()), len(c1)
    uni = lambda w: (c1[w] + 0.1) / (n + 0.1 * (v + 1))
    bi = lambda h, w: (c2[h, w] + (1 + c1[h]) * uni(w)) / (1 + 2 * c1[h])
    tri = lambda g, h, w: (c3[g, h, w] + (1 + c2[g, h]) * bi(h, w)) / (1 + 2 * c2[g, h])
    assert len(got) == len(texts)
    for r in got:
        t = toks[r.doc_id]
        assert (r._n_tokens, r._n_known, r._train_tokens) == (len(t), sum(c1[w] > 0 for w in t), n)
        assert r._base_score == pytest.approx(sum(np.log10(uni(w)) for w in t))
        want = np.log10(bi(b"", t[0])) + sum(np.log10(tri(g, h, w)) for g, h, w in zip([b"", *t], t, t[1:]))
        assert r._score == pytest.approx(want)


def test_lm_frees_the_shuffle_files_of_each_round(spark, texts, monkeypatch):
    key, at, wrote, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark.conf, set(), []
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    d = docs_of(spark, texts).select("doc_id", "text", F.lit(True).alias("train"))
    plain = type(d).checkpoint

    def left():
        end = time.monotonic() + 10
        while (n := len(files() & wrote)) and time.monotonic() < end:
            time.sleep(0.1)
        return n

    def checkpoint(df):
        seen.append(left())  # of the rounds before
        before = files()
        out = plain(df)
        wrote.update(files() - before)
        return out

    monkeypatch.setattr(type(d), "checkpoint", checkpoint)
    was = at.get(key, None)
    out = lm.lm_scores(d, block_bytes=500, bucket_grams=200)
    assert [*seen, left()] == [0] * 4 and at.get(key, None) == was
    assert out.count() == len(texts)


def test_words_of_equal_hash_keep_apart(monkeypatch):
    monkeypatch.setattr(lm.xxhash, "xxh64_intdigest", lambda w: 7)
    b = lm.Block(lm.packed_texts(["a b a", "c"], [True, False]))
    assert dict(zip(b.words, b.word_counts.tolist())) == {b"": 1, b"a": 2, b"b": 1, b"c": 0}
    t = lm.pa.table({"block": [1, 2], "bucket": [0, 0], "kind": [1, 1], "keys": [lm.zlib.compress(b"a b"), lm.zlib.compress(b" b c")], "counts": [lm.packed(np.array(x)) for x in ([2, 1], [1, 0, 5])]})
    got = {r["block"]: lm.unpacked(r["counts"]).tolist() for r in lm._told(t).to_pylist()}
    assert got == {1: [2, 1], 2: [1, 1, 5], -1: [4, 9]}


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_fixed_forms_and_bootstrapping(spark):
    rng = random.Random(2)
    bits = ["a", "@", ".com", "1", "23", ".", "-", " ", "+", "(", "\n", "é🙂", "+1 (555) 123-4567", "255.1.2.3", "a@b.co"]
    t = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(150)]
    for i, r in enumerate(pii.personal_data(docs_of(spark, t)).orderBy("doc_id").collect()):
        for k, p in FORMS.items():
            ok = lambda s, k=k: k == "email" or (all(int(x) <= 255 for x in s.split(".")) if k == "ip" else 8 <= len(re.sub(r"\D", "", s)) <= 15)
            assert [(x.start, x.end) for x in r._base if x.kind == k] == [m.span() for m in re.finditer(p, t[i]) if ok(m[0])]
    t = [f"so phone: +1 (9{i:02d}) 555-{1000 + i} it is" for i in range(20)] + ["xx phone: (212) 555-3001 yy the 445566712 z", "see 212 555 3001"]
    got = [[tuple(x)[:3] for x in r._spans] for r in pii.personal_data(docs_of(spark, t)).orderBy("doc_id").collect()]
    assert got[20] == [("phone", 10, 24)] and got[21] == [("phone", 4, 16)]


def test_toxicity_on_held_out(spark):
    rng = random.Random(4)
    t = [" ".join(rng.choices(WORDS, k=30) + (["Scum!", "moron,"] if i % 4 == 0 else [])) for i in range(400)]
    d = docs_of(spark, t)
    model = toxicity.fitted(d.where("doc_id < 300").select(F.col("doc_id").alias("id"), "text"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "id long, y int"))
    got = {r.doc_id: r._score for r in toxicity.scored(d.select("doc_id", "text"), model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400))


def test_pipeline_stages_keep_the_columns(spark, texts):
    import corpus_pipeline as c

    d = docs_of(spark, [(t or "") + " " + " ".join(WORDS) + f" tail{i}" + " ".join(f"w{i}x{k}" for k in range(40)) for i, t in enumerate(texts)])
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns and out.count() > 0, name
        d = common.written(out)
    out = c.STAGES[-1][1](spark, d, "")
    enc = bpe.TreeEncoder(bpe.vocabulary(bpe.WORD_BPE))
    want = sorted((r.doc_id, hashlib.sha256(np.array(enc.lib.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in d.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in out.collect()) == want


def test_an_idle_worker_lets_go(monkeypatch):
    monkeypatch.setattr(common, "REST", 0.4)
    made = []

    def make(x):
        made.append(x)
        return [x]

    assert common.kept_by_worker(make, 1) is common.kept_by_worker(make, 1) and made == [1]
    for _ in range(4):
        time.sleep(0.2)
        common.kept_by_worker(make, 1)
    assert made == [1]  # it has not rested
    time.sleep(1.0)
    common.kept_by_worker(make, 1)
    assert made == [1, 1]


def test_near_duplicates_at_eighty_percent_go_from_the_pipeline(spark):
    import corpus_pipeline as c

    words = [f"w{i}" for i in range(14)]
    near = docs_of(spark, [" ".join(words), " ".join([*words[:-1], "other"])])  # 10 shingles each, 9 of them common: 9 / 11
    assert [r.doc_id for r in c.drop_near_duplicates(spark, near, "").collect()] == [0]
    assert {r.component for r in near_dup.near_components(near).collect()} == {0}
    assert {r.component for r in near_dup.near_components(near, percent=85).collect()} == {0, 1}
    for percent in (70, 80, 85, 90):
        assert 2 * (1 - (percent / 100) ** near_dup.ROWS) ** near_dup.halves_for(percent) <= 2e-5
    assert near_dup.halves_for(85) == 9 and near_dup.halves_for(80) == 12


def test_bpe_keeps_control_characters():
    enc = bpe.TreeEncoder(bpe.vocabulary(bpe.WORD_BPE))
    for t in ["a\x1cb", "a\x1cb é", "\x1d", "x \x1e\x1f y\x1c", "a\tb\x0bc\x0cd\re\nf"]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_patterns_come_from_discovered_instances(spark):
    t = [f"so phone: +1 (9{i:02d}) 555-{1000 + i} it is" for i in range(20)]
    number = lambda g, k: f"(212) 555-{3000 + 10 * g + k}"
    t += [f"xx phone: {number(0, k)} yy" for k in range(5)]
    for g, w in enumerate("dial ring call page buzz".split()):  # no fixed form follows these words
        t += [f"{w} {number(g, k)} yy" for k in range(5) for _ in range(3)] + [f"{w} {number(g + 1, k)} yy" for k in range(5)]
    t += [f"host 10.0.0.{i} up" for i in range(20)] + ["host 9. 8.7.6 up", "212 555 3000 begins a text"]
    got = [[tuple(x)[:3] for x in r._spans] for r in pii.personal_data(docs_of(spark, t)).orderBy("doc_id").collect()]
    assert all(len(x) == 1 for x in got), [(a, b) for a, b in zip(t, got) if len(b) != 1]
    assert got[-2:] == [[("ip", 5, 13)], [("phone", 0, 12)]]


def test_a_repeated_id_counts_once_for_a_line(spark):
    rows = [(1, "one id\nx", "en", "s", 0)] * 12 + [(100 + i, f"many ids\ny{i}", "en", "s", 0) for i in range(10)] + [(None, "no id", "en", "s", 0)] * 12
    got = {(r.doc_id, r._kept) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, "one id\nx"), (None, "no id")} | {(100 + i, f"y{i}") for i in range(10)}
