"""Edge cases that every operator and stage shares, the registered queries' columns, and their SQL."""

import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.llm import bpe, common, line_dedup, lm, mixing, near_dup, pii, quality, registry, token_counts, topk, toxicity

#: Names that operators use inside or give to their results, and others that are awkward.
CLASHING = "target source_size _key _flags _made _base _kept _n _n_words _size _h _w _id _sum c0 c1 id key block part row rid _rid _score n_tokens ids_sha256 component a.b q`t".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 200_000 + "end"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, "a b c\nA B C", None, None, None), (1, None, "en", "s", 1), (1, None, "en", "s", 1), (2, "", None, "s", 0), (3, "x " * 60, "en", None, 2), (4, "x " * 60, "en", "s", 2), (4, "x " * 60, "en", "s", 2), (5, " \t\n", "en", "s", 2), (6, LONG, "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).cache()


def _model():
    return toxicity.FactorizationMachine.fit([np.array([1, 2]), np.array([3])] * 5, np.array([1, 0] * 5))


OPERATORS = {
    "lines": (line_dedup.dedup_lines, {"_n_lines", "_n_dropped", "_kept"}, ()),
    "quality": (quality.apply_quality, {*quality.MEASURES, "_base_failed", "_kept"}, ()),
    "mix": (mixing.mix, {"_size", "_source_size", "_target", "_taken", "_passes", "_start", "_m", "_nb", "_off"}, ()),
    "bpe": (lambda d: bpe.encoded(d, bpe.vocabulary(bpe.WORD_BPE)), {"_n", "_ids_sum", "_text_sum"}, ("text",)),
    "count": (lambda d: token_counts.token_counts(d, bpe.vocabulary(token_counts.PIECE_BPE)), {"_n_bytes", "_n_tokens", "_over_limit"}, ("text",)),
    "pii": (pii.personal_data, {"_base", "_spans"}, ("text",)),
    "lm": (lambda d: lm.lm_scores(d.withColumn("train", F.lit(True))), {"_n_tokens", "_n_known", "_train_tokens", "_base_score", "_score"}, ("text", "train")),
    "toxicity": (lambda d: toxicity.scored(d, _model()), {"_score"}, ("text",)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, odd, name):
    f, made, gone = OPERATORS[name]
    out = f(odd)
    assert set(out.columns) == (set(odd.columns) | made) - set(gone)
    rows = out.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())
    kept = [c for c in CLASHING if c not in made]
    assert all([r[c] for c in kept] == [CLASHING.index(c) for c in kept] for r in rows)  # a caller's columns pass through
    by = {}
    for r in rows:  # repeated rows have the same results
        by.setdefault(r["doc_id"], []).append([r[c] for c in sorted(made) if c not in ("_start", "_taken")])
    assert by[1][0] == by[1][1] and by[4][0] == by[4][1]
    assert f(odd.where("false")).count() == 0


def test_values_of_odd_rows(odd):
    at = lambda df, *c: {r.doc_id: tuple(r[x] for x in c) for r in df.collect()}
    q = at(quality.apply_quality(odd), "_n_words", "_word_chars", "_n_dup_lines", "_n_repeat_words", "_base_failed")
    assert q[None] == (6, 6, 0, 0, True) and q[1] == q[2] == q[5] == (0, 0, 0, 0, True) and q[3] == (60, 60, 0, 60, True) and q[6] == (200_001, 800_003, 0, 200_000, True)
    lines = at(line_dedup.dedup_lines(odd), "_n_lines", "_n_dropped", "_kept")
    assert lines[None] == (2, 0, "a b c\nA B C") and lines[1] == lines[2] == (1, 0, "") and lines[5] == (2, 0, " \t\n") and lines[6] == (1, 0, LONG)
    ids = lambda x: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
    lib = bpe.TreeEncoder(bpe.vocabulary(bpe.WORD_BPE)).lib
    enc = at(bpe.encoded(odd, bpe.vocabulary(bpe.WORD_BPE)), "_n", "_ids_sum")
    assert enc[1] == enc[2] == enc[5] == (0, ids([])) and enc[6] == (200_001, ids(lib.encode(LONG, add_special_tokens=False).ids))
    assert at(mixing.mix(odd), "_size")[6] == (200_001,) and at(mixing.mix(odd), "_size", "_taken")[1] == (0, 0)
    scores = at(lm.lm_scores(odd.withColumn("train", F.lit(True))), "_n_tokens", "_n_known")
    assert scores[1] == scores[2] == scores[5] == (1, 1) and scores[6] == (200_002, 200_002)
    assert {len(x) for x in at(pii.personal_data(odd), "_base").values() for x in x} == {0}


def test_near_duplicates_of_odd_rows(odd):
    got = {(r.id, r.n_shingles, r.component) for r in near_dup.near_components(odd).collect()}
    assert got == {(None, 2, None), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 2, 6)}
    assert near_dup.near_components(odd.where("false")).count() == 0
    with pytest.raises(TypeError, match="whole-number"):
        near_dup.near_components(odd.withColumn("doc_id", F.lit("x")))


def test_top_k_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [3.0, 0.0], 1), (1, [1.0, 1.0], 1), (1, [0.0, -1.0], 1), (2, None, 1), (None, [9.0, 9.0], 1), (3, [float("nan"), 1.0], 1), (4, [1.0, None], 1), (5, [1.0], 1), (6, [], 1), (20, [1.0, 1.0], 1), (7, [float("inf"), 0.0], 1)]
    df = spark.createDataFrame(rows, "id long, e array<double>, rank int")
    v = df.select("id", topk.whole_components(F.col("e")).alias("v"), "rank")
    got = [tuple(r) for r in topk.top_k(v.where("id % 20 = 0"), v, 3).orderBy("query_id", "rank").collect()]
    s = 64 * 64
    assert got == [(0, 1, 1, 3 * s), (0, 2, 1, 3 * s), (0, 3, 20, 3 * s), (20, 1, 0, 3 * s), (20, 2, 0, 3 * s), (20, 3, 1, 2 * s)]
    assert topk.top_k(v.where("false"), v.where("false"), 3).count() == 0
    tiny = spark.createDataFrame([([-1e-20, 1e-20, -0.5, 1e300, -1 / 64, -1.00001 / 64],)], "e array<double>")
    assert tiny.select(topk.whole_components(F.col("e"))).first()[0] == [-1.0, 0.0, -32.0, 64e300, -1.0, -2.0]


def test_pipeline_stages_of_odd_rows(spark, odd):
    import corpus_pipeline as c

    plain = odd.drop("n_tokens", "ids_sha256")
    for name, stage in c.STAGES:
        out = stage(spark, plain, "")
        assert stage(spark, plain.where("false"), "").count() == 0, name
        if name != c.STAGES[-1][0]:
            assert out.columns == plain.columns, name
        kept = [x for x in CLASHING if x in plain.columns]
        assert all([r[x] for x in kept] == [CLASHING.index(x) for x in kept] for r in out.collect()), name
    ids = lambda s: sorted(str(r.doc_id) for r in dict(c.STAGES)[s](spark, odd, "").collect())
    assert ids("quality") == [] and ids("line_dedup") == sorted(str(r.doc_id) for r in odd.collect())
    assert ids("near_dup") == ["1", "2", "3", "5", "6", "None"]


RESULTS = {
    "op1_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op2_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op6_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op7_near_dup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
}


@pytest.fixture(scope="module")
def tables(spark, odd, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", registry.QUERIES)
def test_registered_queries_have_the_contracts_columns(spark, tables, name):
    df = registry.QUERIES[name](spark, tables)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == RESULTS[name]
    assert df.count() == (1 if name == "op6_topk" else 9)


DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", registry.ORACLES)
def test_registered_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    df = registry.QUERIES[name](spark, DIR)
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, want.fetchall()))


# ---- results that SQL does not express, by brute force ----
def _documents(spark):
    return [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_mixing_query_is_brute_force(spark):
    docs = _documents(spark)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in docs}
    of: dict = {}
    for i, _, s in docs:
        of[s] = of.get(s, 0) + size[i]
    order = sorted(of, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(of.values())
    while open_:  # what is above its limit stops there, the excess is shared again
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > 2 * of[s]}
        for s in over or open_:
            target[s] = 2 * of[s] if over else rate * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    got = registry.QUERIES["op4_mixing"](spark, DIR).collect()
    src = {i: s for i, _, s in docs}
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], of[src[r.doc_id]]) and r.target == pytest.approx(target[src[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
        taken[src[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 3 * mixing.BLOCK_WORDS for s in order)
    assert sorted(got) == sorted(registry.QUERIES["op4_mixing"](spark, DIR).collect())


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _holds(kind, s):
    d = re.sub("[^0-9]", "", s)
    luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_personal_data_query_is_brute_force(spark):
    text = {i: t for i, t, _ in _documents(spark)}
    found = 0
    for r in registry.QUERIES["op5_pii"](spark, DIR).collect():
        spans = {k: [m.span() for m in re.finditer(p, text[r.doc_id]) if _holds(k, m[0])] for k, p in FORMS.items()}
        found += sum(map(len, spans.values()))
        assert [len(spans[k]) for k in FORMS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        base = [f"{k}:{a}:{b}" for k in FORMS for a, b in spans[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(",") if r.spans else [])
    assert found


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_token_queries_equal_the_libraries(spark):
    import sentencepiece

    text = {i: t for i, t, _ in _documents(spark)}
    sp = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary(token_counts.PIECE_BPE))
    for r in registry.QUERIES["op10_token_counts"](spark, DIR).collect():
        n = len(sp.encode(text[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 4096)
    lib = bpe.TreeEncoder(bpe.vocabulary(bpe.WORD_BPE)).lib
    for r in registry.QUERIES["op9_bpe"](spark, DIR).collect():
        ids = lib.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_long_runs_are_joined_by_windows():
    enc = bpe.TreeEncoder(bpe.vocabulary(bpe.WORD_BPE))
    rng = np.random.default_rng(0)
    t = "".join(rng.choice(["the", "ing", "er", "zq", "'s", "!", "é", "0"], 120_000))
    want = np.array(enc.lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert enc.encode(t) == want and enc.work <= 1.2 * len(t)
    assert bpe.Piece.whole(enc, [bpe.Piece.of(enc, t[i : i + 7777]) for i in range(0, len(t), 7777)]) == want


def test_a_long_run_is_split_over_rows(spark):
    enc = bpe.TreeEncoder(bpe.vocabulary(bpe.WORD_BPE))
    t = "".join(np.random.default_rng(1).choice(["the", "ing", "er", "zq", " ", "x"], 60_000, p=[0.2, 0.2, 0.2, 0.2, 0.0001, 0.1999]))
    d = spark.createDataFrame([(1, t), (2, t), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: bytes(r._ids) for r in bpe.encoded(d, bpe.vocabulary(bpe.WORD_BPE), with_text=True, row_chars=10_000).collect()}
    ids = lambda x: np.array(enc.lib.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    assert got == {1: ids(t), 2: ids(t), 3: ids("short")}


def test_encodings_of_all_low_code_points_equal_the_library():
    enc = bpe.TreeEncoder(bpe.vocabulary(bpe.WORD_BPE))
    rng = np.random.default_rng(2)
    alphabet = [*map(chr, range(128)), "<|endoftext|>", "é", "́", " ", "　", "Σ", "🙂"]
    for _ in range(300):
        t = "".join(rng.choice(alphabet, int(rng.integers(1, 60))))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_sketches_keep_their_rank_error(spark):
    n = 60_000  # far more than a sketch holds
    df = spark.range(n).select(F.lit("en").alias("lang"), F.lit("s").alias("source"), (F.col("id") * 7919 % n).alias("_word_chars"), F.lit(1).cast("long").alias("_n_words"), F.lit(0).cast("long").alias("_n_symbols"), F.lit(1).cast("long").alias("_n_lines"), F.lit(0).cast("long").alias("_n_dup_lines"), F.lit(0).cast("long").alias("_n_repeat_words"), F.lit(False).alias("_base_failed"))
    r = quality.thresholds(df.repartition(7)).first()  # rates 0, 1000, ..., 1000 (n - 1): a rank of x is x / 1000 n
    for got, want in ((r._top_len, 0.75 + 3 * 0.5), (r._low_len, 0.25 - 3 * 0.5)):
        assert got / 1000 / n == pytest.approx(want, abs=0.02)
    assert r._top_sym == 0


def test_a_pair_of_terms_tells_what_neither_tells_alone():
    rng = np.random.default_rng(5)
    docs, y = [], []
    for _ in range(1200):  # the insult and the group are as frequent in both classes; only together do they tell
        a, b = rng.random() < 0.5, rng.random() < 0.5
        docs.append(np.array([x for x, there in ((1, a), (2, b)) if there] + [int(k) for k in rng.integers(10, 40, 4)]))
        y.append(int(a == b))
    m = toxicity.FactorizationMachine.fit([np.unique(d) for d in docs], np.array(y))
    place = {int(h): i for i, h in enumerate(m.ids)}
    s = m.score([np.array([place[x] for x in d if x in place], int) for d in ([1, 2, 10], [1, 10], [2, 10])])
    assert s[0] > max(s[1], s[2])


def test_no_temporary_checkpoint_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))})

    session = type("Session", (), {"sparkContext": Context, "conf": type("C", (), {"get": staticmethod(lambda k, d=None: None)})})
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        common.checkpoint_dir(session)


def test_pairs_at_the_threshold_are_found(spark):
    """Recall: 400 pairs of 80 to 85 percent, none of which another pair helps to link, and 400 below."""
    rng = np.random.default_rng(11)
    rows, pairs = [], []
    for i in range(800):
        words = [f"w{i}x{k}" for k in range(64)]
        other = list(words)
        k = (58 if i < 400 else 56) + int(rng.integers(0, 2))  # words before the first changed one; k - 4 of 60 shingles are common
        other[k:] = [f"v{i}x{j}" for j in range(64 - k)]
        near = near_dup.Shingler().set_of(" ".join(words)), near_dup.Shingler().set_of(" ".join(other))
        common_ = len(np.intersect1d(*near))
        pairs.append(100 * common_ >= 80 * (len(near[0]) + len(near[1]) - common_))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = {r.id: r.component for r in near_dup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 300 < sum(pairs) < 500
    assert [got[2 * i + 1] == 2 * i for i in range(800)] == pairs


def test_a_document_of_many_pairs_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SPLIT", 3)
    sets = spark.createDataFrame([(i, list(range(i, 20))) for i in range(12)], "id long, s array<long>")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 12)] + [(3, 2)], "x long, y long")
    got = sorted(tuple(r) for r in near_dup.confirmed(pairs, sets).collect())
    assert got == sorted([(i, 0, 20 - i, 20) for i in range(1, 12)] + [(3, 2, 17, 18)])
