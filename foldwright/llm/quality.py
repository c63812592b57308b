"""Quality rules with thresholds that adapt to each language and source.

The rates of a document (symbols, repeated lines, words in repeated windows and characters, a thousand units of
their base) go into KLL quantile sketches, one for each metric, language and source. Sketches merge upwards:
sources to languages, languages to the corpus; each is bounded in size whatever it has seen. A rate is an outlier
beyond the fences that its group's sketch gives and the noise that a document of its length has anyway:

    upper fence = q75 + FENCE * max(q75 - q25, q90 - q50), lower fence (length only) the same way from q25 and q10
    noise       = NOISE standard deviations of a count of events with the fence's rate, and one more event;
                  an event is one symbol, line or character, but six words of repeated windows: two windows of three

The second width stands in where quartiles coincide. A group of few documents takes its language's fences, a
language of few the corpus's; else the stricter of a source's own and its language's holds, so that a source full
of junk can't excuse itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import WS, Aside, cut, eq_join, sized_join, table, words_of, written

#: A group's own fences need so many documents; else the next wider sketch serves.
MIN_GROUP = 20
#: Widths that a fence lies beyond the quartile, and standard deviations that a document's count may lie beyond that.
FENCE, NOISE = 3, 3
#: Size of a sketch: exact up to about so many documents, a rank error of about a thousandth beyond (some 50 KB).
SKETCH = 4096
#: Metrics: the count, the base that it is a rate of, and how many of the count one event brings.
METRICS = {"sym": ("_n_symbols", "_n_words", 1), "dup": ("_n_dup_lines", "_n_lines", 1), "rep": ("_n_repeat_words", "_n_words", 6), "len": ("_word_chars", "_n_words", 1)}
MEASURES = ("_n_words", "_word_chars", "_n_symbols", "_n_lines", "_n_dup_lines", "_n_repeat_words")


def _twice(words: Column) -> Column:
    """Places of 3-word windows whose hash another window of the text has: a hash in the high bits, the place in the low ones."""
    n = F.size(words)
    bits = F.ceil(F.log2(n + F.lit(1))).cast("int")
    keyed = F.sort_array(
        F.transform(
            F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
            lambda w, i: F.call_function("shiftleft", F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long")),
        )
    )
    return F.struct(keyed.alias("k"), bits.alias("b"))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the MEASURES and _base_failed, all over the whole text.

    Windows that share a hash are compared as words, so no count rests on a hash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_w", words_of(F.col(text_col))).withColumn("_k", _twice(F.col("_w")))
    hash_at = lambda i: F.call_function("shiftrightunsigned", F.get("_k.k", i), F.col("_k.b"))
    same = lambda i, j: F.coalesce(hash_at(i) == hash_at(j), F.lit(False))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_k.b")) - 1
    maybe = F.transform(F.filter("_k.k", lambda x, i: ((i > 0) & same(i, i - 1)) | same(i, i + 1)), lambda x: x.bitwiseAND(low).cast("int"))
    # words hold no blank, so joined windows are equal only if their words are
    df = df.withColumn("_c", F.sort_array(F.transform(maybe, lambda p: F.struct(F.concat_ws(" ", F.get("_w", p), F.get("_w", p + 1), F.get("_w", p + 2)).alias("g"), p.alias("p")))))
    equal = lambda i, j: F.coalesce(F.get("_c", i)["g"] == F.get("_c", j)["g"], F.lit(False))
    real = F.filter("_c", lambda x, i: ((i > 0) & equal(i, i - 1)) | equal(i, i + 1))
    df = df.withColumn("_p", F.sort_array(F.transform(real, lambda x: x["p"].cast("long"))))
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.when(i == 0, F.lit(3).cast("long")).otherwise(F.least(F.lit(3).cast("long"), p - F.get("_p", i - 1)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    df = df.withColumn("_l", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(rf"[^{WS}]")))
    made = {
        "_n_words": F.size("_w"),
        "_word_chars": F.char_length(F.array_join("_w", "")),
        "_n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "_n_lines": F.size("_l"),
        "_n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "_n_repeat_words": covered,
    }
    df = df.withColumns({k: v.cast("long") for k, v in made.items()}).drop("_w", "_k", "_c", "_p", "_l")
    return df.withColumn("_base_failed", (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words")))


def _rate(metric: str) -> Column:
    """A whole number of thousandths."""
    count, base, _ = METRICS[metric]
    return F.when(F.col(base) > 0, F.expr(f"1000 * {count} div {base}")).otherwise(F.lit(0)).cast("long")


def thresholds(m: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, _top_<metric> and _low_len in thousandths for each language and source of m, a table with MEASURES.

    Documents that fail the base rules are no part of a sketch. Sketches are partial before a shuffle, so a source
    with a third of all rows costs no more than any other; no step holds more than a row for each task and group.
    """
    m = m.withColumnsRenamed({lang_col: "lang", source_col: "source"}).withColumns({k: _rate(k) for k in METRICS})
    own = m.where(~F.col("_base_failed")).groupBy("lang", "source")
    own = cut(own.agg(F.count("*").alias("n"), *[F.kll_sketch_agg_bigint(k, F.lit(SKETCH)).alias(k) for k in METRICS]))
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_bigint(k, F.lit(SKETCH)).alias(k) for k in METRICS]]
    by_lang = cut(own.groupBy("lang").agg(*merged))

    def fences(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
        at = F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)])
        # of no sketch at all, as in an empty table, there are no quantiles
        q = {k: F.kll_sketch_get_quantile_bigint(k, at) for k in METRICS}
        top = lambda x: x[3] + FENCE * F.greatest(x[3] - x[1], x[4] - x[2])
        low = lambda x: x[1] - FENCE * F.greatest(x[3] - x[1], x[2] - x[0])
        out = sketch.where("n > 0").select(*keys, F.col("n").alias(f"{name}_n"), *[q[k].alias(k) for k in METRICS])
        return out.select(*keys, f"{name}_n", *[top(F.col(k)).alias(f"{name}_top_{k}") for k in METRICS], low(F.col("len")).alias(f"{name}_low_len"))

    groups = m.groupBy("lang", "source").agg(F.lit(1)).select("lang", "source")
    out = eq_join(eq_join(groups, fences(own, ["lang", "source"], "own"), ["lang", "source"]), fences(by_lang, ["lang"], "lang"), ["lang"])
    out = out.join(F.broadcast(fences(by_lang.agg(*merged), [], "all")), F.lit(True), "left")  # one row

    def pick(what: str, strict) -> Column:
        return F.when(F.coalesce(F.col("lang_n"), F.lit(0)) < MIN_GROUP, F.col(f"all_{what}")).otherwise(
            F.when(F.coalesce(F.col("own_n"), F.lit(0)) < MIN_GROUP, F.col(f"lang_{what}")).otherwise(strict(F.col(f"own_{what}"), F.col(f"lang_{what}")))
        )

    return out.select("lang", "source", *[pick(f"top_{k}", F.least).alias(f"_top_{k}") for k in METRICS], pick("low_len", F.greatest).alias("_low_len"))


def _within(metric: str, fence: Column, sign: int) -> Column:
    """Whether a count lies within its fence (the rate in thousandths) but for the noise of a count of that size."""
    count, base, event = METRICS[metric]
    count, base = F.col(count).cast("double"), F.col(base).cast("double")
    beyond = sign * (1000 * count - fence * base)
    return (beyond <= 0) | (beyond * beyond <= NOISE * NOISE * 1000 * event * (F.greatest(fence, F.lit(0)) * base + 1000 * event))


def apply_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_text: bool = True) -> DataFrame:
    """docs with the MEASURES, `_base_failed` and `_kept`; without keep_text the text is dropped.

    Texts are measured once: documents and measures are written to the shared checkpoint folder as Parquet, whose
    narrow columns make the sketches. Null or empty texts have no words and fail the base rules. Null languages and
    sources form groups of their own. Repeated rows count again. If no document passes the base rules there is no
    sketch, and none is kept; an empty table gives an empty table. A column of docs with an output's name is
    replaced by the output; all others are kept.
    """
    own = Aside(docs)
    text, lang, source = own.of(text_col), own.of(lang_col), own.of(source_col)
    m = measured(own.df, text)
    m = written(m) if keep_text else cut(m.drop(text))
    tops = thresholds(m.select(lang, source, *MEASURES, "_base_failed"), lang, source).withColumnsRenamed({"lang": lang, "source": source})
    ok = ~F.col("_base_failed")
    for k in METRICS:
        ok = ok & _within(k, F.col(f"_top_{k}"), 1)
    ok = ok & _within("len", F.col("_low_len"), -1)
    out = sized_join(m, tops, [lang, source]).withColumn("_kept", F.coalesce(ok, F.lit(False)))
    return own.back(out, {c: c for c in (*MEASURES, "_base_failed", "_kept")}, () if keep_text else (text_col,))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's measures and verdict of every document."""
    out = apply_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep_text=False)
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


OP2_SQL = r"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
win as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select rid, w, unnest(generate_series(1, len(w) - 2)) as i from d)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from win) where c > 1),
cov as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from rep) group by rid),
m as (select rid, doc_id, lang, source, cast(len(w) as bigint) as n_words,
             cast(length(array_to_string(w, '')) as bigint) as word_chars,
             cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, len(l) as nl,
             cast(coalesce(n, 0) as bigint) as n_repeat_words
      from d left join cov using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
v as (select rid, lang, source, base_failed, unnest(['sym', 'dup', 'rep', 'len']) as metric, unnest([1, 1, 6, 1]) as ev, unnest([n_symbols, n_dup_lines, n_repeat_words, word_chars]) as c, unnest([n_words, nl, n_words, n_words]) as n from b),
r as (select *, case when n > 0 then 1000 * c // n else 0 end as v from v),
o as (select lang, source, metric, count(*) as k, quantile_disc(v, [0.1, 0.25, 0.5, 0.75, 0.9]) as q from r where not base_failed group by all),
g as (select lang, metric, count(*) as k, quantile_disc(v, [0.1, 0.25, 0.5, 0.75, 0.9]) as q from r where not base_failed group by all),
a as (select metric, quantile_disc(v, [0.1, 0.25, 0.5, 0.75, 0.9]) as q from r where not base_failed group by all),
e as (select r.rid, r.metric, ev, cast(r.c as double) as c, cast(r.n as double) as n, coalesce(g.k, 0) as gk, coalesce(o.k, 0) as ok,
             o.q[4] + 3 * greatest(o.q[4] - o.q[2], o.q[5] - o.q[3]) as ot, g.q[4] + 3 * greatest(g.q[4] - g.q[2], g.q[5] - g.q[3]) as gt, a.q[4] + 3 * greatest(a.q[4] - a.q[2], a.q[5] - a.q[3]) as xt,
             o.q[2] - 3 * greatest(o.q[4] - o.q[2], o.q[3] - o.q[1]) as ol, g.q[2] - 3 * greatest(g.q[4] - g.q[2], g.q[3] - g.q[1]) as gl, a.q[2] - 3 * greatest(a.q[4] - a.q[2], a.q[3] - a.q[1]) as xl
      from r left join o on r.lang is not distinct from o.lang and r.source is not distinct from o.source and r.metric = o.metric
             left join g on r.lang is not distinct from g.lang and r.metric = g.metric left join a on r.metric = a.metric),
t as (select *, case when gk < 20 then xt when ok < 20 then gt else least(ot, gt) end as top, case when metric <> 'len' then null when gk < 20 then xl when ok < 20 then gl else greatest(ol, gl) end as low from e),
f as (select rid, bool_and(coalesce((1000 * c <= top * n or pow(1000 * c - top * n, 2) <= 9000 * ev * (greatest(top, 0) * n + 1000 * ev))
                                and (metric <> 'len' or 1000 * c >= low * n or pow(1000 * c - low * n, 2) <= 9000 * ev * (greatest(low, 0) * n + 1000 * ev)), false)) as ok from t group by rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and ok as kept from b join f using (rid)
"""
