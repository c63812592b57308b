"""Personal data: fixed forms, and bootstrapped extraction from lexical contexts.

The fixed forms (email, ip, card, phone) give spans in every text and are the seeds. Patterns are what stands next to
an instance: the word before it, the two words before it, the word after it, the two words after it. Candidates
are strings of similar make that no fixed form covers. On the graph of patterns and instances a pattern's score is
the share of its occurrences in the whole corpus that an instance stands next to, each instance counted with its
confidence; an instance's confidence is that the best pattern on its left and the best on its right are not both
wrong. Scores and confidences feed one another until nothing changes: what a pattern discovers is an instance
wherever else it stands, and so raises the patterns there, seeded or not. Only patterns with many different
instances and a high score discover anything. Confidences only rise, in whole steps of 1 / STEPS, so the rounds end.

Matches are exploded to rows: a running sum of lengths gives their places and one sweep in order of places tells
which candidates a fixed form covers, so the work grows with a text's length and not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.llm.common import WORD, WS, Aside, ascii_lower, cut, sized_join, table, words_of

#: The four forms. In Java's terms, so that no text takes more than linear time: a match begins
#: where the run it begins with does, or where the last match ended, and what can't be given back is not tried.
LOCAL = "A-Za-z0-9._%+-"
FORMS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(FORMS)
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: What may be an instance, with the kinds that it may be.
CANDIDATES = {
    "number": (r"[+(]?[0-9](?:[\x20().-]{0,2}+[0-9])++", ("ip", "card", "phone")),
    "address": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++(?:\x20?(?:@|\[at\]|\(at\))\x20?)[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)*+", ("email",)),
}
DIGITS = {"ip": (4, 12), "card": (12, 19), "phone": (7, 15)}
MIN_SUPPORT, MIN_SCORE, MIN_CONFIDENCE, STEPS = 5, 0.5, 0.5, 10_000
#: One or two words at the end and at the beginning of a piece of text.
LAST_WORDS = rf"(?<![^{WS}])[^{WS}]++(?:[{WS}]++[^{WS}]++)?[{WS}]*+\z"
FIRST_WORDS = rf"\A[{WS}]*+[^{WS}]++(?:[{WS}]++[^{WS}]++)?"


def _hint(kind: str, text: Column) -> Column:
    """Whether a text can hold the form at all."""
    return {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"(?:[0-9][\x20-]?){16}")}[kind]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(F.transform(value, lambda v: F.when(v > 9, v - 9).otherwise(v)), F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    d = _digits(s)
    n = F.length(d)
    return {
        "email": F.lit(True),
        "ip": s.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": F.when(n.between(16, 19), _luhn(d)).otherwise(False),
        "phone": n.between(8, 15),
    }[kind]


def _contexts(before: Column, after: Column) -> Column:
    """The patterns around an instance: < and the one or two words before it, > and those after it, A-Z in lower case."""
    words = lambda piece, which: F.regexp_extract_all(F.regexp_extract(ascii_lower(piece), which, 0), F.lit(WORD), F.lit(0))
    l, r = words(before, LAST_WORDS), words(after, FIRST_WORDS)
    one = lambda mark, w, i: F.concat(F.lit(mark), F.try_element_at(w, F.lit(i)))
    two = lambda mark, w: F.when(F.size(w) == 2, F.concat(F.lit(mark), F.concat_ws(" ", w)))
    return F.array_compact(F.array(one("<", l, -1), two("<", l), one(">", r, 1), two(">", r)))


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches in order: kind, characters between the last match and this one, its own, what stands next to it, itself.

    Splitting by the pattern gives the pieces between matches; context is of these, so each character of a text is
    looked at a few times, however many matches there are.
    """
    pieces = F.split(text, pattern, -1)
    hits, after = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    rows = F.zip_with(F.zip_with(hits, pieces, lambda h, b: F.struct(h.alias("h"), b.alias("b"))), after, lambda x, a: F.struct(x["h"].alias("h"), x["b"].alias("b"), a.alias("a")))
    made = lambda x: F.struct(F.lit(kind).alias("kind"), F.char_length(x["b"]).alias("gap"), F.char_length(x["h"]).alias("n"), _contexts(x["b"], x["a"]).alias("w"), x["h"].alias("s"))
    return F.transform(F.filter(rows, lambda x: x["h"].isNotNull()), made)


def _norm(s: Column, kind: Column) -> Column:
    """An ip's dots tell it from others of the same digits."""
    return F.when(s.contains("@") | s.contains("at"), ascii_lower(s)).when(kind == "ip", F.regexp_replace(s, "[^0-9.]", "")).otherwise(_digits(s))


MATCHES = "array<struct<kind:string,gap:int,n:int,w:array<string>,s:string>>"


def found(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `_matches`: all matches of the fixed forms and of the candidates, whether they hold or not."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hints = {k: _hint(k, text) for k in KINDS} | {"number": text.rlike(r"(?:[0-9][\x20().-]{0,2}){7}|[0-9][\x20()-]?\.[\x20()-]?[0-9]"), "address": text.rlike(r"@|\[at\]|\(at\)")}
    forms = FORMS | {c: p for c, (p, _) in CANDIDATES.items()}
    return docs.withColumn("_matches", F.concat(*[F.when(hints[k], _matches(text, k, p)).otherwise(F.array().cast(MATCHES)) for k, p in forms.items()]))


def spans_of(matches: DataFrame) -> DataFrame:
    """(_rid, _matches) to a row for each span of a fixed form (base) and each candidate that none of them covers."""
    rows = matches.select("_rid", F.posexplode("_matches").alias("pos", "m")).select("_rid", "pos", "m.*")
    along = Window.partitionBy("_rid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("n")).over(along)).withColumn("start", F.col("end") - F.col("n"))
    base = F.col("kind").isin(*KINDS)
    holds = F.lit(False)
    for k in KINDS:
        holds = F.when(F.col("kind") == k, _valid(k, F.col("s"))).otherwise(holds)
    rows = rows.withColumn("base", base).where(F.when(base, holds).otherwise(F.size(_kinds_of(F.col("kind"), F.col("s"))) > 0))
    order = Window.partitionBy("_rid").orderBy("start", F.col("base").desc(), "kind")
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("_rid").orderBy(F.col("start").desc(), "base", F.col("kind").desc())  # a frame that grows; one that shrinks is summed anew for each row
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("free", (F.coalesce(ended, F.lit(0)) <= F.col("start")) & (begins.isNull() | (begins >= F.col("end"))))
    return rows.where("base or free").select("_rid", "kind", "start", "end", "s", "w", "base")


def _kinds_of(made: Column, s: Column) -> Column:
    n = F.length(_digits(s))
    dots = F.size(F.split(s, r"\.", -1)) == 4
    return F.when(made == "address", F.array(F.lit("email"))).otherwise(F.array_compact(F.array(*[F.when(n.between(*DIGITS[k]) & (dots if k == "ip" else F.lit(True)), F.lit(k)) for k in ("ip", "card", "phone")])))


def discovered(spans: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame | None:
    """(_rid, kind, start, end) of candidates that high-confidence patterns discover; None if there can be none."""
    seeds = spans.where("base").select("kind", "w", _norm(F.col("s"), F.col("kind")).alias("s"))
    rest = spans.where("not base").select("_rid", "start", "end", "w", "s", F.explode(_kinds_of(F.col("kind"), F.col("s"))).alias("kind"))
    rest = cut(rest.withColumn("s", _norm(F.col("s"), F.col("kind"))))
    if rest.isEmpty():
        return None
    around = rest.select(F.explode("w").alias("w")).distinct()
    edges = seeds.select("kind", "s", F.explode("w").alias("w")).join(around, "w", "left_semi").select("kind", "w", "s").unionByName(rest.select("kind", "s", F.explode("w").alias("w")))
    edges = cut(edges.groupBy("kind", "w", "s").agg(F.count("*").alias("n")))
    sure = seeds.select("kind", "s").distinct().withColumn("c", F.lit(1.0))
    conf = cut(edges.select("kind", "s").unionByName(rest.select("kind", "s")).distinct().join(sure, ["kind", "s"], "left").fillna(0.0, ["c"]))
    # a pattern's occurrences in the corpus: one or two words in a row anywhere, few of them are patterns
    may = cut(edges.groupBy("kind", "w").agg(F.count("*").alias("k")).where(f"k >= {MIN_SUPPORT}").select(F.expr("substring(w, 2)").alias("g")).distinct())
    moved = not may.isEmpty()
    if moved:
        words = docs.select(words_of(ascii_lower(F.col(text_col))).alias("w"))
        pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        grams = words.select(F.explode("w").alias("g")).unionByName(words.select(F.explode(pairs).alias("g")))
        total = cut(sized_join(grams, may, ["g"], "left_semi").groupBy("g").agg(F.count("*").alias("total")))
        stood = edges.groupBy("w").agg(F.sum("n").alias("stood"))
        edges = edges.withColumn("g", F.expr("substring(w, 2)")).join(may, "g", "left_semi").join(total, "g", "left").join(stood, "w")
        # a word that a match cuts off is no word of the text, so it may have stood there more often
        edges = cut(edges.select("kind", "w", "s", "n", F.greatest(F.coalesce("total", F.lit(0)), "stood").alias("total"), (F.substring("w", 1, 1) == "<").alias("left")))
    while moved:
        e = edges.join(conf, ["kind", "s"])
        score = e.groupBy("kind", "w", "total").agg(F.sum(F.col("c") * F.col("n")).alias("hits"), F.count(F.when(F.col("c") >= MIN_CONFIDENCE, 1)).alias("support"))
        score = score.withColumn("p", F.least(F.col("hits") / F.col("total"), F.lit(1.0))).where(f"support >= {MIN_SUPPORT} and p >= {MIN_SCORE}")
        # patterns of one side are not independent of one another, so the best of each counts
        best = lambda side: 1 - F.coalesce(F.max(F.when(F.col("left") == side, F.col("p"))), F.lit(0.0))
        wrong = e.join(score.select("kind", "w", "p"), ["kind", "w"]).groupBy("kind", "s").agg((best(True) * best(False)).alias("wrong"))
        told = wrong.select("kind", "s", (F.floor((1 - F.col("wrong")) * STEPS + 1e-6) / STEPS).alias("told"))
        new = cut(conf.join(told, ["kind", "s"], "left").select("kind", "s", F.col("c").alias("old"), F.greatest("c", "told").alias("c")))
        moved = not new.where("c > old").isEmpty()
        conf = new.select("kind", "s", "c")
    best = conf.where(F.col("c") >= MIN_CONFIDENCE).groupBy("s").agg(F.max(F.struct("c", "kind")).alias("b")).select("s", F.col("b.kind").alias("kind"))
    return cut(rest.join(best, ["s", "kind"], "left_semi").select("_rid", "kind", "start", "end").distinct())


def _joined(spans: Column) -> Column:
    """kind:start:end of spans, which are in order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without their text, with `_base` (spans of the fixed forms) and `_spans` (those and what patterns discover).

    A span is its kind, start and end, in code points from 0, the end excluded; spans are in order of kinds as listed,
    then of places. Null texts are empty and have no spans. Repeated rows have the same spans; they count again for a
    pattern's score. An empty table gives an empty table. A column of docs with an output's name is replaced.
    """
    all_of = Aside(docs)
    text = all_of.of(text_col)
    own = cut(found(all_of.df.withColumn("_rid", F.monotonically_increasing_id()), text).drop(text))  # an id of its own for each row
    spans = cut(spans_of(own.select("_rid", "_matches")))
    more = discovered(spans, all_of.df, text)
    rows = spans.where("base").select("_rid", "kind", "start", "end", "base")
    if more is not None:
        rows = rows.unionByName(more.withColumn("base", F.lit(False)))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    per_row = rows.groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct(order[F.col("kind")].alias("o"), "start", "end", "kind", "base"))).alias("_all"))
    out = own.drop("_matches").join(per_row, "_rid", "left")
    plain = lambda a: F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    made = {"_base": F.coalesce(plain(F.filter("_all", lambda x: x["base"])), none), "_spans": F.coalesce(plain(F.col("_all")), none)}
    return all_of.back(out, made, (text_col,))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a hash of the fixed forms' spans, and all spans, of every document."""
    out = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(F.encode(_joined(F.col("_base")), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))
