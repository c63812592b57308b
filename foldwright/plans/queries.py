"""Registered queries over the driver's tables, and DuckDB SQL that computes the same by other means."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.functions import scalars
from foldwright.operators import decide, encode, estimators, folds, identity, ledger, metrics, reduce, select, space
from foldwright.plans import dag, nested
from foldwright.sources import dataset
from foldwright.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, where driver and executors both reach it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        root = tempfile.mkdtemp(prefix="foldwright-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in cols})


# ---- folds ----
FOLDED = "with f as (select o_orderkey, o_orderstatus, o_orderpriority, cast((row_number() over ({by} order by md5('7:' || cast(o_orderkey as varchar)), o_orderkey) - 1) % 5 as integer) as fold from orders) "


def _orders(spark: SparkSession, d: str, stratify: bool = True) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return folds.assign_folds(o, "o_orderkey", 5, 7, "o_orderstatus" if stratify else None)


@query(FOLDED.format(by="") + "select o_orderkey, fold from f")
def kfold_assign(spark, d):
    return _orders(spark, d, False).select("o_orderkey", "fold")


@query(FOLDED.format(by="partition by o_orderstatus") + "select o_orderkey, fold from f")
def stratified_kfold(spark, d):
    return _orders(spark, d).select("o_orderkey", "fold")


@query(FOLDED.format(by="partition by o_orderstatus") + "select o_orderstatus, fold, count(*) as n from f group by all")
def fold_balance(spark, d):
    return _orders(spark, d).groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"))


@query(FOLDED.format(by="") + "select fold, count(*) as n_assessment, (select count(*) from f) - count(*) as n_analysis from f group by fold")
def outer_analysis_counts(spark, d):
    return folds.analysis_counts(_orders(spark, d, False), 5)


@query(FOLDED.format(by="") + "select o_orderkey, fold, 'cv-k5-stratfalse-seed7#fold' || cast(fold as varchar) as address from f where fold < 2")
def prefix_sample(spark, d):
    s = folds.prefix_sample(_orders(spark, d, False), "in2")
    return s.select("o_orderkey", "fold", scalars.fold_address(scalars.partition_ref(5, False, 7), F.col("fold")).alias("address"))


# ---- encodings ----
ENC = FOLDED.format(by="partition by o_orderstatus") + ", y as (select *, case when o_orderstatus = 'F' then 1.0::double else 0.0::double end as y from f), p as (select avg(y) as prior from y) "


def _encoded_orders(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return o.withColumn("y", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))


@query(
    "with y as (select o_orderkey, o_orderpriority, case when o_orderstatus = 'F' then 1.0::double else 0.0::double end as y from orders), f as (select *, cast((row_number() over (partition by y order by md5('7:' || cast(o_orderkey as varchar)), o_orderkey) - 1) % 5 as integer) as fold from y), "
    "p as (select avg(y) as prior from f), g as (select a.o_orderkey, sum(b.s) as s, sum(b.n) as n from f a join (select o_orderpriority, fold, sum(y) as s, count(*) as n from f group by all) b on a.o_orderpriority = b.o_orderpriority and a.fold <> b.fold group by 1) "
    "select f.o_orderkey, f.fold, round(case when n is null then prior else (s + 10 * prior) / (n + 10) end, 9) as enc from f left join g using (o_orderkey), p"
)
def target_encode_kfold(spark, d):
    e = encode.encode_kfold(_encoded_orders(spark, d), "o_orderpriority", "y", "o_orderkey", 10.0, 5, 7)
    return rounded(e.select("o_orderkey", "fold", "enc"), "enc")


@query(
    "with y as (select o_orderkey, o_orderpriority, case when o_orderstatus = 'F' then 1.0::double else 0.0::double end as y from orders), p as (select avg(y) as prior from y), "
    "w as (select *, sum(y) over (partition by o_orderpriority) as s, count(*) over (partition by o_orderpriority) as n from y) "
    "select o_orderkey, round(case when n <= 1 then prior else (s - y + 10 * prior) / (n - 1 + 10) end, 9) as enc from w, p"
)
def target_encode_loo(spark, d):
    return rounded(encode.encode_loo(_encoded_orders(spark, d), "o_orderpriority", "y").select("o_orderkey", "enc"), "enc")


@query(
    "with y as (select o_orderkey, o_orderpriority, md5('7:' || cast(o_orderkey as varchar)) as h, case when o_orderstatus = 'F' then 1.0::double else 0.0::double end as y from orders), p as (select avg(y) as prior from y), "
    "w as (select *, sum(y) over (partition by o_orderpriority) as s, count(*) over (partition by o_orderpriority) as n, (cast('0x' || h[1:12] as bigint) + 1) / 281474976710657.0::double as u, (cast('0x' || h[13:24] as bigint) + 1) / 281474976710657.0::double as v from y) "
    "select o_orderkey, round(case when n <= 1 then prior else (s - y + 10 * prior) / (n - 1 + 10) end + 0.01::double * sqrt(-2 * ln(u)) * cos(2 * pi() * v), 9) as enc from w, p"
)
def target_encode_loo_noise(spark, d):
    return rounded(encode.encode_loo(_encoded_orders(spark, d), "o_orderpriority", "y", noise=0.01, seed=7, id_col="o_orderkey").select("o_orderkey", "enc"), "enc")


@query(
    "with j as (select d.doc_id, d.source, l.quality from documents d left join labels l using (doc_id)), p as (select avg(cast(quality as double)) as prior from j where quality is not null), g as (select source, sum(quality) as s, count(*) as n from j where quality is not null and source is not null group by 1) "
    "select doc_id, round(case when n is null then prior else (s + 10 * prior) / (n + 10) end, 9) as enc from j left join g using (source), p where quality is null"
)
def target_encode_nonfit(spark, d):
    j = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rounded(encode.encode_nonfit(j, F.col("quality").isNotNull(), "source", "quality").select("doc_id", "enc"), "enc")


# ---- the ledger, from lineitem ----
LEDGER = """with b as (select l_returnflag as family, l_linenumber as ln, cast(l_suppkey % 5 as integer) as fold, case when l_linestatus = 'O' then 'outer' else 'inner' end as level,
  round(cast(sum(cast(round(l_discount * 100) as bigint)) as double) / cast(count(*) * 100 as double), 12) as score, round(cast(sum(cast(round(l_quantity) as bigint)) as double) / cast(count(*) as double), 12) as complexity, count(*) as n from lineitem group by all),
l as (select *, 'family=' || family || ',n=' || cast(ln as varchar) as config_key, case when fold < 3 then 'aaa1' else 'aab2' end as code_fingerprint, case when n % 11 = 0 then 'failed' else 'ok' end as status,
  md5(family || ':' || cast(ln as varchar) || ':' || cast(fold as varchar) || ':' || level) as point_addr from b),
led as (select *, cast(row_number() over (order by point_addr) as integer) as append_ord from l),
st as (select family, ln as ord, avg(score) as mean, coalesce(stddev_samp(score), 0) / sqrt(count(*)) as se, count(*) as n, avg(complexity) as mean_complexity from led where level = 'outer' group by all) """


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_linenumber").alias("ln"), (F.col("l_suppkey") % 5).cast("int").alias("fold"), F.when(F.col("l_linestatus") == "O", "outer").otherwise("inner").alias("level"), "l_discount", "l_quantity")
    b = li.groupBy("family", "ln", "fold", "level").agg(
        F.round(F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double") / (F.count("*") * 100).cast("double"), 12).alias("score"),
        F.round(F.sum(F.round("l_quantity").cast("long")).cast("double") / F.count("*").cast("double"), 12).alias("complexity"),
        F.count("*").alias("n"),
    )
    from pyspark.sql import Window

    led = b.withColumn("code_fingerprint", F.when(F.col("fold") < 3, "aaa1").otherwise("aab2")).withColumn("status", F.when(F.col("n") % 11 == 0, "failed").otherwise("ok"))
    led = led.withColumn("point_addr", F.md5(F.concat_ws(":", "family", F.col("ln").cast("string"), F.col("fold").cast("string"), "level").cast("binary")))
    led = led.withColumn("append_ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("point_addr")))  # a row for each cell
    led = led.withColumn("free_params", F.create_map(F.lit("n"), F.col("ln").cast("string"), F.lit("family"), F.col("family")))
    return led.withColumn("metrics", F.create_map(F.lit("score"), F.col("score"), F.lit("complexity"), F.col("complexity"))).withColumn("config_key", scalars.canonical_map(F.col("free_params")))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return reduce.mean_se(_ledger(spark, d).where("level = 'outer'").withColumnRenamed("ln", "ord"), ["family", "ord"])


@query(LEDGER + "select family, ln as ord, round(avg(score), 9) as mean, round(coalesce(stddev_samp(score), 0) / sqrt(count(*)), 9) as se, count(*) as n, round(avg(complexity), 9) as mean_complexity, string_agg(cast(fold as varchar), ',' order by fold) as told from led where level = 'outer' group by all")
def fold_mean_se(spark, d):
    return rounded(_stats(spark, d).select("family", "ord", "mean", "se", "n", "mean_complexity", "told"), "mean", "se", "mean_complexity")


@query(
    LEDGER + ", m as (select *, unnest(['score', 'complexity']) as metric, unnest([score, complexity]) as v from led) select code_fingerprint, level, config_key, metric, round(avg(v), 9) as mean, case when metric = 'score' then round(coalesce(stddev_samp(v), 0) / sqrt(count(*)), 9) end as se, case when metric = 'score' then count(*) end as n, "
    "case when bool_or(status = 'failed') then 'failed' else 'ok' end as status, min_by(point_addr, append_ord) as point_addr from m group by code_fingerprint, level, config_key, metric"
)
def aggregate_view(spark, d):
    return rounded(reduce.aggregate_view(_ledger(spark, d), "score"), "mean", "se")


@query(LEDGER + "select family, round(avg(score), 9) as mean, round(coalesce(stddev_samp(score), 0) / sqrt(count(*)), 9) as se, count(*) as n from led where level = 'outer' and status <> 'failed' group by family")
def family_estimate(spark, d):
    return rounded(reduce.family_estimate(_ledger(spark, d), "score"), "mean", "se")


WON = "select family, ord, round(mean, 9) as mean from ({rows}) qualify row_number() over (partition by family order by {key}, ord) = 1"
BAND = "select * from (select *, first(mean) over w as best, first(se) over w as best_se from st window w as (partition by family order by mean desc, ord rows between unbounded preceding and unbounded following)) where mean >= best - {width}"
FRUGAL = "select * from (select *, min(mean_complexity) over (partition by family) as c from ({band})) where mean_complexity <= case when c > 0 then c * 1.10::double else c end"


def _won(df: DataFrame) -> DataFrame:
    return rounded(df.select("family", "ord", "mean"), "mean")


@query(LEDGER + WON.format(rows="select * from st", key="mean desc"))
def select_argmax(spark, d):
    return _won(select.argmax_mean(_stats(spark, d)))


@query(LEDGER + WON.format(rows="select * from st", key="mean - se * sqrt(n) desc"))
def select_mean_std(spark, d):
    return _won(select.mean_std(_stats(spark, d)))


@query(LEDGER + WON.format(rows=FRUGAL.format(band=BAND.format(width="best_se")), key="mean desc"))
def select_one_std_err(spark, d):
    return _won(select.one_std_err(_stats(spark, d)))


@query(LEDGER + WON.format(rows=FRUGAL.format(band=BAND.format(width="abs(best) * 0.02::double")), key="mean desc"))
def select_pct_loss(spark, d):
    return _won(select.pct_loss(_stats(spark, d)))


@query(LEDGER + "select family, ord, round(mean, 9) as mean, row_number() over (order by mean desc, family, ord) = 1 as is_ship from (select * from st qualify row_number() over (partition by family order by mean desc, ord) = 1)")
def ship_pick(spark, d):
    return rounded(select.two_level(_stats(spark, d), "argmax-mean").select("family", "ord", "mean", "is_ship"), "mean")


EST = ", e as (select family, avg(score) as mean, coalesce(stddev_samp(score), 0) / sqrt(count(*)) as se from led where level = 'outer' and status <> 'failed' group by family), top as (select mean as bm, se as bs from e order by mean desc, se, family limit 1) "
PICK = "select family, mean, se from e, top where mean >= bm - bs or (select max(se) from e) = 0 order by case when (select max(se) from e) = 0 then 0 else se end, mean desc, family limit 1"


@query(LEDGER + EST + "select family, round(mean, 9) as mean, round(se, 9) as se from (" + PICK + ")")
def family_select(spark, d):
    return rounded(select.family_select(reduce.family_estimate(_ledger(spark, d), "score").drop("n")), "mean", "se")


@query(LEDGER + EST + "select round(mean, 9) as incumbent from (" + PICK + ")")
def incumbent(spark, d):
    return family_select(spark, d).select(F.col("mean").alias("incumbent"))


STOP = (
    ", g as (select family, avg(score) as mean, coalesce(stddev_samp(score), 0) as s, count(*) as n from led where level = 'outer' and fold < 3 and ln = 1 group by family), "
    "q as (select *, 5 - n as r, case n - 1 when 1 then 6.313752::double when 2 then 2.919986::double else 2.353363::double end as tq from g), x as (select family, mean, n, n >= 2 and r > 0 and mean + tq * s * sqrt(r / 25.0::double * (1 + r / cast(n as double))) < 0.0505::double as stop from q) "
)


def _stop(spark: SparkSession, d: str) -> DataFrame:
    rows = _ledger(spark, d).where("level = 'outer' and fold < 3 and ln = 1").select("family", "score")
    return select.auto_stop(rows, 5, F.lit(0.0505))


@query(LEDGER + STOP + "select family, round(mean, 9) as mean, n, stop from x")
def auto_stop(spark, d):
    return rounded(_stop(spark, d), "mean")


@query(LEDGER + STOP + "select point_addr, case when level = 'outer' and coalesce(stop, false) then 'auto' end as stopped from led left join x using (family)")
def mark_stopped(spark, d):
    return select.mark_stopped(_ledger(spark, d), _stop(spark, d)).select("point_addr", "stopped")


@query(LEDGER + "select point_addr, score from led where status <> 'failed' order by score desc, append_ord limit 1")
def ledger_best(spark, d):
    return ledger.best(_ledger(spark, d), "score").select("point_addr", "score")


@query(LEDGER + "select point_addr, score from led where status <> 'failed' order by score, append_ord limit 10")
def ledger_topn(spark, d):
    return ledger.top(_ledger(spark, d), "score", 10, "minimize").select("point_addr", "score")


@query(LEDGER + "select point_addr, cast(row_number() over (order by status = 'failed', case when status <> 'failed' then -score end, append_ord) as integer) as place from led")
def ledger_sort_all(spark, d):
    return ledger.ranked_all(_ledger(spark, d), "score").select("point_addr", "place")


@query(LEDGER + "select point_addr, code_fingerprint, score from led")
def ledger_append_dedup(spark, d):
    led = _ledger(spark, d)
    again = led.where("fold <> 0").withColumn("score", F.col("score") + 1)
    return ledger.append(led, again).select("point_addr", "code_fingerprint", "score")


@query(LEDGER + "select unnest(['complexity', 'n', 'score', 'family']) as key")
def ledger_ragged_union(spark, d):
    led = _ledger(spark, d)
    return ledger.union_keys(led, "metrics").union(ledger.union_keys(led, "free_params"))


@query(LEDGER + 'select code_fingerprint, point_addr, status, level, fold, family as "fp.family", cast(ln as varchar) as "fp.n", complexity as "metric.complexity", score as "metric.score" from led')
def ledger_wide(spark, d):
    return ledger.wide(_ledger(spark, d), ["n", "family"], ["score", "complexity"])


@query(LEDGER + "select code_fingerprint, point_addr, status, level, fold, family, cast(ln as varchar) as ln, score, complexity, row_number() over (order by append_ord) - 1 as append_ord from led")
def ledger_csv_roundtrip(spark, d):
    path = work_folder(spark, "ledger_csv")
    ledger.write_csv(_ledger(spark, d), path)
    back = ledger.read_csv(spark, path)
    return back.select("code_fingerprint", "point_addr", "status", "level", "fold", F.col("free_params.family").alias("family"), F.col("free_params.n").alias("ln"), F.col("metrics.score").alias("score"), F.col("metrics.complexity").alias("complexity"), "append_ord")


@query(
    "select code_fingerprint, count(*) as rows, count(*) filter (event_type = 'click') as inner_rows, count(*) filter (event_type = 'view') as outer_rows, min(ts) as first_start, max(ts) as last_finish, max_by(event_type, event_id) filter (ts = last) as record_status, (max(event_id) filter (ts = last)) % 2 = 0 as dirty, 'c' || cast((max(event_id) filter (ts = last)) % 5 as varchar) as commit, count(distinct event_id % 5) - 1 as more_commits, count(*) as records from (select *, max(ts) over (partition by code_fingerprint) as last from (select event_id, 'u' || cast(user_id % 7 as varchar) as code_fingerprint, event_type, ts from events)) group by 1"
)
def cohort_summary(spark, d):
    e = t(spark, d, "events")
    rows = e.select(F.col("event_id").cast("string").alias("point_addr"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("code_fingerprint"), F.when(F.col("event_type") == "click", "inner").when(F.col("event_type") == "view", "outer").alias("level"), F.col("event_id").alias("append_ord"))
    records = e.select(F.col("event_id").cast("string").alias("point_addr"), F.col("ts").alias("started"), F.col("ts").alias("finished"), F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string")).alias("commit"), (F.col("event_id") % 2 == 0).alias("dirty"), F.col("event_type").alias("record_status"))
    return ledger.cohort_summary(rows, records).select("code_fingerprint", "rows", "inner_rows", "outer_rows", "first_start", "last_finish", "commit", "more_commits", "records", "dirty", "record_status")


@query(LEDGER + "select count(distinct code_fingerprint) as cohorts from led where code_fingerprint <> ''")
def cohort_count(spark, d):
    return ledger.cohort_count(_ledger(spark, d))


@query(LEDGER + "select point_addr, code_fingerprint from led where code_fingerprint = 'aaa1'")
def prefix_resolve(spark, d):
    led = _ledger(spark, d)
    return ledger.of_cohort(led, ledger.resolve_prefix(led, "code_fingerprint", "aaa")).select("point_addr", "code_fingerprint")


POINTS = ", pts as (select distinct 'family=' || family || ',n=' || cast(ln as varchar) as config_key, 'm=' || family as fam, cast(ln as integer) as ord from b where ln <= 4) "


def _points(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).where("ln <= 4").select("config_key", F.concat(F.lit("m="), "family").alias("family"), F.col("ln").cast("int").alias("ord")).distinct()


@query(LEDGER + POINTS + "select point_addr, config_key, fam as family, ord from led join pts using (config_key)")
def config_row_match(spark, d):
    return ledger.match_points(_ledger(spark, d).select("point_addr", "config_key"), _points(spark, d)).select("point_addr", "config_key", "family", "ord")


@query(LEDGER + POINTS + "select point_addr, coalesce(fam, '') as family from led left join pts using (config_key)")
def family_left_match(spark, d):
    return ledger.with_family(_ledger(spark, d).select("point_addr", "config_key"), _points(spark, d)).select("point_addr", "family")


@query(LEDGER + "select point_addr, config_key from led where config_key = (select config_key from led order by point_addr limit 1)")
def point_rows(spark, d):
    led = _ledger(spark, d)
    first = led.agg(F.min("point_addr")).first()[0]
    return ledger.point_rows(led, first[:20]).select("point_addr", "config_key")


@query(LEDGER + "select l.point_addr as run_id, l.config_key, r.score from led l left join (select * from led where fold <> 0) r using (point_addr)")
def manifest_record_join(spark, d):
    led = _ledger(spark, d).withColumnRenamed("point_addr", "run_id")
    return ledger.with_records(led.select("run_id", "config_key"), led.where("fold <> 0").select("run_id", "score"))


NAMED = ", s as (select point_addr as run_id, 0 as ord, 'prep' as step, unnest(['score', 'rows']) as m, unnest([score, cast(n as double)]) as value from led union all select point_addr, 1, 'train', unnest(['score', 'size']), unnest([score + 1, complexity]) from led) "


def _steps(spark: SparkSession, d: str) -> DataFrame:
    def step(name: str, i: int, **m: Column) -> Column:
        return F.struct(F.lit(name).alias("step"), F.lit(i).alias("ord"), F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v)]).alias("metrics"))

    made = F.array(step("prep", 0, score=F.col("score"), rows=F.col("n").cast("double")), step("train", 1, score=F.col("score") + 1, size=F.col("complexity")))
    return _ledger(spark, d).select(F.col("point_addr").alias("run_id"), made.alias("steps"))


@query(LEDGER + NAMED + "select run_id, step || '.' || m as metric, round(value, 9) as value from s")
def metric_namespacing(spark, d):
    return rounded(ledger.namespaced(_steps(spark, d)), "value")


@query(LEDGER + NAMED + "select run_id, m as metric, round(max_by(value, ord), 9) as value from s group by all")
def metric_merge(spark, d):
    return rounded(ledger.merged(_steps(spark, d)), "value")


@query(LEDGER + STOP + ", a as (select family, ord from st where family not in (select family from x where stop)) select * from a union all select family, ord from st where not exists (select * from a)")
def active_families(spark, d):
    return select.active_families(_stats(spark, d), _stop(spark, d)).select("family", "ord")


@query(LEDGER + "select family, round(avg(score), 9) as mean, round(coalesce(stddev_samp(score), 0) / sqrt(count(*)), 9) as se, count(*) as n from led where level = 'outer' and status <> 'failed' and fold < 2 group by family")
def partial_finalise(spark, d):
    return rounded(reduce.family_estimate(folds.prefix_sample(_ledger(spark, d), "in2"), "score"), "mean", "se")


@query(LEDGER + "select distinct level = 'outer' and status <> 'failed' as outer_ok, point_addr from led where level <> 'outer' or status <> 'failed'")
def level_filter(spark, d):
    led = _ledger(spark, d)
    return ledger.of_level(led, True).select(F.lit(True).alias("outer_ok"), "point_addr").unionByName(ledger.of_level(led, False).select(F.lit(False).alias("outer_ok"), "point_addr"))


@query(LEDGER + "select distinct family from (select family, fold <> 4 as has from led) where not has")
def complexity_guard(spark, d):
    led = _ledger(spark, d).withColumn("complexity", F.when(F.col("fold") != 4, F.col("complexity")))
    return reduce.without_complexity(reduce.mean_se(led, ["family", "ln"]))


CELLS = "select unnest([cast(event_id as varchar), cast(value as varchar), event_type, props, case when event_id % 3 = 0 then 'true' else '' end]) as s from events"


@query(
    "select kind, count(*) as n from (select case when s is null or s = '' then null when s in ('true', 'false') then 'bool' when regexp_matches(s, '^\\s*[\\[{]') and json_valid(s) then 'json' when regexp_full_match(s, '[+-]?[0-9]+') then 'int' "
    "when try_cast(s as double) is not null then 'float' else 'string' end as kind from (" + CELLS + ")) group by kind"
)
def cell_kinds(spark, d):
    s = F.array(F.col("event_id").cast("string"), F.col("value").cast("string"), F.col("event_type"), F.col("props"), F.when(F.col("event_id") % 3 == 0, "true").otherwise(""))
    return t(spark, d, "events").select(F.explode(s).alias("s")).select(ledger.cell_kind(F.col("s")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# ---- datasets ----
@query("select l_quantity, l_extendedprice, l_discount from lineitem")
def role_projection(spark, d):
    roles = {"l_orderkey": "id", "l_quantity": "feature", "l_extendedprice": "feature", "l_discount": "feature", "l_returnflag": "target"}
    li = t(spark, d, "lineitem")
    return dataset.Dataset(dataset.Schema(roles, {}), li).x(li)


@query("select o_orderkey as id, unnest(['F', 'O']) as class, unnest([cast(o_custkey % 10 as double), cast(o_custkey % 7 as double)]) as p from orders")
def probabilities_unpivot(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("proba_F"), (F.col("o_custkey") % 7).alias("proba_O"))
    return dataset.unpivot(o, "o_orderkey")


@query("select event_id, case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' || (s % 60) || 's' else (s // 3600) || 'h' || (s % 3600 // 60) || 'm' end as took from (select event_id, event_id * 37 % 20000 as s from events)")
def compact_duration(spark, d):
    return t(spark, d, "events").select("event_id", scalars.compact_duration(F.col("event_id") * 37 % 20000).alias("took"))


@query("select o_orderstatus, count(*) as n from orders group by 1")
def class_counts(spark, d):
    return metrics.class_counts(t(spark, d, "orders"), "o_orderstatus")


# ---- spaces ----
SPACE = {"train": {"model": {"$any": {"logreg": {"C": {"$any": [0.1, 1, 10]}}, "rf": {"max_depth": {"$any": [4, 8]}, "n_estimators": {"$any": [100, 500]}}}}}}


@query("select cast(i as integer) as ord, case when i < 3 then 'train.model=logreg' else 'train.model=rf' end as family from range(7) r(i)")
def family_of(spark, d):
    return space.expanded(spark, SPACE).select("ord", "family")


@query(LEDGER + "select distinct config_key, f::integer as fold, 'cv-k5-stratfalse-seed7#fold' || f as address from led, range(5) r(f)")
def task_grid(spark, d):
    of = spark.range(5).select(F.col("id").cast("int").alias("fold"))
    grid = space.product(_ledger(spark, d).select("config_key").distinct(), of)
    return grid.withColumn("address", scalars.fold_address(scalars.partition_ref(5, False, 7), F.col("fold")))


@query("select 'train.model=logreg' as family, 3::bigint as n union all select 'train.model=rf', 4")
def tagged_union_expand(spark, d):
    return space.expanded(spark, SPACE).groupBy("family").agg(F.count("*").alias("n"))


@query("select r_regionkey, n_nationkey from region, nation")
def grid_expand(spark, d):
    return space.product(t(spark, d, "nation").select("n_nationkey"), t(spark, d, "region").select("r_regionkey")).select("r_regionkey", "n_nationkey")


@query("select i::bigint as i, round(2.5 * i, 9)::double as value from range(5) r(i)")
def linear_range(spark, d):
    return rounded(space.linear_range(spark, 0, 10, 5), "value")


@query("select i::bigint as i, round(pow(10.0, i), 9)::double as value from range(4) r(i)")
def log_range(spark, d):
    return rounded(space.log_range(spark, 1, 1000, 4), "value")


# ---- scores and decisions ----
PRED = "with p as (select o_orderkey, o_orderstatus as y, case when o_totalprice > 150000 then 'F' else 'O' end as p, cast(o_custkey % 5 as integer) as fold from orders) "


def _preds(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("y"), F.when(F.col("o_totalprice") > 150000, "F").otherwise("O").alias("p"), (F.col("o_custkey") % 5).cast("int").alias("fold"))


@query(PRED + "select round(avg(case when y = p then 1.0::double else 0.0::double end), 9) as accuracy from p")
def accuracy(spark, d):
    return rounded(metrics.accuracy(_preds(spark, d)), "accuracy")


@query(PRED + "select round(avg(r), 9) as balanced_accuracy from (select y, avg(case when y = p then 1.0::double else 0.0::double end) as r from p group by y)")
def balanced_accuracy(spark, d):
    return rounded(metrics.balanced_accuracy(_preds(spark, d)), "balanced_accuracy")


@query("select round(sqrt(avg(pow(l_quantity - 25.0::double, 2))), 6) as rmse from lineitem")
def rmse(spark, d):
    r = metrics.rmse(t(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("y"), F.lit(25.0).alias("p")))
    return r.withColumn("rmse", F.round("rmse", 6))


@query(PRED + "select round(avg(a), 9) as cv_score, count(*) as n_folds from (select fold, avg(case when y = p then 1.0::double else 0.0::double end) as a from p group by fold)")
def cv_score(spark, d):
    return rounded(metrics.cv_score(_preds(spark, d), "accuracy"), "cv_score")


@query("select doc_id, round(cast((select count(*) from labels) as double) / ((select count(distinct toxic) from labels) * (select count(*) from labels k where k.toxic = l.toxic)), 9) as weight from labels l")
def weighted_balance(spark, d):
    return rounded(metrics.balanced_weights(t(spark, d, "labels"), "toxic").select("doc_id", "weight"), "weight")


PROB = "with p as (select o_orderkey as id, unnest(['F', 'O', 'P']) as class, cast(unnest([1 + (o_orderkey * {a}) % 97, 1 + (o_custkey * {a}) % 89, 1 + (o_orderkey + o_custkey) % 83]) as double) / 300.0::double as p, o_orderstatus as y from orders) "


def _probs(spark: SparkSession, d: str, a: int) -> DataFrame:
    o = t(spark, d, "orders")
    n = F.array(1 + (F.col("o_orderkey") * a) % 97, 1 + (F.col("o_custkey") * a) % 89, 1 + (F.col("o_orderkey") + F.col("o_custkey")) % 83)
    return o.select(F.col("o_orderkey").alias("id"), F.posexplode(n).alias("i", "v")).select("id", F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("i") + 1).alias("class"), (F.col("v").cast("double") / F.lit(300.0)).alias("p"))


@query(PROB.format(a=31) + "select id, class as label from p join (select unnest(['F', 'O', 'P']) as class, unnest([0.0::double, 0.31::double, -0.17::double]) as o) using (class) qualify row_number() over (partition by id order by ln(greatest(p, 1e-12)) + o desc, class) = 1")
def offset_argmax(spark, d):
    offsets = spark.createDataFrame([("F", 0.0), ("O", 0.31), ("P", -0.17)], "class string, offset double")
    return decide.apply_offsets(_probs(spark, d, 31), offsets)


@query(
    "with m as (" + PROB.format(a=31).replace("with p as (", "select *, 0.25::double as w from (").rstrip() + " union all " + PROB.format(a=57).replace("with p as (", "select *, 0.75::double as w from (").rstrip() + "), s as (select id, class, round(sum(w * ln(greatest(p, 1e-12))), 12) as s from m group by all) select id, class as label from s qualify row_number() over (partition by id order by s desc, class) = 1"
)
def blend_soft_vote(spark, d):
    return decide.blend([_probs(spark, d, 31), _probs(spark, d, 57)], [1.0, 3.0])


TILTED = ", o as (select unnest(['F', 'O', 'P']) as class, unnest([0.0::double, 0.31::double, -0.17::double]) as o), s as (select id, class, round(sum(w * (ln(greatest(p, 1e-12)) + case when w < 0.5 then o else 0 end)), 12) as s from m join o using (class) group by all) select id, class as label from s qualify row_number() over (partition by id order by s desc, class) = 1"


@query("with m as (" + PROB.format(a=31).replace("with p as (", "select *, 0.25::double as w from (").rstrip() + " union all " + PROB.format(a=57).replace("with p as (", "select *, 0.75::double as w from (").rstrip() + ")" + TILTED)
def blend_offsets(spark, d):
    offsets = spark.createDataFrame([("F", 0.0), ("O", 0.31), ("P", -0.17)], "class string, offset double")
    return decide.blend([_probs(spark, d, 31), _probs(spark, d, 57)], [1.0, 3.0], [offsets, None])


TUNE = (
    PROB.format(a=31) + ", w as (select id, ln(greatest(max(p) filter (class = 'F'), 1e-12)) as f, ln(greatest(max(p) filter (class = 'O'), 1e-12)) as o, ln(greatest(max(p) filter (class = 'P'), 1e-12)) as q, any_value(y) as y from p group by id), "
    "g as (select 0 as ord, 0.0::double as a, 0.0::double as b union all select 1 + i * 41 + j, -4.0::double + i * 0.2::double, -4.0::double + j * 0.2::double from range(41) r(i), range(41) s(j)), "
    "h as (select ord, y, avg(case when y = case when f >= o + a and f >= q + b then 'F' when o + a >= q + b then 'O' else 'P' end then 1.0::double else 0.0::double end) as r, count(*) as n from w, g group by all), "
)


@query(TUNE + """b as (select ord, round(avg(r), 12) as s from h group by ord order by 2 desc, ord limit 1) select 0.0::double as "offset_F", round(a, 9) as "offset_O", round(b, 9) as "offset_P", round(s, 9) as balanced_accuracy from b t join g using (ord)""".replace("round(b, 9)", "round(g.b, 9)"))
def offset_tune(spark, d):
    y = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("y"))
    return rounded(decide.tune_offsets(_probs(spark, d, 31), y, ["F", "O", "P"]), "offset_O", "offset_P", "balanced_accuracy")


@query(TUNE + """b as (select ord, round(sum(r * n) / sum(n), 12) as s from h group by ord order by 2 desc, ord limit 1) select 0.0::double as "offset_F", round(g.a, 9) as "offset_O", round(g.b, 9) as "offset_P", round(s, 9) as accuracy from b t join g using (ord)""")
def offset_tune_accuracy(spark, d):
    y = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("y"))
    return rounded(decide.tune_offsets(_probs(spark, d, 31), y, ["F", "O", "P"], "accuracy"), "offset_O", "offset_P", "accuracy")


@query(PROB.format(a=31) + "select id, class from p where id % 10 = 0")
def blend_misaligned(spark, d):
    p = _probs(spark, d, 31)
    return decide.misaligned([p, p.where("id % 10 <> 0")])


@query("select 'P' as class")
def offsets_uncovered(spark, d):
    return decide.uncovered(_probs(spark, d, 31), spark.createDataFrame([("F", 0.0), ("O", 0.3)], "class string, offset double"))


# ---- identity and graphs ----
@query("select coalesce(sum(o_custkey), 0)::bigint as bytes from orders")
def pool_size(spark, d):
    return identity.pool_size(t(spark, d, "orders").select(F.col("o_custkey").alias("size")))


@query("select n_nationkey, sha1('blob ' || strlen(n_name) || chr(0) || n_name) as blob from nation")
def git_blob_hash(spark, d):
    return t(spark, d, "nation").select("n_nationkey", scalars.git_blob(F.col("n_name")).alias("blob"))


EDGES = "with recursive e as (select cast(n_nationkey as integer) as child, cast(n_nationkey // 2 as integer) as parent from nation where n_nationkey > 0) "


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").cast("int").alias("child"), F.expr("n_nationkey div 2").cast("int").alias("parent"))


@query(EDGES + ", up(child, ancestor) as (select child, parent from e union select u.child, e.parent from up u join e on e.child = u.ancestor) select distinct child, ancestor from up")
def closure_recursive(spark, d):
    return dag.closure(spark, _edges(spark, d))


@query(EDGES + ", l(node, level) as (select 0, 0 union all select e.child, l.level + 1 from l join e on e.parent = l.node) select node, max(level) as level from l group by node")
def topo_levels(spark, d):
    return dag.levels(spark, _edges(spark, d))


@query("select p_brand, sha256(string_agg(p_name || ' ' || md5(cast(p_partkey as varchar)), chr(10) order by p_name || ' ' || md5(cast(p_partkey as varchar)))) as manifest, count(*) as files from part group by 1")
def manifest_hash(spark, d):
    p = t(spark, d, "part").select("p_brand", F.col("p_name").alias("path"), F.md5(F.col("p_partkey").cast("string").cast("binary")).alias("hash"))
    return identity.manifest_hash(p, ["p_brand"])


FILES = "with p as (select 'r' as repo, cast(p_partkey as varchar) as path, md5(cast(p_partkey as varchar)) as h, p_partkey as k from part) "


def _files(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.lit("r").alias("repo"), F.col("p_partkey").cast("string").alias("path"), F.md5(F.col("p_partkey").cast("string").cast("binary")).alias("hash"), F.col("p_partkey").alias("k"))


@query(FILES + "select count(*) filter (where k % 5 = 0) = 0 as unchanged from p")
def closure_unchanged(spark, d):
    f = _files(spark, d)
    now = f.withColumn("hash", F.when(F.col("k") % 5 == 0, "new").otherwise(F.col("hash")))
    return identity.drift(f, now).agg((F.count("*") == 0).alias("unchanged"))


@query(FILES + "select repo, path, case when k % 3 = 0 then 'new' else h end as hash from p")
def merge_read_set(spark, d):
    f = _files(spark, d)
    return identity.merge_read_sets(f.where("k % 2 = 0 or k % 3 <> 0"), f.where("k % 3 = 0").withColumn("hash", F.lit("new")))


@query(FILES + "select repo, path, h as hash, case when k % 4 <> 0 then 'new' end as now, case when k % 4 = 0 then 'missing' else 'changed' end as state from p where k % 4 = 0 or k % 5 = 0")
def drift_join(spark, d):
    f = _files(spark, d)
    return identity.drift(f, f.where("k % 4 <> 0").withColumn("hash", F.when(F.col("k") % 5 == 0, "new").otherwise(F.col("hash"))))


@query(
    "with b as (select cast(o_orderkey as varchar) as hash, cast(o_custkey as bigint) as size, o_orderdate as mtime from orders), w as (select *, sum(size) over (order by mtime, hash rows unbounded preceding) - size as prior, sum(size) over () as total from b) select hash, size, mtime from w where total - prior > 100000"
)
def lru_evict(spark, d):
    return identity.evicted(t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("hash"), F.col("o_custkey").cast("long").alias("size"), F.col("o_orderdate").alias("mtime")), 100000)


# ---- progress ----
@query(
    "with e as (select event_id, count(*) over w as n, epoch_us(ts) - epoch_us(min(ts) over w) as us from events window w as (partition by event_type order by ts, event_id rows between 63 preceding and current row)) select event_id, case when n >= 16 and us >= 15000000 then round((n - 1) * 60 / (us / 1e6::double), 9) end as rate from e"
)
def moving_rate(spark, d):
    return rounded(progress.moving_rate(t(spark, d, "events"), ["event_type"]).select("event_id", "rate"), "rate")


@query("select event_id, cast(round(avg(event_id % 9) over (partition by user_id order by event_id rows between 3 preceding and current row)) as bigint) as occupancy from events")
def occupancy_mean(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 9).alias("busy"))
    return progress.occupancy(e, ["user_id"], "busy", "event_id").select("event_id", "occupancy")


# ---- models ----
@query(
    "with d as (select cast(l_quantity as double) as x, l_extendedprice as y, cast(l_suppkey % 5 as integer) as fold from lineitem), g as (select cast(unnest([0, 1, 100]) as double) as alpha), s as (select f.fold, count(*) as n, avg(x) as mx, avg(y) as my, covar_pop(x, y) * count(*) as cxy, var_pop(x) * count(*) as cxx from d join (select distinct fold from d) f on d.fold <> f.fold group by f.fold), "
    "m as (select alpha, fold, cxy / (cxx + alpha) as b, my - cxy / (cxx + alpha) * mx as a from s, g) select alpha, fold, round(sqrt(avg(pow(y - a - b * x, 2))), 3) as rmse, count(*) as n from d join m using (fold) group by alpha, fold"
)
def ridge_cv_sufficient_stats(spark, d):
    li = t(spark, d, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_suppkey") % 5).cast("int").alias("fold"))
    r = estimators.ridge_cv(li, "l_quantity", "l_extendedprice", "fold", [0, 1, 100])
    return r.withColumn("rmse", F.round("rmse", 3))


# Where one feature has few values, a tree that may split them all, or a linear model with an indicator for each, gives
# every group its classes' rates; so SQL has what MLlib must find.
# MLlib joins leaves that predict the same class, so most rows take a class that turns with the year.
YEARS = "with d as (select o_orderkey, case when o_orderkey % 10 < 6 then ['F', 'O', 'P'][year(cast(o_orderdate as date)) % 3 + 1] else o_orderstatus end as y, cast(year(cast(o_orderdate as date)) as integer) as g, o_totalprice / 1e5::double as f0 from orders) "
TREE = {"rf": {"n_estimators": 1, "max_depth": 8, "bootstrap": False}}


def _years(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    g = F.year(F.to_date("o_orderdate"))
    turned = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), g % 3 + 1)
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 < 6, turned).otherwise(F.col("o_orderstatus")).alias("y"), g.alias("g"), ((g - 1995) / F.lit(10.0)).alias("f1"), (F.col("o_totalprice") / F.lit(1e5)).alias("f0"))


RATES = "r as (select g, c.class, cast(count(*) filter (y = c.class) as double) / count(*) as p from d, (select distinct y as class from d) c group by all) "


@query(YEARS + ", " + RATES + "select o_orderkey as id, class, round(p, 9) as p from d join r using (g)")
def predict_probabilities(spark, d):
    df = _years(spark, d)
    return rounded(estimators.probabilities(estimators.fit(df, ["g"], "y", TREE), df, "o_orderkey"), "p")


@query(YEARS + ", " + RATES + ", a as (select class, cast(count(*) filter (y = class) as double) / any_value((select count(*) from d)) as q from d, (select distinct y as class from d) group by class) select o_orderkey as id, class, round(0.75::double * p + 0.25::double * q, 9) as p from d join r using (g) join a using (class)")
def ensemble_probabilities(spark, d):
    df = _years(spark, d)
    prior = {"rf": {"n_estimators": 1, "max_depth": 0, "bootstrap": False}}
    model = estimators.fit(df, ["g"], "y", {"ensemble": {"members": [TREE, prior], "weights": [3.0, 1.0]}})
    return rounded(estimators.probabilities(model, df, "o_orderkey"), "p")


@query(YEARS + ", " + RATES + "select o_orderkey as id, class as prediction from d join r using (g) qualify row_number() over (partition by o_orderkey order by round(p, 12) desc, class) = 1")
def predicted_labels(spark, d):
    df = _years(spark, d)
    return estimators.predictions(estimators.fit(df, ["g"], "y", TREE), df, "o_orderkey")


@query("with d as (select o_orderpriority as g, o_orderstatus as y from orders), " + RATES + "select g, class, round(p, 4) as p from r")
def logreg_saturated(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("g"), F.col("o_orderstatus").alias("y"))
    names = [f"{i}-" for i in (1, 2, 3, 4)]  # the fifth priority is what none of them is
    df = o.withColumns({f"is_{i}": F.col("g").startswith(n).cast("double") for i, n in enumerate(names)})
    model = estimators.fit(df, [f"is_{i}" for i in range(len(names))], "y", {"logreg": {"C": 1e9}})
    one = df.groupBy("g").agg(F.min("o_orderkey").alias("id"), *[F.first(f"is_{i}").alias(f"is_{i}") for i in range(len(names))])
    p = estimators.probabilities(model, one, "id").join(one.select("id", "g"), "id")
    return p.select("g", "class", F.round("p", 4).alias("p"))


@query("select round(regr_intercept, 4) as intercept, round(b, 6) as coefficient from (select b, my - b * mx as regr_intercept from (select covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 50) as b, avg(x) as mx, avg(y) as my from (select cast(l_quantity as double) as x, cast(l_extendedprice as double) as y from lineitem)))")
def ridge_fit(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    last = estimators.fit(li, ["x"], "y", {"ridge": {"alpha": 50}}).stages[-1]
    return spark.createDataFrame([(round(last.intercept, 4), round(float(last.coefficients[0]), 6))], "intercept double, coefficient double")


@query(YEARS + "select cast(count(distinct rates) as double) as mean_leaves from (select g, list(round(p, 12) order by class) as rates from (select g, c.class, cast(count(*) filter (y = c.class) as double) / count(*) as p from d, (select distinct y as class from d) c group by all) group by g)")
def rf_complexity(spark, d):
    return spark.createDataFrame([(estimators.complexity(estimators.fit(_years(spark, d), ["g"], "y", TREE), TREE),)], "mean_leaves double")


# the first tree splits all values apart and leaves the other two nothing to split
@query("select cast(count(distinct l_linenumber) + 2 as double) as total_leaves from lineitem")
def gbt_total_leaves(spark, d):
    li = t(spark, d, "lineitem").select("l_linenumber", (F.col("l_linenumber") * F.col("l_linenumber") + F.col("l_quantity") * 0).cast("double").alias("y"))
    spec = {"hist_gbm_reg": {"max_iter": 3, "max_depth": 8}}
    return spark.createDataFrame([(estimators.complexity(estimators.fit(li, ["l_linenumber"], "y", spec), spec),)], "total_leaves double")


# folds of seed and seed + 1, as nested_cv deals them; depth 0 gives every row the commonest class of the fit
NESTED = (
    YEARS + ", o as (select *, cast((row_number() over (partition by y order by md5('0:' || cast(o_orderkey as varchar)), o_orderkey) - 1) % 3 as integer) as outer_fold from d), "
    "i as (select k.f as o, x.*, cast((row_number() over (partition by k.f, y order by md5('1:' || cast(o_orderkey as varchar)), o_orderkey) - 1) % 3 as integer) as fold from o x, (select distinct outer_fold as f from o) k where x.outer_fold <> k.f), "
    "ig as (select o, f.f as fold, g, y, count(*) filter (fold <> f.f) as n from i, (select distinct fold as f from i) f group by all), "
    "ip as (select o, fold, g, first(y order by n desc, y) as p1 from ig group by all), iq as (select o, fold, first(y order by n desc, y) as p0 from (select o, fold, y, sum(n) as n from ig group by all) group by all), "
    "s as (select o, i.fold, avg(cast(y = p0 as integer)) as s0, avg(cast(y = p1 as integer)) as s1 from i join iq using (o, fold) join ip using (o, fold, g) group by all), "
    "won as (select o, avg(s1) > avg(s0) as tree from s group by o), "
    "og as (select f.f as o, g, y, count(*) filter (outer_fold <> f.f) as n from o, (select distinct outer_fold as f from o) f group by all), "
    "op as (select o, g, first(y order by n desc, y) as p1 from og group by all), oq as (select o, first(y order by n desc, y) as p0 from (select o, y, sum(n) as n from og group by all) group by all), "
    "e as (select won.o, avg(cast(y = case when tree then p1 else p0 end as integer)) as score from o x join won on won.o = x.outer_fold join oq on oq.o = won.o join op on op.o = won.o and op.g = x.g group by won.o) "
)


@query(NESTED + "select round(avg(score), 9) as mean, round(stddev_samp(score) / sqrt(count(*)), 9) as se, count(*) as n from e")
def nested_cv_trees(spark, d):
    configs = [("tree", {"rf": TREE["rf"] | {"max_depth": depth}}) for depth in (0, 8)]
    _, est = nested.nested_cv(_years(spark, d), ["g"], "y", "o_orderkey", configs, 3, "accuracy", stratify="y")
    return rounded(est, "mean", "se")


@query()
def nested_cv_logreg(spark, d):
    _, est = nested.nested_cv(_years(spark, d), ["f1", "f0"], "y", "o_orderkey", [("logreg", {"logreg": {"C": c, "max_iter": 20}}) for c in (0.1, 1.0)], 2, "accuracy", stratify="y")
    return est


@query()
def offsets_on_holdout(spark, d):
    return estimators.tuned_on_holdout(_years(spark, d), ["f1", "f0"], "y", "o_orderkey", {"logreg": {"max_iter": 20}}, 0.2)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Folds, encodings and fold scores of four shrinkages, and the choice among them by one standard error."""
    out = None
    for i, m in enumerate((0.0, 1.0, 10.0, 100.0)):
        e = encode.encode_kfold(_encoded_orders(spark, d), "o_orderpriority", "y", "o_orderkey", m, 5, 7)
        p = e.crossJoin(F.broadcast(e.agg(F.avg("y").alias("prior")))).withColumn("p", (F.col("enc") > F.col("prior")).cast("double"))
        s = metrics.accuracy(p, by=["fold"]).select(F.lit("shrink").alias("family"), F.lit(i).alias("ord"), "fold", F.col("accuracy").alias("score"), F.lit(1.0 / (1.0 + m)).alias("complexity"))
        out = s if out is None else out.unionByName(s)
    return select.one_std_err(reduce.mean_se(out, ["family", "ord"]))
