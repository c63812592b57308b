"""Scalar expressions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom, then the normal one (fixed values).
T95 = [6.313752, 2.919986, 2.353363, 2.131847, 2.015048, 1.943180, 1.894579, 1.859548, 1.833113, 1.812461, 1.795885, 1.782288, 1.770933, 1.761310, 1.753050, 1.745884, 1.739607, 1.734064, 1.729133, 1.724718, 1.720743, 1.717144, 1.713872, 1.710882, 1.708141, 1.705618, 1.703288, 1.701131, 1.699127, 1.697261, 1.644854]


def t95(df: Column) -> Column:
    """The quantile for so many degrees of freedom; more than 30 take the normal one."""
    return F.element_at(F.array(*[F.lit(x) for x in T95]), F.least(F.greatest(df, F.lit(1)), F.lit(len(T95))).cast("int"))


def seeded(seed: int | str, key: Column) -> Column:
    """A reproducible rank key: hexadecimal md5 of seed and a whole-number id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def git_blob(content: Column) -> Column:
    """The hash that git gives to a file of this content: sha1 of a header with its bytes, and the bytes."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")).cast("binary"), F.unhex(F.lit("00")), raw))


def compact_duration(seconds: Column) -> Column:
    """34s, 3m10s, 2h5m."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m")))


def plain_number(s: Column) -> Column:
    """A whole number is the same with and without a fraction of zeros."""
    return F.regexp_replace(s, r"^([+-]?[0-9]+)\.0+$", "$1")


def canonical(pairs: Sequence[tuple[str, Column]]) -> Column:
    """name=value pairs by name, joined by commas; null values are as if absent."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), plain_number(c.cast("string")))) for n, c in sorted(pairs, key=lambda p: p[0])]
    return F.concat_ws(",", *parts)


def canonical_map(m: Column) -> Column:
    """The same of a map of strings."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(F.map_filter(m, lambda k, v: v.isNotNull())), lambda e: F.concat(e["key"], F.lit("="), plain_number(e["value"])))), ",")


def partition_ref(k: int, stratified: bool, seed: int) -> str:
    return f"cv-k{k}-strat{str(stratified).lower()}-seed{seed}"


def fold_address(ref: str, fold: Column) -> Column:
    return F.format_string("%s#fold%d", F.lit(ref), fold)
