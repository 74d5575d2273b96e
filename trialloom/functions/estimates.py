"""Column functions for states, ratios, planning and result columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialloom.registry import MIN_DENOMINATOR, MIN_POSITIVE_UNITS, STRATA, TARGETS, Z975


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def state_of(code: Column | str) -> Column:
    """Source code to state: 0 none, 1 right, 2 or 3 wrong; anything else is an error."""
    c = col(code)
    return (F.when(c == 1, "C").when(c.isin(2, 3), "E").when(c == 0, "N")
            .otherwise(F.raise_error(F.concat(F.lit("unknown source code "), c.cast("string"))).cast("string")))


def strict_int(c: Column | str) -> Column:
    """Canonical non-negative integer text; blank is null, anything else fails."""
    text = F.nullif(col(c), F.lit(""))
    return (F.when(text.isNull(), F.lit(None).cast("bigint"))
            .when(text.rlike("^(0|[1-9][0-9]*)$"), text.cast("bigint"))
            .otherwise(F.raise_error(F.concat(F.lit("not a canonical integer: "), text)).cast("bigint")))


def strict_bool(c: Column | str) -> Column:
    """Exactly True or False; blank is null, anything else fails."""
    text = F.nullif(col(c), F.lit(""))
    return (F.when(text.isNull(), F.lit(None).cast("boolean"))
            .when(text == "True", F.lit(True)).when(text == "False", F.lit(False))
            .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean")))


def ratio(num: Column | str, den: Column | str, reason: str) -> Column:
    """struct(value, defined, undefined_reason); a zero denominator is undefined, never 0."""
    n, d = col(num), col(den)
    ok = d > 0
    return F.struct(
        F.when(ok, F.try_divide(n.cast("double"), d.cast("double"))).alias("value"),
        F.coalesce(ok, F.lit(False)).alias("defined"),
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)).alias("undefined_reason"),
    )


def half_width(variance: Column | str, units: Column | int) -> Column:
    r = units if isinstance(units, Column) else F.lit(float(units))
    return F.lit(Z975) * F.sqrt(col(variance) / r)


def required_r(variance: Column | str, target: Column | float) -> Column:
    h = target if isinstance(target, Column) else F.lit(float(target))
    return F.ceil(F.lit(Z975 * Z975) * col(variance) / (h * h)).cast("bigint")


def target_of(metric: Column | str) -> Column:
    m = col(metric)
    return reduce(lambda acc, kv: acc.when(m == kv[0], F.lit(kv[1])), TARGETS.items(), F.when(F.lit(False), F.lit(0.0)))


def support(metric: Column | str, total: Column | str, positive: Column | str) -> Column:
    """Denominator support; the fixed-denominator metric is exempt."""
    return ((col(metric) == "P_cor")
            | ((col(total) >= MIN_DENOMINATOR) & (col(positive) >= MIN_POSITIVE_UNITS)))


def ci_position(lo: Column | str, hi: Column | str, defined: Column | str) -> Column:
    d = F.coalesce(col(defined), F.lit(False))
    return (F.when(~d, "UNDEFINED").when(col(lo) > 0, "POSITIVE").when(col(hi) < 0, "NEGATIVE")
            .otherwise("INCLUDES_ZERO"))


def one_sided(point: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """Larger one-sided half-width; null as soon as one input is null."""
    p, a, b = col(point), col(lo), col(hi)
    known = p.isNotNull() & a.isNotNull() & b.isNotNull()
    return F.when(known, F.greatest(p - a, b - p))


def stratum(a: Column | str, b: Column | str) -> Column:
    """Stratum of two levels by absolute difference 0, 1 or at least 2."""
    d = F.abs(col(a) - col(b))
    return F.when(d == 0, STRATA[0]).when(d == 1, STRATA[1]).when(d >= 2, STRATA[2])


def reasons(**flags: Column) -> Column:
    """Semicolon-joined names of the flags that are true, in the given order."""
    return F.concat_ws(";", *[F.when(flag, F.lit(name)) for name, flag in flags.items()])


def slug(code: Column | str) -> Column:
    """Lower-case path component: runs of other characters become one dash."""
    return F.btrim(F.regexp_replace(F.lower(col(code)), "[^a-z0-9]+", "-"), F.lit("-"))


def chunk_path(ordinal: Column | str, code: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.concat(F.lit("condition_"), F.lpad(col(ordinal).cast("string"), 2, "0"), F.lit("_"), slug(code),
                    F.lit("/repeats_"), col(start).cast("string"), F.lit("_"), col(end).cast("string"))


def finite(c: Column | str) -> Column:
    """True for a real number: not null, not NaN, not infinite."""
    return F.coalesce(F.abs(col(c)) < F.lit(math.inf), F.lit(False)) & ~F.isnan(col(c))
