"""Column expressions: any-of prefixes, keywords and patterns, money, rounding."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def starts_with_any(col: Column, prefixes: Iterable[str]) -> Column:
    return any_of(col.startswith(p) for p in prefixes)


def contains_any(col: Column, words: Iterable[str]) -> Column:
    return any_of(col.contains(w) for w in words)


def matches_any(col: Column, patterns: Iterable[str]) -> Column:
    """Case-insensitive search, accented letters included."""
    return col.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))


def first_of(pairs: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first condition that holds."""
    out, pairs = F.lit(default), list(pairs)
    for cond, value in reversed(pairs):
        out = F.when(cond, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def sum_if(value: Column, cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0).cast(MONEY))


def total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0).cast(MONEY))


def number(col: Column) -> Column:
    return col.cast("double")


def rounded(col: Column, places: int = 4) -> Column:
    """A rounded double, never a negative zero.

    To few places it is rounded as a decimal, so that halves don't hang on the last bits
    that the order of a sum leaves in a double.
    """
    exact = F.round(col.cast("double"), places)
    if places < 6:
        exact = F.coalesce(F.round(col.cast("double").try_cast("decimal(28,6)"), places).cast("double"), exact)
    return exact + F.lit(0.0)


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b as a double; default where b is zero."""
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if default is None else F.coalesce(r, F.lit(default))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over the rows where both are there; null where one is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
