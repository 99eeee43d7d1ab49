"""Column expressions that operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_PATH = "__none__"
NO_STATIONS = "no_stations"


def quantized(x: Column, digits: int = 6) -> Column:
    """x on a decimal grid, in a form that engines agree on (unlike round on ties)."""
    s = F.lit(float(10**digits))
    return F.floor(x.cast("double") * s + F.lit(0.5)) / s


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation from counts; 0 where it isn't defined."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    d = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(d <= 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / F.sqrt(d))


def cost(fp: Column, fn: Column, per_fn: float = 100.0, per_fp: float = 5.0) -> Column:
    return fn * F.lit(per_fn) + fp * F.lit(per_fp)


def budget_rows(n: Column, percent: Column) -> Column:
    """Rows that a budget of so many percent pays for: rounded up, never negative."""
    return F.greatest(F.lit(0), F.ceil(n * percent / F.lit(100.0))).cast("long")


def tokens(signature: Column) -> Column:
    """Stations of a path signature; none for null and for the sentinel."""
    return F.when(signature.isNull() | (signature == NO_PATH), F.array().cast("array<string>")).otherwise(F.filter(F.split(signature, "[|]"), lambda x: x != ""))


def transitions(path: Column) -> Column:
    """a>b of neighbours."""
    return F.transform(F.slice(path, 2, F.greatest(F.size(path), F.lit(1))), lambda y, i: F.concat(F.get(path, i), F.lit(">"), y))


def pairs(path: Column) -> Column:
    """a&b of all unordered pairs, in the path's order."""
    return F.flatten(F.transform(path, lambda x, i: F.transform(F.slice(path, i + 2, F.greatest(F.size(path), F.lit(1))), lambda y: F.concat(x, F.lit("&"), y))))


def smoothed(n: Column, rate: Column, overall: Column, m: float = 10.0) -> Column:
    return (n * rate + F.lit(m) * overall) / (n + F.lit(m))


def shift_bucket(hour: Column) -> Column:
    """1 to 3 for hours in (0, 8], (8, 16], (16, 24]; null at 0."""
    return F.when(hour <= 0, None).when(hour <= 8, 1).when(hour <= 16, 2).when(hour <= 24, 3)


def risk_tier(count: Column) -> Column:
    return F.when(count <= 0, None).when(count <= 10, 0).when(count <= 100, 1).otherwise(2)


def balance(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Harmonic mean, defined at zeros."""
    return 2 * a * b / (a + b + F.lit(eps))
