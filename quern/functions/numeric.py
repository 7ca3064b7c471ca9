"""Rounding and guarded arithmetic (MTH-01..07) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, places: int = 0) -> Column:
    """Half-even rounding (MTH-01)."""
    return F.bround(x, places)


def half_even_score(x: Column, places: int) -> Column:
    """Half-even rounding of a computed score; the last digits of a float don't decide a tie."""
    return F.bround(F.round(x, 9), places)


def step_round(v: Column) -> Column:
    """Whole hundreds, from 50 000 on whole five hundreds, half-even (MTH-02)."""
    step = F.when(v >= 50_000, F.lit(500)).otherwise(F.lit(100))
    return (F.bround(v / step) * step).cast("long")


def cents(v: Column) -> Column:
    """Decimal money rounded half up to 0.01, once (MTH-03)."""
    return F.round(v, 2).cast("decimal(18,2)")


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def finite(x: Column) -> Column:
    """A number that is neither NULL, NaN nor infinite (MTH-04)."""
    v = x.cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def ratio(x: Column, y: Column, default: float = 0.0) -> Column:
    """x / y, the default where y is 0 or a side is unknown (MTH-04)."""
    return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(default))


def relative_gap(x: Column, y: Column) -> Column:
    """abs(x - y) / max(abs(x), abs(y)), 0 where both are 0 (MTH-04)."""
    return ratio(F.abs(x - y), F.greatest(F.abs(x), F.abs(y)))


def percent_discount(price: Column, reference: Column) -> Column:
    """Whole percent below the reference; NULL where either is missing or zero (MTH-06)."""
    known = (F.coalesce(price, F.lit(0)) != 0) & (F.coalesce(reference, F.lit(0)) != 0)
    return F.when(known, F.bround(F.try_divide(reference - price, reference) * 100)).cast("int")


def convert(price: Column, rate: Column) -> Column:
    """Half-even product; NULL (not an error) where the rate is missing or not positive (MTH-05)."""
    return F.when(rate > 0, F.bround(price * rate)).cast("long")


def token_cost(fresh: Column, cached: Column, output: Column, rates: tuple[float, float, float]) -> Column:
    """Cost of a call in dollars; cached tokens are held to the input and rates are per million (MTH-07)."""
    hit = F.least(F.coalesce(cached, F.lit(0)), F.coalesce(fresh, F.lit(0)))
    total = (F.coalesce(fresh, F.lit(0)) - hit) * rates[0] + hit * rates[1] + F.coalesce(output, F.lit(0)) * rates[2]
    return F.bround(total / 1_000_000, 8)


def backoff(k: Column, base: float, cap: float) -> Column:
    """Delay after the k-th error in a row: doubling up to a cap, 0 without errors (WN-10)."""
    return F.when(k <= 0, F.lit(0.0)).otherwise(F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(k, F.lit(60)) - 1), F.lit(float(cap))))


def lookup_budget(n: Column) -> Column:
    """Lookups a cycle may spend on n candidates (TK-02)."""
    fifth = F.ceil(n * F.lit(0.2)).cast("int")
    return F.when(n <= 10, n.cast("int")).when(n <= 30, 10).when(n <= 70, 15).otherwise(F.least(F.lit(20), F.greatest(F.lit(15), fifth)))
