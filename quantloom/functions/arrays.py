"""Frames as arrays: what window functions don't have, for each row of a dense panel. Rows without a value are left out of a frame."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def by_asset():
    return Window.partitionBy("asset").orderBy("date")


def framed(x: str | Column, n: int, lag: int = 0) -> Column:
    """The values of the n rows that end `lag` rows before this one, in order."""
    return F.collect_list(x).over(by_asset().rowsBetween(1 - n - lag, -lag))


def whole(values: Column, n: int, result: Column) -> Column:
    """result where the frame has n values."""
    return F.when(F.size(values) >= n, result)


def ts_rank(x: str, n: int) -> Column:
    """Share of the frame's values that are below the row's own, ties by half, the own one counted."""
    v, own = framed(x, n), F.col(x)
    below, equal = F.size(F.filter(v, lambda y: y < own)), F.size(F.filter(v, lambda y: y == own))
    return F.when(own.isNotNull(), whole(v, n, (below + (equal + 1) / 2) / n))


def ts_argmax(x: str, n: int) -> Column:
    """Rows from the frame's start to its first largest value."""
    v = framed(x, n)
    return whole(v, n, (F.array_position(v, F.array_max(v)) - 1).cast("double"))


def ts_argmin(x: str, n: int) -> Column:
    v = framed(x, n)
    return whole(v, n, (F.array_position(v, F.array_min(v)) - 1).cast("double"))


def decay_linear(x: str, n: int) -> Column:
    """Mean of the frame with weights 1 to n, the last row's the largest."""
    v = framed(x, n)
    return whole(v, n, F.aggregate(F.transform(v, lambda y, i: y * (i + 1)), F.lit(0.0), lambda a, y: a + y) / (n * (n + 1) / 2))


def signed_power(x: Column, e: Column | float) -> Column:
    """The size of x to the power e, with x's sign; null where that is no finite number."""
    e = F.lit(e) if isinstance(e, (int, float)) else e
    power = F.when((x != 0) | (e > 0), F.pow(F.abs(x), e)).when(e == 0, 1.0)
    return F.signum(x) * F.when(power < 1e300, power)


def ranks(v: Column) -> Column:
    """Average ranks of an array's values."""
    return F.transform(v, lambda y: F.size(F.filter(v, lambda z: z < y)) + (F.size(F.filter(v, lambda z: z == y)) + 1) / 2)


def correlation(pairs: Column) -> Column:
    """Pearson correlation of an array of structs (a, b) of moderate numbers, from one pass of sums; null where a side does not vary."""
    names = ("n", "a", "b", "aa", "bb", "ab")
    start = F.struct(*[F.lit(0.0).alias(k) for k in names])
    step = lambda s, p: F.struct((s["n"] + 1).alias("n"), (s["a"] + p["a"]).alias("a"), (s["b"] + p["b"]).alias("b"), (s["aa"] + p["a"] * p["a"]).alias("aa"), (s["bb"] + p["b"] * p["b"]).alias("bb"), (s["ab"] + p["a"] * p["b"]).alias("ab"))

    def end(s: Column) -> Column:
        va, vb = s["n"] * s["aa"] - s["a"] * s["a"], s["n"] * s["bb"] - s["b"] * s["b"]
        return F.try_divide(s["n"] * s["ab"] - s["a"] * s["b"], F.sqrt(F.when((va > 1e-9) & (vb > 1e-9), va * vb)))

    return F.aggregate(pairs, start, step, end)
