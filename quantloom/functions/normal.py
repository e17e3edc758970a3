"""The normal distribution function, as SQL text for Spark and, by another way, for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Hart's rational approximation to double precision, highest powers first.
NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _polynomial(x: str, terms: tuple[float, ...]) -> str:
    text = repr(terms[0])
    for t in terms[1:]:
        text = f"({text} * {x} + {t!r})"
    return text.replace("e-02", "e-2")


def upper_tail(x: str) -> str:
    """The probability of more than x, for x >= 0."""
    near = f"exp(-({x}) * ({x}) / 2) * {_polynomial(f'({x})', NUMERATOR)} / {_polynomial(f'({x})', DENOMINATOR)}"
    far = f"exp(-({x}) * ({x}) / 2) / 2.506628274631 / ({x} + 1 / ({x} + 2 / ({x} + 3 / ({x} + 4 / ({x} + 0.65e0)))))"
    return f"(case when {x} < 7.07106781186547e0 then {near} when {x} < 37 then {far} else 0e0 end)"


def normal_cdf(x: str) -> str:
    """The probability of at most x; null where x is."""
    return f"(case when {x} is null then null when {x} > 0 then 1 - {upper_tail(f'abs({x})')} else {upper_tail(f'abs({x})')} end)"


def array_cdf() -> Callable[[np.ndarray], np.ndarray]:
    """normal_cdf() of arrays; an inner function, so that tasks get it whole and import nothing from here."""

    def cdf(x: np.ndarray) -> np.ndarray:
        a = np.abs(x)
        e = np.exp(-a * a / 2)
        near = e * np.polyval(NUMERATOR, a) / np.polyval(DENOMINATOR, a)
        far = e / 2.506628274631 / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65)))))
        tail = np.where(a < 7.07106781186547, near, np.where(a < 37, far, 0.0))
        return np.where(x > 0, 1 - tail, tail)

    return cdf


def two_sided(t: str) -> str:
    """The probability of a normal value at least as far from 0 as t; null where t is."""
    return f"(case when {t} is null then null else 2 * {upper_tail(f'abs({t})')} end)"


def normal_cdf_sql(x: str) -> str:
    """DuckDB: the power series within six deviations, the asymptotic one beyond."""
    series = f"list_reduce(list_transform(range(0, 61), lambda k: {{'t': ({x})::double, 's': ({x})::double, 'k': k::double}}), lambda a, b: {{'t': a.t * ({x}) * ({x}) / (2 * b.k + 1), 's': a.s + a.t * ({x}) * ({x}) / (2 * b.k + 1), 'k': b.k}}).s"
    density = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()))"
    tail = f"({density} / abs({x}) * (1 - 1 / (({x}) * ({x})) + 3 / power({x}, 4) - 15 / power({x}, 6)))"
    return f"(case when {x} is null then null when abs({x}) < 6 then 0.5 + {density} * {series} when {x} > 0 then 1 - {tail} else {tail} end)"
