"""Tails of distributions as SQL expressions. Spark has no error function; this one is Cody's (1969) rational form."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Cody's approximations, by range of |x|.
_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_C = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
_D = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _ratio(top: tuple[float, ...], bottom: tuple[float, ...], x: str) -> str:
    num, den = f"({top[-1]!r}D * {x})", x
    for a, b in zip(top[: len(bottom) - 1], bottom[:-1], strict=True):
        num, den = f"(({num} + {a!r}D) * {x})", f"(({den} + {b!r}D) * {x})"
    return f"(({num} + {top[len(bottom) - 1]!r}D) / ({den} + {bottom[-1]!r}D))"


def erfc(x: str) -> str:
    """The complementary error function of a non-negative SQL expression."""
    y = f"({x})"
    small = f"(1D - {y} * {_ratio(_A, _B, f'({y} * {y})')})"
    mid = f"(exp(-{y} * {y}) * {_ratio(_C, _D, y)})"
    inv = f"(1D / ({y} * {y}))"
    large = f"(exp(-{y} * {y}) / {y} * (0.5641895835477562869D - {inv} * {_ratio(_P, _Q, inv)}))"
    return f"(CASE WHEN {y} <= 0.46875D THEN {small} WHEN {y} <= 4D THEN {mid} WHEN {y} < 26D THEN {large} ELSE 0D END)"


def two_sided(z: str) -> str:
    """The two-sided normal tail of an SQL expression."""
    return erfc(f"abs({z}) / 1.4142135623730951D")


def chi2_sf1(x: str) -> str:
    return erfc(f"sqrt(greatest(0D, {x}) / 2D)")


def chi2_sf2(x: str) -> str:
    return f"exp(-greatest(0D, {x}) / 2D)"


def chi2_sf(x: str, k: int) -> str:
    """Upper tail for k degrees of freedom: exact for 2, else by Wilson and Hilferty."""
    if k == 2:
        return chi2_sf2(x)
    z = f"((pow(greatest(0D, {x}) / {k}D, 1D / 3D) - (1D - 2D / {9 * k}D)) / sqrt(2D / {9 * k}D))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5D * {erfc(f'abs({z}) / 1.4142135623730951D')} ELSE 1D - 0.5D * {erfc(f'abs({z}) / 1.4142135623730951D')} END)"


def chi2_tail(x: float, k: int) -> float:
    """The same for one value, on the driver."""
    x = max(0.0, x)
    if k == 2:
        return math.exp(-x / 2)
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


# Lanczos' coefficients for g = 7 and nine terms.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function of a column of numbers of 0.5 or more."""
    x = x - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (x + i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * F.log(t) - t + F.log(total)
