"""The normal distribution as SQL expressions that Spark and other engines read alike."""

from __future__ import annotations

import math

# W. J. Cody's rational approximations of the error function (Math. Comp. 23, 1969).
NEAR = [3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1]
NEAR_BELOW = [2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03]
MIDDLE = [
    5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
    1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8,
]
MIDDLE_BELOW = [
    1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
    4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03,
]
FAR = [3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2]
FAR_BELOW = [2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]
BOUND, WIDE = 0.46875, 4.0


def number(x: float) -> str:
    """A literal of type double in every dialect."""
    return f"{x:.17e}"


def polynomial(factors: list[float], x: str) -> str:
    """The factors, highest power first, by Horner's rule."""
    out = number(factors[0])
    for f in factors[1:]:
        out = f"({out} * {x} + {number(f)})"
    return out


def scaled_erfc(y: str) -> str:
    """exp(y * y) * erfc(y) for y > BOUND."""
    middle = f"{polynomial([MIDDLE[8], *MIDDLE[:8]], y)} / {polynomial([1.0, *MIDDLE_BELOW], y)}"
    w = f"(1E0 / ({y} * {y}))"
    far = f"({number(1 / math.sqrt(math.pi))} - {w} * {polynomial([FAR[5], *FAR[:5]], w)} / {polynomial([1.0, *FAR_BELOW], w)}) / {y}"
    return f"(CASE WHEN {y} <= {number(WIDE)} THEN {middle} ELSE {far} END)"


def hazard(y: str) -> str:
    """Density over distribution function of the standard normal at z, for ``y`` = z / sqrt(2), a column's name.

    In the lower tail both are tiny, and their quotient is one of scaled functions.
    """
    square = f"({y} * {y})"
    erf = f"{y} * {polynomial([NEAR[4], *NEAR[:4]], square)} / {polynomial([1.0, *NEAR_BELOW], square)}"
    density = f"({number(1 / math.sqrt(2 * math.pi))} * exp(-{square}))"
    return (
        f"(CASE WHEN {y} < {number(-BOUND)} THEN {number(math.sqrt(2 / math.pi))} / {scaled_erfc(f'(-{y})')} "
        f"WHEN {y} <= {number(BOUND)} THEN {density} / (0.5E0 * (1E0 + {erf})) "
        f"ELSE {density} / (1E0 - 0.5E0 * exp(-{square}) * {scaled_erfc(y)}) END)"
    )


def expected_signal(x: str, mu: str, sigma: str, alpha: str, y: str) -> str:
    """Expected exponential signal (mean ``alpha``) of ``x`` over normal background; ``y`` is :func:`standardised` of the same."""
    signal = f"({x} - {mu} - {sigma} * {sigma} / {alpha} + {sigma} * {hazard(y)})"
    return f"(CASE WHEN {signal} < 0 THEN greatest({signal}, 1E-6) ELSE {signal} END)"


def standardised(x: str, mu: str, sigma: str, alpha: str) -> str:
    return f"(({x} - {mu} - {sigma} * {sigma} / {alpha}) / ({sigma} * {number(math.sqrt(2))}))"


def upper_tail(y: str) -> str:
    """The standard normal's probability above z, for ``y`` = z / sqrt(2), a column's name."""
    square = f"({y} * {y})"
    erf = f"{y} * {polynomial([NEAR[4], *NEAR[:4]], square)} / {polynomial([1.0, *NEAR_BELOW], square)}"
    return (
        f"(CASE WHEN {y} > {number(BOUND)} THEN 0.5E0 * exp(-{square}) * {scaled_erfc(y)} WHEN {y} >= {number(-BOUND)} THEN 0.5E0 * (1E0 - {erf}) "
        f"ELSE 1E0 - 0.5E0 * exp(-{square}) * {scaled_erfc(f'(-{y})')} END)"
    )
