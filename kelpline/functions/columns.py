"""Column functions: rounding to bytes, activations, array arithmetic, deterministic draws."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize_u8(x: Column) -> Column:
    """Saturated to 0..255, halves to even; NaN and null become 0."""
    fine = F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(255.0), fine))).cast("smallint")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where it is used for each element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def gelu_tanh(x: Column) -> Column:
    """The published tanh form of GELU."""
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


#: The error function differs from 1 by less than a double can hold from here on.
ERF_FLAT = 6.0


@functools.cache
def erf_terms(degree: int = 24) -> tuple[float, ...]:
    """Coefficients, lowest first, of log(erfc(a) / t) + a^2 as a polynomial of s, for 0 <= a <= ERF_FLAT.

    t = 2 / (2 + a), and s is t moved to -1..1. Interpolated at the Chebyshev nodes, so the error is
    about that of rounding.
    """
    low = 2 / (2 + ERF_FLAT)

    def value(s: np.ndarray) -> np.ndarray:
        t = (low + 1) / 2 + s * (1 - low) / 2
        return np.array([math.log(math.erfc(2 / x - 2) / x) + (2 / x - 2) ** 2 for x in t])

    return tuple(np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebinterpolate(value, degree)))


def erf(x: Column) -> Column:
    """The error function, within 1e-12; null for null and NaN for NaN."""
    low, a = 2 / (2 + ERF_FLAT), F.abs(x)
    t = 2 / (2 + a)
    s = (2 * t - (low + 1)) / (1 - low)
    log_rest = functools.reduce(lambda sum_, c: sum_ * s + F.lit(c), reversed(erf_terms()[:-1]), F.lit(erf_terms()[-1]))
    return F.signum(x) * F.when(a < ERF_FLAT, 1 - t * F.exp(log_rest - a * a)).otherwise(1.0)


def erf_sql(x: str) -> str:
    """The same in SQL; ``x`` is a column's name."""
    low, t = 2 / (2 + ERF_FLAT), f"(2 / (2 + abs({x})))"
    s = f"((2 * {t} - {low + 1!r}) / {1 - low!r})"
    log_rest = functools.reduce(lambda sum_, c: f"({sum_} * {s} + {c!r}::DOUBLE)", map(float, reversed(erf_terms()[:-1])), f"{float(erf_terms()[-1])!r}::DOUBLE")
    return f"(sign({x}) * CASE WHEN abs({x}) < {ERF_FLAT} THEN 1 - {t} * exp({log_rest} - {x} * {x}) ELSE 1 END)"


def erf_inverse(y: Column) -> Column:
    """The x whose error function is ``y``: a closed first guess and three steps of Halley's rule.

    Infinite at -1 and 1, NaN beyond. Within 1e-9 of x for abs(y) up to 1 - 1e-8; nearer to 1 the error
    is that of ``y`` as a double.
    """
    shape = 0.147  # fixed value of the published first guess
    log_rest = F.log((1 - y) * (1 + y))
    middle = 2 / (math.pi * shape) + log_rest / 2
    guess = F.signum(y) * F.sqrt(F.greatest(F.sqrt(middle * middle - log_rest / shape) - middle, F.lit(0.0)))

    def step(x: Column) -> Column:
        return let((erf(x) - y) / (2 / math.sqrt(math.pi) * F.exp(-x * x)), lambda u: x - u / (1 + x * u))

    found = let(let(let(guess, step), step), step)
    return F.when(F.abs(y) < 1, found).when(F.abs(y) == 1, F.signum(y) * F.lit(float("inf"))).when(y.isNotNull(), F.lit(float("nan")))


def gelu(x: Column) -> Column:
    """GELU by the error function."""
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def truncated_normal(u: Column, mean: float = 0.0, deviation: float = 1.0, low: float = -2.0, high: float = 2.0) -> Column:
    """A normal value between ``low`` and ``high`` from ``u``, which is uniform in 0..1."""
    below, above = (math.erf((edge - mean) / (deviation * math.sqrt(2))) for edge in (low, high))
    return F.greatest(F.lit(low), F.least(F.lit(high), mean + deviation * math.sqrt(2) * erf_inverse(below + u * (above - below))))


def argmax(x: Column) -> Column:
    """Place of the largest value from 0, the first on ties; null for an empty or null array."""
    place = F.array_position(x, F.array_max(x)) - 1
    return F.when(place >= 0, place).cast("int")


def cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log-likelihood by log-sum-exp, shifted by the largest logit."""
    return let(F.array_max(logits), lambda top: top + F.log(total(F.transform(logits, lambda v: F.exp(v - top))))) - F.element_at(logits, label.cast("int") + 1)


def draw(*parts: Column | str) -> Column:
    """A whole number below 2**32 out of the MD5 of the parts, the same on every engine."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str) -> Column:
    return draw(*parts) / F.lit(4294967296.0)
