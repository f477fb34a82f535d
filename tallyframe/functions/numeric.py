"""Guarded arithmetic, link functions and count likelihoods as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, null unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def logit(probability: Column, epsilon: float = 1e-12) -> Column:
    p = clip(probability, epsilon, 1.0 - epsilon)
    return F.log(p / (1.0 - p))


def logistic(value: Column) -> Column:
    """1 / (1 + e^-x) through the negative branch only, so neither tail overflows."""
    decay = F.exp(-F.abs(value))
    return F.when(value >= 0, 1.0 / (1.0 + decay)).otherwise(decay / (1.0 + decay))


def harmonic(left: Column, right: Column) -> Column:
    """Harmonic exposure 2ab/(a+b); zero when either side has none."""
    return F.when((left > 0) & (right > 0), 2.0 * left * right / (left + right)).otherwise(F.lit(0.0))


def bit_code(*flags: Column) -> Column:
    """Sum of 2^i over the flags that hold; null flags count as unset."""
    code = F.lit(0).cast("bigint")
    for position, flag in enumerate(flags):
        code = code + F.when(flag, F.lit(1 << position)).otherwise(F.lit(0))
    return code


def log_gamma(value: Column) -> Column:
    """ln(Gamma(x)) for x > 0: shift x up by eight, then Stirling's series to the x^-7 term."""
    shift = 8
    product = value
    for step in range(1, shift):
        product = product * (value + step)
    z = value + shift
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def negative_binomial_logpmf(count: Column, mean: Column, dispersion: float) -> Column:
    """Log probability of a count under mean ``mean`` and variance mean + dispersion * mean^2."""
    size = 1.0 / dispersion
    probability = size / (size + mean)
    return (
        log_gamma(count + size)
        - log_gamma(F.lit(size))
        - log_gamma(count + 1.0)
        + size * F.log(probability)
        + count * F.log1p(-probability)
    )
