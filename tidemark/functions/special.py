"""Special functions as columns: log-gamma and digamma by recurrence up to SHIFT and the asymptotic series from there, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8

# Bernoulli numbers B(2k) over 2k(2k - 1), of the series of log-gamma, and over 2k, of that of digamma.
GAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
DIGAMMA_SERIES = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760)


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function; null for what isn't positive."""
    x = F.when(x > 0, x.cast("double"))
    y = x + SHIFT
    series = _sum([c / F.pow(y, 2 * k + 1) for k, c in enumerate(GAMMA_SERIES)])
    steps = F.log(x)
    for i in range(1, SHIFT):
        steps = steps + F.log(x + i)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - steps


def digamma(x: Column) -> Column:
    """The derivative of log-gamma; null for what isn't positive."""
    x = F.when(x > 0, x.cast("double"))
    y = x + SHIFT
    series = _sum([c / F.pow(y, 2 * k + 2) for k, c in enumerate(DIGAMMA_SERIES)])
    return F.log(y) - 0.5 / y - series - _sum([1 / (x + i) for i in range(SHIFT)])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def log_beta(alpha: Column) -> Column:
    """The logarithm of the multivariate beta function of an array."""
    return total(F.transform(alpha, log_gamma)) - log_gamma(total(alpha))


def dirichlet_divergence(q: Column, p: Column) -> Column:
    """KL divergence of a Dirichlet distribution with parameters p from one with q, arrays of equal length of positive numbers."""
    mean = digamma(total(q))
    return log_beta(p) - log_beta(q) + total(F.zip_with(q, p, lambda a, b: (a - b) * (digamma(a) - mean)))
