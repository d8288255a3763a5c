"""Vectors as arrays of doubles: kernels as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm1(v: Column) -> Column:
    return total(F.transform(v, lambda x: F.abs(x.cast("double"))))


def _with(value: Column, body) -> Column:
    """The body with the value bound to a name, so that it is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def norm2(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    n = norm2(a) * norm2(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def combine(a: Column, b: Column, x: float = 1.0, y: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda p, q: x * p.cast("double") + y * q.cast("double"))


def product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double"))


def unit(v: Column) -> Column:
    """The zero vector stays what it is."""
    return _with(norm2(v), lambda n: F.transform(v, lambda x: F.when(n > 0, F.try_divide(x.cast("double"), n)).otherwise(0.0)))


def softmax(v: Column) -> Column:
    e = _with(F.array_max(v).cast("double"), lambda top: F.transform(v, lambda x: F.exp(x.cast("double") - top)))
    return _with(e, lambda e: _with(total(e), lambda s: F.transform(e, lambda x: x / s)))


def probabilities(v: Column) -> Column:
    """Shares of the sum; zeros where that is zero."""
    s = total(F.transform(v, lambda x: x.cast("double")))
    return _with(s, lambda s: F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), s), F.lit(0.0))))


def entropy(v: Column) -> Column:
    """Of a vector of probabilities, natural."""
    return -total(F.transform(v, lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0)))


def kl(a: Column, b: Column) -> Column:
    """Over places where both are positive."""
    return total(F.zip_with(a, b, lambda p, q: F.when((p > 0) & (q > 0), p * F.log(p / q)).otherwise(0.0)))


def js(a: Column, b: Column) -> Column:
    m = F.zip_with(a, b, lambda p, q: (p + q) / 2)
    return (kl(a, m) + kl(b, m)) / 2


def geometric_mean(v: Column) -> Column:
    return F.exp(total(F.transform(v, lambda x: F.log(x.cast("double")))) / F.size(v))


def clip(v: Column, low: float, high: float) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x.cast("double"))))


ACTIVATIONS = {
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)), "tanh": F.tanh, "relu": lambda x: F.greatest(x, F.lit(0.0)), "leaky_relu": lambda x: F.when(x > 0, x).otherwise(0.01 * x),
    "softsign": lambda x: x / (1 + F.abs(x)), "hard_sigmoid": lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.2 * x + 0.5)), "hard_tanh": lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)),
}


def activate(v: Column, name: str) -> Column:
    return F.transform(v, lambda x: ACTIVATIONS[name](x.cast("double")))


def cumulate(v: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: total(F.transform(F.slice(v, 1, i), lambda x: x.cast("double"))))


def arg_max(v: Column) -> Column:
    """The place (from 0) of the first greatest value."""
    return F.array_position(v, F.array_max(v)) - 1


def ranked_places(v: Column) -> Column:
    """Places in order of falling values."""
    pairs = F.transform(v, lambda x, i: F.struct((-x.cast("double")).alias("v"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of a 2 x 2 table of counts."""
    n = a + b + c + d
    under = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(under > 0, n * F.pow(a * d - b * c, F.lit(2.0)) / under).otherwise(0.0)


def pmi(xy: Column, x: Column, y: Column, normalized: bool = False) -> Column:
    """Of probabilities; minus infinity (normalised: -1) where one is outside (0, 1]."""
    valid = xy.between(1e-300, 1.0) & x.between(1e-300, 1.0) & y.between(1e-300, 1.0)
    value = F.log(xy) - F.log(x) - F.log(y)
    return F.when(valid, value / -F.log(xy) if normalized else value).otherwise(-1.0 if normalized else float("-inf"))


def gaussian(x: Column, mean: float = 0.0, sigma: float = 1.0) -> Column:
    import math

    return F.exp(-F.pow((x - mean) / sigma, F.lit(2.0)) / 2) / (sigma * math.sqrt(2 * math.pi))


def heaps(n: Column, k: float, beta: float) -> Column:
    return k * F.pow(n, F.lit(beta))


def zipf(rank: Column, total_: Column, s: float = 1.0) -> Column:
    return total_ / F.pow(rank, F.lit(s))


def log_gamma(x: Column) -> Column:
    """Stirling's series after eight steps of the recurrence."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    for k in range(8):
        series = series - F.log(x + float(k))
    return series


def log_combination(n: Column, k: Column) -> Column:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def log_binomial(n: Column, k: Column, p: Column) -> Column:
    return log_combination(n, k) + k * F.log(p) + (n - k) * F.log(1 - p)
