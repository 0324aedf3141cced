"""Column expressions over vectors, portable random numbers and comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm2(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x)


def norm(a) -> Column:
    return F.sqrt(norm2(a))


def distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x - y), F.lit(0.0), lambda s, x: s + x * x))


def pnorm(a, p: float | None) -> Column:
    """p-norm of a vector column; None is the largest absolute value."""
    a = _c(a)
    if p is None:
        return F.array_max(F.transform(a, F.abs))
    return F.pow(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x), F.lit(float(p)))), F.lit(1.0 / p))


def uniform(seed, step, ident) -> Column:
    """A number in (0, 1) that depends on seed, step and id alone; other engines get it from md5 too."""
    parts = [F.lit(str(x)) if isinstance(x, (int, str)) else x.cast("string") for x in (seed, step)]
    digits = F.substring(F.md5(F.concat_ws(":", *parts, _c(ident).cast("string"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def gauss(seed, step, ident) -> Column:
    """A standard normal number from two uniform ones."""
    u, v = uniform(seed, step, ident), uniform(seed, F.concat(F.lit("v"), F.lit(str(step)) if isinstance(step, (int, str)) else step.cast("string")), ident)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def isclose(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    a, b = _c(a), _c(b)
    return F.abs(a - b) <= atol + rtol * F.abs(b)
