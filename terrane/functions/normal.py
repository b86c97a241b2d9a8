"""The normal distribution as Columns, and uniforms that depend on a seed and labels alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational approximations of the distribution function (Hart) and its inverse (Acklam).
TOP = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
BOTTOM = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041432e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
ROOT_2PI = 2.5066282746310002
LOW = 0.02425


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for k in coefficients[1:]:
        out = out * x + k
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: a lambda's variable, which is not written out at each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def cdf(x: Column) -> Column:
    """P(Z <= x), to about 1e-15."""

    def of(x: Column) -> Column:
        return let(F.struct(F.abs(x).alias("a"), F.exp(-x * x / 2).alias("e")), lambda s: _tail(x, s["a"], s["e"]))

    return let(x.cast("double"), of)


def _tail(x: Column, a: Column, e: Column) -> Column:
    far = a + 0.65
    for k in (4, 3, 2, 1):
        far = a + k / far
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, e * _horner(a, TOP) / _horner(a, BOTTOM)).otherwise(e / far / ROOT_2PI)
    return let(tail, lambda t: F.when(x.isNotNull(), F.when(x > 0, 1 - t).otherwise(t)))


def quantile(p: Column) -> Column:
    """x with P(Z <= x) = p: a rational approximation and one step of Halley's method; null outside (0, 1)."""

    def first(q: Column) -> Column:
        tail = let(F.sqrt(-2 * F.ln(F.least(q, 1 - q))), lambda s: _horner(s, C) / _horner(s, D))
        middle = let(q - 0.5, lambda m: m * let(m * m, lambda r: _horner(r, A) / _horner(r, B)))
        return F.when(q < LOW, tail).when(q > 1 - LOW, -tail).otherwise(middle)

    def better(q: Column, x: Column) -> Column:
        return let((cdf(x) - q) * ROOT_2PI * F.exp(x * x / 2), lambda u: x - u / (1 + x * u / 2))

    return let(F.when((p > 0) & (p < 1), p.cast("double")), lambda q: F.when(q.isNotNull(), let(first(q), lambda x: better(q, x))))


def uniform(seed: int, *labels: Column | str) -> Column:
    """A number in (0, 1) from a seed and labels: reruns and other partitionings agree."""
    h = F.xxhash64(F.lit(seed).cast("long"), *[F.lit(x) if isinstance(x, str) else x for x in labels])
    return (F.shiftrightunsigned(h, 12) + 0.5) / float(1 << 52)


def uniform_by_text(seed: int, *labels: Column | str) -> Column:
    """As uniform(), by the MD5 of the labels' text, which engines with other hashes repeat."""
    said = F.concat_ws("|", F.lit(str(seed)), *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in labels])
    return (F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
