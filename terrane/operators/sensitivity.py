"""Quasi-random designs and variance-based sensitivity: direction numbers and exclusive-or as Columns.

A point is the exclusive-or of direction numbers chosen by the bits of its index's Gray code, so it is made where its
row is, in any order. Indices pair two halves of one design: each parameter of the first is swapped for the second's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32
#: Degree, coefficients and first direction numbers of the primitive polynomials of dimensions 2 to 10.
POLYNOMIALS = (
    (1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17)), (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19)),
)
MOST = len(POLYNOMIALS) + 1


def directions(dimension: int) -> list[int]:
    """The BITS direction numbers of a dimension, from 1, by its polynomial's recurrence."""
    if dimension == 1:
        return [1 << (BITS - 1 - i) for i in range(BITS)]
    if not 1 <= dimension <= MOST:
        raise ValueError(f"dimensions run from 1 to {MOST}")
    degree, coefficients, first = POLYNOMIALS[dimension - 2]
    v = [m << (BITS - 1 - i) for i, m in enumerate(first)]
    for i in range(degree, BITS):
        x = v[i - degree] ^ (v[i - degree] >> degree)
        for k in range(1, degree):
            if coefficients >> (degree - 1 - k) & 1:
                x ^= v[i - k]
        v.append(x)
    return v


def sobol(index: Column, dimension: int) -> Column:
    """Coordinate in [0, 1) of the point of this index, from 0, which is the origin; indices below 2 ** BITS."""
    gray = index.bitwiseXOR(F.shiftright(index, 1))
    out = F.lit(0).cast("long")
    for i, v in enumerate(directions(dimension)):
        out = out.bitwiseXOR(F.shiftright(gray, i).bitwiseAND(F.lit(1).cast("long")) * F.lit(v).cast("long"))
    return out / F.lit(float(1 << BITS))


def design(draws: DataFrame, index: str, names: list[str]) -> DataFrame:
    """(index, swapped, names...): for each draw a row of the first half (swapped null), one of the second (swapped '*'),
    and for each name the first with that parameter of the second. Names are MOST / 2 at most."""
    k = len(names)
    if 2 * k > MOST:
        raise ValueError(f"{k} parameters need {2 * k} dimensions; there are {MOST}")
    at = F.col(index).cast("long")
    points = draws.select(F.col(index), F.array(*[sobol(at, j + 1) for j in range(2 * k)]).alias("_p"))
    which = F.explode(F.array(F.lit(None).cast("string"), F.lit("*"), *[F.lit(n) for n in names])).alias("swapped")
    rows = points.select(index, "_p", which)
    value = lambda j, n: F.get("_p", F.lit(j) + F.when(F.coalesce(F.col("swapped").isin("*", n), F.lit(False)), k).otherwise(0)).alias(n)
    return rows.select(index, "swapped", *[value(j, n) for j, n in enumerate(names)])


def indices(results: DataFrame, index: str, result: str, names: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., parameter, first_order, total, n) from results (index, swapped, result) of a design.

    first_order is the share of the variance that a parameter explains alone, mean(B (AB - A)) / Var; total that with
    all it takes part in, mean((A - AB) ** 2) / 2 Var. One partial aggregate; nothing is collected. Draws whose results
    are not all there do not count. A variance of 0 gives nulls.
    """
    by = by or []
    per = F.max(F.when(F.col("swapped").isNull(), F.col(result))).alias("_a"), F.max(F.when(F.col("swapped") == "*", F.col(result))).alias("_b")
    swaps = [F.max(F.when(F.col("swapped") == n, F.col(result))).alias(f"_s{i}") for i, n in enumerate(names)]
    rows = results.groupBy(*by, index).agg(*per, *swaps).dropna(subset=["_a", "_b", *[f"_s{i}" for i in range(len(names))]])
    a, b = F.col("_a"), F.col("_b")
    sums = [F.avg(b * (F.col(f"_s{i}") - a)).alias(f"_f{i}") for i in range(len(names))] + [F.avg((a - F.col(f"_s{i}")) ** 2).alias(f"_t{i}") for i in range(len(names))]
    spread = ((F.var_pop("_a") + F.var_pop("_b")) / 2).alias("_v")
    wide = rows.groupBy(*by).agg(*sums, spread, F.count(F.lit(1)).alias("n")).filter("n > 0")
    share = lambda v: F.when(F.col("_v") > 0, v / F.when(F.col("_v") > 0, F.col("_v")))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), share(F.col(f"_f{i}")).alias("first_order"), share(F.col(f"_t{i}") / 2).alias("total")) for i, n in enumerate(names)])).alias("_e")
    return wide.select(*by, each, "n").select(*by, "_e.*", "n")
