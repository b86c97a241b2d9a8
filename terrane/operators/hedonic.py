"""Spatial hedonic price models: OLS from one Gram aggregate, lag and error tests on k-nearest-neighbour weights."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ols(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(coefficients, (X'X)^-1, residual variance, n), intercept first; sums over the rows, algebra here."""
    cols = [F.lit(1.0), *map(F.col, xs), F.col(y)]
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = df.dropna(subset=[y, *xs]).agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    m = np.zeros((k, k))
    for i, j in pairs:
        m[i, j] = m[j, i] = got[f"s{i}_{j}"] or 0.0
    inverse = np.linalg.pinv(m[:-1, :-1])
    beta = inverse @ m[:-1, -1]
    n = int(m[0, 0])
    return beta, inverse, float((m[-1, -1] - beta @ m[:-1, -1]) / max(n, 1)), n


def lagged(df: DataFrame, weights: DataFrame, key: str, other: str, names: list[str]) -> DataFrame:
    """Weighted neighbour means of columns, as w_<name>: one join and one aggregate for all of them.

    The joins are merged, as files of few bytes may hold more rows than the driver can broadcast.
    """
    values = df.select(F.col(key).alias(other), *names)
    out = weights.join(values.hint("merge"), other).groupBy(key).agg(*[F.sum(F.col("weight") * F.col(n)).alias(f"w_{n}") for n in names])
    return df.join(out.hint("merge"), key, "left").fillna(0.0, [f"w_{n}" for n in names])


def lm_tests(df: DataFrame, weights: DataFrame, key: str, other: str, y: str, xs: list[str]) -> dict[str, float]:
    """Lagrange multiplier statistics for a spatial lag and a spatial error, with p-values (one degree of freedom)."""
    beta, inverse, s2, n = ols(df, y, xs)
    fit = sum((float(b) * F.col(x) for b, x in zip(beta[1:], xs)), F.lit(float(beta[0])))
    rows = df.withColumn("_fit", fit).withColumn("_e", F.col(y) - fit)
    rows = lagged(rows, weights, key, other, ["_e", y, "_fit"])
    cols = [F.lit(1.0), *map(F.col, xs)]
    sums = [F.sum(F.col("_e") * F.col("w__e")), F.sum(F.col("_e") * F.col(f"w_{y}")), F.sum(F.col("w__fit") ** 2), *[F.sum(F.col("w__fit") * x) for x in cols]]
    got = [float(v) for v in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    back = weights.select(F.col(key).alias("_o"), F.col(other).alias("_k"), F.col("weight").alias("_w"))
    both = weights.join(back, (F.col(key) == F.col("_k")) & (F.col(other) == F.col("_o")), "left")
    trace = float(both.agg(F.sum(F.col("weight") ** 2 + F.col("weight") * F.coalesce("_w", F.lit(0.0)))).first()[0])
    fx = np.array(got[3:])
    spread = got[2] - fx @ inverse @ fx
    error = (got[0] / s2) ** 2 / trace
    lag = (got[1] / s2) ** 2 / (spread / s2 + trace)
    p = lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2))
    robust_lag = (got[1] / s2 - got[0] / s2) ** 2 / max(spread / s2, 1e-12)
    robust_error = (got[0] / s2 - trace / (spread / s2 + trace) * got[1] / s2) ** 2 / max(trace * (1 - trace / (spread / s2 + trace)), 1e-12)
    return {"lm_lag": lag, "lm_error": error, "p_lag": p(lag), "p_error": p(error), "rlm_lag": robust_lag, "rlm_error": robust_error}


def moran_residuals(df: DataFrame, weights: DataFrame, key: str, other: str, y: str, xs: list[str]) -> dict[str, float]:
    """Moran's I of the least squares residuals, with its mean and deviation under no correlation, z and p.

    The moments come from traces of M W, M the residual maker: W and X are only ever summed over rows and links, so no
    matrix is larger than the number of regressors.
    """
    beta, inverse, s2, n = ols(df, y, xs)
    k = len(xs) + 1
    fit = sum((float(b) * F.col(x) for b, x in zip(beta[1:], xs)), F.lit(float(beta[0])))
    rows = df.withColumn("_e", F.col(y) - fit).withColumn("_one", F.lit(1.0))
    design = ["_one", *xs]
    rows = lagged(rows, weights, key, other, ["_e", *design])
    # W'X: what each row is to the rows that it is a neighbour of
    turned = weights.select(F.col(other).alias(key), F.col(key).alias(other), "weight")
    back = rows.select(F.col(key).alias(other), *design)
    sent = turned.join(back, other).groupBy(key).agg(*[F.sum(F.col("weight") * F.col(x)).alias(f"b_{x}") for x in design])
    rows = rows.join(sent, key, "left").fillna(0.0, [f"b_{x}" for x in design])
    cells = [(i, j) for i in range(k) for j in range(k)]
    kinds = {"xw": ("", "w_"), "ww": ("b_", "w_"), "gg": ("w_", "w_"), "bb": ("b_", "b_")}
    sums = [F.sum(F.col(f"{a}{design[i]}") * F.col(f"{b}{design[j]}")).alias(f"{name}{i}_{j}") for name, (a, b) in kinds.items() for i, j in cells]
    got = rows.agg(F.sum(F.col("_e") * F.col("w__e")).alias("ewe"), F.sum(F.col("_e") ** 2).alias("ee"), *sums).first()
    m = {name: np.array([[float(got[f"{name}{i}_{j}"]) for j in range(k)] for i in range(k)]) for name in kinds}
    mutual = weights.join(turned.withColumnRenamed("weight", "_w"), [key, other], "left").agg(F.sum("weight").alias("s0"), F.sum(F.col("weight") ** 2).alias("sq"), F.sum(F.col("weight") * F.coalesce("_w", F.lit(0.0))).alias("ab")).first()
    s0, sq, ab = (float(v) for v in mutual)
    a = inverse @ m["xw"]  # (X'X)^-1 X'WX
    first = -np.trace(a)
    both = sq - np.trace(inverse @ (m["gg"] + m["bb"])) + np.trace(a @ inverse @ m["xw"].T)  # tr(M W M W')
    same = ab - 2 * np.trace(inverse @ m["ww"]) + np.trace(a @ a)  # tr(M W M W)
    free = n - k
    value = n / s0 * float(got["ewe"]) / float(got["ee"])
    mean = n / s0 * first / free
    spread = (n / s0) ** 2 * (both + same + first**2) / (free * (free + 2)) - mean**2
    z = (value - mean) / math.sqrt(spread)
    return {"moran_i": value, "mean": mean, "deviation": math.sqrt(spread), "z": z, "p": math.erfc(abs(z) / math.sqrt(2))}


def standard_errors(inverse: np.ndarray, s2: float, n: int) -> np.ndarray:
    """Of least squares coefficients, from (X'X)^-1 and the mean squared residual."""
    return np.sqrt(np.diag(inverse) * s2 * n / max(n - len(inverse), 1))


def choose(tests: dict[str, float], alpha: float = 0.05) -> str:
    """ols, lag or error: the significant one, or of two the one with the larger robust statistic."""
    lag, error = tests["p_lag"] < alpha, tests["p_error"] < alpha
    if lag and error:
        return "lag" if tests["rlm_lag"] >= tests["rlm_error"] else "error"
    return "lag" if lag else "error" if error else "ols"


def fit_lag(df: DataFrame, weights: DataFrame, key: str, other: str, y: str, xs: list[str]) -> dict[str, float]:
    """Two-stage least squares with WX as instruments for Wy; total effects are coefficients / (1 - rho)."""
    rows = lagged(df, weights, key, other, [y, *xs])
    first, *_ = ols(rows, f"w_{y}", [*xs, *(f"w_{x}" for x in xs)])
    names = [*xs, *(f"w_{x}" for x in xs)]
    rows = rows.withColumn("_wy", sum((float(b) * F.col(x) for b, x in zip(first[1:], names)), F.lit(float(first[0]))))
    beta, inverse, _, n = ols(rows, y, [*xs, "_wy"])
    rho = float(beta[-1])
    # residuals are those of Wy itself, with unequal variances allowed for
    miss = F.col(y) - float(beta[0]) - rho * F.col(f"w_{y}") - sum((float(b) * F.col(x) for b, x in zip(beta[1:], xs)), F.lit(0.0))
    z = [F.lit(1.0), *map(F.col, xs), F.col("_wy")]
    k = len(z)
    got = rows.withColumn("_u2", miss * miss).agg(*[F.sum(F.col("_u2") * z[i] * z[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(k)]).first()
    meat = np.array([[float(got[f"s{i}_{j}"]) for j in range(k)] for i in range(k)])
    errors = np.sqrt(np.diag(inverse @ meat @ inverse))
    said = {"se_intercept": float(errors[0]), "se_rho": float(errors[-1])} | {f"se_{x}": float(v) for x, v in zip(xs, errors[1:])}
    return said | {"rho": rho, "intercept": float(beta[0])} | {x: float(b) for x, b in zip(xs, beta[1:])} | {f"total_{x}": float(b) / (1 - rho) for x, b in zip(xs, beta[1:])}


def fit_error(df: DataFrame, weights: DataFrame, key: str, other: str, y: str, xs: list[str]) -> dict[str, float]:
    """Spatial error model by moments: lambda from those of the residuals and their first two lags, then least squares
    on y - lambda Wy and X - lambda WX. Sums are over the rows, algebra here."""
    beta, _, _, n = ols(df, y, xs)
    fit = sum((float(b) * F.col(x) for b, x in zip(beta[1:], xs)), F.lit(float(beta[0])))
    rows = lagged(df.withColumn("_e", F.col(y) - fit), weights, key, other, ["_e"])
    rows = lagged(rows, weights, key, other, ["w__e"])
    u, v, w = F.col("_e"), F.col("w__e"), F.col("w_w__e")
    got = rows.agg(*[F.sum(a * b).alias(f"s{i}") for i, (a, b) in enumerate(((u, u), (u, v), (v, v), (w, v), (w, w), (u, w)))]).first()
    uu, uv, vv, wv, ww, uw = (float(x or 0.0) / n for x in got)
    trace = float(weights.agg(F.sum(F.col("weight") ** 2)).first()[0]) / n
    # the three moments: what lambda and the variance should make of them
    left = np.array([[2 * uv, -vv, 1.0], [2 * wv, -ww, trace], [uw + vv, -wv, 0.0]])
    right = np.array([uu, vv, uv])

    def loss(lam: float) -> float:
        base = left[:, 0] * lam + left[:, 1] * lam * lam
        s2 = max(float(left[:, 2] @ (right - base) / (left[:, 2] @ left[:, 2])), 0.0)
        miss = base + left[:, 2] * s2 - right
        return float(miss @ miss)

    lam, width = 0.0, 0.99
    for _ in range(40):  # a finer grid about the best point each time
        grid = np.clip(np.linspace(lam - width, lam + width, 21), -0.99, 0.99)
        lam, width = float(grid[np.argmin([loss(float(g)) for g in grid])]), width / 4
    rows = lagged(df, weights, key, other, [y, *xs])
    turned = rows.select((F.col(y) - lam * F.col(f"w_{y}")).alias("_y"), *[(F.col(x) - lam * F.col(f"w_{x}")).alias(x) for x in xs])
    beta, inverse, _, n = ols(turned, "_y", xs)
    z = [F.lit(1.0), *map(F.col, xs)]
    u2 = (F.col("_y") - float(beta[0]) - sum((float(b) * F.col(x) for b, x in zip(beta[1:], xs)), F.lit(0.0))) ** 2
    got = turned.dropna().withColumn("_u2", u2).agg(*[F.sum(F.col("_u2") * z[i] * z[j]).alias(f"s{i}_{j}") for i in range(len(z)) for j in range(len(z))]).first()
    meat = np.array([[float(got[f"s{i}_{j}"]) for j in range(len(z))] for i in range(len(z))])
    errors = np.sqrt(np.diag(inverse @ meat @ inverse))  # unequal variances allowed for
    said = {"se_intercept": float(errors[0]) / (1 - lam)} | {f"se_{x}": float(v) for x, v in zip(xs, errors[1:])}
    # weights that sum to one turn the constant into 1 - lambda of itself
    return said | {"lambda": lam, "intercept": float(beta[0]) / (1 - lam)} | {x: float(b) for x, b in zip(xs, beta[1:])} | {f"total_{x}": float(b) for x, b in zip(xs, beta[1:])}


def hedonic(df: DataFrame, weights: DataFrame, key: str, other: str, y: str, xs: list[str], alpha: float = 0.05) -> dict[str, object]:
    """The model that the tests choose, fitted, with the tests."""
    tests = lm_tests(df, weights, key, other, y, xs)
    model = choose(tests, alpha)
    if model == "ols":
        beta, inverse, s2, n = ols(df, y, xs)
        errors = standard_errors(inverse, s2, n)
        fitted = {"se_intercept": float(errors[0])} | {f"se_{x}": float(v) for x, v in zip(xs, errors[1:])} | {"intercept": float(beta[0])} | {x: float(b) for x, b in zip(xs, beta[1:])} | {f"total_{x}": float(b) for x, b in zip(xs, beta[1:])}
    else:
        fitted = (fit_lag if model == "lag" else fit_error)(df, weights, key, other, y, xs)
    return {"model": model, **fitted, **tests}
