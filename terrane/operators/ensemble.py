"""Draws for Monte Carlo runs: parameters, macro states and correlated chances of projects, all by hashes of a seed, so a
draw does not depend on how many others there are. Correlation matrices of a few factors stay on the driver."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import normal
from terrane.params import Params
from terrane.sources.ship import ship_package


def correlation(groups: list[str], same: float, macro: float) -> np.ndarray:
    """Correlations of projects (same within a group) and one macro factor, made positive definite."""
    n = len(groups)
    out = np.eye(n + 1)
    for i in range(n):
        out[i, n] = out[n, i] = macro
        for j in range(n):
            if i != j and groups[i] == groups[j]:
                out[i, j] = same
    return nearest_pd(out)


def nearest_pd(m: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """Eigenvalues raised to a floor, diagonal back to 1."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    if values.min() > floor:
        return m
    fixed = vectors @ np.diag(np.maximum(values, floor)) @ vectors.T
    d = np.sqrt(np.diag(fixed))
    return fixed / np.outer(d, d)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def beta_quantile(u: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < u else (low, mid)
    return (low + high) / 2


def child_seed(seed: int, *labels: object) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, (seed, *labels))).encode()).digest()[:8], "big")


def parameter_draws(draws: DataFrame, p: Params, paths: list[str], seed: int, draw: str = "draw") -> DataFrame:
    """draws with a column for each path (dots as underscores): uniform between a leaf's bounds, else its value.

    A draw's numbers depend on the seed, the draw and the path alone.
    """
    cols = []
    for path in paths:
        leaf = p.leaf(path)
        low, high = leaf.get("low"), leaf.get("high")
        value = F.lit(float(p.value(path))) if low is None or high is None else float(low) + (float(high) - float(low)) * normal.uniform(seed, path, F.col(draw).cast("long"))
        cols.append(value.alias(path.replace(".", "_")))
    return draws.select("*", *cols)


def macro_draws(draws: DataFrame, seed: int, rho: float = -0.3, shares: dict[str, float] | None = None, draw: str = "draw") -> DataFrame:
    """draws with z_phi and z_eta, standard normals that correlate, and macro, a category by its shares."""
    shares = shares or {"base": 0.6, "bull": 0.2, "bear": 0.2}
    d = F.col(draw).cast("long")
    z1, z2 = (normal.quantile(normal.uniform(seed, tag, d)) for tag in ("phi", "eta"))
    u, upto, name = normal.uniform(seed, "macro", d), 0.0, None
    for k, share in shares.items():
        upto += share / sum(shares.values())
        name = F.when(u < upto, k) if name is None else name.when(u < upto, k)
    return draws.select("*", z1.alias("z_phi"), (rho * z1 + math.sqrt(1 - rho * rho) * z2).alias("z_eta"), name.otherwise(list(shares)[-1]).alias("macro"))


def mode_shares(draws: DataFrame, p: Params, seed: int, draw: str = "draw") -> DataFrame:
    """draws with share_<mode>, drawn between the leaves' bounds and divided by their sum."""
    modes = sorted({path.rpartition(".")[2] for path in p.paths("access.mode_share")})
    rows = parameter_draws(draws, p, [f"access.mode_share.{m}" for m in modes], seed, draw)
    total = sum((F.col(f"access_mode_share_{m}") for m in modes), F.lit(0.0))
    return rows.select(*draws.columns, *[(F.col(f"access_mode_share_{m}") / total).alias(f"share_{m}") for m in modes])


def project_draws(projects: DataFrame, draws: DataFrame, seed: int, same: float = 0.5, public: float = 0.3, strength: float = 20.0) -> DataFrame:
    """(draw, project_id, p): Beta quantiles of correlated normals, for projects (project_id, announcer_id, is_public,
    p_completion) and draws (draw).

    Scores are sums of factors that hashes give: one of all public projects, one of each announcer, one of the project;
    so projects of one announcer correlate by same, public ones by public, and public ones of one announcer by same. A
    private and a public project of one announcer correlate by sqrt(same * (same - public)). Nothing is collected; a
    project's chances do not depend on which others there are.
    """
    c = F.col
    d = c("draw").cast("long")
    z = lambda *labels: normal.quantile(normal.uniform(seed, *labels))
    w_public = F.when(c("is_public"), math.sqrt(public)).otherwise(0.0)
    w_announcer = F.when(c("announcer_id").isNull(), 0.0).when(c("is_public"), math.sqrt(max(same - public, 0.0))).otherwise(math.sqrt(same))
    rows = projects.select("project_id", "announcer_id", "is_public", F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), c("p_completion"))).alias("_m")).join(draws.select("draw"))
    announcer = z("announcer", c("announcer_id").cast("string"), d)
    score = w_public * z("public", d) + w_announcer * F.coalesce(announcer, F.lit(0.0)) + F.sqrt(1 - w_public * w_public - w_announcer * w_announcer) * z("project", c("project_id").cast("string"), d)
    rows = rows.select("draw", "project_id", normal.cdf(score).alias("u"), (c("_m") * strength).alias("a"), ((1 - c("_m")) * strength).alias("b"))

    def chances(batches):
        for part in batches:
            yield part.drop(columns=["u", "a", "b"]).assign(p=beta_quantiles(part["u"].to_numpy(float), part["a"].to_numpy(float), part["b"].to_numpy(float)))

    ship_package(projects.sparkSession)
    return rows.mapInPandas(chances, f"draw {dict(rows.dtypes)['draw']}, project_id {dict(rows.dtypes)['project_id']}, p double")


def beta_quantiles(u: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Beta quantiles of whole arrays, by halving an interval on the regularised incomplete beta function."""
    low, high = np.zeros_like(u), np.ones_like(u)
    for _ in range(50):
        mid = (low + high) / 2
        below = beta_cdfs(mid, a, b) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def beta_cdfs(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of arrays, by its continued fraction."""
    turned = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b) + a * np.log(inside) + b * np.log1p(-inside)) / a
    safe = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 200):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / safe(1 + top * d)
            c = safe(1 + top / c)
            out *= c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    value = np.where(x <= 0, 0.0, front * out)
    return np.where(turned, 1 - value, value)
