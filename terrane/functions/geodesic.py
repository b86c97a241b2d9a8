"""Geodesic distance on WGS84 by Vincenty's inverse formula, over numpy arrays and as an Arrow pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.functions.scalar import WGS84_A, WGS84_F
from terrane.sources.ship import ship_package


def geodesic_m(lon1, lat1, lon2, lat2, rounds: int = 60) -> np.ndarray:
    """Metres between points in degrees. Nearly antipodal points may not settle and come back as NaN."""
    lam_d = np.radians(np.asarray(lon2, float) - np.asarray(lon1, float))
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = (np.arctan((1 - WGS84_F) * np.tan(np.radians(np.asarray(x, float)))) for x in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = lam_d.copy() if lam_d.ndim else np.array(lam_d)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            ss = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
            cs = s1 * s2 + c1 * c2 * np.cos(lam)
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * np.sin(lam) / ss, 0.0)
            ca = 1 - sa * sa
            mid = np.where(ca > 0, cs - 2 * s1 * s2 / ca, 0.0)
            k = WGS84_F / 16 * ca * (4 + WGS84_F * (4 - 3 * ca))
            new = lam_d + (1 - k) * WGS84_F * sa * (sigma + k * ss * (mid + k * cs * (2 * mid * mid - 1)))
            off, lam = np.abs(new - lam), new
            if np.all(off < 1e-13):
                break
        uu = ca * (WGS84_A**2 - b * b) / (b * b)
        big = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
        small = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
        d = small * ss * (mid + small / 4 * (cs * (2 * mid * mid - 1) - small / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)))
        return np.where(off < 1e-9, b * big * (sigma - d), np.nan)


def with_geodesic(df: DataFrame, lon1: str, lat1: str, lon2: str, lat2: str, out: str = "metres") -> DataFrame:
    """Adds the distance to every row, in Arrow batches."""
    at = [df.columns.index(c) for c in (lon1, lat1, lon2, lat2)]

    def run(batches):
        for batch in batches:
            d = geodesic_m(*(batch.column(i).to_numpy(zero_copy_only=False) for i in at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d)], [*batch.schema.names, out])

    ship_package(df.sparkSession)
    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` double")
