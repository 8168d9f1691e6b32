"""Published ellipsoidal Albers equal-area formulas (EPSG:5070 parameters) as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# EPSG:5070 / GRS80: fixed values of the coordinate system definition.
SEMI_MAJOR_M = 6378137.0
INVERSE_FLATTENING = 298.257222101
STANDARD_PARALLELS = (29.5, 45.5)
ORIGIN_LAT, ORIGIN_LON = 23.0, -96.0

_F = 1 / INVERSE_FLATTENING
_E2 = 2 * _F - _F * _F
_E = math.sqrt(_E2)


def _q_value(phi: float) -> float:
    s = math.sin(phi)
    return (1 - _E2) * (
        s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E)
    )


def _m_value(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - _E2 * math.sin(phi) ** 2)


_P1, _P2 = (math.radians(p) for p in STANDARD_PARALLELS)
N = (_m_value(_P1) ** 2 - _m_value(_P2) ** 2) / (_q_value(_P2) - _q_value(_P1))
C = _m_value(_P1) ** 2 + N * _q_value(_P1)
RHO0 = SEMI_MAJOR_M * math.sqrt(C - N * _q_value(math.radians(ORIGIN_LAT))) / N


def albers_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude / latitude in degrees to projected metres."""
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    rho = SEMI_MAJOR_M * F.sqrt(C - N * q) / N
    theta = N * F.radians(lon - ORIGIN_LON)
    return rho * F.sin(theta), RHO0 - rho * F.cos(theta)


def albers_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Projected metres back to degrees (series inverse, good to 1e-9 degrees)."""
    rho = F.sqrt(x * x + F.pow(RHO0 - y, F.lit(2.0)))
    theta = F.atan2(x, RHO0 - y)
    q = (C - F.pow(rho * N / SEMI_MAJOR_M, F.lit(2.0))) / N
    q_pole = 1 - (1 - _E2) / (2 * _E) * math.log((1 - _E) / (1 + _E))
    beta = F.asin(q / q_pole)
    e4, e6 = _E2**2, _E2**3
    phi = (
        beta
        + (_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
        + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta)
        + (761 * e6 / 45360) * F.sin(6 * beta)
    )
    return ORIGIN_LON + F.degrees(theta / N), F.degrees(phi)
