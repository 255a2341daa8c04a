"""Transverse Mercator and web Mercator as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80 and the parameters of the national grid.
A, FLATTENING = 6378137.0, 1 / 298.257222101
LON0, SCALE, EASTING, NORTHING = 19.0, 0.9993, 500000.0, -5300000.0

_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger's series to the fourth order of n.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
#: From the conformal to the geodetic latitude.
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def to_grid(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres of degrees."""
    phi, lam = F.radians(lat), F.radians(lon - LON0)
    t = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    north, east = xi, eta
    for j, a in enumerate(_ALPHA, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return EASTING + SCALE * _RADIUS * east, NORTHING + SCALE * _RADIUS * north


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) of grid metres."""
    xi, eta = (y - NORTHING) / (SCALE * _RADIUS), (x - EASTING) / (SCALE * _RADIUS)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.asin(F.sin(u) / F.cosh(v))
    phi = conformal
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * conformal)
    return LON0 + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(phi)


def to_web(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in web Mercator metres."""
    return A * F.radians(lon), A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def from_web(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) of web Mercator metres."""
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


def tile_box(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """Web Mercator box of an XYZ tile."""
    half = math.pi * A
    size = 2 * half / (1 << z)
    return -half + x * size, half - (y + 1) * size, -half + (x + 1) * size, half - y * size


def flip_row(z: int, row: int) -> int:
    """Tile row counted from the other side."""
    return (1 << z) - 1 - row
