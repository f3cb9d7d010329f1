"""Reference systems: geographic, Web Mercator and UTM, on numpy arrays.

Others need pyproj, which is used if it can be imported. Coordinates are (x, y), for
geographic systems (longitude, latitude).
"""

from __future__ import annotations

import numpy as np

from .tiles import ORIGIN

_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_K0 = 0.9996
#: The transverse Mercator series in the third flattening.
_FORWARD = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
_BACKWARD = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480]
_LATITUDE = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15]


def _code(crs: str) -> int | None:
    head, _, tail = crs.upper().partition(":")
    return int(tail) if head == "EPSG" and tail.isdigit() else None


def _utm(code: int) -> tuple[float, float] | None:
    zone = code % 100
    if code // 100 in (326, 327) and 1 <= zone <= 60:
        return np.radians(6 * zone - 183), 0.0 if code // 100 == 326 else 1e7
    return None


def to_lonlat(crs: str, x, y):
    code = _code(crs)
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    if code == 4326:
        return x, y
    if code == 3857:
        return x * (180 / ORIGIN), np.degrees(2 * np.arctan(np.exp(y * np.pi / ORIGIN)) - np.pi / 2)
    if code and (zone := _utm(code)):
        xi, eta = (y - zone[1]) / (_K0 * _RADIUS), (x - 5e5) / (_K0 * _RADIUS)
        xp = xi - sum(b * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, b in enumerate(_BACKWARD, 1))
        ep = eta - sum(b * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, b in enumerate(_BACKWARD, 1))
        chi = np.arcsin(np.sin(xp) / np.cosh(ep))
        lat = chi + sum(d * np.sin(2 * k * chi) for k, d in enumerate(_LATITUDE, 1))
        return np.degrees(zone[0] + np.arctan2(np.sinh(ep), np.cos(xp))), np.degrees(lat)
    return _other(crs, "EPSG:4326", x, y)


def from_lonlat(crs: str, lon, lat):
    code = _code(crs)
    lon, lat = np.asarray(lon, np.float64), np.asarray(lat, np.float64)
    if code == 4326:
        return lon, lat
    if code == 3857:
        with np.errstate(all="ignore"):
            return lon * (ORIGIN / 180), np.log(np.tan((90 + lat) * np.pi / 360)) * ORIGIN / np.pi
    if code and (zone := _utm(code)):
        s, e = np.sin(np.radians(lat)), 2 * np.sqrt(_N) / (1 + _N)
        t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
        d = np.radians(lon) - zone[0]
        xp, ep = np.arctan2(t, np.cos(d)), np.arctanh(np.sin(d) / np.sqrt(1 + t * t))
        xi = xp + sum(a * np.sin(2 * k * xp) * np.cosh(2 * k * ep) for k, a in enumerate(_FORWARD, 1))
        eta = ep + sum(a * np.cos(2 * k * xp) * np.sinh(2 * k * ep) for k, a in enumerate(_FORWARD, 1))
        return 5e5 + _K0 * _RADIUS * eta, zone[1] + _K0 * _RADIUS * xi
    return _other("EPSG:4326", crs, lon, lat)


def _other(source: str, target: str, x, y):
    try:
        from pyproj import Transformer
    except ImportError:
        raise ValueError(f"{source} to {target} needs pyproj") from None
    return Transformer.from_crs(source, target, always_xy=True).transform(x, y)


def transform(source: str, target: str, x, y):
    if _code(source) is not None and _code(source) == _code(target):
        return np.asarray(x, np.float64), np.asarray(y, np.float64)
    return from_lonlat(target, *to_lonlat(source, x, y))
