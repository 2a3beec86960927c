"""Projection between longitude/latitude and UTM, pixel indices and boxes, as plain Column arithmetic.

The transverse Mercator mapping is the Krueger series to third order in the
third flattening; everything stays inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 ellipsoid and UTM scale.
A, INV_F, K0, E0 = 6378137.0, 298.257223563, 0.9996, 500000.0
_N = (1 / INV_F) / (2 - 1 / INV_F)
RADIUS = K0 * A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
ECC = 2 * math.sqrt(_N) / (1 + _N)


def meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def _conformal(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Tangent of the conformal latitude and the angle from the zone's meridian."""
    s = F.sin(F.radians(lat))
    return F.sinh(F.atanh(s) - ECC * F.atanh(ECC * s)), F.radians(lon - meridian(zone))


def _sphere(t: Column, d: Column) -> tuple[Column, Column]:
    return F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))


def _plane(xi: Column, eta: Column, south: bool) -> tuple[Column, Column]:
    x = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    y = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    return E0 + RADIUS * x, (1e7 if south else 0.0) + RADIUS * y


def to_utm(lon: Column, lat: Column, zone: int = 34, south: bool = True) -> tuple[Column, Column]:
    """Easting and northing in metres (G1) as two columns; for a whole table ``with_utm`` has the smaller plan."""
    return _plane(*_sphere(*_conformal(lon, lat, zone)), south)


def with_utm(df: DataFrame, lon: str, lat: str, easting: str = "e", northing: str = "n", zone: int = 34, south: bool = True) -> DataFrame:
    """``df`` with easting and northing (G1).

    The steps of the series are projections of their own, so that each is written
    and computed once instead of wherever the next one uses it.
    """
    steps = dict(zip(("_t", "_d"), _conformal(F.col(lon), F.col(lat), zone), strict=True))
    out = df.withColumns(steps).withColumns(dict(zip(("_xi", "_eta"), _sphere(F.col("_t"), F.col("_d")), strict=True)))
    ends = zip((easting, northing), _plane(F.col("_xi"), F.col("_eta"), south), strict=True)
    return out.withColumns(dict(ends)).drop("_t", "_d", "_xi", "_eta")


def _series(easting: Column, northing: Column, south: bool) -> tuple[Column, Column]:
    xi0, eta0 = (northing - (1e7 if south else 0.0)) / RADIUS, (easting - E0) / RADIUS
    xi = xi0 - sum(b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0) for j, b in enumerate(BETA, 1))
    eta = eta0 - sum(b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0) for j, b in enumerate(BETA, 1))
    return xi, eta


def _angles(xi: Column, eta: Column) -> tuple[Column, Column]:
    """Conformal latitude and the angle from the zone's meridian."""
    return F.asin(F.sin(xi) / F.cosh(eta)), F.atan2(F.sinh(eta), F.cos(xi))


def _degrees(chi: Column, lam: Column, zone: int) -> tuple[Column, Column]:
    return meridian(zone) + F.degrees(lam), F.degrees(chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(DELTA, 1)))


def from_utm(easting: Column, northing: Column, zone: int = 34, south: bool = True) -> tuple[Column, Column]:
    """Longitude and latitude in degrees (G2) as two columns; for arrays of points ``points_from_utm`` has the smaller plan."""
    return _degrees(*_angles(*_series(easting, northing, south)), zone)


def points_from_utm(points: Column, zone: int = 34, south: bool = True) -> Column:
    """Array of (x, y) in metres as (lon, lat); each step of the series is a pass of its own, so that nothing is written out twice."""
    pair = lambda v, names: F.struct(*[c.alias(n) for c, n in zip(v, names, strict=True)])
    out = F.transform(points, lambda p: pair(_series(p["x"], p["y"], south), ("xi", "eta")))
    out = F.transform(out, lambda p: pair(_angles(p["xi"], p["eta"]), ("chi", "lam")))
    return F.transform(out, lambda p: pair(_degrees(p["chi"], p["lam"], zone), ("lon", "lat")))


def pixel_index(easting: Column, northing: Column, origin_x: Column, pixel_w: Column, origin_y: Column, pixel_h: Column) -> tuple[Column, Column]:
    """Pixel column and row, truncated toward zero."""
    return ((easting - origin_x) / pixel_w).cast("int"), ((northing - origin_y) / pixel_h).cast("int")


def fits_patch(x: Column, y: Column, width: Column, height: Column, half: int) -> Column:
    """Whether a patch of ``2 * half`` pixels around (x, y) lies inside (P10)."""
    return (x >= half) & (x < width - half) & (y >= half) & (y < height - half)


def inside_tile(x: Column, y: Column, patch: int, size: int = 64) -> Column:
    """Strictly inside a tile's border."""
    return (x > patch) & (x < size - patch) & (y > patch) & (y < size - patch)


def in_box(lat: Column, lon: Column, box: Column) -> Column:
    """Point in a box struct with lat_min, lat_max, lon_min, lon_max, ends included."""
    return lat.between(box["lat_min"], box["lat_max"]) & lon.between(box["lon_min"], box["lon_max"])


def coord_key(lat: Column, lon: Column, digits: int = 5) -> Column:
    """Rounded coordinates as one key (P8); halves round up, away from zero."""
    return F.struct(F.round(lat, digits).alias("lat_key"), F.round(lon, digits).alias("lon_key"))


def _box(*pixels: tuple[Column, Column]) -> Column:
    """Longitude/latitude box of pixel places of a granule; the series is written once for all of them."""
    at = lambda x, y: F.struct((F.col("origin_x") + x * F.col("pixel_w")).alias("x"), (F.col("origin_y") + y * F.col("pixel_h")).alias("y"))
    points = points_from_utm(F.array(*[at(x.cast("double"), y.cast("double")) for x, y in pixels]))
    lats, lons = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    return F.struct(F.array_min(lats).alias("lat_min"), F.array_max(lats).alias("lat_max"), F.array_min(lons).alias("lon_min"), F.array_max(lons).alias("lon_max"))


def granule_box(corners: int = 4) -> Column:
    """Longitude/latitude box of a granule from 4 corners, or 2 for the diagonal only."""
    w, h, zero = F.col("width"), F.col("height"), F.lit(0)
    return _box(*[(zero, zero), (w, h), (w, zero), (zero, h)][:corners])


def with_patch_bounds(df: DataFrame, x: str, y: str, half: int, zone: int = 34, south: bool = True) -> DataFrame:
    """``df`` with the longitude/latitude box of a pixel window, from its two corners (G5); as in ``with_utm`` each step is a projection of its own."""
    def step(df: DataFrame, old: tuple[str, str], new: tuple[str, str], f) -> DataFrame:
        return df.withColumns({f"{n}{i}": c for i in (1, 2) for n, c in zip(new, f(*[F.col(f"{o}{i}") for o in old]), strict=True)})

    places = {"_e": ("origin_x", x, "pixel_w"), "_n": ("origin_y", y, "pixel_h")}
    out = df.withColumns({f"{n}{i}": F.col(o) + (F.col(c) + by).cast("double") * F.col(p) for i, by in ((1, -half), (2, half)) for n, (o, c, p) in places.items()})
    out = step(out, ("_e", "_n"), ("_xi", "_eta"), lambda e, n: _series(e, n, south))
    out = step(out, ("_xi", "_eta"), ("_chi", "_lam"), _angles)
    out = step(out, ("_chi", "_lam"), ("_lon", "_lat"), lambda chi, lam: _degrees(chi, lam, zone))
    ends = {f"{c}_{e}": f(f"_{c}1", f"_{c}2") for c in ("lat", "lon") for e, f in (("min", F.least), ("max", F.greatest))}
    return out.withColumns(ends).drop(*[f"_{n}{i}" for n in ("e", "n", "xi", "eta", "chi", "lam", "lon", "lat") for i in (1, 2)])


def _spread_bits(v: Column) -> Column:
    """The lower 32 bits with a zero bit after each."""
    v = v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(y: Column, x: Column) -> Column:
    """Place of a pixel on the Z-order curve: the bits of row and column in turn; a square of side 2^k at a multiple of its side is one range of codes."""
    return F.shiftleft(_spread_bits(y), 1).bitwiseOR(_spread_bits(x))
