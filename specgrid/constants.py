"""Band lists and class schemes as rules and short tables."""

from __future__ import annotations

# Raw sensor bands, ranges of bad ones (first, last), and absorption gaps in nanometres.
RAW_BANDS = 425
BAD_BAND_RANGES = [(0, 1), (99, 99), (196, 206), (284, 319), (423, 424)]
GAPS_NM = [(1340.0, 1480.0), (1780.0, 1970.0)]
GRID_NM = (400.0, 2450.0, 200)
NODATA, NODATA_BELOW = -10000.0, -9000.0
SENSOR_BANDS = 224
SENSOR_BAD_RANGES = [(126, 140), (160, 166)]

INVALID = -1
# Land-cover class codes, names and train ids; a class without a train id is invalid there.
WORLDCOVER = [
    (10, "Tree cover", 0), (20, "Shrubland", 1), (30, "Grassland", 2), (40, "Cropland", 3), (50, "Built-up", 4), (60, "Bare/sparse vegetation", 5),
    (70, "Snow and Ice", 6), (80, "Permanent water bodies", 7), (90, "Herbaceous wetland", 8), (95, "Mangroves", 9), (100, "Moss and lichen", 10),
]
DFC = [
    (1, "Forest", 0), (2, "Shrubland", 1), (3, "Savanna", INVALID), (4, "Grassland", 2), (5, "Wetlands", 3), (6, "Croplands", 4),
    (7, "Urban/Built-up", 5), (8, "Snow/Ice", INVALID), (9, "Barren", 6), (10, "Water", 7),
]


def good_bands(total: int = RAW_BANDS, bad: list[tuple[int, int]] = BAD_BAND_RANGES) -> list[int]:
    """Indices of the bands outside the bad ranges."""
    out = {b for lo, hi in bad for b in range(lo, hi + 1)}
    return [b for b in range(total) if b not in out]


def linspace(start: float, stop: float, n: int) -> list[float]:
    return [start + i * (stop - start) / (n - 1) for i in range(n)]
