"""Names of granules, flightlines, sites and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: collection prefix of stored file names.
PREFIX = "BioSCape_AVNG_L2B_BRDF_GCFR."


def normalize_granule_id(name: Column, prefix: str = PREFIX, suffix: str = ".nc") -> Column:
    """Name without collection prefix and file suffix."""
    return F.regexp_replace(F.replace(name, F.lit(prefix), F.lit("")), suffix.replace(".", r"\.") + "$", "")


def basename(path: Column) -> Column:
    """Last part after slashes of either kind; empty if the path ends in one."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def flightline_id(name: Column) -> Column:
    """First token before ``_``, last token after ``.``."""
    first = F.element_at(F.split(name, "_L2B_BRDF_GCFR\\."), -1)
    return F.element_at(F.split(F.element_at(F.split(first, "_"), 1), r"\."), -1)


def display_name(name: Column) -> Column:
    """What stands before ``_L2B_``."""
    return F.substring_index(name, "_L2B_", 1)


def acquisition_ts(name: Column) -> Column:
    """Timestamp in ``angYYYYMMDDtHHMMSS``; null if there is none."""
    return F.try_to_timestamp(F.regexp_extract(name, r"ang(\d{8}t\d{6})", 1), F.lit("yyyyMMdd't'HHmmss"))


def segment_number(name: Column) -> Column:
    """Number in ``_NNN_`` after the timestamp."""
    return F.nullif(F.regexp_extract(name, r"t\d{6}_(\d{3})_", 1), F.lit("")).cast("int")


def parse_geotransform(text: Column) -> Column:
    """Blank-separated six numbers as a struct of the four that count; a null text is the unit grid (P5)."""
    p = F.transform(F.split(F.trim(F.coalesce(text, F.lit("0 1 0 0 0 1"))), " +"), lambda x: x.cast("double"))
    return F.struct(p[0].alias("origin_x"), p[1].alias("pixel_w"), p[3].alias("origin_y"), p[5].alias("pixel_h"))


def rescale_geotransform(text: Column, factor: int) -> Column:
    """Pixel sizes times ``factor``, written back as text."""
    p = F.transform(F.split(F.trim(text), " +"), lambda x: x.cast("double"))
    return F.array_join(F.transform(p, lambda x, i: F.when(i.isin(1, 5), x * factor).otherwise(x).cast("string")), " ")


def site_id(given: Column, lat: Column, lon: Column) -> Column:
    """The given id, else ``Site_lat_lon`` with four digits."""
    return F.coalesce(given, F.format_string("Site_%.4f_%.4f", lat, lon))


def in_window(ts: Column, start: str, end: str) -> Column:
    """Within a date window, both ends included."""
    return ts.between(F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(end)))
