"""Sites, granules, flightlines: projections, range joins, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from specgrid.functions import geo
from specgrid.functions import names as nm
from specgrid.operators import mapping as mp
from specgrid.plans.registry import query
from specgrid.plans.views import duck, table, view
from specgrid.sources import io


def _utm_sql(lon: str, lat: str, src: str, keep: str) -> str:
    """Common tables that end in ``utm`` with columns e and n beside ``keep``."""
    a = geo.ALPHA
    return f"""u1 AS (SELECT {keep}, sinh(atanh(sin(radians({lat}))) - {geo.ECC!r} * atanh({geo.ECC!r} * sin(radians({lat})))) AS t, radians({lon} - {geo.meridian(34)!r}e0) AS d FROM {src}),
u2 AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM u1),
utm AS (SELECT {keep}, {geo.E0!r}e0 + {geo.RADIUS!r} * (eta + {" + ".join(f"{x!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, x in enumerate(a, 1))}) AS e,
 1e7 + {geo.RADIUS!r} * (xi + {" + ".join(f"{x!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, x in enumerate(a, 1))}) AS n FROM u2)"""


def _lonlat(e: str, n: str) -> tuple[str, str]:
    xi0, eta0 = f"((({n}) - 1e7) / {geo.RADIUS!r})", f"((({e}) - {geo.E0!r}e0) / {geo.RADIUS!r})"
    xi = f"({xi0} - " + " - ".join(f"{b!r} * sin({2 * j} * {xi0}) * cosh({2 * j} * {eta0})" for j, b in enumerate(geo.BETA, 1)) + ")"
    eta = f"({eta0} - " + " - ".join(f"{b!r} * cos({2 * j} * {xi0}) * sinh({2 * j} * {eta0})" for j, b in enumerate(geo.BETA, 1)) + ")"
    chi = f"asin(sin({xi}) / cosh({eta}))"
    lat = f"degrees({chi} + " + " + ".join(f"{x!r} * sin({2 * j} * {chi})" for j, x in enumerate(geo.DELTA, 1)) + ")"
    return f"({geo.meridian(34)!r}e0 + degrees(atan2(sinh({eta}), cos({xi}))))", lat


_MAPPED = (
    _utm_sql("lon", "lat", "v_sites", "site_id, lat, lon, richness")
    + """, pairs AS (SELECT site_id, lat, lon, richness, gid, granule_id, width, height, CAST(trunc((e - origin_x) / pixel_w) AS INT) AS x_idx,
 CAST(trunc((n - origin_y) / pixel_h) AS INT) AS y_idx FROM utm JOIN v_granules ON e BETWEEN least(origin_x, origin_x + width * pixel_w) AND greatest(origin_x, origin_x + width * pixel_w)
 AND n BETWEEN least(origin_y, origin_y + height * pixel_h) AND greatest(origin_y, origin_y + height * pixel_h)),
mapped AS (SELECT * FROM pairs WHERE x_idx >= 8 AND x_idx < width - 8 AND y_idx >= 8 AND y_idx < height - 8)"""
)


def _corner_boxes(corners: int) -> str:
    pts = [("origin_x", "origin_y"), ("origin_x + width * pixel_w", "origin_y + height * pixel_h")]
    if corners == 4:
        pts += [("origin_x + width * pixel_w", "origin_y"), ("origin_x", "origin_y + height * pixel_h")]
    ll = [_lonlat(*p) for p in pts]
    lons, lats = ", ".join(x[0] for x in ll), ", ".join(x[1] for x in ll)
    return f"boxes AS (SELECT granule_id, gid, least({lats}) AS lat_min, greatest({lats}) AS lat_max, least({lons}) AS lon_min, greatest({lons}) AS lon_max FROM v_granules)"


_MAP_DUCK = duck("v_sites", "v_granules", more=_MAPPED)
_LINES = "matches AS (SELECT site_id, granule_id, CAST(gid % 24 AS BIGINT) AS flightline FROM mapped)"
_MATCH_DUCK = duck("v_sites", "v_granules", more=_MAPPED + ", " + _LINES)
_BOX_DUCK = duck("v_sites", "v_granules", more=_corner_boxes(4))


def _mapping(spark, sf):
    return mp.map_sites(view(spark, sf, "v_sites"), view(spark, sf, "v_granules"))


def _mapped(spark, sf):
    return mp.mapped_sites(view(spark, sf, "v_sites"), view(spark, sf, "v_granules").withColumn("flightline", (F.col("gid") % 24).cast("long")))


def _cornered(granules, corners=4):
    return granules.select("granule_id", geo.granule_box(corners).alias("b")).select("granule_id", "b.*")


def _boxes(spark, sf):
    return mp.kept(view(spark, sf, "v_granules"), _cornered)


@query("map_sites", _MAP_DUCK + "SELECT site_id, granule_id, x_idx, y_idx FROM (SELECT *, row_number() OVER (PARTITION BY round(lat, 5), round(lon, 5) ORDER BY granule_id, site_id) AS rn FROM mapped) WHERE rn = 1")
def map_sites(spark, sf):
    return mp.first_granules(_mapped(spark, sf)).select("site_id", "granule_id", "x_idx", "y_idx")


@query("g1_to_utm", duck("v_sites", more=_utm_sql("lon", "lat", "v_sites", "site_id")) + "SELECT site_id, round(e, 3) AS easting, round(n, 3) AS northing FROM utm")
def g1_to_utm(spark, sf):
    utm = geo.with_utm(view(spark, sf, "v_sites"), "lon", "lat")
    return utm.select("site_id", F.round("e", 3).alias("easting"), F.round("n", 3).alias("northing"))


_LL = _lonlat("origin_x", "origin_y")


@query("g2_from_utm", duck("v_granules") + f"SELECT granule_id, round({_LL[0]}, 7) AS lon, round({_LL[1]}, 7) AS lat FROM v_granules")
def g2_from_utm(spark, sf):
    lon, lat = geo.from_utm(F.col("origin_x"), F.col("origin_y"))
    return view(spark, sf, "v_granules").select("granule_id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("g3_pixel_index", _MAP_DUCK + "SELECT site_id, granule_id, x_idx, y_idx FROM pairs")
def g3_pixel_index(spark, sf):
    s = mp.located_sites(view(spark, sf, "v_sites"))
    ends = {"x1": F.col("origin_x") + F.col("width") * F.col("pixel_w"), "y1": F.col("origin_y") + F.col("height") * F.col("pixel_h")}
    g = mp.kept(view(spark, sf, "v_granules"), lambda df: df.withColumns(ends))
    pairs = mp.range_join(s, g, "e", "n", ("origin_x", "x1", "y1", "origin_y"), 24_000.0)  # no granule is wider
    x, y = geo.pixel_index(F.col("e"), F.col("n"), F.col("origin_x"), F.col("pixel_w"), F.col("origin_y"), F.col("pixel_h"))
    return pairs.select("site_id", "granule_id", x.alias("x_idx"), y.alias("y_idx"))


def _rounded_boxes(corners):
    sql = duck("v_granules", more=_corner_boxes(corners)) + "SELECT granule_id, round(lat_min, 7) AS lat_min, round(lat_max, 7) AS lat_max, round(lon_min, 7) AS lon_min, round(lon_max, 7) AS lon_max FROM boxes"

    @query(f"g4_granule_box_{corners}", sql)
    def g4(spark, sf):
        return _cornered(view(spark, sf, "v_granules"), corners).select("granule_id", *[F.round(c, 7).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")])


_rounded_boxes(4)
_rounded_boxes(2)
_P1, _P2 = _lonlat("origin_x + (x_idx - 8) * pixel_w", "origin_y + (y_idx - 8) * pixel_h"), _lonlat("origin_x + (x_idx + 8) * pixel_w", "origin_y + (y_idx + 8) * pixel_h")


@query(
    "g5_patch_bounds",
    _MAP_DUCK
    + f""", w AS (SELECT site_id, m.granule_id, {_P1[0]} AS lon1, {_P1[1]} AS lat1, {_P2[0]} AS lon2, {_P2[1]} AS lat2 FROM mapped m JOIN v_granules g ON m.gid = g.gid)
SELECT site_id, granule_id, round(least(lat1, lat2), 7) AS lat_min, round(least(lon1, lon2), 7) AS lon_min, round(greatest(lat1, lat2), 7) AS lat_max, round(greatest(lon1, lon2), 7) AS lon_max FROM w""",
)
def g5_patch_bounds(spark, sf):
    out = mp.patch_bounds(view(spark, sf, "v_sites"), view(spark, sf, "v_granules"), digits=7)
    return out.select("site_id", "granule_id", "lat_min", "lon_min", "lat_max", "lon_max")


@query(
    "g6_extent_overlap",
    _BOX_DUCK + "SELECT granule_id, round(lat_min, 6) AS lat_min, round(lon_max, 6) AS lon_max, count(site_id) AS n_sites FROM boxes LEFT JOIN v_sites ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max GROUP BY ALL",
)
def g6_extent_overlap(spark, sf):
    out = mp.extent_overlap(_boxes(spark, sf), view(spark, sf, "v_sites"))
    return out.groupBy("granule_id", F.round("lat_min", 6).alias("lat_min"), F.round("lon_max", 6).alias("lon_max")).agg(F.sum("n_sites").alias("n_sites"))


@query("g7_sites_extent", duck("v_sites") + "SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM v_sites")
def g7_sites_extent(spark, sf):
    return mp.sites_extent(view(spark, sf, "v_sites"))


@query("j1_bbox_join", _BOX_DUCK + "SELECT site_id, granule_id FROM v_sites JOIN boxes ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max")
def j1_bbox_join(spark, sf):
    box = ("lon_min", "lon_max", "lat_min", "lat_max")
    return mp.range_join(view(spark, sf, "v_sites"), _boxes(spark, sf), "lon", "lat", box, 0.25).select("site_id", "granule_id")


@query("j2_map_sites", _MAP_DUCK + "SELECT site_id, granule_id, x_idx, y_idx, richness FROM mapped")
def j2_map_sites(spark, sf):
    return _mapping(spark, sf).select("site_id", "granule_id", "x_idx", "y_idx", "richness")


@query(
    "j7_coverage_gaps",
    duck("v_sites", "v_granules", more=_MAPPED + ", " + _corner_boxes(4))
    + """SELECT site_id, CASE WHEN EXISTS (SELECT 1 FROM boxes b WHERE s.lat BETWEEN lat_min AND lat_max AND s.lon BETWEEN lon_min AND lon_max) THEN 'edge_or_data' ELSE 'no_granule' END AS reason
FROM v_sites s WHERE site_id NOT IN (SELECT site_id FROM mapped)""",
)
def j7_coverage_gaps(spark, sf):
    return mp.coverage_gaps(view(spark, sf, "v_sites"), _mapped(spark, sf), _boxes(spark, sf)).select("site_id", "reason")


@query("a3_granule_site_counts", _MAP_DUCK + "SELECT granule_id, count(*) AS n_sites FROM mapped GROUP BY 1")
def a3_granule_site_counts(spark, sf):
    return mp.granule_site_counts(_mapped(spark, sf))


@query("a4_flightline_coverage", _MATCH_DUCK + "SELECT flightline, count(DISTINCT site_id) AS n_sites, array_to_string(list_sort(list(DISTINCT granule_id)), ',') AS granules FROM matches GROUP BY 1")
def a4_flightline_coverage(spark, sf):
    return mp.flightline_coverage(_mapped(spark, sf)).withColumn("granules", F.array_join("granules", ","))


@query("a5_coverage_totals", _MATCH_DUCK + "SELECT count(DISTINCT site_id) AS n_sites, count(DISTINCT granule_id) AS n_granules, count(*) AS n_pairs FROM matches")
def a5_coverage_totals(spark, sf):
    return mp.coverage_totals(_mapped(spark, sf))


@query(
    "w3_rank_flightlines",
    _MATCH_DUCK
    + """, c AS (SELECT flightline, count(DISTINCT site_id) AS n_sites FROM matches GROUP BY 1), r AS (SELECT *, CAST(row_number() OVER (ORDER BY n_sites DESC, flightline) AS INT) AS rank FROM c QUALIFY rank <= 10),
b AS (SELECT site_id, min(rank) AS rank FROM matches JOIN r USING (flightline) GROUP BY 1)
SELECT r.rank, flightline, n_sites, count(b.site_id) AS new_sites FROM r LEFT JOIN b ON b.rank = r.rank GROUP BY ALL""",
)
def w3_rank_flightlines(spark, sf):
    return mp.rank_flightlines(mp.flightline_sites(_mapped(spark, sf)), 10)


_BEST = "b{i} AS (SELECT flightline, count(DISTINCT site_id) AS k FROM matches WHERE site_id NOT IN (SELECT site_id FROM matches WHERE flightline IN ({before})) GROUP BY 1 ORDER BY k DESC, flightline LIMIT 1)"
_COVER = ", ".join(_BEST.format(i=i, before=" UNION ALL ".join(["SELECT -1", *(f"SELECT flightline FROM b{j}" for j in range(1, i))])) for i in range(1, 6))


@query("w3_greedy_cover", _MATCH_DUCK + ", " + _COVER + " UNION ALL ".join(f" SELECT CAST({i} AS INT) AS rank, flightline, k AS new_sites FROM b{i}" for i in range(1, 6)))
def w3_greedy_cover(spark, sf):
    return mp.greedy_cover(mp.flightline_sites(_mapped(spark, sf)), 5)


@query("w1_dedup_first", duck("v_pred") + "SELECT id, flightline, site_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY flightline, id) AS rn FROM v_pred) WHERE rn = 1")
def w1_dedup_first(spark, sf):
    return mp.dedup_first(view(spark, sf, "v_pred"), ["site_id"], ["flightline", "id"]).select("id", "flightline", "site_id")


@query("p17_richness_ramp", duck("v_sites") + "SELECT site_id, round(richness / greatest(m, 1e0), 9) AS ratio, round((1 - richness / greatest(m, 1e0)) * 120, 7) AS hue FROM v_sites, (SELECT max(richness) AS m FROM v_sites)")
def p17_richness_ramp(spark, sf):
    return mp.richness_ramp(view(spark, sf, "v_sites")).select("site_id", F.round("ratio", 9).alias("ratio"), F.round("hue", 7).alias("hue"))


@query("p8_coord_key", duck("v_sites") + "SELECT round(lat, 2) AS lat_key, round(lon, 2) AS lon_key, count(*) AS n FROM v_sites GROUP BY 1, 2")
def p8_coord_key(spark, sf):
    return view(spark, sf, "v_sites").groupBy(geo.coord_key(F.col("lat"), F.col("lon"), 2).alias("k")).agg(F.count(F.lit(1)).alias("n")).select("k.*", "n")


@query("p9_in_bbox", duck("v_sites") + "SELECT site_id FROM v_sites WHERE lat BETWEEN -34.2e0 AND -33.5e0 AND lon BETWEEN 19e0 AND 21e0")
def p9_in_bbox(spark, sf):
    box = F.struct(F.lit(-34.2).alias("lat_min"), F.lit(-33.5).alias("lat_max"), F.lit(19.0).alias("lon_min"), F.lit(21.0).alias("lon_max"))
    return view(spark, sf, "v_sites").where(geo.in_box(F.col("lat"), F.col("lon"), box)).select("site_id")


@query("p10_fits_patch", _MAP_DUCK + "SELECT site_id, granule_id, (x_idx >= 50 AND x_idx < width - 50 AND y_idx >= 50 AND y_idx < height - 50) AS fits FROM mapped")
def p10_fits_patch(spark, sf):
    return _mapping(spark, sf).select("site_id", "granule_id", geo.fits_patch(F.col("x_idx"), F.col("y_idx"), F.col("width"), F.col("height"), 50).alias("fits"))


_NAME = "concat('BioSCape_AVNG_L2B_BRDF_GCFR.', granule_id, '_OE_0b4f48b4_RFL_ORT_tbg_v1.nc')"


def _named(spark, sf):
    return view(spark, sf, "v_granules").select("gid", "granule_id", F.expr(_NAME).alias("name"))


@query("p1_normalize_id", duck("v_granules") + f"SELECT gid, regexp_replace(replace({_NAME}, 'BioSCape_AVNG_L2B_BRDF_GCFR.', ''), '\\.nc$', '') AS norm FROM v_granules")
def p1_normalize_id(spark, sf):
    return _named(spark, sf).select("gid", nm.normalize_granule_id(F.col("name")).alias("norm"))


@query("p3_flightline_id", duck("v_granules") + "SELECT gid, split_part(granule_id, '_', 1) AS line, split_part(granule_id, '_L2B', 1) AS shown FROM v_granules")
def p3_flightline_id(spark, sf):
    norm = nm.normalize_granule_id(F.col("name"))
    return _named(spark, sf).select("gid", nm.flightline_id(F.col("name")).alias("line"), nm.display_name(norm).alias("shown"))


@query("p4_acquisition_ts", duck("v_granules") + "SELECT gid, CAST(epoch(strptime(substr(granule_id, 4, 15), '%Y%m%dt%H%M%S')) AS BIGINT) AS ts, CAST(substr(granule_id, 20, 3) AS INT) AS segment FROM v_granules")
def p4_acquisition_ts(spark, sf):
    return _named(spark, sf).select("gid", F.unix_timestamp(nm.acquisition_ts(F.col("name"))).alias("ts"), nm.segment_number(F.col("name")).alias("segment"))


_GT = "concat(CAST(CAST(origin_x AS BIGINT) AS VARCHAR(20)), ' 30 0 ', CAST(CAST(origin_y AS BIGINT) AS VARCHAR(20)), ' 0 -30')"


@query("p5_parse_geotransform", duck("v_granules") + "SELECT gid, origin_x, 30e0 AS pixel_w, origin_y, -30e0 AS pixel_h FROM v_granules")
def p5_parse_geotransform(spark, sf):
    return view(spark, sf, "v_granules").select("gid", nm.parse_geotransform(F.expr(_GT)).alias("g")).select("gid", "g.*")


@query("p6_rescale_geotransform", duck("v_granules") + "SELECT gid, origin_x, 180e0 AS pixel_w, origin_y, -180e0 AS pixel_h FROM v_granules")
def p6_rescale_geotransform(spark, sf):
    return view(spark, sf, "v_granules").select("gid", nm.parse_geotransform(nm.rescale_geotransform(F.expr(_GT), 6)).alias("g")).select("gid", "g.*")


@query("p7_site_id", duck("v_sites") + "SELECT site_id, CASE WHEN site_id % 3 = 0 THEN CAST(site_id AS VARCHAR) ELSE printf('Site_%.4f_%.4f', lat, lon) END AS name FROM v_sites")
def p7_site_id(spark, sf):
    given = F.when(F.col("site_id") % 3 == 0, F.col("site_id").cast("string"))
    return view(spark, sf, "v_sites").select("site_id", nm.site_id(given, F.col("lat"), F.col("lon")).alias("name"))


@query("p12_usable_granules", duck("v_granules") + "SELECT granule_id FROM v_granules WHERE 300 + gid % 100 >= 0.5e0 * 700 AND width >= 650 AND height >= 650")
def p12_usable_granules(spark, sf):
    g = view(spark, sf, "v_granules").withColumn("bands", 300 + F.col("gid") % 100)
    return g.where((F.col("bands") >= 0.5 * 700) & (F.col("width") >= 650) & (F.col("height") >= 650)).select("granule_id")


@query("s3_granule_catalog", duck("v_granules") + "SELECT granule_id AS path, CAST(425 AS INT) AS bands, CAST(height AS BIGINT) AS height, CAST(width AS BIGINT) AS width, CASE WHEN gid % 2 = 0 THEN origin_x ELSE 0e0 END AS origin_x, CASE WHEN gid % 2 = 0 THEN origin_y ELSE 0e0 END AS origin_y FROM v_granules")
def s3_granule_catalog(spark, sf):
    even = F.col("gid") % 2 == 0
    headers = view(spark, sf, "v_granules").select(
        F.col("granule_id").alias("path"), F.when(even, 425).alias("group_bands"), F.lit(425).alias("bands"), F.col("height").cast("long").alias("height"),
        F.col("width").cast("long").alias("width"), F.when(even, F.expr(_GT)).alias("projection_geotransform"),
    )
    return io.granule_catalog(headers).select("path", "bands", "height", "width", "origin_x", "origin_y")


@query("s4_granule_metadata", duck("v_granules") + "SELECT granule_id AS native_id, origin_x AS lon_min, origin_y AS lat_max FROM v_granules WHERE gid % 5 <> 0 UNION ALL SELECT granule_id, origin_x + 1, origin_y + 1 FROM v_granules WHERE gid % 5 = 1")
def s4_granule_metadata(spark, sf):
    box = lambda d: F.struct(
        (F.col("origin_x") + d).alias("WestBoundingCoordinate"), F.lit(0.0).alias("SouthBoundingCoordinate"), F.lit(1.0).alias("EastBoundingCoordinate"), (F.col("origin_y") + d).alias("NorthBoundingCoordinate")
    )
    nested = F.struct(
        F.struct(F.col("granule_id").alias("native-id")).alias("meta"),
        F.struct(F.struct(F.struct(F.struct(F.when(F.col("gid") % 5 == 1, F.array(box(0), box(1))).when(F.col("gid") % 5 != 0, F.array(box(0))).alias("BoundingRectangles")).alias("Geometry")).alias("HorizontalSpatialDomain")).alias("SpatialExtent")).alias("umm"),
    )
    text = view(spark, sf, "v_granules").select(F.to_json(nested).alias("value"))
    parsed = text.select(F.from_json("value", io.METADATA).alias("m")).select("m.*")
    return io.explode_boxes(parsed).select("native_id", "lon_min", "lat_max")


@query("s10_geojson_ring", duck("v_granules") + "SELECT granule_id, 0 AS ord, round({0}, 6) AS lon, round({1}, 6) AS lat FROM v_granules UNION ALL SELECT granule_id, 1, round({2}, 6), round({3}, 6) FROM v_granules".format(*_lonlat("origin_x", "origin_y"), *_lonlat("origin_x + width * pixel_w", "origin_y + height * pixel_h")))
def s10_geojson_ring(spark, sf):
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    g = view(spark, sf, "v_granules")
    ring = F.array(p(F.col("origin_x"), F.col("origin_y")), p(F.col("origin_x") + F.col("width") * F.col("pixel_w"), F.col("origin_y") + F.col("height") * F.col("pixel_h")))
    out = io.rings(g.select("granule_id", ring.alias("ring")))
    return out.select("granule_id", F.posexplode("ring").alias("ord", "p")).select("granule_id", "ord", "p.lon", "p.lat")


_LL0, _LL1 = _lonlat("origin_x", "origin_y"), _lonlat("origin_x + width * pixel_w", "origin_y + height * pixel_h")


@query(
    "s10_geojson_file",
    duck("v_granules")
    + f"""SELECT CAST(gid AS VARCHAR) AS gid, granule_id, 'Feature' AS type, 'Polygon' AS shape, ord, lon, lat FROM (SELECT gid, granule_id, 0 AS ord, round({_LL0[0]}, 6) AS lon, round({_LL0[1]}, 6) AS lat FROM v_granules
UNION ALL SELECT gid, granule_id, 1, round({_LL1[0]}, 6), round({_LL1[1]}, 6) FROM v_granules)""",
)
def s10_geojson_file(spark, sf):
    """Features written as lines of a file and read back."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(p(F.col("origin_x"), F.col("origin_y")), p(F.col("origin_x") + F.col("width") * F.col("pixel_w"), F.col("origin_y") + F.col("height") * F.col("pixel_h")))
    told = F.create_map(F.lit("gid"), F.col("gid").cast("string"), F.lit("granule_id"), F.col("granule_id"))
    path = io.work_dir(spark, "footprints")
    io.to_geojson(view(spark, sf, "v_granules").select(F.col("gid").alias("footprint_id"), told.alias("props"), ring.alias("ring"))).select("feature").write.text(path)
    schema = "type string, properties struct<gid:string,granule_id:string>, geometry struct<type:string,coordinates:array<array<array<double>>>>"
    out = spark.read.schema(schema).json(path).select("properties.*", "type", F.col("geometry.type").alias("shape"), F.posexplode(F.col("geometry.coordinates")[0]).alias("ord", "p"))
    return out.select("gid", "granule_id", "type", "shape", "ord", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


@query("s4_event_props", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def s4_event_props(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
