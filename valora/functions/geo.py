"""Spatial Column functions: great-circle distance and an axial hex grid.

All functions return ``Column`` expressions (JVM-side, inside whole-stage
codegen); nothing here runs Python per row.

Hex grid: a local equirectangular projection around an origin (the city
centre by default) in km, pointy-top hexagons with edge ``HEX_EDGE_KM``
(area ~0.104 km2, the nominal size of the original resolution-9 cells), axial
coordinates (q, r) with cube rounding.  Cells are packed into one BIGINT
``(q + 2^20) * 2^21 + (r + 2^20)``; the string id is its lower-case hex.
Ids are not H3-compatible; the grid is valid at city/region scale (choose an
origin per region).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from valora import params as P

SQRT3 = math.sqrt(3.0)
KX = P.KM_PER_DEG_LON_EQ * math.cos(math.radians(P.CITY_CENTER_LAT))  # km per deg lon
KY = P.KM_PER_DEG_LAT
EDGE = P.HEX_EDGE_KM
OFF = P.CELL_OFFSET
SHIFT = 1 << 21


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance, R = 6371 km, 2*atan2(sqrt(a), sqrt(1-a))."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = (F.pow(F.sin(dlat / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2))
    return F.lit(P.EARTH_RADIUS_KM) * (F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)))


def distance_to_center(lat="lat", lon="lon", center=(P.CITY_CENTER_LAT, P.CITY_CENTER_LON)) -> Column:
    return haversine_km(lat, lon, F.lit(center[0]), F.lit(center[1]))


def distance_to_nearest_station(lat="lat", lon="lon", stations=P.STATIONS) -> Column:
    """Minimum distance to a station list: ``least`` of N haversines, all
    JVM-side in one projection.  A station table is small and fixed-size:
    pass its (name, lat, lon) rows as ``stations``."""
    return F.least(*[haversine_km(lat, lon, F.lit(s_lat), F.lit(s_lon))
                     for _, s_lat, s_lon in stations])


def _axial_fractional(lat: Column, lon: Column, origin=(P.CITY_CENTER_LAT, P.CITY_CENTER_LON),
                      edge: float = EDGE):
    x = (lon - F.lit(origin[1])) * F.lit(KX)
    y = (lat - F.lit(origin[0])) * F.lit(KY)
    qf = (F.lit(SQRT3 / 3.0) * x - y / F.lit(3.0)) / F.lit(edge)
    rf = (F.lit(2.0 / 3.0) * y) / F.lit(edge)
    return qf, rf


def _nearest_whole(x: Column) -> Column:
    """``round(x, 0)`` (half away from zero) of a double below 2^52, without the
    decimal that ``round`` makes of each number.  The addend is the double just
    below 0.5: with 0.5 itself 0.49999999999999994 would become 1."""
    return (x + F.signum(x) * F.lit(0.49999999999999994)).cast("bigint").cast("double")


def cell_axial(lat="lat", lon="lon", origin=(P.CITY_CENTER_LAT, P.CITY_CENTER_LON),
               edge: float = EDGE) -> Column:
    """struct<q: bigint, r: bigint> of the hex containing the point (cube rounding)."""
    lat, lon = _c(lat), _c(lon)
    qf, rf = _axial_fractional(lat, lon, origin, edge)
    sf = -qf - rf
    rq, rr, rs = _nearest_whole(qf), _nearest_whole(rf), _nearest_whole(sf)
    dq, dr, ds = F.abs(rq - qf), F.abs(rr - rf), F.abs(rs - sf)
    q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    valid = (lat.isNotNull() & lon.isNotNull() & (F.abs(lat) <= 90) & (F.abs(lon) <= 180))
    return F.when(valid, F.struct(q.cast("bigint").alias("q"), r.cast("bigint").alias("r")))


def pack_cell(q: Column, r: Column) -> Column:
    return (q + F.lit(OFF)) * F.lit(SHIFT) + (r + F.lit(OFF))


def cell_id(q: Column, r: Column) -> Column:
    """Hex string id of an axial cell."""
    return F.lower(F.hex(pack_cell(q, r)))


def cell_index(lat="lat", lon="lon") -> Column:
    """Point -> hex cell string id; invalid/NULL coordinates -> NULL."""
    ax = cell_axial(lat, lon)
    return cell_id(ax["q"], ax["r"])


def with_cell(df, lat: str = "lat", lon: str = "lon", out: str = "h3_index",
              edge: float = EDGE, origin=(P.CITY_CENTER_LAT, P.CITY_CENTER_LON)):
    """DataFrame form of ``cell_index`` computed in stages.

    Each stage is its own projection; because the intermediate columns are
    referenced several times and are not cheap, Catalyst keeps the projects
    apart instead of inlining them, which keeps the generated code small
    (the single nested expression exceeds the 64 KB method limit when it is
    combined with other features and falls back to interpreted mode).
    """
    la, lo = F.col(lat), F.col(lon)
    qf, rf = _axial_fractional(la, lo, origin, edge)
    valid = la.isNotNull() & lo.isNotNull() & (F.abs(la) <= 90) & (F.abs(lo) <= 180)
    d = df.withColumns({"_cq": qf, "_cr": rf, "_cv": valid})
    d = d.withColumn("_cs", -F.col("_cq") - F.col("_cr"))
    d = d.withColumns({f"_r{x}": _nearest_whole(F.col(f"_c{x}")) for x in "qrs"})
    d = d.withColumns({"_dq": F.abs(F.col("_rq") - F.col("_cq")), "_dr": F.abs(F.col("_rr") - F.col("_cr")),
                       "_ds": F.abs(F.col("_rs") - F.col("_cs"))})
    first = (F.col("_dq") > F.col("_dr")) & (F.col("_dq") > F.col("_ds"))
    q = F.when(first, -F.col("_rr") - F.col("_rs")).otherwise(F.col("_rq")).cast("bigint")
    r = F.when(first, F.col("_rr")).when(F.col("_dr") > F.col("_ds"), -F.col("_rq") - F.col("_rs")) \
        .otherwise(F.col("_rr")).cast("bigint")
    d = d.withColumns({"_q": q, "_r": r})
    d = d.withColumn(out, F.when(F.col("_cv"), cell_id(F.col("_q"), F.col("_r"))))
    return d.drop("_cq", "_cr", "_cv", "_cs", "_rq", "_rr", "_rs", "_dq", "_dr", "_ds", "_q", "_r")


def pseudo_cell(lat="lat", lon="lon") -> Column:
    """Fallback cell key ``round(lat,3)_round(lon,3)`` (no grid available).

    Rounds half-up on the scaled double (``floor(x*1000 + 0.5)/1000``) so the
    key is identical on every engine."""
    def r3(c):
        return (F.floor(_c(c) * 1000 + 0.5) / 1000).cast("string")
    return F.concat_ws("_", r3(lat), r3(lon))


def cell_numeric(cell="h3_index") -> Column:
    """Hex string -> integer; NULL or invalid -> 0."""
    c = _c(cell)
    ok = c.rlike("^[0-9a-fA-F]{1,15}$")
    return F.when(ok, F.conv(c, 16, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def cell_unpack(cell="h3_index") -> Column:
    """Hex string id -> struct<q, r>."""
    n = F.conv(_c(cell), 16, 10).cast("bigint")
    return F.struct((F.floor(n / F.lit(SHIFT)) - F.lit(OFF)).cast("bigint").alias("q"),
                    (F.pmod(n, F.lit(SHIFT)) - F.lit(OFF)).cast("bigint").alias("r"))


def cell_center(q: Column, r: Column, origin=(P.CITY_CENTER_LAT, P.CITY_CENTER_LON)) -> Column:
    """Axial cell -> struct<lat, lon> of its centre (inverse projection)."""
    x = F.lit(EDGE) * (F.lit(SQRT3) * q + F.lit(SQRT3 / 2.0) * r)
    y = F.lit(EDGE) * (F.lit(1.5) * r)
    return F.struct((F.lit(origin[0]) + y / F.lit(KY)).alias("lat"),
                    (F.lit(origin[1]) + x / F.lit(KX)).alias("lon"))


def disk_offset_list(k: int = 1, include_center: bool = True) -> list[tuple[int, int]]:
    """Axial offsets (dq, dr) within k rings."""
    return [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1)
            if abs(a + b) <= k and (include_center or (a, b) != (0, 0))]


def disk_offsets(k: int = 1, include_center: bool = True) -> Column:
    """array<struct<dq, dr>> literal of the axial offsets within k rings
    (3k(k+1)+1 entries; a constant, so it folds away in codegen)."""
    return F.array(*[F.struct(F.lit(a).cast("bigint").alias("dq"), F.lit(b).cast("bigint").alias("dr"))
                     for a, b in disk_offset_list(k, include_center)])


def cell_boundary(q: Column, r: Column, origin=(P.CITY_CENTER_LAT, P.CITY_CENTER_LON)) -> Column:
    """array<struct<lat, lon>> of the 6 corners (pointy-top: 30 + 60*i degrees)."""
    ctr = cell_center(q, r, origin)

    def corner(i):
        ang = F.radians(F.lit(60.0) * i - F.lit(30.0))
        return F.struct((ctr["lat"] + F.lit(EDGE) * F.sin(ang) / F.lit(KY)).alias("lat"),
                        (ctr["lon"] + F.lit(EDGE) * F.cos(ang) / F.lit(KX)).alias("lon"))
    return F.transform(F.sequence(F.lit(0), F.lit(5)), corner)


def sq_degree_distance(lat, lon, lat0, lon0) -> Column:
    """Squared distance in degrees (nearest-point click lookup)."""
    return F.pow(_c(lat) - _c(lat0), 2) + F.pow(_c(lon) - _c(lon0), 2)


def sql_literal(v: float) -> str:
    """Exact double literal usable by Spark SQL and DuckDB."""
    return "%.17e" % v
