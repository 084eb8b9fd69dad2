"""SQL text fragments for the DuckDB oracle side.

They restate the Column formulas of ``valora.functions.geo`` in SQL with the
same operation order and exact double literals, so both engines compute
bit-identical cell assignments.
"""

from __future__ import annotations

from valora import params as P
from valora.functions import geo

L = geo.sql_literal


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * "
         f"cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))")
    return f"({L(P.EARTH_RADIUS_KM)} * ({L(2.0)} * atan2(sqrt({a}), sqrt({L(1.0)} - {a}))))"


def dist_center(lat: str = "lat", lon: str = "lon") -> str:
    return hav(lat, lon, L(P.CITY_CENTER_LAT), L(P.CITY_CENTER_LON))


def dist_station(lat: str = "lat", lon: str = "lon") -> str:
    return "least(" + ", ".join(hav(lat, lon, L(a), L(b)) for _, a, b in P.STATIONS) + ")"


def cell_cols(lat: str = "lat", lon: str = "lon", edge: float = geo.EDGE) -> str:
    """Select-list text adding _qf, _rf (fractional axial coordinates)."""
    x = f"(({lon}) - {L(P.CITY_CENTER_LON)}) * {L(geo.KX)}"
    y = f"(({lat}) - {L(P.CITY_CENTER_LAT)}) * {L(geo.KY)}"
    qf = f"({L(geo.SQRT3 / 3.0)} * ({x}) - ({y}) / {L(3.0)}) / {L(edge)}"
    rf = f"({L(2.0 / 3.0)} * ({y})) / {L(edge)}"
    return f"{qf} AS _qf, {rf} AS _rf"


def cells_from(src: str, lat: str = "lat", lon: str = "lon") -> str:
    """``SELECT src.*, q, r, h3_index`` over a FROM-able text ``src``."""
    return f"""(SELECT * EXCLUDE (_qf, _rf, _sf, _rq, _rr, _rs, _dq, _dr, _ds),
  CASE WHEN _ok THEN CAST(CASE WHEN _dq > _dr AND _dq > _ds THEN -_rr - _rs ELSE _rq END AS BIGINT) END AS q,
  CASE WHEN _ok THEN CAST(CASE WHEN _dq > _dr AND _dq > _ds THEN _rr WHEN _dr > _ds THEN -_rq - _rs ELSE _rr END AS BIGINT) END AS r
 FROM (SELECT *, abs(_rq - _qf) AS _dq, abs(_rr - _rf) AS _dr, abs(_rs - _sf) AS _ds
  FROM (SELECT *, round(_qf, 0) AS _rq, round(_rf, 0) AS _rr, round(_sf, 0) AS _rs
   FROM (SELECT *, -_qf - _rf AS _sf FROM (SELECT *, {cell_cols(lat, lon)},
     ({lat} IS NOT NULL AND {lon} IS NOT NULL AND abs({lat}) <= 90 AND abs({lon}) <= 180) AS _ok
     FROM {src}) s0) s1) s2) s3)"""


def with_cell_id(src: str, lat: str = "lat", lon: str = "lon") -> str:
    """Adds q, r, h3_index (hex string id) and drops the helper flag."""
    return (f"(SELECT * EXCLUDE (_ok), lower(hex(({packed('q', 'r')}))) AS h3_index "
            f"FROM {cells_from(src, lat, lon)} c0)")


def packed(q: str, r: str) -> str:
    return f"(({q}) + {geo.OFF}) * {geo.SHIFT} + (({r}) + {geo.OFF})"
