"""Registered spatial queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.outlines import ring_areas
from plumbline.operators import areas
from plumbline.operators import spatial as s
from plumbline.sources import tables

from .detector_queries import COMP
from .fixtures import AS_OF, Tables, oracle
from .grid_sql import centred, excess, located, neighbours, sides
from .sql import POSITION, km, rnd

D180 = AS_OF - 180 * 86_400_000


def points(t: Tables) -> DataFrame:
    return t.fx_stations.join(t.fx_station_scores, F.col("name") == F.col("station_name")).select(F.col("name").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("avg_fix_rate").alias("value"))


POINTS = "SELECT name AS id, latitude AS lat, longitude AS lon, avg_fix_rate AS value FROM fx_stations JOIN fx_station_scores ON station_name = name"
PAIRS = f"SELECT a.id, b.id AS r_id, a.value, b.value AS r_value, {km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS dk FROM pts a, pts b WHERE a.id <> b.id"
BINS = """SELECT bin, (bin + 5e-1) * (5e2 / 15) AS distance, sv AS semivariance, n AS count
   FROM (SELECT CAST(floor(dk / (5e2 / 15)) AS int) AS bin, count(*) AS n, sum(pow(value - r_value, 2)) / (2 * count(*)) AS sv
 FROM prs WHERE id < r_id AND dk < 500 GROUP BY 1 HAVING count(*) >= 3)"""
FIT = f"""SELECT 'exponential' AS model, {rnd("nugget", 3)} AS nugget, {rnd("sill", 3)} AS sill, {rnd("rng", 1)} AS "range", {rnd("r2", 3)} AS
   r_squared FROM (
 SELECT ni, si, ri, any_value(nugget) AS nugget, any_value(sill) AS sill, any_value(rng) AS rng, 1 - sum(pow(semivariance - (nugget + (sill - nugget)
    * (1 - exp(-3 * distance / rng))), 2)) / sum(pow(semivariance - mean, 2)) AS r2 FROM bns,
  (SELECT *, lo * nf AS nugget, hi * sf AS sill, far * rf AS rng
     FROM (SELECT max(semivariance) AS hi, min(semivariance) AS lo, max(distance) AS far, avg(semivariance) AS mean
     FROM bns), (VALUES (0, 0e0), (1, 25e-2), (2, 5e-1), (3, 75e-2), (4, 1e0)) a(ni, nf),
   (VALUES (0, 5e-1), (1, 75e-2), (2, 1e0), (3, 125e-2), (4, 15e-1)) b(si, sf), (VALUES (0, 15e-2), (1, 25e-2), (2, 35e-2), (3, 5e-1), (4, 7e-1))
      c(ri, rf)) WHERE sill > nugget GROUP BY 1, 2, 3) ORDER BY {rnd("r2", 9)} DESC, ni, si, ri LIMIT 1"""
ROWS = """SELECT p.id, p.value, m.mean, m.s2, m.n, sum(1 / dk) AS rw, sum(1 / dk / dk) AS sq, sum((r_value - m.mean) / dk) AS lag
   FROM prs p, (SELECT avg(value) AS mean, var_pop(value) AS s2, count(*) AS n FROM pts) m
 WHERE dk > 0 AND dk <= 100 GROUP BY ALL"""
GLOBAL = """SELECT *, num / (w * s2) AS i, -1 / (n - 1) AS e, (n * ((n * n - 3 * n + 3) * s1 - n * ss2 + 3 * w * w) - s4 / (s2 * s2) * ((n * n - n) *
   s1 - 2 * n * ss2 + 6 * w * w)) / ((n - 1) * (n - 2) * (n - 3) * w * w) - 1 / ((n - 1) * (n - 1)) AS v FROM
 (SELECT CAST(any_value(n) AS double) AS n, any_value(s2) AS s2, (SELECT avg(pow(value - (SELECT avg(value) FROM pts), 4))
    FROM pts) AS s4, sum(rw) AS w, sum(sq) * 2 AS s1, sum(4 * rw * rw) AS ss2, sum((value - mean) * lag) AS num FROM rws)"""
_T = "(1 / (1 + 2316419e-7 * abs(z)))"
PVAL = f"(2 * (3989422804014327e-16 * exp(-z * z / 2) * {_T} * (319381530e-9 + {_T} * (-356563782e-9 + {_T} * (1781477937e-9 + {_T} * (-1821255978e-9 + {_T} * 1330274429e-9))))))"


BASE = """SELECT name, coalesce(network, 'unknown') AS network, latitude, longitude, coalesce(uptime_7d, 5e-1) AS uptime,
   coalesce(median_correction_age, 2e0) AS age FROM fx_stations LEFT JOIN fx_station_scores ON station_name = name
   WHERE status IN ('ONLINE', 'ACTIVE')"""
SEEN_CELLS = f"""SELECT cell, sum(n) AS n, sum(users) AS users, sum(fix) AS fix, sum(secs) AS secs, sum(ma * n) / sum(CASE
   WHEN ma > 0 THEN n END) AS seen_age FROM {located("sq", "lat", "lon")} GROUP BY 1"""
SQUARES = f"""
SELECT {rnd("latitude", 1)} AS lat, {rnd("longitude", 1)} AS lon, count(*) AS n, count(DISTINCT username) AS users, sum(fix_rate * CASE
    WHEN duration > 0 THEN duration ELSE 1 END) AS fix, sum(CASE WHEN duration > 0 THEN duration ELSE 1 END) AS secs,
  avg(CASE WHEN avg_age > 0 THEN avg_age END) AS ma FROM fx_sessions WHERE login_time >= {D180} AND {POSITION} AND abs(longitude) > 0.1
     GROUP BY 1, 2"""
#: Cells of stations, the first ring around them, the second, and the cells of sessions.
OWN_CELLS = f"SELECT cell FROM {located('(SELECT latitude, longitude FROM bas)', 'latitude', 'longitude')}"
FIRST_RING = f"SELECT near AS cell FROM {neighbours('own')} UNION SELECT cell FROM own"
SECOND_RING = f"SELECT near AS cell FROM {neighbours('rg1')} UNION SELECT cell FROM rg1"
CELLS = f"SELECT * FROM {centred('(SELECT cell FROM rg2 UNION SELECT cell FROM sen)')}"
NEAR = f"""SELECT c.cell, b.*, {km("c.lat", "c.lon", "b.latitude", "b.longitude")} AS dk, degrees(atan2(sin(radians(b.longitude - c.lon)) *
   cos(radians(b.latitude)), cos(radians(c.lat)) * sin(radians(b.latitude)) - sin(radians(c.lat)) * cos(radians(b.latitude)) * cos(radians(b.longitude
   - c.lon)))) AS br
 FROM cel c, bas b WHERE abs(c.lat - b.latitude) < 1 AND dk <= 50"""
AROUND = """SELECT cell, count(*) AS in_range, count(*) FILTER (dk <= 35) AS clo, sum(uptime * exp(-pow(dk / 20, 2))) / sum(exp(-pow(dk / 20, 2))) AS
   up, min(CASE WHEN age = 0 THEN 5e0 ELSE age END) FILTER (k <= 3) AS best_age, min(dk) AS nk, arg_min(name, struct_pack(d := dk, n := name)) AS
   nearest,
 count(DISTINCT CASE WHEN network <> 'unknown' THEN network END) AS redundancy, max(gap) AS gap, min(br) FILTER (dk <= 35) AS b0, max(br) FILTER (dk
    <= 35) AS b1 FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY dk, name) AS k,
  CASE WHEN dk <= 35 THEN br - lag(br) OVER (PARTITION BY cell, dk <= 35 ORDER BY br) END AS gap FROM nea) GROUP BY 1"""
COVERAGE = f"""SELECT CAST(cell AS VARCHAR) AS cell_id, {rnd("lat", 5)} AS latitude, {rnd("lon", 5)} AS longitude, qs AS quality_score,
   {rnd("bl", 2)} AS baseline, ge AS geometry, {rnd("up", 2)} AS uptime, {rnd("fr", 2)} AS freshness, {rnd("fp", 2)} AS fix_rate,
 n AS session_count, coalesce(users, 0) AS unique_users, {rnd("CASE WHEN n >= 3 THEN least(1e0, n / 5e1) ELSE 0e0 END", 2)} AS confidence, CASE
    WHEN n >= 20 THEN 'observed' WHEN n >= 3 THEN 'hybrid' ELSE 'modeled' END AS data_source,
 CASE WHEN qs >= 75e-2 THEN 'full_rtk' WHEN qs >= 5e-1 THEN 'degraded_rtk' WHEN qs >= 25e-2 THEN 'float_dgps'
    ELSE 'no_coverage' END AS zone_tier, coalesce(redundancy, 0) AS redundancy, coalesce(nearest, '') AS nearest_station,
    {rnd("coalesce(nk, 999e0)", 1)} AS nearest_km, in_range AS stations_in_range
FROM (SELECT *, {rnd("bl * 35e-2 + ge * 2e-1 + up * 2e-1 + fr * 15e-2 + fp * 1e-1", 2)} AS qs FROM (SELECT *, CASE WHEN n >= 3 THEN fix / secs / 1e2
   ELSE bl END AS fp FROM (SELECT c.cell, c.lat, c.lon, coalesce(n, 0) AS n, users, fix, secs, redundancy, nearest, nk, coalesce(in_range, 0) AS
   in_range, coalesce(up, 0e0) AS up,
 CASE WHEN coalesce(in_range, 0) > 0 THEN exp(-pow(nk / 20, 2)) ELSE 0e0 END AS bl, CASE WHEN coalesce(n, 0) >= 20
    AND seen_age > 0 THEN greatest(0e0, 1 - seen_age / 10) WHEN coalesce(in_range, 0) > 0 THEN greatest(0e0, 1 - best_age / 10) ELSE 5e-1 END AS fr,
 CASE WHEN coalesce(in_range, 0) = 0 THEN 0e0 WHEN in_range = 1 THEN 3e-1 WHEN clo = 0 THEN 1e-1 WHEN clo = 1 THEN 3e-1
    ELSE
    {rnd("least(1e0, greatest(0e0, 1 - (greatest(coalesce(gap, 0e0), 360 - b1 + b0) / (36e1 / clo) - 1) / 3) * 6e-1 + least(1e0, clo / 4e0) * 4e-1)", 2)}
    END AS ge
 FROM cel c LEFT JOIN aro USING (cell) LEFT JOIN sen USING (cell))))"""


GOOD = """SELECT cell_id, CAST(cell_id AS bigint) AS cell, latitude, longitude, quality_score, zone_tier FROM cv WHERE zone_tier IN ('full_rtk', 'degraded_rtk')"""
ADJOINING = f"SELECT a.cell_id AS a, b.cell_id AS b FROM {neighbours('gd')} n JOIN gd a ON a.cell = n.cell JOIN gd b ON b.cell = n.near"
ZONES = f"""
SELECT *, (SELECT max({km("z.lat", "z.lon", "g.latitude", "g.longitude")}) FROM zc g WHERE g.zone = z.zone) AS reach FROM (
  SELECT zone, count(*) AS cells, count(*) FILTER (zone_tier = 'full_rtk') AS f, avg(latitude) AS lat, avg(longitude) AS lon, avg(quality_score) AS
     aq, min(quality_score) AS mq
  FROM zc GROUP BY 1 HAVING count(*) >= 3) z"""
ZONE_CELLS = "SELECT g.*, coalesce(c.comp, g.cell_id) AS zone FROM gd g LEFT JOIN comp c ON c.id = g.cell_id"
HELD = f"""
SELECT zone, count(*) FILTER (network = 'geodnet') AS p, count(*) FILTER (network = 'onocoy') AS o FROM (
  SELECT z.zone, s.network, {km("z.lat", "z.lon", "s.latitude", "s.longitude")} AS dk, coalesce(t.composite_score, 5e-1) AS tr
  FROM zn z, fx_stations s LEFT JOIN fx_trust t ON t.station = s.name
  WHERE tr >= 4e-1 AND dk <= 50 QUALIFY row_number() OVER (PARTITION BY z.zone ORDER BY floor(-tr * 10), dk, s.name) <= 20) GROUP BY 1"""
COVERAGE_ZONES = f"""
SELECT zone AS zone_id, tier AS zone_tier, network,
       CASE WHEN tier = 'full_rtk' THEN CASE WHEN network <> 'onocoy' THEN 1 ELSE 20 END WHEN network <> 'onocoy' THEN 10 ELSE 30 END AS priority,
       CASE WHEN cells >= 7 THEN 'polygon' ELSE 'circle' END AS fence_type, {rnd("lat", 6)} AS lat, {rnd("lon", 6)} AS lon,
          {rnd("(reach + 5) * 1000")} AS radius_m, cells,
       {rnd("aq", 2)} AS avg_quality, mq AS min_quality, cells * 73 AS area_km2
FROM (SELECT *, CASE WHEN p > 0 AND o > 0 THEN 'multi' WHEN o > 0 THEN 'onocoy' ELSE 'geodnet' END AS network, CASE
   WHEN f >= cells - f THEN 'full_rtk' ELSE 'degraded_rtk' END AS tier
      FROM zn LEFT JOIN hd USING (zone))
ORDER BY avg_quality DESC, zone_id LIMIT 450"""


CELL_PARTS = {"bas": BASE, "sq": SQUARES, "sen": SEEN_CELLS, "own": OWN_CELLS, "rg1": FIRST_RING, "rg2": SECOND_RING, "cel": CELLS, "nea": NEAR, "aro": AROUND}


def fitted(t: Tables) -> DataFrame:
    return s.fit_variogram(s.empirical_variogram(points(t)))


def cell_rows(t: Tables) -> DataFrame:
    return s.coverage_cells(t.fx_stations, t.fx_station_scores, t.fx_sessions, AS_OF)


def surface(t: Tables) -> DataFrame:
    return s.kriging_surface(points(t), fitted(t), 1.0)


ZONE_SIDES = f"""
SELECT s.*, c.zone FROM {sides("gd")} s JOIN zc c USING (cell) JOIN (SELECT zone FROM zc GROUP BY 1 HAVING count(*) >= 3) USING (zone)"""
RIM = "SELECT * FROM zs s WHERE NOT EXISTS (SELECT 1 FROM zs o WHERE o.zone = s.zone AND o.a = s.b AND o.b = s.a)"
#: From every corner around its ring; the ring is known by its smallest corner.
WALKED = """
SELECT zone, begin_ AS a, min(spot) AS ring FROM (
  WITH RECURSIVE walk(zone, begin_, spot) AS (
    SELECT zone, a, a FROM rim UNION SELECT w.zone, w.begin_, r.b FROM walk w JOIN rim r ON r.zone = w.zone AND r.a = w.spot)
  SELECT * FROM walk) GROUP BY 1, 2"""
_O, _P, _B, _Q = (("o.lat", "o.lon"), ("r.lat", "r.lon"), ("r.bend_lat", "r.bend_lon"), ("n.lat", "n.lon"))
OUTLINES = f"""
SELECT r.zone AS zone_id, w.ring, count(*) AS sides,
       {rnd("6371e0 * 6371 * sum(CASE WHEN r.bend_lat IS NULL THEN " + excess(_O, _P, _Q) + " ELSE " + excess(_O, _P, _B) + " + " + excess(_O, _B, _Q) + " END)", 3)} AS area_km2
FROM rim r JOIN wk w ON w.zone = r.zone AND w.a = r.a JOIN rim o ON o.zone = r.zone AND o.a = w.ring JOIN rim n ON n.zone = r.zone AND n.a = r.b
GROUP BY 1, 2"""
CELL_POLYGONS = f"""
SELECT CAST(cell AS VARCHAR) AS cell_id, 'Polygon' AS kind, count(*) + count(bend_lat) + 1 AS positions, true AS closed,
       {rnd("min(least(lat, coalesce(bend_lat, lat)))", 5)} AS south, {rnd("max(greatest(lat, coalesce(bend_lat, lat)))", 5)} AS north,
       {rnd("min(least(lon, coalesce(bend_lon, lon)))", 5)} AS west, {rnd("max(greatest(lon, coalesce(bend_lon, lon)))", 5)} AS east
FROM {sides("cel")} GROUP BY 1"""


def zone_outlines(t: Tables) -> DataFrame:
    return ring_areas(areas.zone_rings(cell_rows(t)), "zone").select(F.col("zone").alias("zone_id"), "ring", "sides", s.half_up("area_km2", 3).alias("area_km2"))


def cell_polygons(t: Tables) -> DataFrame:
    """What the GeoJSON features of the cells hold, read back from their text."""
    ring = F.from_json(F.get_json_object("feature", "$.geometry.coordinates"), "array<array<array<double>>>")[0]
    rows = tables.export_cells(cell_rows(t)).select("cell_id", F.get_json_object("feature", "$.geometry.type").alias("kind"), ring.alias("ring"))
    side = lambda f, k: s.half_up(f(F.transform("ring", lambda p: p[k])), 5)
    return rows.select("cell_id", "kind", F.size("ring").cast("long").alias("positions"), (F.col("ring")[0] == F.element_at("ring", -1)).alias("closed"),
                       side(F.array_min, 1).alias("south"), side(F.array_max, 1).alias("north"), side(F.array_min, 0).alias("west"), side(F.array_max, 0).alias("east"))


SPATIAL = {
    "zone_outlines": (zone_outlines, oracle(OUTLINES, **CELL_PARTS, cv=COVERAGE, gd=GOOD, edg=ADJOINING, comp=COMP, zc=ZONE_CELLS, zs=ZONE_SIDES, rim=RIM, wk=WALKED)),
    "cell_polygons": (cell_polygons, oracle(CELL_POLYGONS, **CELL_PARTS)),
    "coverage_zones": (
        lambda t: areas.coverage_zones(cell_rows(t), t.fx_stations, t.fx_trust).drop("points", "stations"),
        oracle(COVERAGE_ZONES, **CELL_PARTS, cv=COVERAGE, gd=GOOD, edg=ADJOINING, comp=COMP, zc=ZONE_CELLS, zn=ZONES, hd=HELD)),
    "coverage_cells": (cell_rows, oracle(COVERAGE, **CELL_PARTS)),
    "empirical_variogram": (
        lambda t: s.empirical_variogram(points(t)).select("bin", s.half_up("distance", 3).alias("distance"), s.half_up("semivariance", 3).alias("semivariance"), "count"),
        oracle(f"""SELECT bin, {rnd('distance', 3)} AS distance, {rnd('semivariance', 3)} AS semivariance, count
           FROM bns""", pts=POINTS, prs=PAIRS, bns=BINS)),
    "fit_variogram": (fitted, oracle(FIT, pts=POINTS, prs=PAIRS, bns=BINS)),
    "morans_i": (
        lambda t: s.morans_i(points(t))[0],
        oracle(f"""SELECT {rnd("i", 3)} AS global_i, {rnd("e", 3)} AS expected_i, {rnd("z", 2)} AS z_score, {rnd(PVAL, 4)} AS p_value, CASE
           WHEN {PVAL} > 5e-2 THEN 'random' WHEN i > 0 THEN 'clustered' ELSE 'dispersed' END AS interpretation
         FROM (SELECT *, CASE WHEN v > 0 THEN (i - e) / sqrt(v) ELSE 0e0 END AS z FROM glo)""", pts=POINTS, prs=PAIRS, rws=ROWS, glo=GLOBAL)),
    "local_morans_i": (
        lambda t: s.morans_i(points(t))[1],
        oracle(f"""SELECT id, {rnd("li", 3)} AS local_i, {rnd("z", 2)} AS z_score, CASE WHEN d > 0 AND lag > 0 THEN 'high-high' WHEN d < 0
           AND lag < 0 THEN 'low-low' WHEN d > 0 AND lag < 0 THEN 'high-low' ELSE 'low-high' END AS cluster_type
         FROM (SELECT r.id, r.lag, r.value - r.mean AS d, (r.value - r.mean) / r.s2 * r.lag AS li, (r.value - r.mean) / r.s2 * r.lag /
            sqrt(greatest(g.v, 1e-10)) AS z FROM rws r, glo g) WHERE abs(z) > 196e-2""", pts=POINTS, prs=PAIRS, rws=ROWS, glo=GLOBAL)),
    "kriging_surface": (surface, None),
}
