"""Registered queries of gap regions, overlay areas, integrity zones and surface summaries, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import actions, areas, spatial, zones

from .action_queries import OVERLAYS
from .detector_queries import ALERT_ROWS, ALERT_STATS, COMP
from .fixtures import Tables, oracle
from .spatial_queries import points
from .sql import km, rnd
from .zone_queries import GAPS, GATES, NEAREST, VALIDATION, gates, validation


def near(t: Tables) -> DataFrame:
    return zones.nearest_primary(t.fx_stations, t.fx_station_scores, t.fx_trust)


def pass_over(rows: str, order: str, reach: float) -> str:
    """``id, leader``: a sequential pass in which a row joins the first leader under ``reach`` km or becomes one itself."""
    close = km("lats[i]", "lons[i]", "o.lat", "o.lon")
    return f"""
SELECT id, leader FROM (
  WITH RECURSIVE ord AS (SELECT id, lat, lon, row_number() OVER (ORDER BY {order}) AS k FROM {rows}),
  walk(k, id, leader, names, lats, lons) AS (
    SELECT 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[], []::DOUBLE[], []::DOUBLE[]
    UNION ALL
    SELECT o.k, o.id, coalesce(names[hit], o.id), CASE WHEN hit IS NULL THEN list_append(names, o.id) ELSE names END,
           CASE WHEN hit IS NULL THEN list_append(lats, o.lat) ELSE lats END,
           CASE WHEN hit IS NULL THEN list_append(lons, o.lon) ELSE lons END
    FROM walk w JOIN ord o ON o.k = w.k + 1,
         LATERAL (SELECT nullif(list_position(list_transform(range(1, len(names) + 1), lambda i: {close} < {reach}e0), true), 0) AS hit) x)
  SELECT id, leader FROM walk WHERE k > 0)"""


GAP_ROWS = "SELECT name AS id, latitude AS lat, longitude AS lon, * FROM gp"
GAP_REGIONS = f"""
SELECT r.region, c.latitude, c.longitude, c.reason, c.primary_km, {rnd("least(4e1, c.primary_km * 6e-1)", 1)} AS radius_km, candidates, best_score,
       survey_grade, enabled_zones, best_candidate, best_score >= 5e-1 AS fillable
FROM (
  SELECT leader AS region, count(*) AS candidates, max(gap_fill_score) AS best_score, count(*) FILTER (hardware_class = 'survey_grade') AS
     survey_grade,
         count(*) FILTER (enabled) AS enabled_zones, arg_max(name, struct_pack(a := gap_fill_score, b := -priority, c := name)) AS best_candidate
  FROM ps JOIN gr USING (id) GROUP BY 1) r
JOIN gr c ON c.id = r.region"""

CANDIDATES = "SELECT zone_id AS id, * FROM ov"
KEPT = "SELECT o.* FROM ca o JOIN ps USING (id) WHERE id = leader"
TOUCH = f"""
SELECT a.zone_id AS a, b.zone_id AS b FROM kp a JOIN kp b ON a.zone_id <> b.zone_id
WHERE {km("a.lat", "a.lon", "b.lat", "b.lon")} * 1000 < a.radius_m + b.radius_m"""
PLACED = "SELECT k.*, coalesce(c.comp, k.zone_id) AS area FROM kp k LEFT JOIN comp c ON c.id = k.zone_id"
#: Three points of an area that are not on one line: then its hull is a polygon.
BENT = "(b.lat - a.lat) * (c.lon - a.lon) - (b.lon - a.lon) * (c.lat - a.lat)"
AREAS = f"""
SELECT *, members > 1 AND {km("s", "w", "n", "e")} <= 200 AS merged,
       EXISTS (SELECT 1 FROM pl a, pl b, pl c WHERE a.area = x.area AND b.area = x.area AND c.area = x.area AND {BENT} > 1e-12) AS bent,
       (SELECT max({km("x.mlat", "x.mlon", "p.lat", "p.lon")}) FROM pl p WHERE p.area = x.area) AS reach
FROM (
  SELECT area, count(*) AS members, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e, avg(lat) AS mlat, avg(lon) AS mlon,
         min(priority) AS priority, max(confidence) AS confidence, bool_or(hardware_class = 'survey_grade') AS survey,
         bool_or(validation_status = 'confirmed') AS confirmed, arg_min(reason, zone_id) AS reason, arg_min(hardware_class, zone_id) AS hardware_class
  FROM pl GROUP BY 1) x"""
MERGED = f"""
SELECT concat('merged_', area) AS zone_id, CASE WHEN priority <= 10 THEN 'primary' ELSE 'failover' END AS type, reason, priority,
       CASE WHEN bent THEN 'polygon' ELSE 'circle' END AS fence_type, {rnd("mlat", 6)} AS lat, {rnd("mlon", 6)} AS lon,
       CASE WHEN bent THEN 0e0 ELSE {rnd("least(45e3, (reach + 45) * 1000)")} END AS radius_m, members,
       CASE WHEN survey THEN 'survey_grade' ELSE hardware_class END AS hardware_class, {rnd("confidence", 2)} AS confidence,
       CASE WHEN confirmed THEN 'confirmed' ELSE 'untested' END AS validation_status
FROM ar WHERE merged
UNION ALL
SELECT p.zone_id, CASE WHEN p.priority <= 10 THEN 'primary' ELSE 'failover' END, p.reason, p.priority, 'circle', p.lat, p.lon, p.radius_m, 1,
       p.hardware_class, p.confidence, p.validation_status
FROM pl p JOIN ar ON ar.area = p.area WHERE NOT ar.merged"""
OVERLAY_PARTS = {"nea": NEAREST, "val": VALIDATION, "ov": OVERLAYS, "ca": CANDIDATES, "ps": pass_over("ca", "confidence DESC, id", 5), "kp": KEPT, "edg": TOUCH,
                 "comp": COMP, "pl": PLACED}


def qualified(t: Tables) -> DataFrame:
    """Stations that pass all gates, as :func:`areas.integrity_zones` takes them."""
    g = gates(t).filter("not disqualified").select(F.col("station").alias("name"), "network", F.col("composite_score").alias("trust"), F.col("uq_score").alias("uq"), "uptime",
                                                  F.col("quality_tier").alias("tier"))
    fix = t.fx_station_scores.select(F.col("station_name").alias("name"), "avg_fix_rate")
    return t.fx_stations.select("name", "latitude", "longitude").join(g, "name").join(fix, "name", "left").fillna({"avg_fix_rate": 0.0})


def storms(t: Tables) -> DataFrame:
    """A few circles of interference."""
    return t.fx_zones.filter("priority % 5 = 0").select(F.col("zone_id").alias("c_id"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), (F.col("radius_m") / 4000).alias("radius_km"))


QUALIFIED = f"""
SELECT s.name, s.latitude, s.longitude, g.network, g.composite_score AS trust, g.uq_score AS uq, g.uptime, g.quality_tier AS tier,
       coalesce(c.avg_fix_rate, 0e0) AS fix
FROM fx_stations s JOIN gt g ON g.station = s.name LEFT JOIN fx_station_scores c ON c.station_name = s.name
WHERE NOT g.disqualified AND NOT EXISTS (
  SELECT 1 FROM fx_zones z WHERE z.priority % 5 = 0 AND {km("s.latitude", "s.longitude", "z.lat", "z.lon")} <= z.radius_m / 4000)"""
CHOSEN = f"""
SELECT * FROM (
  SELECT o.*, CASE WHEN p.dk IS NULL OR p.dk > 4e1 * 7e-1 THEN 'gap' WHEN o.trust > p.p_trust + 15e-2 THEN 'upgrade' END AS kind
  FROM qs o LEFT JOIN (
    SELECT o.name, p.trust AS p_trust, {km("o.latitude", "o.longitude", "p.latitude", "p.longitude")} AS dk
    FROM qs o JOIN qs p ON o.network = 'onocoy' AND p.network = 'geodnet'
    QUALIFY row_number() OVER (PARTITION BY o.name ORDER BY dk, p.name) = 1) p USING (name)
  WHERE o.network = 'onocoy') WHERE kind IS NOT NULL"""
RANGE = f"""
SELECT a.name AS a, b.name AS b FROM ch a JOIN ch b ON a.name <> b.name
WHERE {km("a.latitude", "a.longitude", "b.latitude", "b.longitude")} <= 2e2 * 7e-1"""
CLUSTERED = "SELECT h.*, coalesce(c.comp, h.name) AS cluster, h.latitude AS lat, h.longitude AS lon FROM ch h LEFT JOIN comp c ON c.id = h.name"


def part_sql(lat: str, lon: str) -> str:
    rules = " ".join(f"WHEN {lat} > {s} AND {lat} <= {n} AND {lon} {'>=' if name == 'Eastern Europe' else '>'} {w} AND {lon} < {e} THEN '{name}'" for name, s, n, w, e in areas.WORLD_PARTS)
    return f"CASE {rules} ELSE 'Global' END"


INTEGRITY = f"""
SELECT 'integrity_primary_global' AS zone_id, 'primary' AS zone_type, 'Global' AS region, CASE
   WHEN count(*) FILTER (tier = 'platinum') > count(*) * 3e-1 THEN 1 ELSE 10 END AS priority,
       'circle' AS fence_type, 0e0 AS lat, 0e0 AS lon, 2e7 AS radius_m, count(*) AS stations, {rnd("avg(trust) * 100")} AS integrity_score,
       {rnd("coalesce(avg(fix) FILTER (fix > 0), 80e0)", 1)} AS expected_fix_rate, NULL AS failover
FROM qs WHERE network = 'geodnet' HAVING count(*) > 0
UNION ALL
SELECT concat('integrity_overlay_', cluster), CASE WHEN gap THEN 'overlay_gap' ELSE 'overlay_upgrade' END, {part_sql("mlat", "mlon")},
       CASE WHEN gap THEN CASE WHEN best THEN 20 ELSE 35 END WHEN best THEN 35 ELSE 50 END, CASE WHEN bent THEN 'polygon' ELSE 'circle' END,
       {rnd("mlat", 6)}, {rnd("mlon", 6)}, CASE WHEN NOT bent THEN {rnd("(reach + 5e1 * 7e-1) * 1000")} END, stations, {rnd("trust * 100")},
          {rnd("quality * 100", 1)}, 'integrity_primary_global'
FROM (
  SELECT *, EXISTS (SELECT 1 FROM cl a, cl b, cl c WHERE a.cluster = x.cluster AND b.cluster = x.cluster AND c.cluster = x.cluster
     AND {BENT} > 1e-12) AS bent,
         (SELECT max({km("x.mlat", "x.mlon", "p.lat", "p.lon")}) FROM cl p WHERE p.cluster = x.cluster) AS reach
  FROM (SELECT cluster, count(*) AS stations, count(*) FILTER (kind = 'gap') > count(*) / 2 AS gap, avg(lat) AS mlat, avg(lon) AS mlon, avg(trust) AS
     trust,
               coalesce(bool_or(tier = 'platinum'), false) AS best, avg(trust * uq * uptime) AS quality FROM cl GROUP BY 1) x)"""
INTEGRITY_PARTS = {"st": ALERT_STATS, "al": ALERT_ROWS, "gt": GATES, "qs": QUALIFIED, "ch": CHOSEN, "edg": RANGE, "comp": COMP, "cl": CLUSTERED}


def cell_surface(t: Tables) -> DataFrame:
    """A surface of two-degree nodes from the quality of cells, moved so that it meets several regions."""
    side = lambda c: F.floor(F.col(c) / 2).cast("int") * 2.0
    return t.fx_cells.groupBy(side("latitude").alias("lat"), (F.floor(F.col("longitude") / 2).cast("int") * 20.0 - 100).alias("lon")).agg(
        F.avg("quality_score").alias("predicted"), F.var_pop("quality_score").alias("variance"), F.count("*").alias("k")).withColumn(
            "confidence", F.when(F.col("k") > 4, "high").otherwise("low")).drop("k")


def cell_clusters(t: Tables) -> DataFrame:
    return t.fx_cells.select(F.col("latitude").alias("lat"), (F.col("longitude") * 10 - 100).alias("lon"), F.when(F.col("quality_score") > 0.6, "high-high").when(F.col("quality_score") < 0.2, "low-low")
                             .otherwise("high-low").alias("cluster_type")).filter("lat > 46")


_BOXES = ", ".join(f"('{n}', {la}e0, {lo}e0, {h}e0)" for n, la, lo, h in spatial.SURFACE_BOXES)
SURFACE = f"""
SELECT r.name AS region, r.la AS lat_center, r.lo AS lon_center, n AS n_points, {rnd("p", 1)} AS mean_predicted, {rnd("v", 3)} AS mean_variance,
       coalesce((SELECT arg_min(kind, struct_pack(a := -k, b := kind)) FROM (SELECT cluster_type AS kind, count(*) AS k FROM lc
          WHERE abs(lat - r.la) < r.h AND abs(lon - r.lo) < r.h GROUP BY 1)),
                'not-significant') AS moran_type
FROM (VALUES {_BOXES}) r(name, la, lo, h),
     LATERAL (SELECT count(*) AS n, avg(predicted) AS p, avg(variance) AS v FROM sf WHERE abs(lat - r.la) < r.h AND abs(lon - r.lo) < r.h) x
WHERE n > 0"""
CELL_SURFACE = """
SELECT floor(latitude / 2) * 2 AS lat, floor(longitude / 2) * 20 - 100 AS lon, avg(quality_score) AS predicted, var_pop(quality_score) AS variance
FROM fx_cells GROUP BY 1, 2"""
CELL_CLUSTERS = """
SELECT latitude AS lat, longitude * 10 - 100 AS lon,
       CASE WHEN quality_score > 6e-1 THEN 'high-high' WHEN quality_score < 2e-1 THEN 'low-low' ELSE 'high-low' END AS cluster_type
FROM fx_cells WHERE latitude > 46"""


def quality_surface(t: Tables) -> DataFrame:
    """The whole chain: variogram, kriging, local clusters, regions."""
    p = points(t)
    model = spatial.fit_variogram(spatial.empirical_variogram(p))
    local = spatial.morans_i(p)[1].join(p.select("id", "lat", "lon"), "id")
    return spatial.surface_regions(spatial.kriging_surface(p, model, 1.0), local)


AREA_TABLE = {
    "gap_regions": (
        lambda t: zones.gap_regions(zones.gap_candidates(t.fx_stations, t.fx_station_scores, t.fx_trust, validation(t))),
        oracle(GAP_REGIONS, nea=NEAREST, val=VALIDATION, gp=GAPS, gr=GAP_ROWS, ps=pass_over("gr", "id", 30))),
    "overlay_zones": (
        lambda t: actions.overlay_zones(near(t), validation(t)).select("zone_id", "confidence", "radius_m", "area"),
        oracle("SELECT zone_id, confidence, radius_m, area FROM pl", **OVERLAY_PARTS)),
    "merged_overlays": (lambda t: areas.merged_overlays(actions.overlay_zones(near(t), validation(t))).drop("points"), oracle(MERGED, **OVERLAY_PARTS, ar=AREAS)),
    "overlay_stats": (
        lambda t: areas.overlay_stats(areas.merged_overlays(actions.overlay_zones(near(t), validation(t)))),
        oracle("""SELECT count(*) AS zones, count(*) FILTER (type = 'primary') AS primary_zones, count(*) FILTER (type = 'failover') AS
           failover_zones, count(*) FILTER (fence_type = 'polygon') AS polygons,
         CAST(sum(members) AS bigint) AS stations, count(*) FILTER (hardware_class = 'survey_grade') AS survey_grade, count(*) FILTER
            (validation_status = 'confirmed') AS confirmed FROM mg""",
               **OVERLAY_PARTS, ar=AREAS, mg=MERGED)),
    "integrity_zones": (lambda t: areas.integrity_zones(qualified(t), 5.0, storms(t))[0].drop("points"), oracle(INTEGRITY, **INTEGRITY_PARTS)),
    "integrity_zone_members": (
        lambda t: areas.integrity_zones(qualified(t), 5.0, storms(t))[1],
        oracle("""SELECT 'integrity_primary_global' AS zone_id, name AS station FROM qs WHERE network = 'geodnet'
         UNION ALL SELECT concat('integrity_overlay_', cluster), name FROM cl""", **INTEGRITY_PARTS)),
    "surface_regions": (lambda t: spatial.surface_regions(cell_surface(t), cell_clusters(t)), oracle(SURFACE, sf=CELL_SURFACE, lc=CELL_CLUSTERS)),
    "quality_surface": (quality_surface, None),
}
