"""Registered queries of trust, gates, zones, gaps and classifiers, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import classify
from plumbline.functions.geo import distance_join, half_degree_cell, PLACE_BOXES, nearest_join, place_name, region_by_box, region_by_circle
from plumbline.functions.rules import half_up, severity_rank
from plumbline.operators import detectors, reports, scores, trust, zones

from .detector_queries import ALERT_ROWS, ALERT_STATS
from .fixtures import AS_OF, Tables, oracle
from .report_queries import ANOMALIES, SEEN, anomalies
from .sql import D7, D14, H6, H24, NOISE, POSITION, STATION, box, circle, km, place, rnd

H4 = AS_OF - 4 * 3_600_000
DECAYED = AS_OF - 12 * 3_600_000


def state(t: Tables) -> DataFrame:
    """Trust state as of twelve hours ago; excluded stations since 5, 7 or 30 hours."""
    n = F.substring("station", 3, 6).cast("int")
    hours = F.when(n % 3 == 0, 5).when(n % 3 == 1, 7).otherwise(30)
    return t.fx_trust.select("station", "alpha", "beta", F.lit(DECAYED).cast("long").alias("last_decay"),
                             F.when(F.col("flag") == "excluded", AS_OF - hours * 3_600_000).alias("excluded_at"))


STATE = f"""SELECT station, alpha, beta, CAST({DECAYED} AS bigint) AS last_decay, CASE WHEN flag = 'excluded' THEN {AS_OF} -
   CASE CAST(substr(station, 3) AS int) % 3 WHEN 0 THEN 5 WHEN 1 THEN 7 ELSE 30 END * 3600000 END AS excluded_at FROM fx_trust"""


def counts(t: Tables) -> DataFrame:
    return anomalies(t).groupBy("station").agg((F.count("*") * 2).alias("anomalies"))


EVIDENCE = f"""SELECT station, sum(CASE WHEN fix_rate >= 70 THEN 1e0 WHEN fix_rate <= 20 THEN 0e0 ELSE (fix_rate - 20) / 5e1 * 5e-1 END) AS da,
 sum(CASE WHEN fix_rate >= 70 THEN 0e0 WHEN fix_rate <= 20 THEN 15e-1
    ELSE (1 - (fix_rate - 20) / 5e1) * 5e-1 END) AS db, count(*) AS n, avg(fix_rate) AS mf FROM fx_sessions WHERE {SEEN} AND login_time >= {H4}
    GROUP BY 1"""
CONSISTENCY = f"""SELECT a.station, greatest(0e0, 1 - avg(abs(a.mf - b.mf)) / 5e1) AS cons FROM ev a JOIN fx_stations p ON p.name = a.station, ev b
   JOIN fx_stations q ON q.name = b.station
 WHERE a.station <> b.station AND a.n >= 3 AND b.n >= 3 AND {km("p.latitude", "p.longitude", "q.latitude", "q.longitude")} <= 80 GROUP BY 1"""
TRUST = f"""SELECT * EXCLUDE (ex), coalesce(ex, 0) AS excluded_at
   FROM (SELECT station, network, {rnd("a", 2)} AS alpha, {rnd("b", 2)} AS beta, {rnd("tr", 3)} AS trust_score, {rnd("wq", 3)} AS w_quality,
   {rnd("wu", 3)} AS w_uptime, {rnd("wc", 3)} AS w_consistency,
 {rnd("wh", 3)} AS w_history, {rnd("wd", 3)} AS w_distance, {rnd("bl", 3)} AS composite_score, {rnd("conf", 3)} AS confidence, {rnd("sm")} AS
    total_sessions,
 CASE WHEN sm < 10 THEN 'new' WHEN excluded_at IS NOT NULL THEN CASE WHEN back THEN 'probation' ELSE 'excluded' END WHEN bl < 25e-2 THEN 'excluded'
    WHEN bl >= 65e-2 THEN 'trusted' WHEN bl >= 4e-1 THEN 'probation' ELSE 'untrusted' END AS flag,
 CASE WHEN sm < 10 THEN excluded_at WHEN excluded_at IS NOT NULL THEN CASE WHEN NOT back THEN excluded_at END WHEN bl < 25e-2 THEN {AS_OF} END AS ex
FROM (SELECT *, (h >= 6 AND bl >= 7e-1) OR (h >= 24 AND bl >= 55e-2) AS back
   FROM (SELECT *, ({AS_OF} - excluded_at) / 36e5 AS h, tr * 6e-1 + 4e-1 * (wq * 3e-1 + wu * 2e-1 + wc * 2e-1 + wh * 15e-2 + wd * 15e-2) AS bl,
 greatest(0e0, least(1e0, 1 - CASE WHEN a + b > 2 THEN 392e-2 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) ELSE 1e0 END)) AS conf
    FROM (SELECT *, a / (a + b) AS tr, a + b - 2 AS sm FROM (
 SELECT station, coalesce(network, 'unknown') AS network, excluded_at, CASE WHEN n IS NULL THEN alpha
    ELSE 1 + (coalesce(alpha, 1e0) - 1) * pow(995e-3, greatest(1e0, {rnd(f"({AS_OF} - coalesce(last_decay, {AS_OF})) / 144e5")})) + da END AS a,
  CASE WHEN n IS NULL THEN beta ELSE 1 + (coalesce(beta, 1e0) - 1) * pow(995e-3, greatest(1e0,
     {rnd(f"({AS_OF} - coalesce(last_decay, {AS_OF})) / 144e5")})) + db END AS b,
  CASE WHEN coalesce(uq, 0e0) = 0 THEN 5e-1 ELSE uq END AS wq, CASE WHEN coalesce(up, 0e0) = 0 THEN 5e-1
     ELSE up END AS wu, coalesce(cons, 75e-2) AS wc, greatest(1e-1, 1 - coalesce(an, 0) * 1e-1) AS wh,
  coalesce(greatest(0e0, 1 - dk / 1e2), 5e-1) AS wd
 FROM stt FULL JOIN ev USING (station) LEFT JOIN (SELECT name AS station, network, coalesce(uq_score, 5e-1) AS uq, coalesce(uptime_7d, 5e-1) AS up
    FROM fx_stations LEFT JOIN fx_station_scores ON station_name = name) m USING (station)
 LEFT JOIN con USING (station) LEFT JOIN (SELECT s.station, avg({km("s.latitude", "s.longitude", "p.latitude", "p.longitude")}) AS dk
    FROM fx_sessions s JOIN fx_stations p ON p.name = s.station
   WHERE {NOISE} AND login_time >= {H4} AND abs(s.latitude) > 0.1 AND s.longitude <> 0 GROUP BY 1) d USING (station)
 LEFT JOIN (SELECT station, count(*) * 2 AS an FROM ano GROUP BY 1) x USING (station))))))"""
ZONES = """SELECT zone_id, enabled, fence_type, lat, lon, CAST(radius_m AS double) AS radius_m, [[lat - 5e-1, lon - 7e-1], [lat + 5e-1, lon - 7e-1],
   [lat + 5e-1, lon + 7e-1], [lat, lon], [lat - 5e-1, lon + 7e-1]] AS points FROM fx_zones"""
#: The same concave ring as five edges, for the even-odd test in SQL.
RING = ["-5e-1,-7e-1", "5e-1,-7e-1", "5e-1,7e-1", "0e0,0e0", "-5e-1,7e-1"]


def zones_of(t: Tables) -> DataFrame:
    ring = F.array(*[F.array(F.col("lat") + float(a), F.col("lon") + float(b)) for a, b in (p.split(",") for p in RING)])
    return t.fx_zones.select("zone_id", "enabled", "fence_type", "lat", "lon", F.col("radius_m").cast("double").alias("radius_m"), ring.alias("points"))


def _inside(lat: str, lon: str) -> str:
    corners = [[float(x) for x in p.split(",")] for p in RING]
    crossings = []
    for i, (yi, xi) in enumerate(corners):
        yj, xj = corners[i - 1]
        crossings.append(f"CASE WHEN (z.lat + {yi}e0 > {lat}) <> (z.lat + {yj}e0 > {lat}) AND {lon} < ((z.lon + {xj}e0) - (z.lon + {xi}e0)) * ({lat} - (z.lat + {yi}e0)) / ((z.lat + {yj}e0) - (z.lat + {yi}e0)) + (z.lon + {xi}e0) THEN 1 ELSE 0 END")
    return f"(z.enabled AND CASE WHEN z.fence_type = 'circle' THEN {km(lat, lon, 'z.lat', 'z.lon')} * 1e3 <= z.radius_m ELSE ({' + '.join(crossings)}) % 2 = 1 END)"


IN_ZONE = f"""SELECT z.zone_id, s.* FROM fx_sessions s JOIN fx_zones z ON {_inside('s.latitude', 's.longitude')} WHERE {SEEN} AND s.latitude IS NOT NULL
   AND abs(s.latitude) > 0.1 AND login_time >= {H24}"""
ZONE_INTEGRITY = f"""SELECT zone_id, least(1e2, greatest(0e0,
   {rnd("least(1e0, f / 1e2) * 40 + tr * 30 + least(1e0, st / 5e0) * 20 + CASE WHEN n < 5 THEN 75e-2 ELSE greatest(0e0, 1 - sd / 5e1) END * 10")})) AS
   integrity_score, {rnd("f", 1)} AS mean_fix_rate,
 n AS active_sessions, u AS active_users, {rnd("tr", 3)} AS trust_avg, CASE WHEN nb >= 10 AND f > b * 105e-2 THEN 'improving' WHEN nb >= 10
    AND f < b * 95e-2 THEN 'declining' ELSE 'stable' END AS trend
FROM (SELECT zone_id, count(*) FILTER (login_time >= {H6}) AS n, avg(fix_rate) FILTER (login_time >= {H6}) AS f, stddev_pop(fix_rate) FILTER
   (login_time >= {H6}) AS sd, count(DISTINCT username) FILTER (login_time >= {H6}) AS u,
  count(*) FILTER (login_time < {H6}) AS nb, avg(fix_rate) FILTER (login_time < {H6}) AS b FROM inz GROUP BY 1)
 JOIN (SELECT zone_id, avg(coalesce(composite_score, 5e-1)) AS tr, count(*) AS st FROM (SELECT DISTINCT zone_id, station FROM inz
    WHERE login_time >= {H6}) LEFT JOIN fx_trust USING (station) GROUP BY 1) USING (zone_id)"""


def zone_stations(t: Tables) -> DataFrame:
    """Stations by the last digit of their number: ten zones."""
    return t.fx_stations.groupBy(F.concat(F.lit("z"), F.substring("name", -1, 1)).alias("zone_id")).agg(F.collect_list("name").alias("stations"))


FEEDBACK = f"""SELECT zone_id, session_count, unique_users, {rnd("mean", 1)} AS mean_fix_rate, {rnd("p10", 1)} AS p10_fix_rate,
 CASE WHEN mean >= 85 THEN 'A' WHEN mean >= 70 THEN 'B' WHEN mean >= 50 THEN 'C' WHEN mean >= 30 THEN 'D' ELSE 'F' END AS quality_grade,
 array_to_string(list_filter([CASE WHEN mean < 30 THEN 'critical' WHEN mean < 50 THEN 'poor' END, CASE WHEN p10 < 10 THEN 'low_p10' END, CASE
    WHEN ed THEN 'edge_drop' END], lambda x: x IS NOT NULL), ',') AS issues,
 CASE WHEN mean < 30 THEN 'disable' WHEN mean < 50 THEN 'adjust_priority' WHEN p10 < 10 THEN 'investigate' WHEN ed THEN 'expand_overlap'
    ELSE 'keep' END AS recommendation
FROM (SELECT a.*, coalesce(of_ >= 3 AND session_count >= 20 AND core - edge > 20, false) AS ed
   FROM (SELECT zone_id, count(*) AS session_count, count(DISTINCT username) AS unique_users, avg(fix_rate) AS mean,
   list_sort(list(fix_rate))[CAST(floor(count(*) * 1e-1) AS int) + 1] AS p10 FROM zs GROUP BY 1 HAVING count(*) >= 5) a
 LEFT JOIN (SELECT zone_id, max(of_) AS of_, avg(av) FILTER (k <= ceil(of_ / 2)) AS core, avg(av) FILTER (k > ceil(of_ / 2)) AS edge
    FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY n DESC, station) AS k,
   count(*) OVER (PARTITION BY zone_id) AS of_ FROM (SELECT zone_id, station, avg(fix_rate) AS av, count(*) AS n FROM zs GROUP BY 1, 2))
      GROUP BY 1) USING (zone_id))"""
ZONE_SESSIONS = f"""SELECT concat('z', right(station, 1)) AS zone_id, s.* FROM fx_sessions s WHERE {SEEN} AND login_time >= {H24}
   AND station IN (SELECT name FROM fx_stations)"""
NEAREST = f"""SELECT o.*, n.primary_name AS "primary", n.dk AS distance_km, n.p_uq, n.p_trust FROM fx_stations o LEFT
   JOIN (SELECT o.name, p.name AS primary_name, {km("o.latitude", "o.longitude", "p.latitude", "p.longitude")} AS dk,
  coalesce(c.uq_score, 5e-1) AS p_uq, coalesce(r.composite_score, 5e-1) AS p_trust FROM fx_stations o, fx_stations p LEFT JOIN fx_station_scores c
     ON c.station_name = p.name LEFT JOIN fx_trust r ON r.station = p.name
  WHERE o.network = 'onocoy' AND p.network = 'geodnet' QUALIFY row_number() OVER (PARTITION BY o.name ORDER BY dk, p.name) = 1) n ON n.name = o.name
     WHERE o.network = 'onocoy'"""


def validation(t: Tables) -> DataFrame:
    return t.fx_trust.select("station", F.when(F.col("flag") == "trusted", "confirmed").when(F.col("flag") == "excluded", "rejected").otherwise("live_testing").alias("status"),
                             (F.col("composite_score") * 100).alias("fix_rate"), (F.col("alpha") % 60).cast("long").alias("sessions"), F.lit(AS_OF - 86_400_000).cast("long").alias("last_updated"))


VALIDATION = f"""SELECT station, CASE WHEN flag = 'trusted' THEN 'confirmed' WHEN flag = 'excluded' THEN 'rejected'
   ELSE 'live_testing' END AS status, composite_score * 100 AS fix_rate,
 CAST(alpha AS bigint) % 60 AS sessions, CAST({AS_OF - 86_400_000} AS bigint) AS last_updated FROM fx_trust"""


def _like(col: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


HW = f"""CASE WHEN {_like("h", classify.SURVEY)} THEN 'survey_grade|95e-2' WHEN {_like("h", classify.PROFESSIONAL)} THEN 'professional|8e-1'
   WHEN {_like("h", classify.CONSUMER)} THEN 'consumer|5e-1'
 WHEN contains(h, 'SURVEY_GRADE_INFERRED') THEN 'survey_grade|75e-2' WHEN contains(h, 'PROFESSIONAL_INFERRED') THEN 'professional|65e-2'
    WHEN contains(h, 'CONSUMER_GOOD_INFERRED') THEN 'consumer|5e-1'
 WHEN contains(h, 'CONSUMER_BASIC_INFERRED') THEN 'consumer|3e-1' ELSE 'unknown|2e-1' END"""
GAPS = f"""SELECT name, latitude, longitude, "primary", {rnd("dk", 1)} AS primary_km, reason, hc AS hardware_class, sc AS gap_fill_score,
 CASE hc WHEN 'survey_grade' THEN CASE st WHEN 'confirmed' THEN 10 WHEN 'live_testing' THEN 20 ELSE 15 END WHEN 'professional' THEN CASE st
    WHEN 'confirmed' THEN 15 ELSE 25 END ELSE CASE st WHEN 'confirmed' THEN 20 ELSE 35 END END AS priority,
 {rnd("least(35e3, dk * 500)")} AS radius_m, (sc >= 6e-1 OR hc = 'survey_grade') AS enabled, st AS validation_status
FROM (SELECT *,
   {rnd("least(1e0, hcf * 4e-1 + CASE WHEN dk > 100 THEN 1e0 WHEN dk > 60 THEN 8e-1 WHEN dk > 40 THEN 6e-1 WHEN dk > 20 THEN 3e-1 ELSE 1e-1 END * 3e-1 + (1 - coalesce(p_uq, 0e0)) * 2e-1 + CASE WHEN st = 'confirmed' AND coalesce(vf, 0) <> 0 THEN vf / 1e2 * 1e-1 WHEN st = 'live_testing' THEN 5e-2 ELSE 0e0 END)", 2)}
   AS sc,
  CASE WHEN dk > 40 THEN 'no_primary' WHEN coalesce(p_uq, 0e0) < 55e-2 AND dk > 15 THEN 'primary_poor' WHEN coalesce(p_trust, 0e0) < 4e-1
     AND dk > 15 THEN 'primary_untrusted' END AS reason
 FROM (SELECT n.*, coalesce(distance_km, 999e0) AS dk, split_part(hw, '|', 1) AS hc, CAST(split_part(hw, '|', 2) AS double) AS hcf, coalesce(v.status,
    'untested') AS st, v.fix_rate AS vf
  FROM (SELECT *, {HW} AS hw FROM (SELECT *, upper(concat_ws(' ', CASE WHEN receiver_type = '' THEN name ELSE receiver_type END, antenna_type)) AS h
     FROM nea)) n LEFT JOIN val v ON v.station = n.name))
WHERE hc <> 'unknown' AND reason IS NOT NULL AND st <> 'rejected'"""


def gates(t: Tables) -> DataFrame:
    return trust.qualified_stations(t.fx_stations, t.fx_station_scores, t.fx_trust, t.fx_trust.filter("alpha > 45").select("station"), detectors.predictive_alerts(t.fx_sessions, AS_OF, 2, limit=None))


GATES = f"""SELECT station, network, {rnd("sc", 3)} AS composite_score, {rnd("uq", 3)} AS uq_score, {rnd("up", 3)} AS uptime, tier AS quality_tier,
 CASE WHEN alert = 'pre_downgrade' THEN least(99e0, base + 20) WHEN alert = 'pre_promote' AND base > 10 THEN greatest(1e0, base - 10)
    ELSE base END AS cascade_priority, gate AS disqualify_reason, gate IS NOT NULL AS disqualified
FROM (SELECT *, least(99e0, greatest(1e0, CASE WHEN sc >= 85e-2 THEN {rnd("(1 - sc) * 20 + 1")} WHEN sc >= 7e-1 THEN {rnd("(85e-2 - sc) * 60 + 11")}
   ELSE {rnd("(7e-1 - sc) * 60 + 31")} END)) AS base,
  CASE WHEN sc >= 85e-2 THEN 'platinum' WHEN sc >= 7e-1 THEN 'gold' ELSE 'silver' END AS tier,
  CASE WHEN alert = 'pre_exclude' THEN 'predictive' WHEN flag = 'excluded' THEN 'excluded' WHEN sc < 55e-2 THEN 'trust' WHEN up < 5e-1 THEN 'uptime'
     WHEN uq < 3e-1 THEN 'quality' WHEN hit THEN 'critical_event'
   WHEN n < 5 AND flag = 'new' AND uq < 5e-1 THEN 'new_low_quality' END AS gate
 FROM (SELECT s.name AS station, coalesce(s.network, 'unknown') AS network, coalesce(composite_score, 6e-1) AS sc, coalesce(flag, 'new') AS flag,
    coalesce(uq_score, 0e0) AS uq, coalesce(uptime_7d, 0e0) AS up,
   coalesce(session_count, 0) AS n, coalesce(r.alpha > 45, false) AS hit, a.action AS alert FROM fx_stations s LEFT JOIN fx_station_scores
      ON station_name = s.name LEFT JOIN fx_trust r ON r.station = s.name
   LEFT JOIN (SELECT station, action FROM al QUALIFY row_number() OVER (PARTITION BY station ORDER BY confidence DESC, indicator) = 1) a
      ON a.station = s.name))"""
WEATHER = """SELECT event_id, value, 950 + value % 90 AS p, value % 45 - 10 AS t, value % 100 AS h, user_id % 80 AS lat, user_id % 3000 AS z
   FROM events"""


def weather(t: Tables) -> DataFrame:
    return t.events.selectExpr("event_id", "value", "950 + value % 90 AS p", "value % 45 - 10 AS t", "value % 100 AS h", "cast(user_id % 80 AS double) AS lat", "cast(user_id % 3000 AS double) AS z")


def pairs_within(t: Tables, reach: float) -> DataFrame:
    right = t.fx_stations.select(F.col("name").alias("other"), F.col("latitude").alias("r_latitude"), F.col("longitude").alias("r_longitude"))
    return distance_join(t.fx_stations.select("name", "latitude", "longitude"), right, reach, spread=True).filter("name < other").select("name", "other", half_up("distance_km", 3).alias("km"))


def named_places(t: Tables) -> DataFrame:
    """The cells' places spread over the globe, so that every box of a scheme has some, under the names of each scheme."""
    lat, lon = (F.col("latitude") - 43.5) * 20 - 60, (F.col("longitude") - 1.5) * 33 - 178
    return t.fx_cells.select("cell_id", *(place_name(lat, lon, scheme).alias(f"{scheme}_name") for scheme in PLACE_BOXES))


ZONE_TABLE = {
    "trust_scores": (
        lambda t: trust.trust_scores(t.fx_sessions, state(t), t.fx_stations, t.fx_station_scores, counts(t), AS_OF).fillna(0, ["excluded_at"]), oracle(TRUST, ano=ANOMALIES, stt=STATE, ev=EVIDENCE, con=CONSISTENCY)),
    "trust_ordering": (
        lambda t: trust.trust_order(t.fx_trust, 10).select("station", "flag", "composite_score"),
        oracle("""SELECT station, flag, composite_score FROM fx_trust ORDER BY CASE flag WHEN 'excluded' THEN 0 WHEN 'untrusted' THEN 1
           WHEN 'probation' THEN 2 WHEN 'new' THEN 3 ELSE 4 END, composite_score, station LIMIT 10""")),
    "trust_from_logs": (
        lambda t: trust.trust_from_logs(reports.caster_performance(t.fx_caster_log), t.fx_trust),
        oracle(f"""SELECT station, {rnd("coalesce(alpha, 1e0) + CASE WHEN use AND st > 7e-1 THEN w ELSE 0e0 END", 4)} AS alpha,
           {rnd("coalesce(beta, 1e0) + CASE WHEN use AND st < 3e-1 THEN w ELSE 0e0 END", 4)} AS beta FROM
         (SELECT *, coalesce(n >= 3 AND NOT (SELECT count(*) > 10 AND count(*) FILTER (st < 3e-1) / count(*) > 5e-1
            FROM pf), false) AS use, log10(greatest(1, n)) * 3e-1 AS w FROM fx_trust FULL JOIN pf USING (station))
         WHERE alpha IS NOT NULL OR use""", pf=f"""SELECT backend_source AS station, count(*) AS n,
            {rnd("least(1e0, avg(duration_s) / 18e2) * (1 - least(1e0, sum(failover_count) / count(*)) * 5e-1)", 2)} AS st
         FROM fx_caster_log WHERE coalesce(backend_source, '') <> '' GROUP BY 1""")),
    "overlay_validation": (
        lambda t: trust.overlay_validation(validation(t), t.fx_station_scores.filter("session_count > 0").select(F.col("station_name").alias("station"), F.col("avg_fix_rate").alias("new_fix"), F.col("session_count").cast("long").alias("new_sessions")), AS_OF),
        oracle(f"""SELECT station, CASE WHEN ns IS NULL THEN status WHEN tot >= 50 THEN CASE WHEN fx >= 70 THEN 'confirmed'
           WHEN fx < 40 THEN 'rejected' ELSE 'live_testing' END WHEN tot >= 10 THEN CASE WHEN fx >= 80 THEN 'confirmed' WHEN fx < 20 THEN 'rejected'
           ELSE 'live_testing' END
          ELSE 'live_testing' END AS status, CASE WHEN ns IS NULL THEN fix_rate ELSE {rnd("fx", 1)} END AS fix_rate, CASE
             WHEN ns IS NULL THEN sessions ELSE tot END AS sessions, CASE WHEN ns IS NULL THEN last_updated ELSE {AS_OF} END AS last_updated
         FROM (SELECT *, CASE WHEN coalesce(fix_rate, 0e0) <> 0 THEN fix_rate * 6e-1 + nf * 4e-1 ELSE nf END AS fx, coalesce(sessions, 0) + ns AS tot
            FROM val FULL JOIN
          (SELECT station_name AS station, avg_fix_rate AS nf, session_count AS ns FROM fx_station_scores
             WHERE session_count > 0) USING (station))""", val=VALIDATION)),
    "qualified_stations": (gates, oracle(GATES, st=ALERT_STATS, al=ALERT_ROWS)),
    "qualified_tiers": (
        lambda t: gates(t).filter("not disqualified").groupBy("quality_tier", "network").agg(F.count("*").alias("stations"), half_up(F.avg("composite_score"), 3).alias("avg_composite")),
        oracle(f"""SELECT quality_tier, network, count(*) AS stations, {rnd('avg(composite_score)', 3)} AS avg_composite FROM gt WHERE NOT disqualified
           GROUP BY 1, 2""", st=ALERT_STATS, al=ALERT_ROWS, gt=GATES)),
    "point_in_geofence": (
        lambda t: zones.point_in_geofence(t.fx_stations.select("name", "latitude", "longitude"), zones_of(t)).select("name", "zone_id"),
        oracle(f"SELECT s.name, z.zone_id FROM fx_stations s JOIN fx_zones z ON {_inside('s.latitude', 's.longitude')}")),
    "zone_integrity": (lambda t: zones.zone_integrity(zones_of(t), t.fx_sessions, t.fx_trust, AS_OF), oracle(ZONE_INTEGRITY, inz=IN_ZONE)),
    "session_feedback": (lambda t: zones.session_feedback(zone_stations(t), t.fx_sessions, AS_OF), oracle(FEEDBACK, zs=ZONE_SESSIONS)),
    "stations_in_zones": (
        lambda t: zones.stations_in_zones(zone_stations(t), t.fx_sessions).groupBy("zone_id").agg(F.count("*").alias("sessions")),
        oracle("""SELECT concat('z', right(station, 1)) AS zone_id, count(*) AS sessions FROM fx_sessions WHERE station IN (SELECT name
           FROM fx_stations) GROUP BY 1""")),
    "stations_outside_regions": (
        lambda t: zones.stations_outside_regions(t.fx_stations, t.fx_zones.filter("enabled").select(F.col("zone_id").alias("c_id"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), (F.col("radius_m") / 2000).alias("radius_km"))).select("name"),
        oracle(f"""SELECT name FROM fx_stations s WHERE NOT EXISTS (SELECT 1 FROM fx_zones z WHERE z.enabled
           AND {km('s.latitude', 's.longitude', 'z.lat', 'z.lon')} <= z.radius_m / 2000)""")),
    "uncovered_sessions": (
        lambda t: zones.uncovered_sessions(t.fx_sessions, t.fx_stations, AS_OF, km=12.0),
        oracle(f"""SELECT "row", "column", sessions, {rnd("x.latitude", 4)} AS lat, {rnd("x.longitude", 4)} AS lon
           FROM (SELECT floor(latitude) AS "row", floor(longitude) AS "column", count(*) AS sessions,
          max(struct_pack(login_time := login_time, id := id, latitude := latitude, longitude := longitude)) AS x FROM fx_sessions s
             WHERE login_time >= {D14} AND {POSITION} AND NOT EXISTS (SELECT 1 FROM fx_stations p
          WHERE sqrt(pow((s.latitude - p.latitude) * 111, 2) + pow((s.longitude - p.longitude) * 111 * cos(radians(s.latitude)), 2)) <= 12)
             GROUP BY 1, 2 HAVING count(*) >= 2)""")),
    "distance_join": (
        lambda t: pairs_within(t, 80.0),
        oracle(f"""SELECT a.name, b.name AS other, {rnd(km("a.latitude", "a.longitude", "b.latitude", "b.longitude"), 3)} AS km FROM fx_stations a
           JOIN fx_stations b ON a.name < b.name AND {km("a.latitude", "a.longitude", "b.latitude", "b.longitude")} <= 80""")),
    "nearest_join": (
        lambda t: nearest_join(t.fx_cells, t.fx_stations.select(F.col("name").alias("station"), F.col("latitude").alias("r_latitude"), F.col("longitude").alias("r_longitude")), "cell_id", "station")
        .select("cell_id", "station", half_up("distance_km", 2).alias("km")),
        oracle(f"""SELECT cell_id, station, {rnd("dk", 2)} AS km
           FROM (SELECT c.cell_id, s.name AS station, {km("c.latitude", "c.longitude", "s.latitude", "s.longitude")} AS dk
           FROM fx_cells c, fx_stations s
         QUALIFY row_number() OVER (PARTITION BY c.cell_id ORDER BY dk, s.name) = 1)""")),
    "gap_fill": (lambda t: zones.gap_candidates(t.fx_stations, t.fx_station_scores, t.fx_trust, validation(t)), oracle(GAPS, nea=NEAREST, val=VALIDATION)),
    "probe_targets": (
        lambda t: zones.probe_targets(t.fx_stations, t.fx_station_scores, t.fx_trust),
        oracle(f"""SELECT name, CASE WHEN distance_km > 40 THEN 'primary_gap'
           ELSE 'potential_upgrade' END AS reason, {rnd("distance_km", 1)} AS primary_km, p_uq FROM nea WHERE distance_km > 40 OR (p_uq < 4e-1
           AND distance_km < 80)
         ORDER BY CASE WHEN distance_km > 40 THEN 0 ELSE 1 END, 3 DESC, name LIMIT 50""", nea=NEAREST)),
    "zone_changes": (
        lambda t: zones.zone_changes(t.fx_zones.filter("priority < 80").select("zone_id", (F.col("priority") / 100).alias("quality")), t.fx_zones.filter("priority > 20").select("zone_id", (F.col("priority") * 1.1 / 100).alias("quality"))),
        oracle("""SELECT zone_id, CASE WHEN p IS NULL THEN 'added' WHEN q IS NULL THEN 'removed' ELSE 'updated' END AS change
           FROM (SELECT zone_id, priority / 1e2 AS p FROM fx_zones WHERE priority < 80)
         FULL JOIN (SELECT zone_id, priority * 11e-1 / 1e2 AS q FROM fx_zones WHERE priority > 20) USING (zone_id) WHERE p IS NULL OR q IS NULL
            OR abs(p - q) > 5e-2""")),
    "merge_zones": (
        lambda t: zones.merge_zones(t.fx_zones.filter("priority % 3 = 0").select("zone_id", F.lit("manual").alias("origin")), t.fx_zones.select("zone_id", F.lit("generated").alias("origin"))),
        oracle("SELECT zone_id, CASE WHEN priority % 3 = 0 THEN 'manual' ELSE 'generated' END AS origin FROM fx_zones")),
    "coverage_report": (
        lambda t: zones.coverage_report(t.fx_cells, t.fx_stations),
        oracle(f"""SELECT "row", "column", cells, {rnd("q", 2)} AS mean_quality, overlay, {rnd("dk", 1)} AS overlay_km, CASE
           WHEN overlay IS NULL THEN 'find_partner' WHEN {_like("rc", ("LEICA", "TRIMBLE", "SEPT", "CHCNAV", "SURVEY_GRADE"))} THEN 'deploy_overlay'
           ELSE 'validate_overlay' END AS action,
          CASE WHEN q < 25e-2 THEN 0 WHEN overlay IS NULL OR q < 5e-1 THEN 1 ELSE 2 END AS priority FROM bad LEFT
             JOIN (SELECT "row", "column", s.name AS overlay, upper(s.receiver_type) AS rc, {km("bad.lat", "bad.lon", "s.latitude", "s.longitude")} AS
             dk
          FROM bad, fx_stations s WHERE s.network = 'onocoy' AND s.status IN ('ONLINE', 'ACTIVE') AND dk < 50
             QUALIFY row_number() OVER (PARTITION BY "row", "column" ORDER BY dk, s.name) = 1) USING ("row", "column")
          ORDER BY priority, cells DESC, "row", "column" LIMIT 50""", bad="""SELECT CAST(floor(latitude + 5e-1) AS int) AS "row", CAST(floor(longitude
             + 5e-1) AS int) AS "column", count(*) AS cells, avg(latitude) AS lat, avg(longitude) AS lon, avg(quality_score) AS q
          FROM fx_cells WHERE zone_tier <> 'full_rtk' GROUP BY 1, 2 HAVING count(*) >= 2""")),
    "diversity_cap": (
        lambda t: zones.diversity_cap(t.fx_zones.select("zone_id", "lat", "lon", "priority", F.lit(0.5).alias("confidence")), 7).select("zone_id", "turn"),
        oracle("""SELECT zone_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY floor(lat / 10), floor(lon / 10)
           ORDER BY priority, zone_id) AS turn FROM fx_zones) ORDER BY turn, floor(lat / 10), floor(lon / 10) LIMIT 7""")),
    "classify_hardware": (
        lambda t: t.fx_stations.select("name", classify.classify_hardware(F.col("receiver_type"), F.col("antenna_type")).alias("h")).select("name", "h.*"),
        oracle(f"""SELECT name, split_part(hw, '|', 1) AS hardware_class, CAST(split_part(hw, '|', 2) AS double) AS confidence
           FROM (SELECT name, {HW} AS hw FROM (SELECT name, upper(concat_ws(' ', receiver_type, antenna_type)) AS h FROM fx_stations))""")),
    "classify_hardware_report": (
        lambda t: t.fx_stations.filter("network = 'onocoy'").groupBy(classify.hardware_report_class(F.col("receiver_type")).alias("hw_class")).agg(F.count("*").alias("stations")),
        oracle(f"""SELECT CASE WHEN receiver_type IS NULL OR receiver_type = '' THEN 'unknown'
           WHEN {_like("receiver_type", ("LEICA", "TRIMBLE", "SEPT", "NOVATEL", "CHC", "TOPCON"))} THEN 'survey_grade_exact'
         WHEN contains(receiver_type, 'SURVEY_GRADE_PROBED') THEN 'survey_grade_probed'
            WHEN contains(receiver_type, 'SURVEY_GRADE_INFERRED') THEN 'survey_grade_inferred'
            WHEN contains(receiver_type, 'PROFESSIONAL') THEN 'professional'
         WHEN {_like("receiver_type", ("CONSUMER", "U-BLOX", "F9P"))} THEN 'consumer' ELSE 'other' END AS hw_class, count(*) AS stations
            FROM fx_stations WHERE network = 'onocoy' GROUP BY 1""")),
    "infer_receiver_class": (
        lambda t: t.events.select("event_id", classify.infer_receiver_class(F.when(F.col("user_id") % 2 == 0, "1005,1077").otherwise("1075"), F.when(F.col("user_id") % 3 == 0, "GPS+GLO+GAL+BDS").otherwise("GPS+GLO"),
                                  (F.col("user_id") % 6).cast("int"), F.when(F.col("user_id") % 7 == 0, "LEICA").otherwise("")).alias("receiver_class")),
        """SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'LEICA' WHEN user_id % 2 = 0 AND user_id % 3 = 0
           AND user_id % 6 >= 4 THEN 'SURVEY_GRADE_INFERRED' WHEN user_id % 2 = 0 AND user_id % 3 = 0 THEN 'PROFESSIONAL_INFERRED'
         ELSE 'CONSUMER_GOOD_INFERRED' END AS receiver_class FROM events"""),
    "region_by_circle": (
        lambda t: t.fx_cells.select("cell_id", region_by_circle(F.col("latitude"), F.col("longitude") - 100).alias("region")),
        oracle(f"SELECT cell_id, {circle('latitude', '(longitude - 100)')} AS region FROM fx_cells")),
    "region_by_box": (
        lambda t: t.fx_cells.select("cell_id", region_by_box(F.col("latitude") - 20, F.col("longitude") - 80).alias("region")),
        oracle(f"SELECT cell_id, {box('(latitude - 20)', '(longitude - 80)')} AS region FROM fx_cells")),
    "place_names": (named_places, oracle(f"""SELECT cell_id, {", ".join(f"{place('la', 'lo', scheme)} AS {scheme}_name" for scheme in PLACE_BOXES)}
           FROM (SELECT cell_id, (latitude - 435e-1) * 20 - 60 AS la, (longitude - 15e-1) * 33 - 178 AS lo FROM fx_cells)""")),
    "storm_impact_kp": (
        lambda t: t.fx_env_history.select("hour_ts", classify.storm_impact_kp(F.col("kp")).alias("s")).select(F.unix_millis(F.col("hour_ts").cast("timestamp")).alias("ms"), "s.level", "s.impact_pct"),
        oracle("""SELECT epoch_ms(hour_ts) AS ms, CASE WHEN kp < 4 THEN 'none' WHEN kp = 4 THEN 'minor' WHEN kp = 5 THEN 'moderate'
           WHEN kp = 6 THEN 'strong' WHEN kp IN (7, 8) THEN 'severe' ELSE 'extreme' END AS level,
         CASE WHEN kp <= 3 THEN 0 WHEN kp = 4 THEN -5 WHEN kp = 5 THEN -12 WHEN kp = 6 THEN -25 ELSE -40 END AS impact_pct FROM fx_env_history""")),
    "storm_impact": (
        lambda t: weather(t).select("event_id", classify.storm_impact(F.col("value") % 10, -F.col("h"), F.col("t") - 15, F.col("p") * 1e-7).alias("s")).select("event_id", "s.level", "s.phase", "s.impact_pct", F.size("s.regions").alias("regions")),
        oracle("""SELECT event_id, level, phase, CASE level WHEN 'extreme' THEN -50 WHEN 'severe' THEN -35 WHEN 'strong' THEN -25
           WHEN 'moderate' THEN -12 WHEN 'minor' THEN -5 ELSE 0 END + CASE WHEN x >= 1e-4 THEN -15 WHEN x >= 1e-5 THEN -5 ELSE 0 END AS impact_pct,
         CASE level WHEN 'quiet' THEN 0 WHEN 'minor' THEN 2 WHEN 'moderate' THEN 5 ELSE 10 END AS regions FROM (SELECT *, CASE WHEN k >= 8 OR d < -200
            OR x >= 1e-4 THEN 'extreme' WHEN k >= 7 OR d < -100 THEN 'severe' WHEN k >= 6 OR d < -50 THEN 'strong'
          WHEN k >= 5 OR d < -30 THEN 'moderate' WHEN k >= 4 OR d < -20 THEN 'minor' ELSE 'quiet' END AS level, CASE WHEN d < -30
             AND b < -5 THEN 'main' WHEN d < -20 AND b > 0 THEN 'recovery' WHEN b < -10 THEN 'initial' ELSE 'quiet' END AS phase
          FROM (SELECT event_id, value % 10 AS k, -h AS d, t - 15 AS b, p * 1e-7 AS x FROM w))""", w=WEATHER)),
    "kp_from_cme_speed": (
        lambda t: t.events.select("event_id", classify.kp_from_cme_speed(F.col("value") * 10).alias("kp")),
        """SELECT event_id, CASE WHEN value * 10 >= 2000 THEN 9 WHEN value * 10 >= 1500 THEN 8 WHEN value * 10 >= 1000 THEN 7
           WHEN value * 10 >= 800 THEN 6 WHEN value * 10 >= 600 THEN 5 WHEN value * 10 >= 400 THEN 4 ELSE 3 END AS kp FROM events"""),
    "flare_class": (
        lambda t: t.events.select("event_id", classify.flare_class(F.col("value") * 1e-6).alias("flare")),
        oracle(f"""SELECT event_id, CASE WHEN f >= 1e-4 THEN concat('X', printf('%.1f', {rnd("f / 1e-4", 1)}))
           WHEN f >= 1e-5 THEN concat('M', printf('%.1f', {rnd("f / 1e-5", 1)}))
           WHEN f >= 1e-6 THEN concat('C', printf('%.1f', {rnd("f / 1e-6", 1)})) END AS flare
         FROM (SELECT event_id, value * 1e-6 AS f FROM events)""")),
    "tropo_delay": (
        lambda t: weather(t).select("event_id", classify.tropo_delay(F.col("p"), F.col("t"), F.col("h"), F.col("lat"), F.col("z")).alias("x"), classify.tropo_risk(F.col("h"), F.col("t") / 10).alias("rain_risk")).select("event_id", "rain_risk", "x.*"),
        oracle(f"""SELECT event_id, CASE WHEN h > 85 AND t / 10 > 2 THEN 'high' WHEN h > 70 OR t / 10 > 5e-1 THEN 'medium'
           ELSE 'low' END AS rain_risk, {rnd("d", 4)} AS dry_m, {rnd("w", 4)} AS wet_m, {rnd("d + w", 4)} AS total_m,
          {rnd("(d + w) / (sin(radians(10)) + 143e-5 / (tan(radians(10)) + 445e-4))", 3)} AS slant_m, {rnd("w * 1e3 * (5e1 / 75e0) * 1e-1", 1)} AS
             baseline_error_mm,
          CASE WHEN w < 1e-1 AND h < 60 THEN 'low' WHEN w < 2e-1 OR h < 80 THEN 'medium' ELSE 'high' END AS risk
             FROM (SELECT *, 22768e-7 * p / (1 - 266e-5 * cos(2 * radians(lat)) - 28e-5 * z / 1e3) AS d,
          2277e-6 * (1255 / (t + 27315e-2) + 5e-2) * (h / 1e2 * 61078e-4 * pow(1e1, 75e-1 * t / (2373e-1 + t))) AS w FROM wx)""", wx=WEATHER)),
    "magnetic_latitude": (
        lambda t: t.fx_cells.select("cell_id", half_up(classify.magnetic_latitude(F.col("latitude"), F.col("longitude")), 4).alias("mag_lat")),
        oracle(f"""SELECT cell_id,
           {rnd('degrees(asin(greatest(-1e0, least(1e0, sin(radians(latitude)) * sin(radians(865e-1)) + cos(radians(latitude)) * cos(radians(865e-1)) * cos(radians(longitude + 164))))))', 4)}
           AS mag_lat FROM fx_cells""")),
    "iono_sigma": (
        lambda t: weather(t).select("event_id", half_up(classify.iono_sigma(F.col("h"), F.col("t"), F.lit(50.0), True), 5).alias("dual"), half_up(classify.iono_sigma(F.col("h"), F.col("t"), F.lit(50.0), False), 5).alias("single")),
        oracle(f"""SELECT event_id, {rnd('t * 5e1 * 1e-3', 5)} AS dual, {rnd('4e-1 * h / (157542e-2 * 157542e-2) * 1e6', 5)} AS single
           FROM w""", w=WEATHER)),
    "infer_network": (
        lambda t: t.events.select("event_id", scores.infer_network(F.concat(F.when(F.col("user_id") % 3 == 0, "NRBY_").otherwise("AB"), F.lpad(F.col("user_id").cast("string"), 6, "0"))).alias("network")),
        "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'onocoy' ELSE 'geodnet' END AS network FROM events"),
    "mask_user": (lambda t: t.fx_caster_log.select(reports.mask_user(F.col("username")).alias("user")).distinct(), oracle("SELECT DISTINCT concat(substr(username, 1, 3), '***') AS \"user\" FROM fx_caster_log")),
    "severity_ordering": (
        lambda t: anomalies(t).orderBy(severity_rank(), "station").limit(15),
        oracle("SELECT * FROM ano ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, station LIMIT 15", ano=ANOMALIES)),
}

