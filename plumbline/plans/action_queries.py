"""Registered queries of zone actions, overlays, ionosphere and smaller jobs, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import DAY, HOUR, half_up
from plumbline.operators import actions, detectors, forecast, scores, trust, zones

from .fixtures import AS_OF, Tables, oracle
from .report_queries import ANOMALIES, anomalies
from .sql import D7, H6, H24, NOISE, STATION, km, rnd
from .zone_queries import EVIDENCE, NEAREST, STATE, VALIDATION, _like, state, validation


def zone_rows(t: Tables) -> DataFrame:
    """Zones of stations by the last digit of their number; zone 7 is disabled."""
    key = F.substring("name", -1, 1)
    return t.fx_stations.groupBy(key.alias("k")).agg(F.collect_list("name").alias("stations")).select(
        F.concat(F.lit("z"), "k").alias("zone_id"), (F.col("k") != "7").alias("enabled"), (F.col("k").cast("int") * 9 + 5).alias("priority"), "stations")


def action_rows(t: Tables) -> DataFrame:
    drift = anomalies(t).select(F.lit("fix_rate_drop").alias("type"), "severity", "station", F.lit(False).alias("region"))
    mass = anomalies(t).filter("severity = 'critical'").limit(1).select(F.lit("mass_disconnect").alias("type"), F.lit("critical").alias("severity"), F.lit("").alias("station"), F.lit(True).alias("region"))
    events = t.fx_trust.filter("alpha > 48").agg(F.collect_list("station").alias("stations")).select(F.lit("jamming").alias("classification"), "stations")
    recent = t.fx_zones.filter("zone_id in ('z2', 'z3')").select("zone_id")
    return actions.zone_actions(zone_rows(t), t.fx_trust, drift.unionByName(mass), events, recent)


ZONE_AT = """SELECT concat('z', right(name, 1)) AS zone_id, right(name, 1) <> '7' AS enabled, CAST(right(name, 1) AS int) * 9 + 5 AS priority, name AS
   station FROM fx_stations"""
ALL_ACTIONS = """SELECT * FROM (SELECT 'exclude' AS action, zone_id, station, priority AS priority_before, CAST(NULL AS int) AS priority_after, 1 AS
   source FROM za JOIN fx_trust USING (station) WHERE enabled AND (flag = 'excluded' OR (flag = 'untrusted' AND composite_score < 3e-1))
 UNION ALL SELECT 'downgrade', zone_id, station, priority, least(99, priority + 20), 2 FROM za JOIN fx_trust USING (station) WHERE flag = 'probation'
    AND composite_score < 5e-1
 UNION ALL SELECT 'exclude', zone_id, station, priority, 99, 0 FROM za JOIN fx_trust USING (station) WHERE alpha > 48
 UNION ALL SELECT 'new_fence', NULL, '', NULL, 99, 3 WHERE EXISTS (SELECT 1 FROM ano WHERE severity = 'critical')
 UNION ALL SELECT 'downgrade', zone_id, station, priority, least(99, priority + 30), 4 FROM za JOIN ano USING (station) WHERE severity = 'critical'
 UNION ALL SELECT 'restore', zone_id, station, priority, 10, 5 FROM za JOIN fx_trust USING (station) WHERE flag = 'trusted'
    AND composite_score >= 7e-1 AND (NOT enabled OR priority > 50))
 WHERE source = 0 OR action = 'restore' OR zone_id IS NULL OR zone_id NOT IN ('z2', 'z3')"""
DEGRADING = "(SELECT count(*) FROM aa WHERE action IN ('exclude', 'downgrade'))"
KEPT = f"""SELECT * FROM aa WHERE action = 'restore' OR {DEGRADING} <= 20 UNION ALL SELECT * FROM (SELECT * FROM aa WHERE action <> 'restore'
   AND {DEGRADING} > 20 ORDER BY source, zone_id NULLS LAST, station, priority_after NULLS FIRST LIMIT 20)
 UNION ALL SELECT 'cascade_exhaustion', NULL, NULL, NULL, NULL, 9 WHERE {DEGRADING} > 20"""
OVERLAYS = f"""SELECT concat('ono_', name) AS zone_id, name, latitude AS lat, longitude AS lon, hc AS hardware_class, CASE WHEN hc = 'survey_grade'
   AND dk <= 40 THEN 'overlay_better' ELSE 'primary_absent' END AS reason,
 CASE WHEN hc = 'survey_grade' OR (hc = 'professional' AND st = 'confirmed') THEN 5 ELSE 30 END AS priority, CASE hc
    WHEN 'survey_grade' THEN {rnd("least(45e3, greatest(15e3, dk * 600))")} WHEN 'professional' THEN {rnd("least(45e3, greatest(15e3, dk * 400))")}
    ELSE {rnd("least(25e3, greatest(15e3, dk * 300))")} END AS radius_m,
 {rnd("CASE WHEN hc = 'consumer' THEN 6e-1 WHEN hc = 'survey_grade' AND st = 'confirmed' THEN greatest(hcf, 9e-1) ELSE hcf END", 2)} AS confidence, st
    AS validation_status
FROM (SELECT *, split_part(hw, '|', 1) AS hc, CAST(split_part(hw, '|', 2) AS double) AS hcf
   FROM (SELECT n.*, coalesce(distance_km, 999e0) AS dk, coalesce(v.status, 'untested') AS st, v.fix_rate AS vf,
  CASE WHEN {_like("h", actions.SURVEY)} THEN 'survey_grade|95e-2' WHEN contains(h, 'SURVEY_GRADE_INFERRED') THEN 'survey_grade|75e-2'
     WHEN contains(h, 'PROFESSIONAL_INFERRED') THEN 'professional|65e-2'
   WHEN {_like("h", ("CONSUMER_GOOD_INFERRED", "U-BLOX", "UBLOX", "F9P"))} THEN 'consumer|5e-1'
      WHEN contains(h, 'CONSUMER_BASIC_INFERRED') THEN 'consumer|3e-1' ELSE 'unknown|2e-1' END AS hw
  FROM (SELECT *, upper(CASE WHEN receiver_type = '' THEN name ELSE receiver_type END) AS h FROM nea) n LEFT JOIN val v ON v.station = n.name))
WHERE (hc = 'survey_grade' AND hcf >= 7e-1 AND st <> 'rejected' AND (dk > 40 OR (st = 'confirmed' AND coalesce(vf, 0) > 75))) OR (hc = 'professional'
   AND hcf >= 65e-2 AND st <> 'rejected' AND dk > 60) OR (hc = 'consumer' AND hcf >= 5e-1 AND st = 'confirmed' AND dk > 80)"""
#: A map of 18 by 37 nodes: events are dealt to the nodes, and the mean of its values makes a node's.
GRID = "SELECT event_id % 666 AS node, CAST(floor(avg(value)) AS bigint) AS m FROM events GROUP BY 1"


def tec_grid(t: Tables, shift: int = 0) -> DataFrame:
    """An 18 by 37 grid from the events: the whole part of a node's mean, and ``shift``, modulo 40."""
    nodes = t.events.groupBy((F.col("event_id") % 666).alias("node")).agg(F.floor(F.avg("value")).cast("long").alias("m"))
    return nodes.select(F.floor(F.col("node") / 37).cast("int").alias("lat_idx"), (F.col("node") % 37).cast("int").alias("lon_idx"), ((F.col("m") + shift) % 40).cast("double").alias("vtec"))


def tec_points(t: Tables) -> DataFrame:
    return t.fx_cells.select(F.col("cell_id").alias("point_id"), (F.col("latitude") * 2 - 90).alias("lat"), (F.col("longitude") * 20 - 180).alias("lon"))


def tec(t: Tables, shift: int = 0) -> DataFrame:
    return actions.tec_interpolate(tec_points(t), tec_grid(t, shift), 85.0, -10.0, 18, -180.0, 10.0, 37)


def tec_sql(shift: int) -> str:
    v = lambda a, b: f"(SELECT (m + {shift}) % 40 FROM gm WHERE node = (i + {a}) * 37 + j + {b})"
    return f"""SELECT point_id, lat, lon,
       {rnd(f"{v(0, 0)} * (1 - u) * (1 - w) + {v(0, 1)} * (1 - u) * w + {v(1, 0)} * u * (1 - w) + {v(1, 1)} * u * w", 1)} AS vtec, {rnd("ns", 2)} AS
       gradient_ns, {rnd("ew", 2)} AS gradient_ew, {rnd("sqrt(ns * ns + ew * ew)", 2)} AS gradient_total,
 CASE WHEN sqrt(ns * ns + ew * ew) < 2 THEN 'nominal' WHEN sqrt(ns * ns + ew * ew) < 5 THEN 'elevated'
    WHEN sqrt(ns * ns + ew * ew) < 10 THEN 'degraded' ELSE 'storm' END AS quality
    FROM (SELECT *, (({v(1, 0)} + {v(1, 1)}) / 2e0 - ({v(0, 0)} + {v(0, 1)}) / 2e0) / 1e1 AS ns,
 (({v(0, 1)} + {v(1, 1)}) / 2e0 - ({v(0, 0)} + {v(1, 0)}) / 2e0) / 1e1 AS ew
    FROM (SELECT *, greatest(0e0, least(1e0, fi - i)) AS u, greatest(0e0, least(1e0, fj - j)) AS w
    FROM (SELECT *, CAST(greatest(0, least(16, floor(fi))) AS int) AS i, CAST(greatest(0, least(35, floor(fj))) AS int) AS j FROM
 (SELECT cell_id AS point_id, latitude * 2 - 90 AS lat, longitude * 20 - 180 AS lon, (latitude * 2 - 90 - 85) / -1e1 AS fi, (longitude * 20) / 1e1 AS
    fj FROM fx_cells))))"""


MAG = "abs(degrees(asin(greatest(-1e0, least(1e0, sin(radians(lat)) * sin(radians(865e-1)) + cos(radians(lat)) * cos(radians(865e-1)) * cos(radians(lon + 164)))))))"
SCINT = f"""SELECT point_id, {rnd("rot", 3)} AS rot, {rnd("s4", 2)} AS s4_proxy, CASE WHEN s4 < 3e-1 THEN 'low' WHEN s4 < 5e-1 THEN 'moderate'
   WHEN s4 < 7e-1 THEN 'high' ELSE 'severe' END AS risk, type FROM (SELECT *, least(1e0, CASE type WHEN 'equatorial' THEN rot * 15e-2
   WHEN 'auroral' THEN rot * 1e-1 + 2e-1 ELSE rot * 5e-2 END) AS s4
 FROM (SELECT c.point_id, abs(c.vtec - p.vtec) / 5e0 AS rot, CASE
    WHEN {MAG.replace("lat)", "c.lat)").replace("lon +", "c.lon +")} <= 20 THEN 'equatorial'
    WHEN {MAG.replace("lat)", "c.lat)").replace("lon +", "c.lon +")} >= 60 THEN 'auroral' ELSE 'mid-latitude' END AS type FROM cu c
    JOIN pr p USING (point_id))) WHERE s4 >= 1e-1"""


def satellites(t: Tables) -> DataFrame:
    return t.fx_stations.select(F.coalesce("network", F.lit("none")).alias("constellation"), "name", (F.col("height") / 30000).alias("ecc"), (F.col("height") / 100).alias("motion"))


def cme(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.events.filter("user_id % 50 = 0")
    return (e.select(F.col("event_id").alias("h_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts")),
            t.events.filter("user_id % 50 = 1").select(F.col("event_id").alias("c_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("arrival_ts")))


HOURLY = f"""SELECT station, CAST(floor(login_time / 36e5) * 36e5 AS bigint) AS h, {rnd('avg(fix_rate)', 1)} AS f, count(*) AS n FROM fx_sessions
   WHERE login_time >= {H24} AND {STATION} GROUP BY 1, 2"""

def health(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("gps", "glonass", "galileo", "beidou", "qzss")])
    return t.fx_stations.groupBy(F.get(kinds, (F.substring("name", 3, 6).cast("int") % 5)).alias("constellation")).agg((F.sum(F.when(F.col("height") < 450, 2).otherwise(1)) % 40).cast("int").alias("healthy"), F.lit(32).alias("total"))


HEALTH = """SELECT ['gps', 'glonass', 'galileo', 'beidou', 'qzss'][CAST(substr(name, 3) AS int) % 5 + 1] AS constellation, CAST(sum(CASE
   WHEN height < 450 THEN 2 ELSE 1 END) % 40 AS int) AS healthy, 32 AS total FROM fx_stations GROUP BY 1"""
IMPACT = """SELECT *, least(3e1, loss * CASE constellation WHEN 'gps' THEN 15e-1 WHEN 'galileo' THEN 1e0 WHEN 'glonass' THEN 8e-1
   WHEN 'beidou' THEN 7e-1 ELSE 1e0 END * 3e-1) AS impact FROM (SELECT *, greatest(0, nominal - healthy) * 5 AS loss FROM
 (SELECT *, CASE constellation WHEN 'gps' THEN 31 WHEN 'glonass' THEN 24 WHEN 'galileo' THEN 28 WHEN 'beidou' THEN 45 ELSE total END AS nominal
    FROM he))"""


def forecast_rows(t: Tables) -> DataFrame:
    points = t.fx_cells.select(F.col("cell_id").alias("point_id"), (F.col("latitude") * 2 - 25).alias("lat"), (F.col("longitude") * 9).alias("lon"))
    surface = t.fx_stations.join(t.fx_station_scores, F.col("name") == F.col("station_name")).select((F.col("latitude") * 2 - 25).alias("lat"), (F.col("longitude") * 9).alias("lon"), F.col("avg_fix_rate").alias("predicted"))
    arrivals = t.fx_env_history.filter("kp >= 2 and day(hour_ts) = 30").select((F.unix_millis(F.col("hour_ts").cast("timestamp")) + DAY).alias("arrival_ts"), (F.col("kp") + 3).alias("kp"))
    return forecast.forecast(forecast.current_quality(points, surface, t.fx_station_scores), (1, 3, 12), AS_OF, arrivals, 2.0, 5.0, "high", 1)


_IMP = lambda k: f"CASE WHEN {k} <= 3 THEN 0e0 WHEN {k} <= 4 THEN -5e0 WHEN {k} <= 5 THEN -12e0 WHEN {k} <= 6 THEN -25e0 ELSE -40e0 END"
FORECAST = f"""SELECT point_id, h, {rnd("p", 1)} AS predicted, greatest(0e0, {rnd("p - sqrt(h) * 3 - 10", 1)}) AS low, least(1e2,
   {rnd("p + sqrt(h) * 3 + 5", 1)}) AS high, ke AS kp_expected,
 CASE WHEN ke <= 3 THEN 'nominal' WHEN ke <= 5 THEN 'elevated' WHEN ke <= 7 THEN 'degraded' ELSE 'storm' END AS iono_risk
    FROM (SELECT *, greatest(0e0, least(1e2, cur + ci + CASE WHEN h <= 3 THEN -12 ELSE 0 END +
 CASE WHEN abs(lat) < 20 AND (lo >= 20 OR lo <= 2) THEN -5 WHEN abs(lat) > 60 AND ke >= 4 THEN -8 ELSE 0 END - 3 - 2)) AS p
    FROM (SELECT *, greatest(2e0, coalesce(ck, 0e0), CASE WHEN h <= 3 THEN 5e0 ELSE 0e0 END) AS ke, (h % 24 + floor(lon / 15 + 5e-1)) % 24 AS lo FROM
 (SELECT q.*, coalesce((SELECT arg_min(s.pr, struct_pack(d := {km("q.lat", "q.lon", "s.lat", "s.lon")}, a := s.lat, b := s.lon)) FROM su s
    WHERE {km("q.lat", "q.lon", "s.lat", "s.lon")} < 200), (SELECT avg(avg_fix_rate) FROM fx_station_scores)) AS cur, hz.* FROM
  (SELECT cell_id AS point_id, latitude * 2 - 25 AS lat, longitude * 9 AS lon
     FROM fx_cells) q, (SELECT h, max(a.kp) AS ck, coalesce(sum({_IMP("a.kp")}), 0e0) AS ci FROM (VALUES (1), (3), (12)) v(h) LEFT JOIN
   (SELECT epoch_ms(hour_ts) + 86400000 AS t, kp + 3 AS kp FROM fx_env_history WHERE kp >= 2 AND day(hour_ts) = 30) a
      ON abs(a.t - ({AS_OF} + h * 3600000)) <= 21600000 GROUP BY 1) hz)))"""
SURFACE = "SELECT latitude * 2 - 25 AS lat, longitude * 9 AS lon, avg_fix_rate AS pr FROM fx_stations JOIN fx_station_scores ON station_name = name"
EV1 = EVIDENCE.replace("THEN 15e-1", "THEN 1e0")
TRUST1 = f"""SELECT station, {rnd("a", 2)} AS alpha, {rnd("b", 2)} AS beta, {rnd("a / (a + b)", 3)} AS trust_score, {rnd("c", 3)} AS consistency,
   {rnd("a / (a + b) * 7e-1 + c * 3e-1", 3)} AS combined_score,
 CASE WHEN a + b - 2 < 10 THEN 'new' WHEN a / (a + b) * 7e-1 + c * 3e-1 >= 7e-1 THEN 'trusted'
    WHEN a / (a + b) * 7e-1 + c * 3e-1 >= 4e-1 THEN 'probation' ELSE 'untrusted' END AS flag FROM (SELECT station, coalesce(cons, 75e-2) AS c,
 CASE WHEN n IS NULL THEN alpha ELSE 1 + (coalesce(alpha, 1e0) - 1) * pow(995e-3, CASE WHEN last_decay IS NULL THEN 1 ELSE 3 END) + da END AS a, CASE
    WHEN n IS NULL THEN beta ELSE 1 + (coalesce(beta, 1e0) - 1) * pow(995e-3, CASE WHEN last_decay IS NULL THEN 1 ELSE 3 END) + db END AS b
 FROM stt FULL JOIN ev USING (station) LEFT JOIN (SELECT x.station, greatest(0e0, 1 - avg(abs(x.mf - y.mf)) / 5e1) AS cons FROM ev x
    JOIN fx_stations p ON p.name = x.station, ev y JOIN fx_stations q ON q.name = y.station WHERE x.station <> y.station AND x.n >= 5 AND y.n >= 5
  AND {km("p.latitude", "p.longitude", "q.latitude", "q.longitude")} <= 80 GROUP BY 1) USING (station))"""

ACTIONS = {
    "trust_scores_v1": (lambda t: trust.trust_scores_v1(t.fx_sessions, state(t), t.fx_stations, AS_OF), oracle(TRUST1, stt=STATE, ev=EV1)),
    "constellation_quality": (
        lambda t: forecast.constellation_quality(health(t))[0],
        oracle(f"""SELECT constellation, nominal, healthy, {rnd("healthy / nominal * 1e2", 1)} AS availability_pct, {rnd("loss * 1e0", 1)} AS
           pdop_degradation_pct, {rnd("impact", 1)} AS fix_rate_impact_pct,
         CASE WHEN healthy / nominal < 7e-1 THEN 'degraded' WHEN healthy / nominal < 9e-1 THEN 'reduced' WHEN total > healthy THEN 'minor'
            ELSE 'nominal' END AS state FROM im""", he=HEALTH, im=IMPACT)),
    "constellation_total": (
        lambda t: forecast.constellation_quality(health(t))[1],
        oracle(f"""SELECT {rnd("least(5e1, sum(impact))", 1)} AS total_impact_pct, {rnd("product(1 + loss / 1e2)", 3)} AS pdop_multiplier,
           {rnd("greatest(0e0, (product(1 + loss / 1e2) - 1) * 2e-2)", 4)} AS sigma_contribution FROM im""", he=HEALTH, im=IMPACT)),
    "forecast": (forecast_rows, oracle(FORECAST, su=SURFACE)),
    "zone_actions": (
        lambda t: action_rows(t).fillna(-1, ["priority_before", "priority_after"]),
        oracle("""SELECT * REPLACE (coalesce(priority_before, -1) AS priority_before, coalesce(priority_after, -1) AS priority_after)
           FROM ka""", za=ZONE_AT, ano=ANOMALIES, aa=ALL_ACTIONS, ka=KEPT)),
    "apply_actions": (
        lambda t: actions.apply_actions(zone_rows(t), action_rows(t)),
        oracle("""SELECT z.zone_id, coalesce(e.v, z.enabled) AS enabled, coalesce(p.v, z.priority) AS priority
           FROM (SELECT DISTINCT zone_id, enabled, priority FROM za) z
         LEFT JOIN (SELECT zone_id, arg_max(action = 'restore', struct_pack(a := source, b := station, c := action)) AS v FROM ka
            WHERE action IN ('exclude', 'restore') GROUP BY 1) e USING (zone_id)
         LEFT JOIN (SELECT zone_id, arg_max(coalesce(priority_after, 10), struct_pack(a := source, b := station, c := action)) AS v FROM ka
            WHERE action IN ('downgrade', 'restore') GROUP BY 1) p USING (zone_id)""",
               za=ZONE_AT, ano=ANOMALIES, aa=ALL_ACTIONS, ka=KEPT)),
    "overlay_candidates": (lambda t: actions.overlay_candidates(zones.nearest_primary(t.fx_stations, t.fx_station_scores, t.fx_trust), validation(t)), oracle(OVERLAYS, nea=NEAREST, val=VALIDATION)),
    "classify_hardware_zone": (
        lambda t: t.fx_stations.select("name", actions.zone_hardware(F.col("receiver_type"), F.col("name")).alias("h")).select("name", "h.*"),
        oracle(f"""SELECT name, CASE WHEN {_like("h", actions.SURVEY)} OR contains(h, 'SURVEY_GRADE_INFERRED') THEN 'survey_grade'
           WHEN contains(h, 'PROFESSIONAL_INFERRED') THEN 'professional'
           WHEN {_like("h", ("CONSUMER_GOOD_INFERRED", "U-BLOX", "UBLOX", "F9P", "CONSUMER_BASIC_INFERRED"))} THEN 'consumer'
           ELSE 'unknown' END AS hardware_class,
         CASE WHEN {_like("h", actions.SURVEY)} THEN 95e-2 WHEN contains(h, 'SURVEY_GRADE_INFERRED') THEN 75e-2
            WHEN contains(h, 'PROFESSIONAL_INFERRED') THEN 65e-2 WHEN {_like("h", ("CONSUMER_GOOD_INFERRED", "U-BLOX", "UBLOX", "F9P"))} THEN 5e-1
            WHEN contains(h, 'CONSUMER_BASIC_INFERRED') THEN 3e-1 ELSE 2e-1 END AS confidence
         FROM (SELECT name, upper(CASE WHEN receiver_type = '' THEN name ELSE receiver_type END) AS h FROM fx_stations)""")),
    "probe_receiver_class": (
        lambda t: t.events.select("event_id", actions.probe_receiver_class(F.when(F.col("user_id") % 3 == 0, F.array(*[F.lit(m) for m in (1005, 1077, 1087, 1097, 1127)])).when(F.col("user_id") % 3 == 1, F.array(F.lit(1075), F.lit(1085))).otherwise(F.array(F.lit(1074))),
                                  F.when(F.col("user_id") % 7 == 0, "LEICA").otherwise("")).alias("p")).select("event_id", "p.receiver_class", F.size("p.constellations").alias("systems")),
        """SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'LEICA' WHEN user_id % 3 = 0 THEN 'SURVEY_GRADE_PROBED'
           WHEN user_id % 3 = 1 THEN 'CONSUMER_GOOD_PROBED' ELSE 'CONSUMER_BASIC_PROBED' END AS receiver_class, CASE user_id % 3 WHEN 0 THEN 4
           WHEN 1 THEN 2 ELSE 1 END AS systems FROM events"""),
    "adaptive_thresholds": (
        lambda t: t.fx_env_history.select(F.unix_millis(F.col("hour_ts").cast("timestamp")).alias("ms"), detectors.adaptive_thresholds(F.col("kp")).alias("x")).select("ms", "x.*"),
        oracle("""SELECT epoch_ms(hour_ts) AS ms, CASE WHEN kp >= 7 THEN 8e0 WHEN kp >= 5 THEN 65e-1 WHEN kp >= 4 THEN 55e-1 ELSE 5e0 END AS cusum_h,
           CASE WHEN kp >= 7 THEN 75e-2 WHEN kp >= 5 THEN 6e-1 WHEN kp >= 4 THEN 55e-2 ELSE 5e-1 END AS cusum_k,
         CASE WHEN kp >= 7 THEN 30e0 WHEN kp >= 5 THEN 22e0 WHEN kp >= 4 THEN 18e0 ELSE 15e0 END AS ewma_fix, CASE WHEN kp >= 7 THEN 5e0
            WHEN kp >= 5 THEN 4e0 WHEN kp >= 4 THEN 35e-1 ELSE 3e0 END AS ewma_age,
         CASE WHEN kp >= 7 THEN 4e-1 WHEN kp >= 5 THEN 5e-1 WHEN kp >= 4 THEN 55e-2 ELSE 6e-1 END AS drop_ratio FROM fx_env_history""")),
    "tec_interpolate": (tec, oracle(tec_sql(0), gm=GRID)),
    "scintillation": (lambda t: actions.scintillation(tec(t), tec(t, 17), 5.0, 6.0), oracle(SCINT, gm=GRID, pr=tec_sql(0), cu=tec_sql(17))),
    "constellation_health": (
        lambda t: actions.constellation_health(satellites(t)),
        oracle("""SELECT coalesce(network, 'none') AS constellation, count(*) AS total, count(*) FILTER (height / 3e4 < 2e-2
           AND height / 1e2 > 1) AS healthy, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT (height / 3e4 < 2e-2
           AND height / 1e2 > 1)), '') AS alerts FROM fx_stations GROUP BY 1""")),
    "qc_targets": (lambda t: actions.qc_targets(t.fx_trust), oracle("""SELECT station, flag, composite_score FROM fx_trust
       WHERE flag IN ('probation', 'untrusted') ORDER BY composite_score, station LIMIT 10""")),
    "latest_hours_status": (
        lambda t: actions.latest_hours_status(scores.station_hourly(t.fx_sessions, AS_OF), scores.station_baseline(t.fx_sessions, D7, H6)),
        oracle(f"""SELECT station, total, {rnd("recent", 2)} AS recent_fix, CASE WHEN recent = 0 THEN 'outage' WHEN coalesce(b, 0e0) > 50
           AND recent < b * 6e-1 THEN 'degraded' ELSE 'normal' END AS status FROM (SELECT station, sum(n) AS total, avg(f) FILTER (k <= 3) AS recent
           FROM
         (SELECT *, row_number() OVER (PARTITION BY station ORDER BY h DESC) AS k FROM ho) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50) LEFT
            JOIN (SELECT station, avg(fix_rate) AS b FROM fx_sessions WHERE {STATION} AND {NOISE} AND login_time >= {D7} AND login_time < {H6}
            GROUP BY 1) USING (station)""", ho=HOURLY)),
    "top_50_stations": (
        lambda t: actions.top_by_sessions(t.fx_sessions, AS_OF), oracle(f"""SELECT station, count(*) AS sessions FROM fx_sessions
           WHERE login_time >= {H24} AND {STATION} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")),
    "coverage_trend": (
        lambda t: actions.coverage_trend(t.fx_env_history.select(F.unix_millis(F.col("hour_ts").cast("timestamp")).alias("ts"), (F.col("bz") + 50).alias("green_pct")), 55.5, AS_OF),
        oracle(f"""SELECT before, 555e-1 AS now, {rnd('555e-1 - before', 1)} AS change FROM (SELECT arg_min(bz + 50, hour_ts) AS before
           FROM fx_env_history WHERE epoch_ms(hour_ts) > {D7})""")),
    "cme_window_join": (
        lambda t: actions.cme_window_join(*cme(t)).select("h_id", "c_id", half_up("offset_h", 3).alias("offset_h")),
        f"""SELECT h.event_id AS h_id, c.event_id AS c_id, {rnd("(c.t - h.t) / 36e5", 3)} AS offset_h
           FROM (SELECT *, CAST(floor(epoch_us(ts) / 1e3) AS bigint) AS t FROM events WHERE user_id % 50 = 0) h
           JOIN (SELECT *, CAST(floor(epoch_us(ts) / 1e3) AS bigint) AS t FROM events WHERE user_id % 50 = 1) c
         ON abs(h.t - c.t) <= {6 * HOUR}"""),
    "locate_probes": (
        lambda t: actions.locate_probes(t.fx_status_log.select(F.col("event_id").alias("probe_id"), F.col("station_name").alias("station"), F.col("recorded_ts").alias("ts")), t.fx_stations).select("probe_id", "station", "latitude", "longitude"),
        oracle("""SELECT event_id AS probe_id, station_name AS station, latitude, longitude FROM (SELECT * FROM fx_status_log
           ORDER BY recorded_ts DESC, event_id LIMIT 50) JOIN fx_stations ON name = station_name""")),
    "job_summary": (
        lambda t: actions.job_summary(t.fx_trust, "flag"), oracle(f"""SELECT flag AS value, count(*) AS n,
           {rnd('count(*) / sum(count(*)) OVER () * 1e2', 1)} AS pct FROM fx_trust GROUP BY 1""")),
}
