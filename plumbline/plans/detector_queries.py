"""Registered detector queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.operators import detectors as d

from .fixtures import AS_OF, Tables, oracle
from .report_queries import ANOMALIES, SEEN, anomalies, status_log
from .sql import D7, H6, H24, NOISE, NONZERO, POSITION, STATION, circle, km, rnd

TWO = f"""SELECT station, count(*) FILTER (login_time >= {H6}) AS n, avg(fix_rate) FILTER (login_time >= {H6}) AS fix, avg(avg_age) FILTER (login_time
   >= {H6} AND avg_age > 0) AS age,
 count(DISTINCT username) FILTER (login_time >= {H6}) AS affected_users, max(login_time) FILTER (login_time >= {H6}) AS last_ms, count(*) FILTER
    (login_time < {H6}) AS b_n,
 coalesce(avg(fix_rate) FILTER (login_time < {H6}), 0e0) AS b_fix, coalesce(avg(avg_age) FILTER (login_time < {H6}), 0e0) AS b_age,
 count(DISTINCT username) FILTER (login_time < {H6}) AS b_users FROM fx_sessions WHERE {SEEN} AND login_time >= {D7} GROUP BY 1"""
LATEST = "SELECT station_name AS station, arg_max(status, struct_pack(r := recorded_ts, e := event_id)) AS last_status FROM fx_status_log GROUP BY 1"
HALF = "(floor(latitude * 2 + 5e-1) / 2e0) AS lat, (floor(longitude * 2 + 5e-1) / 2e0) AS lon"
CUT_HOURS, CUSUM_START = 6, AS_OF - 6 * 3_600_000
BASE_AGE = f"""(SELECT coalesce(avg(CASE WHEN avg_age > 0 THEN avg_age END), 2e0) FROM fx_sessions WHERE login_time >= {AS_OF - 12 * 3_600_000}
   AND login_time < {H6} AND {STATION})"""


def disconnect_sql(under: int, least: int, critical: int) -> str:
    return oracle(f"""SELECT 'mass_disconnect' AS type, CASE WHEN affected_users >= {critical} THEN 'critical'
       ELSE 'warning' END AS severity, lat, lon, {circle("lat", "lon")} AS region,
     affected_users, current_value, detected_ms FROM (SELECT {HALF}, count(DISTINCT username) AS affected_users, {rnd("avg(fix_rate)", 1)} AS
        current_value, max(login_time) AS detected_ms
     FROM fx_sessions WHERE {SEEN} AND login_time >= {H6} AND fix_rate < {under} AND {NONZERO} GROUP BY 1, 2) WHERE affected_users >= {least}""")


CLUSTER_POINTS = f"""SELECT id, username, login_time, latitude, longitude, fix_rate AS fix FROM fx_sessions WHERE {SEEN} AND login_time >= {H6}
   AND fix_rate < 25 AND {POSITION}"""
def cluster_edges(minutes: int) -> str:
    return f"""SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.id <> b.id AND abs(a.login_time - b.login_time) <= {minutes * 60_000}
 AND {km("a.latitude", "a.longitude", "b.latitude", "b.longitude")} <= 30"""


CLUSTERS = f"""SELECT m.comp AS cluster, count(*) AS points, count(DISTINCT username) AS affected_users, {rnd("avg(fix)", 1)} AS mean_fix,
   {rnd("any_value(c.lat)", 4)} AS lat,
 {rnd("any_value(c.lon)", 4)} AS lon, {rnd(f"greatest(5e0, max({km('p.latitude', 'p.longitude', 'c.lat', 'c.lon')}))", 2)} AS radius_km
FROM comp m JOIN pts p ON p.id = m.id JOIN (SELECT comp, avg(latitude) AS lat, avg(longitude) AS lon FROM comp JOIN pts USING (id) GROUP BY 1) c
   ON c.comp = m.comp
WHERE m.comp IN (SELECT comp FROM comp JOIN (SELECT a, count(*) AS deg FROM edg GROUP BY 1) e ON e.a = comp.id GROUP BY 1 HAVING max(deg) >= 3)
   GROUP BY 1 HAVING count(DISTINCT username) >= 3"""
COMP = """SELECT id, min(root) AS comp FROM (WITH RECURSIVE reach(id, root) AS (SELECT DISTINCT a, a FROM edg UNION SELECT e.b, r.root FROM reach r
   JOIN edg e ON e.a = r.id) SELECT * FROM reach) GROUP BY 1"""
CROSS_SIDES = f"""SELECT lat, lon, count(*) FILTER (side = 'p') AS ps, count(*) FILTER (side = 'o') AS os, coalesce(sum(s) FILTER (side = 'p'), 0) AS
   p_sum, coalesce(sum(s) FILTER (side = 'o'), 0) AS o_sum,
 coalesce(sum(n) FILTER (side = 'p'), 0) AS p_n, coalesce(sum(n) FILTER (side = 'o'), 0) AS o_n FROM placed GROUP BY 1, 2 HAVING ps >= 2 AND os >= 2
    AND p_n + o_n > 0"""
PLACED = f"""SELECT name AS station, floor(latitude / 10) * 10 AS lat, floor(longitude / 10) * 10 AS lon, CASE
   WHEN contains(lower(network), 'onocoy') THEN 'o' ELSE 'p' END AS side, s, n
 FROM fx_stations LEFT JOIN (SELECT station, sum(fix_rate) AS s, count(*) AS n FROM fx_sessions WHERE login_time >= {H6} AND station IS NOT NULL
    AND {NOISE} GROUP BY 1) x ON x.station = name WHERE network IS NOT NULL"""
PFIX, OFIX = "CASE WHEN p_n > 0 THEN p_sum / p_n ELSE 0e0 END", "CASE WHEN o_n > 0 THEN o_sum / o_n ELSE 0e0 END"
ALERT_STATS = f"""SELECT station, avg(fix_rate) FILTER (login_time >= {AS_OF - 2 * 3_600_000}) AS r_fix, avg(avg_age) FILTER (login_time >=
   {AS_OF - 2 * 3_600_000}) AS r_age,
 avg(CASE WHEN fix_rate = 0 THEN 1e0 ELSE 0e0 END) FILTER (login_time >= {AS_OF - 2 * 3_600_000}) AS r_zero, count(*) FILTER (login_time >=
    {AS_OF - 2 * 3_600_000}) AS r_n,
 avg(fix_rate) FILTER (login_time < {AS_OF - 2 * 3_600_000}) AS o_fix, avg(avg_age) FILTER (login_time < {AS_OF - 2 * 3_600_000}) AS o_age,
 avg(CASE WHEN fix_rate = 0 THEN 1e0 ELSE 0e0 END) FILTER (login_time < {AS_OF - 2 * 3_600_000}) AS o_zero, count(*) FILTER (login_time <
    {AS_OF - 2 * 3_600_000}) AS o_n
 FROM fx_sessions WHERE login_time >= {H6} AND {STATION} GROUP BY 1 HAVING r_n >= 3 AND o_n >= 3"""
ALERT_ROWS = f"""SELECT station, 'fix_rate_declining' AS indicator, CASE WHEN r_fix < 30 THEN 'critical'
   ELSE 'degrading' END AS trend, {rnd("r_fix", 1)} AS current_value, {rnd("o_fix", 1)} AS previous_value,
  {rnd("(r_fix - o_fix) / o_fix * 1e2", 1)} AS change_pct, CASE WHEN r_fix < 30 THEN 'pre_exclude'
     ELSE 'pre_downgrade' END AS action, {rnd("least(9e-1, r_n / 2e1)", 4)} AS confidence FROM st WHERE o_fix > 50 AND r_fix < o_fix * 7e-1
 UNION ALL SELECT station, 'correction_age_rising', CASE WHEN r_age > 10 THEN 'critical'
    ELSE 'degrading' END, {rnd("r_age", 2)}, {rnd("o_age", 2)}, {rnd("(r_age - o_age) / greatest(1e-1, o_age) * 1e2")},
  CASE WHEN r_age > 10 THEN 'pre_downgrade' ELSE 'monitor' END, {rnd("least(8e-1, r_n / 15e0)", 4)} FROM st WHERE o_age < 5 AND r_age > o_age * 2
 UNION ALL SELECT station, 'zero_fix_increasing', CASE WHEN r_zero > 5e-1 THEN 'critical'
    ELSE 'degrading' END, {rnd("r_zero * 1e2")}, {rnd("o_zero * 1e2")}, {rnd("(r_zero - o_zero) * 1e2")},
  CASE WHEN r_zero > 5e-1 THEN 'pre_exclude' ELSE 'pre_downgrade' END, {rnd("least(85e-2, r_n / 1e1)", 4)} FROM st WHERE o_zero < 1e-1
     AND r_zero > 3e-1
 UNION ALL SELECT station, 'fix_rate_improving', 'improving', {rnd("r_fix", 1)}, {rnd("o_fix", 1)}, {rnd("(r_fix - o_fix) / o_fix * 1e2")},
    'pre_promote', {rnd("least(7e-1, r_n / 2e1)", 4)}
  FROM st WHERE o_fix < 60 AND r_fix > o_fix * 13e-1 AND r_fix > 70"""


def _marks() -> str:
    """The cause marks of each cluster, for Kp 0, hour 0 and a radius of 30 km."""
    return """CASE WHEN onset < 2 THEN 3 ELSE 0 END + CASE WHEN fix < 10 THEN 2 ELSE 0 END + CASE WHEN ratio > 3 THEN 1 ELSE 0 END + 1 AS jamming,
     CASE WHEN fix > 50 AND variance < 100 THEN 2 ELSE 0 END + CASE WHEN ratio < 15e-1 THEN 1 ELSE 0 END AS spoofing,
     CASE WHEN onset > 30 THEN 1 ELSE 0 END + CASE WHEN same THEN 2 ELSE 0 END + CASE WHEN networks > 1 THEN 1 ELSE 0 END AS iono,
     CASE WHEN stations = 1 THEN 4 ELSE 0 END + CASE WHEN trust_avg < 4e-1 THEN 2 ELSE 0 END + CASE WHEN NOT same AND networks = 1 THEN 1
        ELSE 0 END AS station_fault,
     CASE WHEN variance > 400 AND stations = 1 THEN 1 ELSE 0 END AS multipath,
     CASE WHEN ratio > 5 AND fix > 30 THEN 3 ELSE 0 END + CASE WHEN stations > 10 AND networks = 1 THEN 2 ELSE 0 END AS network"""


BAD = f"""SELECT s.*, {HALF.replace("latitude", "s.latitude").replace("longitude", "s.longitude")}, coalesce(p.network, 'unknown') AS network,
   r.composite_score FROM fx_sessions s
 LEFT JOIN fx_stations p ON p.name = s.station LEFT JOIN fx_trust r ON r.station = s.station
 WHERE login_time >= {H6} AND s.station IS NOT NULL AND s.station <> '' AND s.latitude IS NOT NULL AND abs(s.latitude) > 0.1 AND fix_rate < 40"""
SHIELD = f"""SELECT lat, lon, CASE greatest(jamming, spoofing, iono, station_fault, multipath, network) WHEN 0 THEN 'unknown'
   WHEN jamming THEN 'jamming' WHEN spoofing THEN 'spoofing' WHEN iono THEN 'iono'
  WHEN station_fault THEN 'station_fault' WHEN multipath THEN 'multipath' ELSE 'network' END AS classification, confidence,
 CASE WHEN affected_users >= 8 OR (jamming >= greatest(spoofing, iono, station_fault, multipath, network) AND jamming > 0) THEN 'critical'
    WHEN affected_users >= 4 THEN 'warning' ELSE 'info' END AS severity,
 affected_users, stations, {rnd("span")} AS duration_min
FROM (SELECT *, CASE WHEN jamming + spoofing + iono + station_fault + multipath + network > 0 THEN
   {rnd("least(95e-2, greatest(jamming, spoofing, iono, station_fault, multipath, network) / (jamming + spoofing + iono + station_fault + multipath + network))", 2)}
   ELSE 0e0 END AS confidence
 FROM (SELECT *, {_marks()} FROM (SELECT a.*, t.trust_avg, t.stations, coalesce(k.networks, 0) AS networks, coalesce(age, 0e0) / {BASE_AGE} AS ratio,
    greatest(1e0, span) AS onset,
   (coalesce(k.networks, 0) < 2 OR k.gap < 20) AS same
  FROM (SELECT lat, lon, count(DISTINCT username) AS affected_users, avg(fix_rate) AS fix, var_pop(fix_rate) AS variance, avg(CASE
     WHEN avg_age > 0 THEN avg_age END) AS age,
    (max(login_time) - min(login_time)) / 6e4 AS span FROM bad GROUP BY 1, 2) a
  JOIN (SELECT lat, lon, avg(t) AS trust_avg, count(*) AS stations FROM (SELECT lat, lon, station, any_value(coalesce(composite_score, 5e-1)) AS t
     FROM bad GROUP BY 1, 2, 3) GROUP BY 1, 2) t USING (lat, lon)
  LEFT JOIN (SELECT lat, lon, count(*) AS networks, max(f) - min(f) AS gap FROM (SELECT lat, lon, network, avg(fix_rate) AS f FROM bad
     WHERE network <> 'unknown' GROUP BY 1, 2, 3) GROUP BY 1, 2) k USING (lat, lon)
  WHERE affected_users >= 2 AND (SELECT count(*) FROM bad) >= 3))) WHERE confidence >= 2e-1"""
CUSUM_SERIES = f"""SELECT station, row_number() OVER (PARTITION BY station ORDER BY k) AS i, fix, base, greatest(5e0, base * 15e-2) AS sigma FROM
 (SELECT station, CAST(floor((login_time - {CUSUM_START}) / 18e5) AS int) AS k, avg(fix_rate) AS fix FROM fx_sessions WHERE {SEEN}
    AND login_time >= {CUSUM_START} AND login_time < {AS_OF} GROUP BY 1, 2)
 JOIN (SELECT station, avg(fix_rate) AS base FROM fx_sessions WHERE {SEEN} AND login_time >= {CUSUM_START - 86_400_000} AND login_time < {CUSUM_START}
    GROUP BY 1 HAVING count(*) >= 3) USING (station)"""
CUSUM = f"""SELECT station, {rnd("base", 3)} AS baseline, i AS buckets, {rnd("low", 3)} AS s_minus, {rnd("ewma", 3)} AS ewma_fix, ca AS cusum_alarms,
   ea AS ewma_alarms FROM (
 WITH RECURSIVE f(station, i, base, low, ewma, ca, ea) AS (
  SELECT DISTINCT station, CAST(0 AS bigint), base, 0e0, base, 0, 0 FROM ser
  UNION ALL SELECT f.station, s.i, f.base, CASE WHEN x.low > 5 AND s.i >= 3 THEN 0e0 ELSE x.low END, x.ew, f.ca + CASE WHEN x.low > 5
     AND s.i >= 3 THEN 1 ELSE 0 END,
   f.ea + CASE WHEN s.i >= 5 AND f.base > 50 AND f.base - x.ew > 15 THEN 1 ELSE 0 END
  FROM f JOIN ser s ON s.station = f.station AND s.i = f.i + 1, LATERAL (SELECT greatest(0e0, f.low - (s.fix - f.base) / s.sigma - 5e-1) AS low, s.fix
     * 2e-1 + f.ewma * 8e-1 AS ew) x)
 SELECT *, max(i) OVER (PARTITION BY station) AS last FROM f) WHERE i = last"""

V1_SERIES = f"""SELECT station, row_number() OVER (PARTITION BY station
   ORDER BY k) AS i, fix, age, base, ab, greatest(5e0, base * 15e-2) AS sg, greatest(5e-1, ab * 2e-1) AS sa FROM
 (SELECT station, CAST(floor((login_time - {CUSUM_START}) / 18e5) AS int) AS k, avg(fix_rate) AS fix, coalesce(avg(CASE
    WHEN avg_age > 0 THEN avg_age END), 0e0) AS age FROM fx_sessions WHERE {SEEN} AND login_time >= {CUSUM_START} AND login_time < {AS_OF}
    GROUP BY 1, 2)
 JOIN (SELECT station, avg(fix_rate) AS base, coalesce(avg(CASE WHEN avg_age > 0 THEN avg_age END), 0e0) AS ab FROM fx_sessions WHERE {SEEN}
    AND login_time >= {CUSUM_START - 86_400_000} AND login_time < {CUSUM_START} GROUP BY 1 HAVING count(*) >= 20) USING (station)"""
V1 = f"""SELECT station, {rnd("low", 3)} AS low, {rnd("high", 3)} AS high, {rnd("ewma", 3)} AS ewma, {rnd("ea", 3)} AS ewma_age, i AS count, ac AS
   age_count, f1 AS fix_alarms, f2 AS age_alarms, f3 AS ewma_fix_alarms, f4 AS ewma_age_alarms FROM (
 WITH RECURSIVE f(station, i, low, high, ewma, ea, ac, f1, f2, f3, f4) AS (SELECT DISTINCT station, CAST(0 AS bigint), 0e0, 0e0, base, ab, 0, 0, 0, 0,
    0 FROM ser
  UNION ALL SELECT f.station, s.i, CASE WHEN x.lo > 5 AND s.i >= 3 THEN 0e0 ELSE x.lo END, CASE WHEN x.seen AND x.hi > 5 AND f.ac + 1 >= 3 THEN 0e0
     ELSE x.hi END, x.ew, x.en, f.ac + CASE WHEN x.seen THEN 1 ELSE 0 END, f.f1 + CASE WHEN x.lo > 5 AND s.i >= 3 THEN 1 ELSE 0 END,
   f.f2 + CASE WHEN x.seen AND x.hi > 5 AND f.ac + 1 >= 3 THEN 1 ELSE 0 END, f.f3 + CASE WHEN s.i >= 5 AND s.base > 50 AND s.base - x.ew > 15 THEN 1
      ELSE 0 END, f.f4 + CASE WHEN s.i >= 5 AND s.ab > 0 AND x.en > s.ab * 3 THEN 1 ELSE 0 END
  FROM f JOIN ser s ON s.station = f.station AND s.i = f.i + 1, LATERAL (SELECT s.age > 0
     AND s.ab > 0 AS seen, greatest(0e0, f.low - (s.fix - s.base) / s.sg - 5e-1) AS lo,
   CASE WHEN s.age > 0 AND s.ab > 0 THEN greatest(0e0, f.high + (s.age - s.ab) / s.sa - 5e-1)
      ELSE f.high END AS hi, s.fix * 2e-1 + f.ewma * 8e-1 AS ew, CASE WHEN s.age > 0 THEN s.age * 2e-1 + f.ea * 8e-1 ELSE f.ea END AS en) x)
 SELECT *, max(i) OVER (PARTITION BY station) AS last FROM f) WHERE i = last"""

REGIONAL = f"""SELECT 'regional_degradation' AS type, CASE WHEN fix < 40 THEN 'critical'
           ELSE 'warning' END AS severity, region, affected_users, {rnd("fix", 1)} AS current_value, {rnd("b_fix", 1)} AS baseline_value,
         {rnd("(fix - b_fix) / b_fix * 1e2", 1)} AS deviation_pct
            FROM (SELECT {circle("latitude", "longitude")} AS region, count(*) AS n, avg(fix_rate) AS fix, count(DISTINCT username) AS affected_users
          FROM fx_sessions WHERE {SEEN} AND login_time >= {H6} AND {NONZERO} GROUP BY 1)
             JOIN (SELECT {circle("latitude", "longitude")} AS region, count(*) AS b_n, avg(fix_rate) AS b_fix
          FROM fx_sessions WHERE login_time >= {H24} AND login_time < {H6} AND {POSITION} AND {STATION} GROUP BY 1) USING (region) WHERE n >= 10
             AND b_n >= 20 AND b_fix > 60 AND fix < b_fix * 7e-1"""
EVENT = f"""SELECT * REPLACE (CASE WHEN login_time >= {H6} AND longitude < 14 THEN fix_rate * 7e-1 ELSE 7e1 + fix_rate * 3e-1 END AS fix_rate) FROM fx_sessions"""


def failing_west() -> Column:
    late = (F.col("login_time") >= AS_OF - 6 * 3_600_000) & (F.col("longitude") < 14)
    return F.when(late, F.col("fix_rate") * 0.7).otherwise(F.col("fix_rate") * 0.3 + 70)


DETECTORS = {
    "cusum_counters_v1": (lambda t: d.cusum_counters_v1(t.fx_sessions, AS_OF), oracle(V1, ser=V1_SERIES)),
    "fix_rate_drop": (
        lambda t: d.fix_rate_drop(t.fx_sessions, AS_OF),
        oracle(f"""SELECT 'fix_rate_drop' AS type, CASE WHEN fix < 30 THEN 'critical' WHEN fix < 50 THEN 'warning'
           ELSE 'info' END AS severity, station, affected_users, {rnd("fix", 1)} AS current_value,
         {rnd("b_fix", 1)} AS baseline_value, {rnd("(fix - b_fix) / b_fix * 1e2", 1)} AS deviation_pct, last_ms AS detected_ms FROM two WHERE n > 0
            AND b_n >= 10 AND b_fix > 50 AND fix < b_fix * 6e-1""", two=TWO)),
    "age_spike": (
        lambda t: d.age_spike(t.fx_sessions, AS_OF),
        oracle(f"""SELECT 'age_spike' AS type, CASE WHEN age > b_age * 5 THEN 'critical'
           ELSE 'warning' END AS severity, station, affected_users, {rnd("age", 1)} AS current_value,
         {rnd("b_age", 1)} AS baseline_value, {rnd("(age - b_age) / b_age * 1e2", 1)} AS deviation_pct FROM two WHERE b_n >= 10 AND b_age > 0
            AND age > b_age * 3""", two=TWO)),
    "latest_status": (lambda t: d.latest_status(status_log(t)), oracle(LATEST)),
    "station_outage": (
        lambda t: d.station_outage(t.fx_sessions, status_log(t), AS_OF),
        oracle(f"""SELECT 'station_outage' AS type, CASE WHEN b_users >= 10 THEN 'critical'
           ELSE 'warning' END AS severity, station, b_users AS affected_users, b_n AS baseline_value
         FROM two JOIN lat USING (station) WHERE n > 0 AND last_ms < {AS_OF - 1_800_000} AND b_n >= 20 AND b_users >= 3
            AND last_status NOT IN ('ONLINE', 'ACTIVE')""", two=TWO, lat=LATEST)),
    "mass_disconnect": (lambda t: d.mass_disconnect(t.fx_sessions, AS_OF), disconnect_sql(30, 5, 10)),
    "mass_disconnect_5m": (lambda t: d.mass_disconnect(t.fx_sessions, AS_OF, 360, 25, 3, 8), disconnect_sql(25, 3, 8)),
    "regional_degradation": (
        lambda t: d.regional_degradation(t.fx_sessions, AS_OF),
        oracle(REGIONAL)),
    # No region of the fixtures fails as a whole; here sessions are good everywhere until the west fails in the last six hours.
    "regional_degradation_event": (
        lambda t: d.regional_degradation(t.fx_sessions.withColumn("fix_rate", failing_west()), AS_OF), oracle(REGIONAL.replace("fx_sessions", "ev"), ev=EVENT)),
    "cusum_counters_v2": (lambda t: d.cusum_counters(t.fx_sessions, AS_OF), oracle(CUSUM, ser=CUSUM_SERIES)),
    "interference_clusters": (lambda t: d.interference_clusters(t.fx_sessions, AS_OF), oracle(CLUSTERS, pts=CLUSTER_POINTS, edg=cluster_edges(10), comp=COMP)),
    # The smallest tables hold no cluster of ten minutes; an hour finds some.
    "interference_clusters_1h": (
        lambda t: d.interference_clusters(t.fx_sessions, AS_OF, minutes=60), oracle(CLUSTERS, pts=CLUSTER_POINTS, edg=cluster_edges(60), comp=COMP)),
    "sessions_with_network": (
        lambda t: d.with_network(t.fx_sessions, t.fx_stations).groupBy("network").agg(F.count(F.lit(1)).alias("sessions")),
        oracle("""SELECT coalesce(p.network, 'unknown') AS network, count(*) AS sessions FROM fx_sessions s LEFT JOIN fx_stations p
           ON p.name = s.station GROUP BY 1""")),
    "cross_network_inconsistency": (
        lambda t: d.cross_network_inconsistency(t.fx_sessions, t.fx_stations, AS_OF),
        oracle(f"""SELECT a.lat, a.lon, CASE WHEN a.fix < b.fix THEN a.network ELSE b.network END AS worse, CASE
           WHEN abs(a.fix - b.fix) > 50 THEN 'warning' ELSE 'info' END AS severity,
         a.n + b.n AS affected_users, {rnd("least(a.fix, b.fix)", 1)} AS current_value, {rnd("greatest(a.fix, b.fix)", 1)} AS baseline_value,
         {rnd("(least(a.fix, b.fix) - greatest(a.fix, b.fix)) / greatest(a.fix, b.fix) * 1e2", 1)} AS deviation_pct FROM c a JOIN c b ON a.lat = b.lat
            AND a.lon = b.lon AND a.network < b.network
         WHERE abs(a.fix - b.fix) > 30""", c=f"""SELECT floor(s.latitude) AS lat, floor(s.longitude) AS lon, p.network, count(*) AS n, avg(fix_rate)
            AS fix FROM fx_sessions s JOIN fx_stations p ON p.name = s.station
         WHERE login_time >= {H6} AND {NOISE} AND s.latitude IS NOT NULL AND abs(s.latitude) > 0.1 AND p.network IS NOT NULL GROUP BY 1, 2, 3
            HAVING count(*) >= 3""")),
    "classify_interference": (lambda t: d.classify_interference(t.fx_sessions, t.fx_stations, t.fx_trust, AS_OF), oracle(SHIELD, bad=BAD)),
    "predictive_alerts": (
        lambda t: d.predictive_alerts(t.fx_sessions, AS_OF, recent_h=2),
        oracle(f"""SELECT * FROM (SELECT * FROM al UNION ALL SELECT 'SYSTEM', 'cascade_exhaustion_warning', 'critical', w, b, 0e0,
           'investigate_systemic', 9e-1 FROM
          (SELECT count(*) FILTER (trend <> 'improving') AS w, count(*) FILTER (trend = 'improving') AS b FROM al) WHERE w > 10 AND w > b * 3)
             ORDER BY confidence DESC, station, indicator LIMIT 50""", st=ALERT_STATS, al=ALERT_ROWS)),
    "cross_validate_networks": (
        lambda t: d.cross_validate_networks(t.fx_sessions, t.fx_stations, AS_OF)[0],
        oracle(f"""SELECT lat, lon, {rnd("p", 1)} AS primary_fix, {rnd("o", 1)} AS overlay_fix, {rnd("p - o", 1)} AS delta,
           {rnd("1 - least(1e0, abs(p - o) / 5e1)", 2)} AS agreement,
         CASE WHEN abs(p - o) < 5 THEN 'tie' WHEN p > o THEN 'primary' ELSE 'overlay' END AS winner FROM (SELECT lat, lon, {PFIX} AS p, {OFIX} AS o
            FROM sides)""", placed=PLACED, sides=CROSS_SIDES)),
    "cross_validation_flags": (
        lambda t: d.cross_validate_networks(t.fx_sessions, t.fx_stations, AS_OF)[1],
        oracle(f"""SELECT station, {rnd("m")} AS fix_rate, {rnd("rm")} AS region_mean, CASE WHEN m - rm < -40 THEN 'exclude'
           WHEN m - rm < -30 THEN 'downgrade' ELSE 'investigate' END AS recommendation
         FROM (SELECT station, s / n AS m, n, (p_sum + o_sum) / (p_n + o_n) AS rm FROM placed JOIN sides USING (lat, lon)) WHERE n >= 3
            AND m - rm < -20""", placed=PLACED, sides=CROSS_SIDES)),
    "clone_pairs": (
        lambda t: d.clone_pairs(t.fx_stations),
        oracle(f"""SELECT name, suspect, network, {rnd("1 - km / 5e-2", 2)} AS similarity, CASE WHEN km < 1e-2 THEN 95e-2 ELSE 7e-1 END AS confidence,
           CASE WHEN km < 1e-2 THEN 'exclude' ELSE 'downgrade' END AS recommendation
         FROM (SELECT a.name, b.name AS suspect, a.network, {km("a.latitude", "a.longitude", "b.latitude", "b.longitude")} AS km FROM fx_stations a
            JOIN fx_stations b ON a.name < b.name
          AND a.network IS NOT DISTINCT FROM b.network AND floor(a.latitude * 1000 + 5e-1) = floor(b.latitude * 1000 + 5e-1)
             AND floor(a.longitude * 1000 + 5e-1) = floor(b.longitude * 1000 + 5e-1)) WHERE km < 5e-2""")),
    "quality_gaming": (
        lambda t: d.quality_gaming(t.fx_stations, t.fx_station_scores),
        oracle(f"""SELECT * FROM (SELECT name, network, 'score' AS rule, {rnd("least(3e-1, (7e-1 - avg_fix_rate / 1e2) * 5e-1) + 6e-1", 3)} AS
           confidence, 'investigate' AS recommendation FROM j
          WHERE uq_score > 7e-1 AND avg_fix_rate < 40 AND session_count >= 10 AND uq_score <> 0 AND avg_fix_rate <> 0
         UNION ALL SELECT name, network, 'zero_fix', {rnd("zero_fix_ratio * 3e-1 + 5e-1", 3)}, CASE WHEN zero_fix_ratio > 8e-1 THEN 'exclude'
            ELSE 'downgrade' END FROM j
          WHERE zero_fix_ratio > 5e-1 AND status = 'ONLINE' AND session_count >= 5 AND uq_score <> 0 AND avg_fix_rate <> 0)""", j="""SELECT *
             FROM fx_stations JOIN fx_station_scores ON station_name = name""")),
    "zombie_stations": (
        lambda t: d.zombie_stations(t.fx_stations, t.fx_station_scores, 0.5, 20),
        oracle("""SELECT name, network, 7e-1 AS confidence, 'downgrade' AS recommendation FROM fx_stations LEFT JOIN fx_station_scores
           ON station_name = name
         WHERE coalesce(uptime_7d, 0e0) < 5e-1 AND coalesce(session_count, 0) <= 20 AND status = 'ONLINE'""")),
    "stations_with_scores": (
        lambda t: d.stations_with_scores(t.fx_stations, t.fx_station_scores, {"uq_score": 0.5, "uptime_7d": 0.5, "session_count": 0}).select("name", "network", "uq_score", "uptime_7d", "session_count"),
        oracle("""SELECT name, network, coalesce(uq_score, 5e-1) AS uq_score, coalesce(uptime_7d, 5e-1) AS uptime_7d, coalesce(session_count, 0) AS
           session_count FROM fx_stations LEFT JOIN fx_station_scores ON station_name = name""")),
    "position_spoofing": (
        lambda t: d.position_spoofing(t.fx_stations.select(F.col("name").alias("station"), F.col("height").alias("position_offset_m"))),
        oracle(f"""SELECT name AS station, {rnd("least(95e-2, height / 1e3 + 5e-1)", 3)} AS confidence, CASE WHEN height > 500 THEN 'exclude'
           ELSE 'investigate' END AS recommendation FROM fx_stations WHERE height > 100""")),
    "dedupe_anomalies": (
        lambda t: d.dedupe_anomalies(anomalies(t), t.fx_trust.filter("flag in ('excluded', 'untrusted')").select(F.lit("low_score").alias("type"), F.lit("info").alias("severity"), "station")),
        oracle("""SELECT type, severity, station FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(station, 'global'), type
           ORDER BY pass, severity) AS k FROM
         (SELECT *, 0 AS pass FROM ano UNION ALL SELECT 'low_score', 'info', station, 1 FROM fx_trust WHERE flag IN ('excluded', 'untrusted')))
            WHERE k = 1""", ano=ANOMALIES)),
}
