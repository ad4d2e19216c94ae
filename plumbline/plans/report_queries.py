"""Registered report queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import OVERLAY, half_up
from plumbline.operators import reports, scores

from .fixtures import AS_OF, Tables, oracle
from .sql import D7, D14, D30, H6, H24, NOISE, NONZERO, POSITION, STATION, box, circle, km, rnd


def status_log(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("recorded_ts").cast("timestamp")).alias("recorded_at")
    return t.fx_status_log.select("station_name", "status", "event_id", ms)


def anomalies(t: Tables) -> DataFrame:
    """Stand-in anomaly rows: degraded stations by score."""
    level = F.when(F.col("uq_score") < 0.1, "critical").otherwise("warning")
    return t.fx_station_scores.filter("uq_score < 0.3").select(F.lit("low_score").alias("type"), level.alias("severity"), F.col("station_name").alias("station"))


def health_history(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("hour_ts").cast("timestamp"))
    return t.fx_env_history.select(ms.alias("timestamp"), (F.col("kp") * 10).alias("score"))


def health(t: Tables) -> DataFrame:
    return reports.network_health(t.fx_sessions, t.fx_station_scores, t.fx_cells, health_history(t), AS_OF)


LOG7 = "recorded_ts >= TIMESTAMP '2024-01-24 00:00:00' AND recorded_ts < TIMESTAMP '2024-01-31 00:00:00'"
UPTIME = f"""SELECT s.name AS station, coalesce(l.up, CASE WHEN s.status IN ('ONLINE','ACTIVE') THEN 9e-1 ELSE 5e-1 END) AS uptime
FROM fx_stations s LEFT JOIN (SELECT station_name, {rnd("avg(CASE WHEN status = 'ONLINE' THEN 1e0 ELSE 0e0 END)", 2)} AS up
  FROM fx_status_log WHERE {LOG7} GROUP BY 1) l ON l.station_name = s.name"""
ANOMALIES = """SELECT 'low_score' AS type, CASE WHEN uq_score < 1e-1 THEN 'critical' ELSE 'warning' END AS severity, station_name AS station
   FROM fx_station_scores WHERE uq_score < 3e-1"""
NETWORK = """CASE WHEN starts_with(station, 'NRBY_') OR starts_with(station, 'ONO_') OR starts_with(station, 'onocoy_') THEN 'onocoy'
 WHEN regexp_full_match(station, '[A-Z0-9]{8,12}') THEN 'geodnet' WHEN regexp_full_match(station, '[A-Z]{4}') THEN 'cors' ELSE 'unknown' END"""
SCORES = f"""
SELECT station, {NETWORK} AS network,
 {rnd("4e-1 * least(1e0, mean_fix / 1e2) + 3e-1 * coalesce(greatest(0e0, 1 - med / 1e1), 5e-1) + 3e-1 * up", 2)} AS uq_score,
 {rnd("up * (1 - zero) * coalesce(greatest(0e0, 1 - p90 / 15e0), 5e-1)", 2)} AS reliability_score, session_count, unique_users,
 {rnd("mean_fix", 1)} AS avg_fix_rate, {rnd("p10", 1)} AS p10_fix_rate, {rnd("coalesce(med, 0e0)", 1)} AS median_correction_age,
 {rnd("coalesce(p90, 0e0)", 1)} AS p90_correction_age, {rnd("coalesce(akm, 0e0)", 1)} AS avg_baseline_km, {rnd("coalesce(mkm, 0e0)", 1)} AS
    max_baseline_km,
 {rnd("zero", 3)} AS zero_fix_ratio, {rnd("secs / 36e2", 1)} AS total_duration_hours, up AS uptime_7d
FROM (SELECT g.*, coalesce(u.uptime, 5e-1) AS up, CASE WHEN secs > 0 THEN w / secs ELSE plain END AS mean_fix FROM (
  SELECT s.station, count(*) AS session_count, count(DISTINCT username) AS unique_users, sum(greatest(0, duration)) AS secs,
   sum(fix_rate * greatest(0, duration)) AS w, avg(fix_rate) AS plain, quantile_disc(fix_rate, 1e-1) AS p10,
   quantile_disc(CASE WHEN avg_age > 0 THEN avg_age END, 5e-1) AS med, quantile_disc(CASE WHEN avg_age > 0 THEN avg_age END, 9e-1) AS p90,
   avg(CASE WHEN fix_rate = 0 THEN 1e0 ELSE 0e0 END) AS zero,
   avg(CASE WHEN abs(s.latitude) > 0.1 AND s.longitude <> 0 AND p.latitude <> 0
      AND p.longitude <> 0 THEN {km("s.latitude", "s.longitude", "p.latitude", "p.longitude")} END) AS akm,
   max(CASE WHEN abs(s.latitude) > 0.1 AND s.longitude <> 0 AND p.latitude <> 0
      AND p.longitude <> 0 THEN {km("s.latitude", "s.longitude", "p.latitude", "p.longitude")} END) AS mkm
  FROM fx_sessions s LEFT JOIN fx_stations p ON p.name = s.station WHERE {STATION} AND login_time >= {D14} AND login_time < {AS_OF} GROUP BY 1) g
 LEFT JOIN fx_uptime u USING (station))
"""
SEEN = f"{STATION} AND {NOISE}"
SURVEY = "receiver_type LIKE '%LEICA%' OR receiver_type LIKE '%TRIMBLE%' OR receiver_type LIKE '%SEPT%' OR receiver_type LIKE '%NOVATEL%' OR receiver_type LIKE '%CHC%' OR receiver_type LIKE '%TOPCON%' OR receiver_type LIKE '%SURVEY_GRADE_PROBED%'"
HEALTH = f"""SELECT score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 80 THEN 'good' WHEN score >= 70 THEN 'acceptable'
   WHEN score >= 60 THEN 'degraded' ELSE 'critical' END AS grade,
 {rnd("q")} AS quality, {rnd("r")} AS reliability, {rnd("c")} AS coverage, {rnd("f")} AS freshness, h1 AS score_1h_ago, h24 AS score_24h_ago,
 CASE WHEN score > h1 + 2 THEN 'improving' WHEN score < h1 - 2 THEN 'declining' ELSE 'stable' END AS trend
FROM (SELECT *, {rnd("q * 4e-1 + r * 25e-2 + c * 2e-1 + f * 15e-2")} AS score FROM (
 SELECT (SELECT least(1e2, coalesce(avg(fix_rate), 0e0)) FROM fx_sessions WHERE login_time >= {H24} AND fix_rate > 0 AND station IS NOT NULL) AS q,
  (SELECT least(1e2, coalesce(avg(uptime_7d), 0e0) * 1e2) FROM fx_station_scores) AS r,
  (SELECT least(1e2, coalesce(avg(CASE WHEN zone_tier = 'full_rtk' THEN 1e0 ELSE 0e0 END), 0e0) * 1e2 * 15e-1) FROM fx_cells) AS c,
  (SELECT greatest(0e0, least(1e2, (1 - coalesce(avg(CASE WHEN median_correction_age > 0 THEN median_correction_age END), 5e0) / 1e1) * 1e2))
     FROM fx_station_scores) AS f,
  (SELECT arg_min(kp * 1e1, hour_ts) FROM fx_env_history WHERE abs(epoch_ms(hour_ts) - {AS_OF - 3_600_000}) < 1800000) AS h1,
  (SELECT arg_min(kp * 1e1, hour_ts) FROM fx_env_history WHERE abs(epoch_ms(hour_ts) - {AS_OF - 86_400_000}) < 3600000) AS h24))"""
HW6 = "CAST(floor(login_time / 36e5) * 36e5 AS bigint)"
INTEGRITY = f"""
SELECT region, least(1e2, greatest(0e0, sc)) AS score, CASE WHEN nb > 10 AND mf > b * 105e-2 THEN 'improving' WHEN nb > 10
   AND mf < b * 95e-2 THEN 'declining' ELSE 'stable' END AS trend,
 stations, sessions_6h, {rnd("sum(least(1e2, greatest(0e0, sc)) * sessions_6h) OVER () / sum(sessions_6h) OVER ()")} AS global_score
FROM (SELECT s.region, s.sessions_6h, s.mf, u.stations, b.b, b.nb,
   {rnd("s.stab * 4e-1 + s.fresh * 25e-2 + u.av * 2e-1 + coalesce(c.coh, 75e0) * 15e-2")} AS sc FROM
 (SELECT region, count(*) AS sessions_6h, avg(fix_rate) AS mf, greatest(0e0, 1 - stddev_pop(fix_rate) / 5e1) * 1e2 AS stab,
   coalesce(greatest(0e0, 1 - avg(CASE WHEN avg_age > 0 THEN avg_age END) / 1e1) * 1e2, 5e1) AS fresh FROM rec WHERE region <> 'Other' GROUP BY 1) s
 JOIN (SELECT region, count(*) AS stations, avg(coalesce(uptime_7d, 5e-1)) * 1e2 AS av FROM (SELECT DISTINCT region, station FROM rec
    WHERE region <> 'Other') x
   LEFT JOIN fx_station_scores y ON y.station_name = x.station GROUP BY 1) u USING (region)
 LEFT JOIN (SELECT region, avg(greatest(0e0, 1 - abs(fix_rate - pf) / 5e1)) * 1e2 AS coh
    FROM (SELECT *, row_number() OVER w AS rn, lag(latitude) OVER w AS pl, lag(longitude) OVER w AS po,
   lag(fix_rate) OVER w AS pf FROM rec WHERE region <> 'Other' WINDOW w AS (PARTITION BY region ORDER BY latitude, id)) WHERE rn <= 200
      AND {km("pl", "po", "latitude", "longitude")} < 100 GROUP BY 1) c USING (region)
 LEFT JOIN (SELECT {circle("latitude", "longitude")} AS region, avg(fix_rate) AS b, count(*) AS nb FROM fx_sessions
   WHERE login_time >= {H24} AND login_time < {H6} AND {POSITION} AND {STATION} GROUP BY 1) b USING (region))
"""
RECENT6 = f"SELECT *, {circle('latitude', 'longitude')} AS region FROM fx_sessions WHERE {SEEN} AND login_time >= {H6} AND {NONZERO}"
ALIGNED = f"""SELECT a.*, e.kp, e.bz FROM (SELECT {HW6} AS hour_ms, {rnd("avg(fix_rate)", 1)} AS fix_rate,
 {rnd("coalesce(avg(CASE WHEN avg_age > 0 THEN avg_age END), 0e0)", 1)} AS correction_age, count(*) AS sessions, count(DISTINCT username) AS users
 FROM fx_sessions WHERE login_time >= {D7} AND {STATION} GROUP BY 1) a LEFT JOIN (SELECT epoch_ms(hour_ts) AS hour_ms, kp, bz
    FROM fx_env_history) e USING (hour_ms)"""
STATION_NAME = "ST000003"

#: name -> (query over the views, SQL twin)
REPORTS = {
    "station_uptime": (lambda t: scores.station_uptime(status_log(t), t.fx_stations, AS_OF), oracle(UPTIME)),
    "station_scores": (lambda t: scores.station_scores(t.fx_sessions, t.fx_stations, status_log(t), AS_OF), oracle(SCORES, fx_uptime=UPTIME)),
    "station_baseline": (
        lambda t: scores.station_baseline(t.fx_sessions, D7, H6, 10).select(
            "station", half_up("mean_fix", 4).alias("mean_fix"), half_up("mean_age", 4).alias("mean_age"), "n", "users"),
        oracle(f"""SELECT station, {rnd("avg(fix_rate)", 4)} AS mean_fix, {rnd("avg(avg_age)", 4)} AS mean_age, count(*) AS n, count(DISTINCT
           username) AS users
         FROM fx_sessions WHERE {SEEN} AND login_time >= {D7} AND login_time < {H6} GROUP BY 1 HAVING count(*) >= 10""")),
    "station_hourly": (
        lambda t: scores.station_hourly(t.fx_sessions, AS_OF),
        oracle(f"""SELECT station, {HW6} AS hour_ms, {rnd("avg(fix_rate)", 1)} AS fix_rate,
           {rnd("coalesce(avg(CASE WHEN avg_age > 0 THEN avg_age END), 0e0)", 1)} AS correction_age,
         count(*) AS sessions FROM fx_sessions WHERE login_time >= {H24} AND {STATION} GROUP BY 1, 2""")),
    "region_integrity_scores": (lambda t: reports.region_integrity_scores(t.fx_sessions, t.fx_station_scores, AS_OF), oracle(INTEGRITY, rec=RECENT6)),
    "integrity_stats": (
        lambda t: reports.integrity_stats(t.fx_sessions, t.fx_stations, anomalies(t), AS_OF),
        oracle(f"""SELECT (SELECT {rnd("coalesce(avg(fix_rate), 0e0)", 1)} FROM fx_sessions WHERE {SEEN} AND login_time >= {H6}) AS mean_fix_rate,
         (SELECT count(*) FROM fx_sessions WHERE duration = -1 AND login_time >= {H6}) AS active_sessions, (SELECT count(*)
            FROM fx_stations) AS stations_monitored,
         (SELECT count(*) FROM ano) AS anomalies_24h""", ano=ANOMALIES)),
    "grid_session_stats": (
        lambda t: reports.grid_session_stats(t.fx_sessions, AS_OF),
        oracle(f"""SELECT {rnd("latitude", 1)} AS lat, {rnd("longitude", 1)} AS lon, count(*) AS sessions, count(DISTINCT username) AS users,
         {rnd("sum(fix_rate * greatest(0, duration))", 1)} AS fix_seconds, sum(greatest(0, duration)) AS seconds,
         {rnd("coalesce(avg(CASE WHEN avg_age > 0 THEN avg_age END), 0e0)", 2)} AS mean_age
         FROM fx_sessions WHERE login_time >= {D14} AND {POSITION} AND abs(longitude) > 0.1 GROUP BY 1, 2""")),
    "network_health": (health, oracle(HEALTH)),
    "daily_report": (
        lambda t: reports.daily_report(t.fx_sessions, t.fx_trust, t.fx_stations, anomalies(t), health(t), AS_OF),
        oracle(f"""SELECT *, array_to_string(list_filter([concat('Network health: ', CAST(CAST(health_score AS int) AS varchar), '/100 (', grade,
           ')'),
          CASE WHEN avg_fix >= 95 THEN 'Fix rate excellent' WHEN avg_fix < 80 THEN 'Fix rate below target' END,
          CASE WHEN critical > 0 THEN concat(critical, ' critical anomalies') END, CASE
             WHEN excluded > 0 THEN concat(excluded, ' stations excluded') END,
          CASE WHEN survey_grade > 0 THEN concat(survey_grade, ' overlay survey-grade stations') END], lambda x: x IS NOT NULL), '; ') AS highlights
             FROM
         (SELECT count(*) AS sessions_24h, {rnd("coalesce(avg(fix_rate), 0e0)", 1)} AS avg_fix, count(DISTINCT username) AS unique_users,
            count(DISTINCT station) AS unique_stations
           FROM fx_sessions WHERE login_time >= {H24} AND fix_rate > 0),
         (SELECT count(*) FILTER (flag = 'trusted') AS trusted, count(*) FILTER (flag = 'probation') AS probation, count(*) FILTER (flag =
            'untrusted') AS untrusted,
           count(*) FILTER (flag = 'excluded') AS excluded, count(*) FILTER (flag = 'new') AS "new" FROM fx_trust),
         (SELECT count(*) FILTER ({SURVEY}) AS survey_grade FROM fx_stations WHERE network = 'onocoy'),
         (SELECT count(*) AS anomalies, count(*) FILTER (severity = 'critical') AS critical FROM ano), (SELECT score AS health_score, grade
            FROM hea)""", ano=ANOMALIES, hea=HEALTH)),
    "sla_report": (
        lambda t: reports.sla_report(t.fx_sessions, t.fx_cells, anomalies(t), AS_OF),
        oracle(f"""SELECT a.*, (SELECT {rnd("count(DISTINCT floor(login_time / 36e5)) / 72e1 * 1e2", 1)} FROM fx_sessions
           WHERE login_time >= {D30}) AS uptime_pct,
         (SELECT {rnd("coalesce(avg(CASE WHEN zone_tier = 'full_rtk' THEN 1e0 ELSE 0e0 END) * 1e2, 0e0)", 1)}
            FROM fx_cells) AS coverage_green_pct, (SELECT count(*) FROM ano) AS incidents
         FROM (SELECT count(*) AS total_sessions, count(DISTINCT username) AS unique_users, count(DISTINCT station) AS stations_used,
          {rnd("coalesce(avg(CASE WHEN fix_rate > 0 THEN fix_rate END), 0e0)", 1)} AS avg_fix_rate,
             {rnd("avg(CASE WHEN fix_rate >= 80 THEN 1e0 ELSE 0e0 END) * 1e2", 1)} AS fix_success_rate,
          {rnd("sum(duration) / 36e2", 1)} AS total_hours, {rnd("coalesce(avg(avg_age), 0e0)", 2)} AS avg_correction_age, count(*) FILTER (fix_rate =
             0 AND duration < 60) AS failed_sessions,
          count(*) FILTER (fix_rate >= 80) AS good_sessions FROM fx_sessions WHERE login_time >= {D30} AND {STATION}) a""", ano=ANOMALIES)),
    "usage_by_hour": (
        lambda t: reports.usage_by_hour(t.fx_sessions, AS_OF),
        oracle(f"""SELECT *, (SELECT hour FROM h ORDER BY sessions DESC, hour LIMIT 1) AS peak_hour, (SELECT hour FROM h
           ORDER BY sessions, hour LIMIT 1) AS quiet_hour FROM h""",
               h=f"""SELECT CAST(floor(login_time / 36e5) AS bigint) % 24 AS hour, count(*) AS sessions, count(DISTINCT username) AS users
                  FROM fx_sessions WHERE login_time >= {D30} GROUP BY 1""")),
    "usage_by_weekday": (
        lambda t: reports.usage_by_weekday(t.fx_sessions, AS_OF),
        oracle(f"""SELECT dayofweek(make_timestamp_ms(login_time)) AS dow, strftime(make_timestamp_ms(login_time), '%a') AS day, count(*) AS sessions,
           count(DISTINCT username) AS users
         FROM fx_sessions WHERE login_time >= {D30} GROUP BY 1, 2""")),
    "usage_by_region": (
        lambda t: reports.usage_by_region(t.fx_sessions, AS_OF),
        oracle(f"""SELECT *, {rnd("sessions / sum(sessions) OVER () * 1e2", 1)} AS share_pct
           FROM (SELECT {box("latitude", "longitude")} AS region, count(*) AS sessions,
         count(DISTINCT username) AS users, {rnd("avg(fix_rate)", 1)} AS avg_fix_rate FROM fx_sessions WHERE login_time >= {D30} AND {POSITION}
            GROUP BY 1)""")),
    "top_stations": (
        lambda t: reports.top_stations(t.fx_sessions, AS_OF),
        oracle(f"""SELECT station, count(*) AS sessions, count(DISTINCT username) AS users, {rnd("avg(fix_rate)", 1)} AS avg_fix,
           {rnd("avg(duration) / 6e1")} AS avg_duration_min
         FROM fx_sessions WHERE login_time >= {D30} AND {STATION} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")),
    "worst_stations": (
        lambda t: reports.worst_stations(t.fx_sessions, AS_OF),
        oracle(f"""SELECT station, count(*) AS sessions, {rnd("avg(fix_rate)", 1)} AS avg_fix,
           {rnd("avg(CASE WHEN fix_rate = 0 THEN 1e0 ELSE 0e0 END) * 1e2")} AS zero_fix_pct
         FROM fx_sessions WHERE login_time >= {D30} AND {STATION} GROUP BY 1 HAVING count(*) >= 10
            ORDER BY {rnd("avg(fix_rate)", 6)}, 1 LIMIT 10""")),
    "duration_distribution": (
        lambda t: reports.duration_distribution(t.fx_sessions, AS_OF),
        oracle(f"""SELECT CASE WHEN duration < 60 THEN '<1min' WHEN duration < 300 THEN '1-5min' WHEN duration < 900 THEN '5-15min'
           WHEN duration < 1800 THEN '15-30min'
         WHEN duration < 3600 THEN '30-60min' WHEN duration < 7200 THEN '1-2h'
            ELSE '>2h' END AS bucket, count(*) AS sessions, {rnd("avg(fix_rate)", 1)} AS avg_fix
         FROM fx_sessions WHERE login_time >= {D30} AND duration > 0 GROUP BY 1""")),
    "retention": (
        lambda t: reports.retention(t.fx_sessions, AS_OF),
        oracle(f"""SELECT count(*) AS total_users, count(*) FILTER (c >= 2) AS returning_users,
           {rnd("count(*) FILTER (c >= 2) / greatest(1, count(*)) * 1e2", 1)} AS return_rate_pct
         FROM (SELECT username, count(*) AS c FROM fx_sessions WHERE login_time >= {D30} GROUP BY 1)""")),
    "hour_align": (lambda t: reports.hour_align(t.fx_sessions, t.fx_env_history, AS_OF), oracle(ALIGNED)),
    "kp_fix_correlation": (
        lambda t: reports.kp_fix_correlation(reports.hour_align(t.fx_sessions, t.fx_env_history, AS_OF)),
        oracle(f"""SELECT CASE WHEN count(*) >= 5 AND var_pop(kp) > 1e-12 AND var_pop(fix_rate) > 1e-12 THEN {rnd("corr(kp, fix_rate)", 3)}
           ELSE 0e0 END AS correlation_kp_fix, count(*) AS data_points
         FROM al WHERE kp IS NOT NULL AND fix_rate > 0""", al=ALIGNED)),
    "session_overview": (
        lambda t: reports.session_overview(t.fx_sessions, AS_OF),
        oracle(f"""SELECT count(*) AS total, count(*) FILTER (login_time >= {H24}) AS last_24h, count(*) FILTER (login_time >= {D7}) AS last_7d,
         {rnd(f"coalesce(avg(fix_rate) FILTER (login_time >= {H24} AND fix_rate > 0), 0e0)", 1)} AS avg_fix_rate_24h,
         count(DISTINCT station) FILTER (login_time >= {H24} AND {STATION}) AS unique_stations_24h, count(DISTINCT username) FILTER (login_time >=
            {H24}) AS unique_users_24h,
         min(login_time) AS oldest, max(login_time) AS newest, {rnd("(max(login_time) - min(login_time)) / 864e5")} AS time_span_days
            FROM fx_sessions""")),
    "tier_summary": (
        lambda t: reports.tier_summary(t.fx_cells),
        oracle(f"""SELECT *, {rnd("coalesce((SELECT count(*) FROM fx_cells WHERE zone_tier = 'full_rtk'), 0) / total_cells * 1e2", 1)} AS green_pct
           FROM
         (SELECT zone_tier, count(*) AS cells, {rnd("avg(quality_score)", 2)} AS avg_quality, sum(count(*)) OVER () AS total_cells FROM fx_cells
            GROUP BY 1)""")),
    "station_score_summary": (
        lambda t: reports.station_score_summary(t.fx_station_scores),
        oracle(f"""SELECT count(*) AS total, count(*) FILTER (uq_score >= 5e-1) AS good, count(*) FILTER (uq_score < 3e-1) AS poor,
           {rnd("avg(uq_score)", 4)} AS avg_uq,
         {rnd("avg(uptime_7d)", 4)} AS avg_uptime FROM fx_station_scores""")),
    "network_breakdown": (
        lambda t: reports.network_breakdown(t.fx_stations),
        oracle("""SELECT coalesce(network, 'unknown') AS network, count(*) AS stations, count(*) FILTER (status IN ('ONLINE','ACTIVE')) AS online
           FROM fx_stations GROUP BY 1""")),
    "hardware_breakdown": (
        lambda t: reports.hardware_breakdown(t.fx_stations),
        oracle(f"""SELECT receiver_type, count(*) AS stations FROM fx_stations WHERE network = '{OVERLAY}' AND coalesce(receiver_type, '') <> ''
           GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")),
    "probe_coverage": (
        lambda t: reports.probe_coverage(t.fx_stations),
        oracle(f"""SELECT count(*) AS total, count(*) FILTER (receiver_type <> '' AND receiver_type NOT LIKE '%INFERRED%') AS probed,
         count(*) FILTER (NOT (receiver_type <> '' AND receiver_type NOT LIKE '%INFERRED%')) AS unprobed, count(*) FILTER ({SURVEY}) AS survey_grade
            FROM fx_stations WHERE network = '{OVERLAY}'""")),
    "table_counts": (
        lambda t: reports.table_counts({"stations": t.fx_stations, "sessions": t.fx_sessions, "status_log": t.fx_status_log, "cells": t.fx_cells}),
        oracle("""SELECT 'stations' AS table_name, count(*) AS rows FROM fx_stations UNION ALL SELECT 'sessions', count(*) FROM fx_sessions
         UNION ALL SELECT 'status_log', count(*) FROM fx_status_log UNION ALL SELECT 'cells', count(*) FROM fx_cells""")),
    "public_summary": (
        lambda t: reports.public_summary(t.fx_sessions, t.fx_stations, t.fx_cells, AS_OF),
        oracle(f"""SELECT *, CASE WHEN integrity_score >= 80 THEN 'operational' WHEN integrity_score >= 60 THEN 'degraded' ELSE 'issues' END AS status
           FROM
         (SELECT count(*) FILTER (status IN ('ONLINE','ACTIVE')) AS stations_online, count(DISTINCT country) AS countries FROM fx_stations),
         (SELECT {rnd("coalesce(avg(fix_rate), 0e0)", 1)} AS mean_fix_24h FROM fx_sessions WHERE login_time >= {H24} AND fix_rate > 0),
         (SELECT {rnd("coalesce(avg(CASE WHEN quality_score > 0 THEN quality_score END), 0e0) * 1e2")} AS integrity_score FROM fx_cells),
         (SELECT unnest(['Europe', 'North America', 'Asia Pacific', 'South America', 'Middle East']) AS region)""")),
    "station_profile": (
        lambda t: reports.station_profile(t.fx_sessions, t.fx_stations, t.fx_station_scores, t.fx_trust, AS_OF, STATION_NAME),
        oracle(f"""SELECT s.name, s.latitude, s.longitude, s.status, s.network, c.uq_score, c.uptime_7d, r.flag, w.*, l.* FROM fx_stations s
         LEFT JOIN fx_station_scores c ON c.station_name = s.name LEFT JOIN fx_trust r ON r.station = s.name,
         (SELECT count(*) AS sessions_7d, count(DISTINCT username) AS users_7d, {rnd("coalesce(avg(fix_rate), 0e0)", 1)} AS avg_fix_7d
            FROM fx_sessions WHERE station = '{STATION_NAME}' AND login_time >= {D7}) w,
         (SELECT coalesce(string_agg(id, ',' ORDER BY id), '') AS latest_ids, count(*) AS sessions_24h FROM (SELECT id FROM fx_sessions
            WHERE station = '{STATION_NAME}' AND login_time >= {H24}
           ORDER BY login_time DESC, id LIMIT 50)) l WHERE s.name = '{STATION_NAME}'""")),
    "caster_ingest_summary": (
        lambda t: reports.caster_ingest_summary(t.fx_caster_log),
        oracle("""SELECT count(*) AS sessions, sum(failover_count) AS failovers, count(DISTINCT username) AS users, count(DISTINCT backend_source) AS
           stations FROM fx_caster_log""")),
    "caster_performance": (
        lambda t: reports.caster_performance(t.fx_caster_log),
        oracle(f"""SELECT station, sessions, {rnd("mean")} AS avg_duration_s, median_duration_s, bytes, failovers, {rnd("st", 2)} AS stability_score,
           {rnd("dr", 2)} AS data_rate_score,
         {rnd("st * 7e-1 + dr * 3e-1", 2)} AS overall_score FROM (SELECT *, least(1e0, mean / 18e2) * (1 - least(1e0, failovers / sessions) * 5e-1) AS
            st,
          least(1e0, bytes / sessions / greatest(1e0, mean) / 5e2) AS dr
             FROM (SELECT backend_source AS station, count(*) AS sessions, avg(duration_s) AS mean,
           list_sort(list(duration_s))[CAST(floor(count(*) / 2) AS int) + 1] AS median_duration_s, sum(bytes_transferred) AS bytes,
              sum(failover_count) AS failovers
           FROM fx_caster_log WHERE coalesce(backend_source, '') <> '' GROUP BY 1))""")),
    "latest_sessions": (
        lambda t: reports.latest_sessions(t.fx_sessions),
        oracle("SELECT id, station, login_time, fix_rate FROM fx_sessions ORDER BY login_time DESC, id LIMIT 2000")),
    "latest_events": (
        lambda t: reports.latest(t.events.select("event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms")), "ts_ms", "event_id", 500),
        """SELECT event_id, event_type, ts_ms FROM (SELECT event_id, event_type, epoch_us(ts) // 1000 AS ts_ms FROM events)
           ORDER BY ts_ms DESC, event_id LIMIT 500"""),
    "latest_alerts": (
        lambda t: reports.latest(anomalies(t), "station", "type", 100),
        oracle("SELECT type, severity, station FROM ano ORDER BY station DESC, type LIMIT 100", ano=ANOMALIES)),
}
