"""Registered queries of job summaries and of the parts of the station page, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import observations, reports, summaries, zones
from plumbline.operators import detectors as d

from .action_queries import ALL_ACTIONS, ANOMALIES, KEPT, ZONE_AT, action_rows
from .area_queries import GAP_REGIONS, GAP_ROWS, pass_over
from .detector_queries import ALERT_ROWS, ALERT_STATS, BAD, SHIELD
from .fixtures import AS_OF, Tables, oracle
from .report_queries import STATION_NAME
from .sql import D7, H24, rnd
from .zone_queries import GAPS, GATES, NEAREST, VALIDATION, gates, validation

#: A station with sessions, alerts and suspicions.
PAGE = STATION_NAME


def qualified(t: Tables) -> DataFrame:
    """The map of networks as text."""
    entries = F.transform(F.map_entries("networks"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return summaries.qualified_summary(gates(t)).withColumn("networks", F.array_join(entries, ","))


def gaps(t: Tables) -> DataFrame:
    found = zones.gap_candidates(t.fx_stations, t.fx_station_scores, t.fx_trust, validation(t))
    return summaries.gap_summary(found, zones.gap_regions(found))


def probes(t: Tables) -> DataFrame:
    """Probe results from the status log: whether a station answered, for what it was asked, and how fast."""
    return t.fx_status_log.select((F.col("status") == "ONLINE").alias("success"), F.when(F.col("event_id") % 3 == 0, "gap_fill").otherwise("quality_compare").alias("probe_type"),
                                  (F.col("event_id") % 250).alias("latency_ms"))


def grades(t: Tables) -> DataFrame:
    rows = t.fx_obs.groupBy("file_id").agg(F.avg("s1").alias("s"), F.count_distinct("prn").alias("p"))
    return rows.select(observations.station_qc_grade(F.col("file_id") % 4, F.col("file_id") % 3, F.col("s") - F.col("file_id"), F.col("s") - 8, F.col("p") / 7).alias("grade"))


def log_ms(t: Tables) -> DataFrame:
    return t.fx_status_log.select("station_name", "status", F.unix_millis(F.col("recorded_ts").cast("timestamp")).alias("recorded_at"))


COUNTS = ", ".join(f"count(*) FILTER (classification = '{cause}') AS {cause}" for cause in summaries.CAUSES)
BY_FLAG = ", ".join(f'count(*) FILTER (flag = \'{f}\') AS "{f}"' for f in summaries.FLAGS)
BY_ACTION = ", ".join(f"count(*) FILTER (action = '{kind}') AS {name}" for name, kind in summaries.ACTIONS.items())
BY_TIER = ", ".join(f"count(*) FILTER (NOT disqualified AND quality_tier = '{x}') AS {x}" for x in summaries.TIERS)
BY_GRADE = ", ".join(f"count(*) FILTER (g = '{x}') AS grade_{x.lower()}" for x in summaries.GRADES)
STEPS = "CASE WHEN {0} >= {1} THEN 2 WHEN {0} >= {2} THEN 1 ELSE 0 END"
GRADE = f"""
SELECT CASE WHEN p >= 11 THEN 'A' WHEN p >= 8 THEN 'B' WHEN p >= 5 THEN 'C' WHEN p >= 3 THEN 'D' ELSE 'F' END AS g FROM (
  SELECT least(4, file_id % 4) + CASE WHEN file_id % 3 >= 2 THEN 2 ELSE 0 END + {STEPS.format("s - file_id", 35, 25)} + {STEPS.format("s - 8", 30, 20)}
         + {STEPS.format("q / 7", "95e-2", "8e-1")} AS p
  FROM (SELECT file_id, avg(s1) AS s, count(DISTINCT prn) AS q FROM fx_obs GROUP BY 1))"""
GAMING = """
SELECT 'suspicion' AS source, 'score' AS kind, {0} AS confidence, 'investigate' AS action FROM j
WHERE uq_score > 7e-1 AND avg_fix_rate < 40 AND session_count >= 10 AND uq_score <> 0 AND avg_fix_rate <> 0
UNION ALL SELECT 'suspicion', 'zero_fix', {1}, CASE WHEN zero_fix_ratio > 8e-1 THEN 'exclude' ELSE 'downgrade' END FROM j
WHERE zero_fix_ratio > 5e-1 AND status = 'ONLINE' AND session_count >= 5 AND uq_score <> 0 AND avg_fix_rate <> 0""".format(
    rnd("least(3e-1, (7e-1 - avg_fix_rate / 1e2) * 5e-1) + 6e-1", 3), rnd("zero_fix_ratio * 3e-1 + 5e-1", 3))

SUMMARIES = {
    "trust_summary": (
        lambda t: summaries.trust_summary(t.fx_trust),
        oracle(f"SELECT count(*) AS total, {BY_FLAG}, {rnd('coalesce(avg(composite_score), 0e0)', 3)} AS avg_trust FROM fx_trust")),
    "interference_summary": (
        lambda t: summaries.interference_summary(d.classify_interference(t.fx_sessions, t.fx_stations, t.fx_trust, AS_OF)),
        oracle(f"SELECT {COUNTS} FROM sh", bad=BAD, sh=SHIELD)),
    "action_summary": (
        lambda t: summaries.action_summary(action_rows(t)),
        oracle(f"SELECT count(*) AS total_actions, {BY_ACTION} FROM ka", za=ZONE_AT, ano=ANOMALIES, aa=ALL_ACTIONS, ka=KEPT)),
    "qualified_summary": (
        qualified,
        oracle(f"""SELECT count(*) AS total_evaluated, count(*) FILTER (NOT disqualified) AS qualified_count, count(*) FILTER (disqualified) AS disqualified_count,
         {BY_TIER}, {rnd("coalesce(avg(composite_score) FILTER (NOT disqualified), 0e0)", 3)} AS avg_composite,
         (SELECT string_agg(concat(network, '=', n), ',' ORDER BY network) FROM (SELECT network, count(*) AS n FROM gt WHERE NOT disqualified GROUP BY 1)) AS networks
         FROM gt""", st=ALERT_STATS, al=ALERT_ROWS, gt=GATES)),
    "gap_summary": (
        gaps,
        oracle("""SELECT (SELECT count(*) FROM rg) AS total_gaps, (SELECT count(*) FROM rg WHERE fillable) AS gaps_fillable,
         count(*) FILTER (hardware_class = 'survey_grade') AS survey_grade, count(*) FILTER (hardware_class = 'consumer') AS consumer,
         count(*) FILTER (enabled) AS zones_created FROM gp""",
               nea=NEAREST, val=VALIDATION, gp=GAPS, gr=GAP_ROWS, ps=pass_over("gr", "id", 30), rg=GAP_REGIONS)),
    "probe_summary": (
        lambda t: summaries.probe_summary(probes(t)),
        oracle(f"""SELECT count(*) AS total_probed, count(*) FILTER (status = 'ONLINE') AS successful, count(*) FILTER (status <> 'ONLINE') AS failed,
         count(*) FILTER (event_id % 3 = 0) AS gap_fills, count(*) FILTER (event_id % 3 <> 0) AS quality_compares,
         {rnd("coalesce(avg(event_id % 250) FILTER (status = 'ONLINE'), 0e0)")} AS avg_latency_ms FROM fx_status_log""")),
    "grade_summary": (lambda t: summaries.grade_summary(grades(t)), oracle(f"SELECT count(*) AS total_downloaded, {BY_GRADE} FROM gr", gr=GRADE)),
    "station_sessions": (
        lambda t: reports.station_sessions(t.fx_sessions, AS_OF, PAGE),
        oracle(f"""SELECT id, fix_rate, avg_age AS correction_age, duration AS duration_s, concat(left(username, 3), '***') AS user, login_time AS time_ms
         FROM fx_sessions WHERE station = '{PAGE}' AND login_time >= {H24} ORDER BY login_time DESC, id LIMIT 50""")),
    "station_week": (
        lambda t: reports.station_week(t.fx_sessions, AS_OF, PAGE),
        oracle(f"""SELECT count(*) AS sessions, count(DISTINCT username) AS users, {rnd("coalesce(avg(fix_rate), 0e0)", 1)} AS avg_fix,
         {rnd("coalesce(avg(duration), 0e0) / 60")} AS avg_duration_min, {rnd("coalesce(avg(avg_age), 0e0)", 2)} AS avg_age
         FROM fx_sessions WHERE station = '{PAGE}' AND login_time >= {D7}""")),
    "station_status_history": (
        lambda t: reports.station_status_history(log_ms(t), AS_OF, PAGE, 14),
        oracle(f"""SELECT CAST(floor(floor(epoch_us(recorded_ts) / 1e3) / 36e5) AS bigint) * 3600000 AS hour_ms, status, count(*) AS entries FROM fx_status_log
         WHERE station_name = '{PAGE}' AND floor(epoch_us(recorded_ts) / 1e3) >= {AS_OF - 14 * 86_400_000} GROUP BY 1, 2""")),
    "station_alerts": (
        lambda t: reports.station_alerts(d.predictive_alerts(t.fx_sessions, AS_OF, recent_h=2, limit=None), d.quality_gaming(t.fx_stations, t.fx_station_scores), PAGE),
        oracle(f"SELECT 'prediction' AS source, indicator AS kind, confidence, action FROM al WHERE station = '{PAGE}' UNION ALL {GAMING}",
               st=ALERT_STATS, al=ALERT_ROWS, j=f"SELECT * FROM fx_stations JOIN fx_station_scores ON station_name = name WHERE name = '{PAGE}'")),
}
