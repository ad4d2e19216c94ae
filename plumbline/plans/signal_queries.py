"""Registered queries of raw signals, models, sources, audit and streams, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import anomaly_id, half_up
from plumbline.operators import ml, observations
from plumbline.sources import tables
from plumbline.streaming import jobs

from .fixtures import AS_OF, Tables, oracle
from .report_queries import status_log
from .sql import D7, H6, H24, NOISE, POSITION, STATION, km, rnd
from .zone_queries import RING, zones_of

A1, A2 = "(l1 * (299792458e0 / 157542e4))", "(l2 * (299792458e0 / 12276e5))"
DF = "(157542e4 - 12276e5)"
HAVE4 = "c1 <> 0 AND c2 <> 0 AND l1 <> 0 AND l2 <> 0"
SLIPS = f"""SELECT file_id, prn, epoch_s, CASE WHEN dm > 2 THEN 'MW' ELSE 'GF' END AS type, CASE WHEN dm > 2 THEN {rnd("dm", 2)}
   ELSE {rnd("dg", 3)} END AS jump FROM (SELECT *, abs(mw - lag(mw) OVER w) AS dm, abs(gf - lag(gf) OVER w) AS dg FROM
 (SELECT file_id, prn, epoch_s, ({A1} * 157542e4 - {A2} * 12276e5) / {DF} / (299792458e0 / {DF}) - (c1 * 157542e4 + c2 * 12276e5) / (157542e4 +
    12276e5) / (299792458e0 / {DF}) AS mw, {A1} - {A2} AS gf FROM fx_obs WHERE {HAVE4})
 WINDOW w AS (PARTITION BY file_id, prn ORDER BY epoch_s)) WHERE dm > 2 OR dg > 15e-2"""
MP = f"""SELECT file_id, sqrt(avg(r * r)) AS mp1,
   {", ".join(f"{rnd(f'coalesce(sqrt(avg(r * r) FILTER ({b})), 0e0)', 3)} AS rms_bin{i}, count(*) FILTER ({b}) AS n_bin{i}" for i, b in enumerate(("snr < 25", "snr >= 25 AND snr < 35", "snr >= 35 AND snr < 45", "snr >= 45")))}
 FROM (SELECT file_id, CASE WHEN s1 <> 0 THEN s1 ELSE 30 END AS snr, c1 - {A1} - avg(c1 - {A1}) OVER w AS r, count(*) OVER w AS k FROM fx_obs
    WHERE c1 <> 0 AND l1 <> 0 WINDOW w AS (PARTITION BY file_id, prn)) WHERE k >= 5 GROUP BY 1"""
MULTIPATH = f"""SELECT file_id, {rnd("mp1", 3)} AS mp1_rms, {rnd("coalesce(mp2, mp1)", 3)} AS mp2_rms, CASE WHEN mp1 < 3e-1 THEN 'excellent'
   WHEN mp1 < 5e-1 THEN 'good' WHEN mp1 < 1 THEN 'acceptable' WHEN mp1 < 2 THEN 'poor' ELSE 'unusable' END AS quality,
 rms_bin0, rms_bin1, rms_bin2, rms_bin3, n_bin0, n_bin1, n_bin2, n_bin3, satellites, epochs, (rms_bin3 > 5e-1 AND (rms_bin0 = 0
    OR rms_bin3 / greatest(rms_bin0, 1e-2) > 5e-1)) AS high_elevation_multipath
FROM (SELECT file_id, count(DISTINCT epoch_s) AS epochs, count(DISTINCT prn) AS satellites FROM fx_obs GROUP BY 1
   HAVING count(DISTINCT epoch_s) >= 10) JOIN mp USING (file_id)
LEFT JOIN (SELECT file_id, sqrt(avg(r * r)) AS mp2 FROM (SELECT file_id, c2 - {A2} - avg(c2 - {A2}) OVER w AS r, count(*) OVER w AS k FROM fx_obs
   WHERE c2 <> 0 AND l2 <> 0 WINDOW w AS (PARTITION BY file_id, prn)) WHERE k >= 5 GROUP BY 1) USING (file_id)"""
TRAIN = f"""SELECT s.*, coalesce(uq_score, 5e-1) AS uq_score, coalesce(uptime_7d, 5e-1) AS uptime_7d, coalesce(avg_fix_rate, 5e1) AS station_avg_fix,
   coalesce(zero_fix_ratio, 1e-1) AS zero_fix_ratio, coalesce(session_count, 10) AS session_count, coalesce(reliability_score, 0e0) AS
   reliability_score,
 coalesce(p.latitude, 0e0) AS s_lat, coalesce(p.longitude, 0e0) AS s_lon, coalesce(p.network, 'unknown') AS network FROM fx_sessions s LEFT
    JOIN fx_station_scores c ON c.station_name = s.station LEFT JOIN fx_stations p ON p.name = s.station
 WHERE s.station IS NOT NULL AND s.station <> '' AND {NOISE} AND s.latitude IS NOT NULL AND abs(s.latitude) > 0.1 AND fix_rate IS NOT NULL"""
F15 = f"""SELECT id, fix_rate AS label, uq_score, uptime_7d AS uptime, station_avg_fix, zero_fix_ratio, {rnd("log10(greatest(1, session_count))", 6)}
   AS session_count_log,
 {rnd(f"least(1e2, CASE WHEN s_lat <> 0 AND s_lon <> 0 THEN {km('latitude', 'longitude', 's_lat', 's_lon')} ELSE 25e0 END)", 4)} AS baseline_km,
    coalesce(composite_score, 5e-1) AS trust, h AS "hour",
 {rnd("sin(h * pi() / 12)", 6)} AS hour_sin, {rnd("cos(h * pi() / 12)", 6)} AS hour_cos, 0e0 AS kp, 0e0 AS dst, 0e0 AS bz, {rnd("abs(latitude)", 6)}
    AS latitude_abs, CASE WHEN network = 'onocoy' THEN 1e0 ELSE 0e0 END AS is_overlay
FROM (SELECT *, CAST(CAST(floor(login_time / 36e5) AS bigint) % 24 AS double) AS h FROM tr) LEFT JOIN fx_trust USING (station)"""
F18 = f"""SELECT id, fix_rate AS label, uq_score, uptime_7d, station_avg_fix, zero_fix_ratio, {rnd("ln(1 + session_count)", 6)} AS session_count_log,
   {rnd(f"least(2e2, {km('latitude', 'longitude', 's_lat', 's_lon')})", 4)} AS baseline_km, h AS "hour",
 {rnd("sin(h * pi() / 12)", 6)} AS hour_sin, {rnd("cos(h * pi() / 12)", 6)} AS hour_cos, {rnd("abs(latitude)", 6)} AS latitude_abs, CASE
    WHEN network = 'onocoy' THEN 1e0 ELSE 0e0 END AS is_overlay, reliability_score, coalesce(avg_age, 0e0) AS correction_age,
 CAST(least(3600, CASE WHEN duration > 0 THEN duration ELSE 300 END) AS double) AS duration, CAST(isodow(d) - 1 AS double) AS day_of_week, m AS
    "month", {rnd("sin(m * pi() / 6)", 6)} AS month_sin, {rnd("cos(m * pi() / 6)", 6)} AS month_cos
FROM (SELECT *, make_timestamp_ms(login_time) AS d, CAST(hour(make_timestamp_ms(login_time)) AS double) AS h,
   CAST(month(make_timestamp_ms(login_time)) AS double) AS m FROM tr)"""


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: half_up(c, d) for c, d in digits.items()})


def trained_rows(t: Tables) -> DataFrame:
    return ml.training_join(t.fx_sessions, t.fx_station_scores, t.fx_stations)


def f15(t: Tables) -> DataFrame:
    return ml.features_15(trained_rows(t), t.fx_trust)


def header_texts(t: Tables) -> DataFrame:
    """``name, value``: the head of an observation file of each station, and a line after it that is no header."""
    line = lambda text, label: F.concat(F.rpad(text, 60, " "), F.lit(label))
    codes = lambda text: line(F.lit(text), "SYS / # / OBS TYPES")
    has = lambda name, text: F.when(F.col("nav_system").contains(name), codes(text))
    three = F.concat_ws("", *(F.lpad(x.cast("decimal(12,3)").cast("string"), 14, " ") for x in (F.col("latitude") * 1e5, F.col("longitude") * 2e4, F.col("height") + 4e6)))
    gps = F.when(F.col("height") % 40 == 0, codes("G    2 C1C L1C")).otherwise(codes("G    6 C1C L1C S1C C2W L2W S2W"))
    head = (line(F.concat(F.rpad(F.lit("17"), 20, " "), F.rpad("receiver_type", 20, " "), F.concat(F.lit("V"), "country")), "REC # / TYPE / VERS"),
            line(F.lit("9"), "ANT # / TYPE"), line(three, "APPROX POSITION XYZ"), gps, has("GLO", "R    3 C1C L1C S1C"), has("GAL", "E    4 C1X L1X C5X L5X"), has("BDS", "C    2 C2I L2I"),
            line(F.lit(""), "END OF HEADER"), codes("J    2 C5Q L5Q"))
    return t.fx_stations.select("name", F.concat_ws("\n", *head).alias("value"))


def header_fields(t: Tables) -> DataFrame:
    joined = {name: F.array_join(name, ",") for name in ("constellations", "frequencies")}
    return observations.observation_headers(header_texts(t)).withColumns(joined).drop("x", "y", "z")


def forest(t: Tables) -> DataFrame:
    """Importances and the errors on the training rows."""
    rows = ml.stored(f15(t))
    return ml.model_report(ml.train_forest(rows), rows)


def boosted(t: Tables) -> DataFrame:
    """Importances and the errors on the held-out fifth."""
    train, test = ml.split(ml.features_18(trained_rows(t)))
    return ml.model_report(ml.train_boosted(train, test), test)


def predictions(t: Tables) -> DataFrame:
    """All rows scored by the model of the training rows; ``held`` marks the fifth that it did not see."""
    rows = ml.stored(f15(t))
    train, _ = ml.split(rows)
    return ml.score_fix_rate(ml.train_forest(train), rows).withColumn("held", F.col("id").isNotNull() & ml.tested())


def query_points(t: Tables) -> DataFrame:
    return t.fx_cells.select(F.col("cell_id").alias("point_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


PL_NEAR = f"""SELECT *, trust * uq * uptime * exp(-dk / 50) AS w, (dk * 1e-3 + 2e-2) / greatest(1e-1, trust) AS s
   FROM (SELECT p.cell_id AS point_id, b.*, {km("p.latitude", "p.longitude", "b.latitude", "b.longitude")} AS dk, row_number() OVER (PARTITION BY
   p.cell_id ORDER BY dk, b.name) AS rk
 FROM fx_cells p, (SELECT name, latitude, longitude, coalesce(uq_score, 5e-1) AS uq, coalesce(uptime_7d, 5e-1) AS uptime, coalesce(avg_fix_rate, 5e1)
    AS fix, coalesce(composite_score, 5e-1) AS trust FROM fx_stations LEFT JOIN fx_station_scores ON station_name = name
  LEFT JOIN fx_trust ON station = name WHERE status IN ('ONLINE', 'ACTIVE')) b WHERE dk <= 100) WHERE rk <= 20"""
PL = f"""SELECT point_id, {rnd("hpl", 3)} AS hpl_m, {rnd("hpl * 15e-1", 3)} AS vpl_m,
   {rnd("CASE WHEN ok THEN greatest(1e-9, exp(least((5e-2 - hpl) / 5e-2, (1e-1 - hpl * 15e-1) / 1e-1) * -10)) ELSE 1e0 END", 6)} AS integrity_risk, ok
   AS available, n AS station_count,
 {rnd("mt", 3)} AS mean_trust, {rnd("CASE WHEN n > 0 THEN ex ELSE 0e0 END", 1)} AS expected_fix_rate, CASE WHEN n >= 5 AND mt >= 7e-1
    AND ex >= 80 THEN 'high' WHEN n >= 3 AND mt >= 5e-1 AND ex >= 60 THEN 'medium' WHEN n >= 1 THEN 'low' ELSE 'insufficient' END AS confidence
FROM (SELECT *, coalesce(hpl < 5e-2 AND hpl * 15e-1 < 1e-1, false) AS ok
   FROM (SELECT c.cell_id AS point_id, coalesce(n, 0) AS n, sg * 533e-2 AS hpl, coalesce(mt, 0e0) AS mt, coalesce(lf, gs, 0e0) AS ex FROM fx_cells c
 LEFT JOIN (SELECT point_id, count(*) FILTER (w >= 1e-2) AS n, sqrt(sum(w * s * s) FILTER (w >= 1e-2) / sum(w) FILTER (w >= 1e-2)) AS sg,
    avg({rnd("trust", 3)}) FILTER (w >= 1e-2) AS mt, avg(fix) FILTER (rk <= 5) AS gs FROM ner GROUP BY 1) a ON a.point_id = c.cell_id
 LEFT JOIN (SELECT c.cell_id AS point_id, avg(fix_rate) AS lf FROM fx_cells c, fx_sessions s WHERE login_time >= {H6} AND fix_rate > 0
    AND s.latitude IS NOT NULL AND abs(s.latitude) > 0.1 AND abs(s.latitude - c.latitude) <= 5e-1 AND abs(s.longitude - c.longitude) <= 5e-1
    GROUP BY 1) l ON l.point_id = c.cell_id))"""
AUDIT = """SELECT event_type, concat('u', CAST(user_id AS varchar)) AS actor, CAST(event_id AS varchar) AS entity_id, value AS v, strftime(ts,
   '%Y-%m-%d %H:%M:%S') AS timestamp FROM events"""


def audit(t: Tables) -> DataFrame:
    return t.events.select("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.col("event_id").cast("string").alias("entity_id"), F.col("value").alias("v"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


def alert_events(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("anomaly", "interference", "environment", "trust_change", "sync")])
    level = F.when(F.col("value") < 20, "critical").when(F.col("value") < 60, "warning").otherwise("info")
    return t.events.select("event_id", F.get(kinds, (F.col("user_id") % 5).cast("int")).alias("type"), level.alias("severity"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))


ALERTS = """SELECT event_id, ['anomaly', 'interference', 'environment', 'trust_change', 'sync'][user_id % 5 + 1] AS type, CASE
   WHEN value < 20 THEN 'critical' WHEN value < 60 THEN 'warning' ELSE 'info' END AS severity, CAST(floor(epoch_us(ts) / 1e3) AS bigint) AS ts_ms
   FROM events"""
ALERT_SEQ = "SELECT *, row_number() OVER (PARTITION BY type, severity ORDER BY ts_ms, event_id) AS i FROM al WHERE severity <> 'info'"
THROTTLED = """SELECT type, severity, event_id, ts_ms FROM (WITH RECURSIVE f(type, severity, i, last, event_id, ts_ms, sent) AS (SELECT type,
   severity, i, ts_ms, event_id, ts_ms, true FROM sq WHERE i = 1
 UNION ALL SELECT s.type, s.severity, s.i, CASE WHEN s.ts_ms - f.last >= 900000 THEN s.ts_ms
    ELSE f.last END, s.event_id, s.ts_ms, s.ts_ms - f.last >= 900000 FROM f JOIN sq s ON s.type = f.type AND s.severity = f.severity
    AND s.i = f.i + 1) SELECT * FROM f)
 WHERE sent AND (type = 'interference' OR (type IN ('anomaly', 'environment', 'trust_change') AND severity = 'critical'))"""
LINES = """SELECT concat('STR;', name, ';id;RTCM;1077;', CAST(length(name) % 6 AS varchar), ';', nav_system, ';net;', country, ';', CAST(latitude AS
   varchar), ';', CAST(longitude AS varchar), ';0;0;', receiver_type) AS value"""


def sourcetable_lines(t: Tables) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    good = F.concat_ws(";", F.lit("STR"), "name", F.lit("id"), F.lit("RTCM"), F.lit("1077"), (F.length("name") % 6).cast("string"), "nav_system", F.lit("net"), "country", s("latitude"), s("longitude"), F.lit("0"), F.lit("0"), "receiver_type")
    bad = F.when(F.col("status") == "OFFLINE", F.concat(F.lit("CAS;"), F.col("name"))).otherwise(good)
    return t.fx_stations.select(bad.alias("value"))


def access_lines(t: Tables) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    csv = F.concat_ws(",", stamp, F.lit("10.0.0.1"), "username", F.coalesce("backend_source", F.lit("")), F.col("duration_s").cast("string"), F.col("bytes_transferred").cast("string"), F.lit("agent"), F.coalesce("backend_source", F.lit("")))
    spaced = F.concat_ws(" ", stamp, F.lit("10.0.0.2"), "username", F.lit("MP1"), F.col("duration_s").cast("string"), F.col("bytes_transferred").cast("string"))
    kind = F.col("duration_s") % 4
    return t.fx_caster_log.select(F.when(kind == 0, csv).when(kind == 1, spaced).when(kind == 2, "# note").otherwise("short,line").alias("value"))


def failover_lines(t: Tables) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    kind = F.col("duration_s") % 3
    text = F.when(kind == 0, F.concat(stamp, F.lit(" switchover ST1 -> ST2"))).when(kind == 1, F.concat(stamp, F.lit(" source ST3 lost, trying next ST3 -> ST4"))).otherwise(F.concat(stamp, F.lit(" ok")))
    return t.fx_caster_log.select(text.alias("value"))


SIGNALS = {
    "slip_events": (lambda t: observations.slip_events(t.fx_obs), oracle(SLIPS)),
    "cycle_slips": (
        lambda t: observations.cycle_slips(t.fx_obs),
        oracle(f"""SELECT file_id, constellation, satellites, slips, {rnd("satellites * hours", 2)} AS satellite_hours, {rnd("rate", 2)} AS
           slip_rate_per_hour,
         CASE WHEN rate < 1e-1 THEN 'excellent' WHEN rate < 1 THEN 'good' WHEN rate < 5 THEN 'acceptable' WHEN rate < 15 THEN 'poor'
            ELSE 'unusable' END AS quality FROM (SELECT *, CASE WHEN satellites * hours > 0 THEN slips / (satellites * hours) ELSE 0e0 END AS rate
            FROM
         (SELECT file_id, left(prn, 1) AS constellation, count(DISTINCT prn) AS satellites FROM fx_obs GROUP BY 1, 2)
            JOIN (SELECT file_id, (max(epoch_s) - min(epoch_s)) / 36e2 AS hours FROM fx_obs GROUP BY 1) USING (file_id)
         LEFT JOIN (SELECT file_id, constellation, n AS slips FROM (SELECT file_id, left(prn, 1) AS constellation, count(*) AS n FROM sl
            GROUP BY 1, 2)) USING (file_id, constellation))""", sl=SLIPS).replace("n AS slips", "coalesce(n, 0) AS slips")),
    "multipath": (lambda t: observations.multipath(t.fx_obs), oracle(MULTIPATH, mp=MP)),
    "observation_summary": (
        lambda t: observations.observation_summary(t.fx_obs),
        oracle(f"""SELECT file_id, max(epoch_s) - min(epoch_s) AS duration_s, count(DISTINCT epoch_s) AS epochs, count(DISTINCT prn) AS satellites,
           'C1,C2,L1,L2,S1' AS bands, {rnd("count(*) / count(DISTINCT epoch_s)", 1)} AS mean_satellites FROM fx_obs GROUP BY 1""")),
    "station_qc_grade": (
        lambda t: t.fx_obs.groupBy("file_id").agg(F.count_distinct("prn").alias("p"), F.avg("s1").alias("s"), F.count("*").alias("n")).select(
            "file_id", observations.station_qc_grade(F.lit(1), F.lit(2), F.col("s"), F.col("s") - 8, F.col("p") / 7).alias("grade")),
        oracle("""SELECT file_id, CASE WHEN g >= 11 THEN 'A' WHEN g >= 8 THEN 'B' WHEN g >= 5 THEN 'C' WHEN g >= 3 THEN 'D' ELSE 'F' END AS grade
           FROM (SELECT file_id, 3 + CASE WHEN s >= 35 THEN 2 WHEN s >= 25 THEN 1 ELSE 0 END + CASE WHEN s - 8 >= 30 THEN 2 WHEN s - 8 >= 20 THEN 1
           ELSE 0 END
         + CASE WHEN p / 7 >= 95e-2 THEN 2 WHEN p / 7 >= 8e-1 THEN 1 ELSE 0 END AS g FROM (SELECT file_id, count(DISTINCT prn) AS p, avg(s1) AS s
            FROM fx_obs GROUP BY 1))""")),
    "measured_position": (
        lambda t: observations.measured_position(t.fx_stations.select("name", (F.col("latitude") * 1e5).alias("x"), (F.col("longitude") * 2e4).alias("y"), (F.col("height") + 4e6).alias("z"))).select("name", "latitude", "longitude", "height"),
        oracle(f"""SELECT name, {rnd("degrees(la)", 6)} AS latitude, {rnd("degrees(atan2(y, x))", 6)} AS longitude,
           {rnd("p / cos(la) - 6378137e0 / sqrt(1 - 669437999014e-14 * sin(la) * sin(la))", 2)} AS height FROM (SELECT *, sqrt(x * x + y * y) AS p,
         atan2(z, sqrt(x * x + y * y) * (1 - 669437999014e-14)) AS la FROM (SELECT name, latitude * 1e5 AS x, longitude * 2e4 AS y, height + 4e6 AS z
            FROM fx_stations))""")),
    "observation_headers": (header_fields, oracle(f"""SELECT name, CASE WHEN receiver_type = '' THEN 'unknown' ELSE substr(receiver_type, 1, 20) END AS receiver_type,
           'V' || country AS firmware_version, 'unknown' AS antenna_type,
           concat_ws(',', 'GPS', CASE WHEN nav_system LIKE '%GLO%' THEN 'GLONASS' END, CASE WHEN nav_system LIKE '%GAL%' THEN 'Galileo' END,
             CASE WHEN nav_system LIKE '%BDS%' THEN 'BeiDou' END) AS constellations,
           concat_ws(',', 'L1', CASE WHEN height % 40 <> 0 THEN 'L2' END, CASE WHEN nav_system LIKE '%GAL%' THEN 'L5' END,
             CASE WHEN height % 40 = 0 AND nav_system LIKE '%BDS%' THEN 'L2' END) AS frequencies,
           {rnd("degrees(la)", 6)} AS latitude, {rnd("degrees(atan2(y, x))", 6)} AS longitude, {rnd("p / cos(la) - 6378137e0", 1)} AS height
         FROM (SELECT *, sqrt(x * x + y * y) AS p, atan2(z, sqrt(x * x + y * y) * (1 - 669437999e-11)) AS la
            FROM (SELECT * EXCLUDE (latitude, longitude), round(latitude * 1e5, 3) AS x, round(longitude * 2e4, 3) AS y, height + 4e6 AS z FROM fx_stations))""")),
    "features_15": (lambda t: rounded(f15(t), session_count_log=6, baseline_km=4, hour_sin=6, hour_cos=6, latitude_abs=6), oracle(F15, tr=TRAIN)),
    "features_18": (lambda t: rounded(ml.features_18(trained_rows(t)), session_count_log=6, baseline_km=4, hour_sin=6, hour_cos=6, latitude_abs=6, month_sin=6, month_cos=6), oracle(F18, tr=TRAIN)),
    "train_forest": (forest, None),
    "train_boosted": (boosted, None),
    "score_fix_rate": (predictions, None),
    "sample_priorities": (lambda t: ml.sample_priorities(t.fx_trust), None),
    "protection_levels": (lambda t: ml.protection_levels(query_points(t), t.fx_stations, t.fx_station_scores, t.fx_trust, t.fx_sessions, AS_OF), oracle(PL, ner=PL_NEAR)),
    "nearest_k": (
        lambda t: ml.nearest_k(query_points(t), t.fx_stations.select("name", F.col("latitude").alias("r_latitude"), F.col("longitude").alias("r_longitude")), "point_id", "name", 3, 100.0).select("point_id", "name", "rank"),
        oracle(f"""SELECT point_id, name, rank FROM (SELECT c.cell_id AS point_id, s.name,
           {km("c.latitude", "c.longitude", "s.latitude", "s.longitude")} AS dk, row_number() OVER (PARTITION BY c.cell_id
           ORDER BY dk, s.name) AS rank FROM fx_cells c, fx_stations s WHERE dk <= 100) WHERE rank <= 3""")),
    "best_station": (
        lambda t: ml.best_station(ml.nearest_k(query_points(t), t.fx_stations.select("name", F.col("latitude").alias("r_latitude"), F.col("longitude").alias("r_longitude")), "point_id", "name", 10, 100.0)
                                  .join(t.fx_station_scores.select(F.col("station_name").alias("name"), F.col("avg_fix_rate").alias("predicted")), "name")),
        oracle(f"""SELECT point_id, name AS station, predicted
           FROM (SELECT point_id, name, avg_fix_rate AS predicted, row_number() OVER (PARTITION BY point_id ORDER BY avg_fix_rate DESC, dk, name) AS k
           FROM (SELECT c.cell_id AS point_id, s.name,
         {km("c.latitude", "c.longitude", "s.latitude", "s.longitude")} AS dk, row_number() OVER (PARTITION BY c.cell_id ORDER BY dk, s.name) AS rank
            FROM fx_cells c, fx_stations s WHERE dk <= 100) JOIN fx_station_scores ON station_name = name WHERE rank <= 10) WHERE k = 1""")),
    "ingest_sessions": (
        lambda t: tables.ingest_sessions(t.fx_sessions_raw, order=("login_time", "station")).select("id", "station", "login_time"),
        oracle("""SELECT id, arg_min(station, struct_pack(l := login_time, s := station)) AS station, min(login_time) AS login_time
           FROM (SELECT id, coalesce(station, '') AS station, login_time FROM fx_sessions_raw) GROUP BY 1""")),
    "incremental_load": (
        lambda t: tables.incremental_load(t.fx_sessions, t.fx_sessions.filter(F.col("login_time") < H24), 1, ("login_time", "station"))[0].select("id", "login_time"),
        oracle(f"SELECT id, login_time FROM fx_sessions WHERE login_time >= {H24}")),
    "upsert_stations": (
        lambda t: tables.upsert_stations(t.fx_stations.withColumn("last_synced", F.lit(1)), t.fx_stations.filter("height > 300").select("name", F.lit("OFFLINE").alias("status"), F.lit("x").alias("network"), F.lit(2).alias("last_synced")), ("network",)).select("name", "status", "network", "last_synced"),
        oracle("""SELECT name, CASE WHEN height > 300 THEN 'OFFLINE' ELSE status END AS status, CASE WHEN height > 300 THEN coalesce(network, 'x')
           ELSE network END AS network, CASE WHEN height > 300 THEN 2 ELSE 1 END AS last_synced FROM fx_stations""")),
    "parse_sourcetable": (
        lambda t: tables.parse_sourcetable(sourcetable_lines(t)),
        oracle("""SELECT name, '1077' AS format_details, length(name) % 6 AS carrier, nav_system, country, latitude, longitude, receiver_type AS
           generator FROM fx_stations WHERE status <> 'OFFLINE'""")),
    "parse_access_log": (
        lambda t: tables.parse_access_log(access_lines(t)).select("timestamp", "client_ip", "username", "mountpoint", "duration_s", "bytes_transferred", "backend_source"),
        oracle("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CASE duration_s % 4 WHEN 0 THEN '10.0.0.1'
           ELSE '10.0.0.2' END AS client_ip, username, CASE duration_s % 4 WHEN 0 THEN coalesce(backend_source, '') ELSE 'MP1' END AS mountpoint,
         CAST(duration_s AS double) AS duration_s, bytes_transferred, CASE WHEN duration_s % 4 = 0 THEN backend_source END AS backend_source
            FROM fx_caster_log WHERE duration_s % 4 < 2""")),
    "parse_failover_log": (
        lambda t: tables.parse_failover_log(failover_lines(t)),
        oracle("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, f AS from_source, o AS to_source, r AS reason FROM fx_caster_log
           JOIN (VALUES (0, 'ST1', 'ST2', 'switchover'), (1, 'ST3', 'ST4', 'source_lost'), (1, 'ST3', '', 'source_disconnect')) v(k, f, o, r)
           ON duration_s % 3 = k""")),
    "read_env_history": (
        lambda t: tables.read_env_history(t.fx_env_history.select(F.unix_millis(F.col("hour_ts").cast("timestamp")).alias("ts"), "kp", "bz")),
        oracle("SELECT epoch_ms(hour_ts) AS ts, kp, bz FROM fx_env_history ORDER BY hour_ts DESC LIMIT 336")),
    "latest_and_next": (
        lambda t: tables.latest_and_next(t.fx_env_history.select(F.unix_millis(F.col("hour_ts").cast("timestamp")).alias("ts"), F.col("bz").alias("value")), AS_OF - 36_000_000, 0.0),
        oracle(f"""SELECT coalesce(arg_max(bz, hour_ts) FILTER (epoch_ms(hour_ts) <= {AS_OF - 36_000_000}), 0e0) AS latest, coalesce(arg_min(bz,
           hour_ts) FILTER (epoch_ms(hour_ts) > {AS_OF - 36_000_000}), arg_max(bz, hour_ts) FILTER (epoch_ms(hour_ts) <= {AS_OF - 36_000_000}), 0e0)
           AS next FROM fx_env_history""")),
    "write_zone_table": (
        lambda t: tables.zone_table(t.fx_zones.select("zone_id", F.lit(1).alias("version"), F.lit(0).alias("manual_override")), t.fx_zones.select("zone_id", F.lit(0).alias("version"), (F.col("priority") % 3 == 0).cast("int").alias("manual_override"))),
        oracle("""SELECT zone_id, CASE WHEN priority % 3 = 0 THEN 0 ELSE 1 END AS version, CASE WHEN priority % 3 = 0 THEN 1
           ELSE 0 END AS manual_override FROM fx_zones""")),
    "export_geojson": (
        lambda t: tables.export_geojson(zones_of(t)).select("zone_id", F.get_json_object("feature", "$.geometry.type").alias("kind"), F.get_json_object("feature", "$.properties.zone_id").alias("prop"),
                                                            F.coalesce(F.size(F.from_json(F.get_json_object("feature", "$.geometry.coordinates[0]"), "array<array<double>>")), F.lit(-1)).alias("ring_size")),
        oracle(f"""SELECT zone_id, CASE fence_type WHEN 'circle' THEN 'Point' ELSE 'Polygon' END AS kind, zone_id AS prop, CASE fence_type
           WHEN 'circle' THEN -1 ELSE {len(RING) + 1} END AS ring_size FROM fx_zones""")),
    "query_audit": (
        lambda t: tables.query_audit(audit(t), since="2024-01-10 00:00:00", limit=100, event_type="error"),
        oracle("""SELECT * FROM au WHERE event_type = 'error' AND timestamp >= '2024-01-10 00:00:00'
           ORDER BY timestamp DESC, entity_id LIMIT 100""", au=AUDIT)),
    "audit_trail": (
        lambda t: tables.query_audit(audit(t).select("event_type", "entity_id", "timestamp").unionByName(t.fx_trust.filter("flag = 'excluded'").select(F.lit("exclusion").alias("event_type"), F.col("station").alias("entity_id"), F.lit("2024-01-30 12:00:00").alias("timestamp"))), since="2024-01-29 00:00:00", limit=200),
        oracle("""SELECT * FROM (SELECT event_type, entity_id, timestamp FROM au UNION ALL SELECT 'exclusion', station, '2024-01-30 12:00:00'
           FROM fx_trust WHERE flag = 'excluded') WHERE timestamp >= '2024-01-29 00:00:00' ORDER BY timestamp DESC, entity_id LIMIT 200""", au=AUDIT)),
    "snapshot_status": (
        lambda t: tables.snapshot_status(t.fx_stations, status_log(t).select("station_name", "status", "recorded_at"), AS_OF).groupBy("station_name").agg(F.count("*").alias("entries"), F.max("recorded_at").alias("newest")),
        oracle(f"""SELECT station_name, count(*) AS entries, max(r) AS newest FROM (SELECT station_name, epoch_ms(recorded_ts) AS r FROM fx_status_log
           UNION ALL SELECT name, {AS_OF} FROM fx_stations) WHERE r >= {AS_OF - 14 * 86_400_000} GROUP BY 1""")),
    "apply_retention": (
        lambda t: tables.apply_retention(status_log(t), "status_log", AS_OF, "recorded_at")[1],
        oracle(f"""SELECT count(*) FILTER (epoch_ms(recorded_ts) >= {AS_OF - 14 * 86_400_000}) AS kept, count(*) FILTER (epoch_ms(recorded_ts) <
           {AS_OF - 14 * 86_400_000}) AS deleted, 'status_log' AS table_name FROM fx_status_log""")),
    "pseudonymize": (
        lambda t: tables.pseudonymize(t.fx_sessions.select("id", "station")),
        oracle("""SELECT id, n.code AS station FROM fx_sessions s LEFT
           JOIN (SELECT station, printf('STN-%04d', row_number() OVER (ORDER BY min(id), station)) AS code FROM fx_sessions WHERE station IS NOT NULL
           GROUP BY 1) n ON n.station = s.station""")),
    "anomaly_id": (
        lambda t: t.fx_station_scores.select("station_name", anomaly_id(F.lit("age_spike"), F.col("station_name"), AS_OF).alias("id")),
        oracle(f"SELECT station_name, concat('anom_', md5(concat('age_spike_', station_name, '_{AS_OF // 300_000}'))) AS id FROM fx_station_scores")),
    "window_stats": (
        lambda t: rounded(jobs.window_stats(t.fx_sessions.filter(F.col("login_time") >= D7), "30 minutes"), mean_fix=3, mean_age=3).fillna(-1.0, ["mean_age"]),
        oracle(f"""SELECT CAST(floor(login_time / 18e5) AS bigint) * 1800000 AS start_ms, station, count(*) AS sessions, {rnd("avg(fix_rate)", 3)} AS
           mean_fix, coalesce({rnd("avg(CASE WHEN avg_age > 0 THEN avg_age END)", 3)}, -1e0) AS mean_age
         FROM fx_sessions WHERE {STATION} AND {NOISE} AND login_time >= {D7} GROUP BY 1, 2""")),
    "micro_window_stats": (
        lambda t: rounded(jobs.window_stats(t.fx_sessions.filter(F.col("login_time") >= D7)), mean_fix=3, mean_age=3).fillna(-1.0, ["mean_age"]),
        oracle(f"""
SELECT CAST(floor(login_time / 3e5) AS bigint) * 300000 AS start_ms, station, count(*) AS sessions, {rnd("avg(fix_rate)", 3)} AS mean_fix,
       coalesce({rnd("avg(CASE WHEN avg_age > 0 THEN avg_age END)", 3)}, -1e0) AS mean_age
FROM fx_sessions WHERE {STATION} AND {NOISE} AND login_time >= {D7} GROUP BY 1, 2""")),
    "sliding_window_stats": (
        lambda t: rounded(jobs.window_stats(t.fx_sessions.filter(F.col("login_time") >= H24), "6 hours", "5 minutes"), mean_fix=3, mean_age=3).fillna(-1.0, ["mean_age"]),
        oracle(f"""
SELECT (CAST(floor(login_time / 3e5) AS bigint) - k) * 300000 AS start_ms, station, count(*) AS sessions, {rnd("avg(fix_rate)", 3)} AS mean_fix,
       coalesce({rnd("avg(CASE WHEN avg_age > 0 THEN avg_age END)", 3)}, -1e0) AS mean_age
FROM fx_sessions, range(72) v(k) WHERE {STATION} AND {NOISE} AND login_time >= {H24} GROUP BY 1, 2""")),
    "throttled_alerts": (lambda t: jobs.throttled_alerts(alert_events(t)), oracle(THROTTLED, al=ALERTS, sq=ALERT_SEQ)),
    "recent_history": (
        lambda t: jobs.recent_history(alert_events(t).select(F.concat_ws(":", "type", "severity").alias("key"), "ts_ms"), AS_OF),
        oracle(f"""SELECT key, count(*) FILTER (ts_ms > {D7}) AS recent, count(*) AS held
           FROM (SELECT concat(type, ':', severity) AS key, ts_ms, row_number() OVER (PARTITION BY type, severity ORDER BY ts_ms DESC) AS k FROM al)
           WHERE k <= 50 GROUP BY 1""", al=ALERTS)),
}
