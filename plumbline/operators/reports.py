"""Usage, quality and service-level reports. Every job is one or two aggregates; tables of one row are cross joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.geo import haversine_km, region_by_box, region_by_circle
from plumbline.functions.graph import checkpointed
from plumbline.functions.rules import (DAY, HOUR, OVERLAY, between, clean_sessions, half_up, has_position, has_station, nonzero_position, not_noise, online,
                                       positive, share_of)



def n(alias: str) -> Column:
    return F.count("*").alias(alias)


def mean(col: str | Column, digits: int = 1) -> Column:
    """Rounded mean; no rows give 0."""
    return half_up(F.coalesce(F.avg(col), F.lit(0.0)), digits)


def spatial_coherence(sessions: DataFrame, first: int = 200) -> DataFrame:
    """Per region: agreement of the fix rates of neighbours in latitude order that stand under 100 km apart,
    0 to 100, over the first sessions of that order; 75 if there are no such neighbours. ``sessions`` has ``region``."""
    order = W.partitionBy("region").orderBy("latitude", "id")
    fix = F.coalesce("fix_rate", F.lit(0.0))
    # The rank alone comes first: Spark then cuts each task's rows to the limit before the shuffle.
    few = sessions.select("region", "id", "latitude", "longitude", fix.alias("fix")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    rows = few.withColumns({"p_lat": F.lag("latitude").over(order), "p_lon": F.lag("longitude").over(order), "p_fix": F.lag("fix").over(order)})
    close = haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("latitude"), F.col("longitude")) < 100
    agree = F.when(close, F.greatest(F.lit(0.0), 1 - F.abs(F.col("fix") - F.col("p_fix")) / 50))
    return rows.groupBy("region").agg(F.coalesce(F.avg(agree) * 100, F.lit(75.0)).alias("coherence"))


def region_integrity_scores(sessions: DataFrame, scores: DataFrame, as_of: int) -> DataFrame:
    """Per named region over six hours: 0.40 stability + 0.25 freshness + 0.20 availability + 0.15 coherence,
    the trend against the 18 hours before, and the session-weighted mean of all regions as ``global_score``."""
    # Written once: three aggregates read it, and finding a region takes ten distances a row.
    recent = checkpointed(clean_sessions(sessions).filter(between(as_of - 6 * HOUR) & nonzero_position())
                          .select("id", "station", "latitude", "longitude", "fix_rate", "avg_age", region_by_circle(F.col("latitude"), F.col("longitude")).alias("region"))
                          .filter("region <> 'Other'"))
    before = (sessions.filter(between(as_of - 24 * HOUR, as_of - 6 * HOUR) & has_position() & has_station())
              .groupBy(region_by_circle(F.col("latitude"), F.col("longitude")).alias("region"))
              .agg(F.avg(F.coalesce("fix_rate", F.lit(0.0))).alias("before"), n("n_before")))
    fix = F.coalesce("fix_rate", F.lit(0.0))
    uptime = (recent.select("region", "station").distinct().join(scores, F.col("station") == F.col("station_name"), "left")
              .groupBy("region").agg(n("stations"), (F.avg(F.coalesce("uptime_7d", F.lit(0.5))) * 100).alias("availability")))
    stats = recent.groupBy("region").agg(
        n("sessions_6h"), F.avg(fix).alias("mean_fix"), (F.greatest(F.lit(0.0), 1 - F.stddev_pop(fix) / 50) * 100).alias("stability"),
        F.coalesce(F.greatest(F.lit(0.0), 1 - F.avg(positive("avg_age")) / 10) * 100, F.lit(50.0)).alias("freshness"))
    joined = stats.join(uptime, "region").join(spatial_coherence(recent), "region").join(before, "region", "left")
    score = half_up(F.col("stability") * 0.4 + F.col("freshness") * 0.25 + F.col("availability") * 0.2 + F.col("coherence") * 0.15)
    enough = F.col("n_before") > 10
    trend = (F.when(enough & (F.col("mean_fix") > F.col("before") * 1.05), "improving")
             .when(enough & (F.col("mean_fix") < F.col("before") * 0.95), "declining").otherwise("stable"))
    rows = joined.select("region", F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)).alias("score"), trend.alias("trend"), "stations", "sessions_6h")
    total = rows.agg(half_up(F.sum(F.col("score") * F.col("sessions_6h")) / F.sum("sessions_6h")).alias("global_score"))
    return rows.crossJoin(F.broadcast(total))


def integrity_stats(sessions: DataFrame, stations: DataFrame, anomalies: DataFrame, as_of: int) -> DataFrame:
    recent = between(as_of - 6 * HOUR)
    one = sessions.filter(recent).agg(
        half_up(F.coalesce(F.avg(F.when(has_station() & not_noise(), F.coalesce("fix_rate", F.lit(0.0)))), F.lit(0.0)), 1).alias("mean_fix_rate"),
        F.count_if(F.col("duration") == -1).alias("active_sessions"))
    return one.crossJoin(stations.agg(n("stations_monitored"))).crossJoin(anomalies.agg(n("anomalies_24h")))


def grid_session_stats(sessions: DataFrame, as_of: int, days: int = 14) -> DataFrame:
    """Sessions of each 0.1 degree cell: the pre-aggregate of the coverage jobs."""
    cell = lambda c: half_up(c, 1)
    length = F.greatest(F.lit(0), F.coalesce("duration", F.lit(0)))
    return (sessions.filter(between(as_of - days * DAY) & has_position() & (F.abs("longitude") > 0.1)).groupBy(cell("latitude").alias("lat"), cell("longitude").alias("lon")).agg(
        n("sessions"), F.count_distinct("username").alias("users"), half_up(F.sum(F.coalesce("fix_rate", F.lit(0.0)) * length), 1).alias("fix_seconds"),
        F.sum(length).alias("seconds"), mean(positive("avg_age"), 2).alias("mean_age")))


def network_health(sessions: DataFrame, scores: DataFrame, cells: DataFrame, history: DataFrame, as_of: int) -> DataFrame:
    """One row: 0.40 quality + 0.25 uptime + 0.20 coverage + 0.15 freshness, grade, and trend against the score
    nearest to an hour ago. ``history`` has ``timestamp, score``."""
    quality = sessions.filter(between(as_of - DAY) & (F.col("fix_rate") > 0) & F.col("station").isNotNull()).agg(
        F.least(F.lit(100.0), F.coalesce(F.avg("fix_rate"), F.lit(0.0))).alias("quality"))
    station = scores.agg(F.least(F.lit(100.0), F.coalesce(F.avg("uptime_7d"), F.lit(0.0)) * 100).alias("reliability"),
                         (F.coalesce(F.avg(positive("median_correction_age")), F.lit(5.0))).alias("age"))
    cover = cells.agg((F.coalesce(F.avg((F.col("zone_tier") == "full_rtk").cast("double")), F.lit(0.0)) * 100).alias("green"))
    near = lambda ms, slack: F.min_by(F.when(F.abs(F.col("timestamp") - (as_of - ms)) < slack, F.col("score")), F.when(
        F.abs(F.col("timestamp") - (as_of - ms)) < slack, F.col("timestamp")))
    past = history.agg(near(HOUR, HOUR // 2).alias("score_1h_ago"), near(DAY, HOUR).alias("score_24h_ago"))
    row = quality.crossJoin(station).crossJoin(cover).crossJoin(past)
    row = row.withColumns({"coverage": F.least(F.lit(100.0), F.col("green") * 1.5), "freshness": F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - F.col("age") / 10) * 100))})
    score = half_up(F.col("quality") * 0.4 + F.col("reliability") * 0.25 + F.col("coverage") * 0.2 + F.col("freshness") * 0.15)
    row = row.withColumn("score", score)
    grade = (F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 80, "good").when(F.col("score") >= 70, "acceptable")
             .when(F.col("score") >= 60, "degraded").otherwise("critical"))
    trend = F.when(F.col("score") > F.col("score_1h_ago") + 2, "improving").when(F.col("score") < F.col("score_1h_ago") - 2, "declining").otherwise("stable")
    return row.select("score", grade.alias("grade"), *[half_up(c).alias(c) for c in ("quality", "reliability", "coverage", "freshness")],
                      "score_1h_ago", "score_24h_ago", trend.alias("trend"))


def daily_report(sessions: DataFrame, trust: DataFrame, stations: DataFrame, anomalies: DataFrame, health: DataFrame, as_of: int) -> DataFrame:
    """One row for the last 24 hours with counts and the lines worth reading, joined by ``; ``."""
    day = sessions.filter(between(as_of - DAY) & (F.col("fix_rate") > 0)).agg(
        n("sessions_24h"), mean("fix_rate").alias("avg_fix"), F.count_distinct("username").alias("unique_users"), F.count_distinct("station").alias("unique_stations"))
    flags = trust.agg(*[F.count_if(F.col("flag") == f).alias(f) for f in ("trusted", "probation", "untrusted", "excluded", "new")])
    hardware = stations.filter(F.col("network") == OVERLAY).agg(
        F.count_if(F.col("receiver_type").rlike("LEICA|TRIMBLE|SEPT|NOVATEL|CHC|TOPCON|SURVEY_GRADE_PROBED")).alias("survey_grade"))
    bad = anomalies.agg(n("anomalies"), F.count_if(F.col("severity") == "critical").alias("critical"))
    row = day.crossJoin(flags).crossJoin(hardware).crossJoin(bad).crossJoin(health.select(F.col("score").alias("health_score"), "grade"))
    lines = F.array_compact(F.array(
        F.concat(F.lit("Network health: "), F.col("health_score").cast("int").cast("string"), F.lit("/100 ("), F.col("grade"), F.lit(")")),
        F.when(F.col("avg_fix") >= 95, "Fix rate excellent").when(F.col("avg_fix") < 80, "Fix rate below target"),
        F.when(F.col("critical") > 0, F.concat(F.col("critical").cast("string"), F.lit(" critical anomalies"))),
        F.when(F.col("excluded") > 0, F.concat(F.col("excluded").cast("string"), F.lit(" stations excluded"))),
        F.when(F.col("survey_grade") > 0, F.concat(F.col("survey_grade").cast("string"), F.lit(" overlay survey-grade stations")))))
    return row.withColumn("highlights", F.array_join(lines, "; "))


def sla_report(sessions: DataFrame, cells: DataFrame, anomalies: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    """One row of conditional aggregates over the period, with the share of hours that saw any session."""
    window = sessions.filter(between(as_of - days * DAY))
    own = has_station()
    when = lambda c, v: F.when(own & c, v)
    row = window.agg(
        F.count_distinct(F.floor(F.col("login_time") / HOUR)).alias("hours"), F.count_if(own).alias("total_sessions"),
        F.count_distinct(F.when(own, F.col("username"))).alias("unique_users"), F.count_distinct(F.when(own, F.col("station"))).alias("stations_used"),
        half_up(F.coalesce(F.avg(when(F.col("fix_rate") > 0, F.col("fix_rate"))), F.lit(0.0)), 1).alias("avg_fix_rate"),
        half_up(F.coalesce(F.avg(F.when(own, (F.col("fix_rate") >= 80).cast("double"))) * 100, F.lit(0.0)), 1).alias("fix_success_rate"),
        half_up(F.coalesce(F.sum(F.when(own, F.col("duration"))) / 3600, F.lit(0.0)), 1).alias("total_hours"),
        half_up(F.coalesce(F.avg(F.when(own, F.col("avg_age"))), F.lit(0.0)), 2).alias("avg_correction_age"),
        F.count_if(own & (F.col("fix_rate") == 0) & (F.col("duration") < 60)).alias("failed_sessions"),
        F.count_if(own & (F.col("fix_rate") >= 80)).alias("good_sessions"))
    green = cells.agg(half_up(F.coalesce(F.avg((F.col("zone_tier") == "full_rtk").cast("double")) * 100, F.lit(0.0)), 1).alias("coverage_green_pct"))
    return (row.withColumn("uptime_pct", half_up(F.col("hours") / float(days * 24) * 100, 1)).drop("hours").crossJoin(green)
            .crossJoin(anomalies.agg(n("incidents"))))


def usage_by_hour(sessions: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    """Sessions and users per hour of day, with the busiest and quietest hour (ties: first) on every row."""
    hours = (sessions.filter(between(as_of - days * DAY)).groupBy((F.floor(F.col("login_time") / HOUR) % 24).cast("int").alias("hour"))
             .agg(n("sessions"), F.count_distinct("username").alias("users")))
    ends = hours.agg(F.min(F.struct(-F.col("sessions"), F.col("hour")))["hour"].alias("peak_hour"), F.min(F.struct("sessions", "hour"))["hour"].alias("quiet_hour"))
    return hours.crossJoin(F.broadcast(ends))


def usage_by_weekday(sessions: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    names = F.array(*[F.lit(d) for d in ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")])
    day = ((F.floor(F.col("login_time") / DAY) + 4) % 7).cast("int")
    return (sessions.filter(between(as_of - days * DAY)).groupBy(day.alias("dow")).agg(n("sessions"), F.count_distinct("username").alias("users"))
            .withColumn("day", F.get(names, F.col("dow"))))


def usage_by_region(sessions: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    rows = (sessions.filter(between(as_of - days * DAY) & has_position()).groupBy(region_by_box(F.col("latitude"), F.col("longitude")).alias("region"))
            .agg(n("sessions"), F.count_distinct("username").alias("users"), mean("fix_rate").alias("avg_fix_rate")))
    total = rows.agg(F.sum("sessions").alias("total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("share_pct", share_of(F.col("total"), F.col("sessions"))).drop("total")


def top_stations(sessions: DataFrame, as_of: int, days: int = 30, limit: int = 20) -> DataFrame:
    return (sessions.filter(between(as_of - days * DAY) & has_station()).groupBy("station").agg(
        n("sessions"), F.count_distinct("username").alias("users"), mean("fix_rate").alias("avg_fix"),
        half_up(F.coalesce(F.avg("duration"), F.lit(0.0)) / 60).alias("avg_duration_min")).orderBy(F.desc("sessions"), "station").limit(limit))


def worst_stations(sessions: DataFrame, as_of: int, days: int = 30, limit: int = 10, least: int = 10) -> DataFrame:
    return (sessions.filter(between(as_of - days * DAY) & has_station()).groupBy("station").agg(
        n("sessions"), F.avg("fix_rate").alias("raw"), half_up(F.avg((F.col("fix_rate") == 0).cast("double")) * 100).alias("zero_fix_pct"))
        .filter(F.col("sessions") >= least).orderBy(half_up("raw", 6), "station").limit(limit)
        .select("station", "sessions", half_up(F.coalesce("raw", F.lit(0.0)), 1).alias("avg_fix"), "zero_fix_pct"))


def duration_distribution(sessions: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    bucket = F.lit(">2h")
    for bound, name in ((7200, "1-2h"), (3600, "30-60min"), (1800, "15-30min"), (900, "5-15min"), (300, "1-5min"), (60, "<1min")):
        bucket = F.when(F.col("duration") < bound, name).otherwise(bucket)
    return (sessions.filter(between(as_of - days * DAY) & (F.col("duration") > 0)).groupBy(bucket.alias("bucket"))
            .agg(n("sessions"), mean("fix_rate").alias("avg_fix")))


def retention(sessions: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    users = sessions.filter(between(as_of - days * DAY) & F.col("username").isNotNull()).groupBy("username").agg(n("n"))
    return users.agg(n("total_users"), F.count_if(F.col("n") >= 2).alias("returning_users")).withColumn(
        "return_rate_pct", F.when(F.col("total_users") > 0, share_of(F.col("total_users"), F.col("returning_users"))).otherwise(0.0))


def hour_align(sessions: DataFrame, env: DataFrame, as_of: int, days: int = 7) -> DataFrame:
    """Hourly session means with the space weather of the same hour (the last reading of an hour wins).

    ``env`` has ``hour_ts, kp, bz``."""
    hours = (sessions.filter(between(as_of - days * DAY) & has_station()).groupBy((F.floor(F.col("login_time") / HOUR) * HOUR).alias("hour_ms")).agg(
        mean("fix_rate").alias("fix_rate"), mean(positive("avg_age")).alias("correction_age"), n("sessions"), F.count_distinct("username").alias("users")))
    ms = F.unix_millis(F.col("hour_ts").cast("timestamp"))
    readings = env.groupBy((F.floor(ms / HOUR) * HOUR).alias("hour_ms")).agg(F.max_by("kp", ms).alias("kp"), F.max_by("bz", ms).alias("bz"))
    return hours.join(readings, "hour_ms", "left")


def kp_fix_correlation(aligned: DataFrame) -> DataFrame:
    """Pearson correlation of Kp and fix rate over hours that have both; 0 under five hours or without variance."""
    pair = aligned.filter(F.col("kp").isNotNull() & (F.col("fix_rate") > 0))
    # F.corr divides before any condition is seen, which is an error where one side has no variance.
    both = F.var_pop("kp") * F.var_pop("fix_rate")
    known = (F.count("*") >= 5) & (F.var_pop("kp") > 1e-12) & (F.var_pop("fix_rate") > 1e-12)
    r = F.when(known, half_up(F.covar_pop("kp", "fix_rate") / F.sqrt(F.nullif(both, F.lit(0.0))), 3)).otherwise(F.lit(0.0))
    return pair.agg(r.alias("correlation_kp_fix"), n("data_points"))


def session_overview(sessions: DataFrame, as_of: int) -> DataFrame:
    day = between(as_of - DAY)
    return sessions.agg(
        n("total"), F.count_if(day).alias("last_24h"), F.count_if(between(as_of - 7 * DAY)).alias("last_7d"),
        half_up(F.coalesce(F.avg(F.when(day & (F.col("fix_rate") > 0), F.col("fix_rate"))), F.lit(0.0)), 1).alias("avg_fix_rate_24h"),
        F.count_distinct(F.when(day & has_station(), F.col("station"))).alias("unique_stations_24h"),
        F.count_distinct(F.when(day, F.col("username"))).alias("unique_users_24h"), F.min("login_time").alias("oldest"), F.max("login_time").alias("newest"),
        half_up((F.max("login_time") - F.min("login_time")) / DAY).alias("time_span_days"))


def tier_summary(cells: DataFrame) -> DataFrame:
    rows = cells.groupBy("zone_tier").agg(n("cells"), half_up(F.avg("quality_score"), 2).alias("avg_quality"))
    total = rows.agg(F.sum("cells").alias("total_cells"), F.sum(F.when(F.col("zone_tier") == "full_rtk", F.col("cells"))).alias("green"))
    return rows.crossJoin(F.broadcast(total)).withColumn("green_pct", share_of(F.col("total_cells"), F.coalesce("green", F.lit(0)))).drop("green")


def station_score_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(n("total"), F.count_if(F.col("uq_score") >= 0.5).alias("good"), F.count_if(F.col("uq_score") < 0.3).alias("poor"),
                      half_up(F.avg("uq_score"), 4).alias("avg_uq"), half_up(F.avg("uptime_7d"), 4).alias("avg_uptime"))


def network_breakdown(stations: DataFrame) -> DataFrame:
    return stations.groupBy(F.coalesce("network", F.lit("unknown")).alias("network")).agg(n("stations"), F.count_if(online()).alias("online"))


def hardware_breakdown(stations: DataFrame, network: str = OVERLAY, limit: int = 20) -> DataFrame:
    return (stations.filter((F.col("network") == network) & (F.coalesce("receiver_type", F.lit("")) != "")).groupBy("receiver_type").agg(n("stations"))
            .orderBy(F.desc("stations"), "receiver_type").limit(limit))


def probe_coverage(stations: DataFrame, network: str = OVERLAY) -> DataFrame:
    kind = F.coalesce("receiver_type", F.lit(""))
    probed = (kind != "") & ~kind.contains("INFERRED")
    return stations.filter(F.col("network") == network).agg(
        n("total"), F.count_if(probed).alias("probed"), F.count_if(~probed).alias("unprobed"),
        F.count_if(kind.rlike("LEICA|TRIMBLE|SEPT|NOVATEL|CHC|TOPCON|SURVEY_GRADE_PROBED")).alias("survey_grade"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(n("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def public_summary(sessions: DataFrame, stations: DataFrame, cells: DataFrame, as_of: int) -> DataFrame:
    """One row per public region; all share the mean quality of the network, as the page shows it."""
    score = half_up(F.coalesce(F.avg(positive("quality_score")), F.lit(0.0)) * 100)
    one = (stations.agg(F.count_if(online()).alias("stations_online"), F.count_distinct("country").alias("countries"))
           .crossJoin(sessions.filter(between(as_of - DAY) & (F.col("fix_rate") > 0)).agg(mean("fix_rate").alias("mean_fix_24h")))
           .crossJoin(cells.agg(score.alias("integrity_score"))))
    names = F.explode(F.array(*[F.lit(r) for r in ("Europe", "North America", "Asia Pacific", "South America", "Middle East")]))
    status = F.when(F.col("integrity_score") >= 80, "operational").when(F.col("integrity_score") >= 60, "degraded").otherwise("issues")
    return one.withColumn("region", names).withColumn("status", status)


def station_profile(sessions: DataFrame, stations: DataFrame, scores: DataFrame, trust: DataFrame, as_of: int, name: str) -> DataFrame:
    """One row about a station: place, scores, trust, week statistics and its latest sessions of the day (50 at most)."""
    own = sessions.filter((F.col("station") == name) & between(as_of - 7 * DAY))
    day = own.filter(between(as_of - DAY)).orderBy(F.desc("login_time"), "id").limit(50)
    latest = day.agg(F.array_sort(F.collect_list("id")).alias("ids"), n("sessions_24h")).select(F.array_join("ids", ",").alias("latest_ids"), "sessions_24h")
    week = own.agg(n("sessions_7d"), F.count_distinct("username").alias("users_7d"), mean("fix_rate").alias("avg_fix_7d"))
    info = (stations.filter(F.col("name") == name).select("name", "latitude", "longitude", "status", "network")
            .join(scores.select(F.col("station_name").alias("name"), "uq_score", "uptime_7d"), "name", "left")
            .join(trust.select(F.col("station").alias("name"), "flag"), "name", "left"))
    return info.crossJoin(week).crossJoin(latest)


def station_sessions(sessions: DataFrame, as_of: int, name: str, limit: int | None = 50) -> DataFrame:
    """The latest sessions of a station within a day, newest first, users masked: the page shows 50 of them."""
    own = sessions.filter((F.col("station") == name) & between(as_of - DAY))
    out = own.select("id", "fix_rate", F.col("avg_age").alias("correction_age"), F.col("duration").alias("duration_s"), mask_user(F.col("username")).alias("user"), F.col("login_time").alias("time_ms"))
    return out if limit is None else out.orderBy(F.desc("time_ms"), "id").limit(limit)


def station_week(sessions: DataFrame, as_of: int, name: str) -> DataFrame:
    """One row about a station's week: sessions, users, mean fix rate, mean duration in minutes, mean correction age."""
    own = sessions.filter((F.col("station") == name) & between(as_of - 7 * DAY))
    return own.agg(n("sessions"), F.count_distinct("username").alias("users"), mean("fix_rate").alias("avg_fix"), half_up(F.coalesce(F.avg("duration"), F.lit(0.0)) / 60).alias("avg_duration_min"),
                   half_up(F.coalesce(F.avg("avg_age"), F.lit(0.0)), 2).alias("avg_age"))


def station_status_history(log: DataFrame, as_of: int, name: str, days: int = 7) -> DataFrame:
    """Status entries (``station_name, status, recorded_at``) of a station by hour and status."""
    hour = (F.floor(F.col("recorded_at") / HOUR) * HOUR).cast("long")
    return log.filter((F.col("station_name") == name) & (F.col("recorded_at") >= as_of - days * DAY)).groupBy(hour.alias("hour_ms"), "status").agg(n("entries"))


def station_alerts(alerts: DataFrame, flags: DataFrame, name: str) -> DataFrame:
    """``source, kind, confidence, action``: the predictive alerts and the suspicions that concern a station."""
    told = alerts.filter(F.col("station") == name).select(F.lit("prediction").alias("source"), F.col("indicator").alias("kind"), "confidence", "action")
    return told.unionByName(flags.filter(F.col("name") == name).select(F.lit("suspicion").alias("source"), F.col("rule").alias("kind"), "confidence", F.col("recommendation").alias("action")))


def mask_user(user: Column) -> Column:
    return F.concat(F.substring(user, 1, 3), F.lit("***"))


def caster_ingest_summary(log: DataFrame) -> DataFrame:
    return log.agg(n("sessions"), F.sum("failover_count").alias("failovers"), F.count_distinct("username").alias("users"),
                   F.count_distinct("backend_source").alias("stations"))


def caster_performance(log: DataFrame) -> DataFrame:
    """Per backend station: duration, upper median, volume, failovers, stability, rate and overall mark."""
    rows = log.filter(F.coalesce("backend_source", F.lit("")) != "").withColumnRenamed("backend_source", "station")
    # The median counts values: a station has as many rows in the window as different durations.
    values, station = rows.filter("duration_s is not null").groupBy("station", "duration_s").agg(n("k")), W.partitionBy("station")
    upto = values.withColumns({"upto": F.sum("k").over(station.orderBy("duration_s")), "of": F.sum("k").over(station)})
    middle = upto.filter(F.col("upto") > F.floor(F.col("of") / 2)).groupBy("station").agg(F.min("duration_s").alias("median_duration_s"))
    out = rows.groupBy("station").agg(n("sessions"), F.avg("duration_s").alias("mean"), F.sum("bytes_transferred").alias("bytes"), F.sum("failover_count").alias("failovers")).join(middle, "station", "left")
    stability = F.least(F.lit(1.0), F.col("mean") / 1800) * (1 - F.least(F.lit(1.0), F.col("failovers") / F.col("sessions")) * 0.5)
    rate = F.col("bytes") / F.col("sessions") / F.greatest(F.lit(1.0), F.col("mean"))
    return out.select("station", "sessions", half_up("mean").alias("avg_duration_s"), "median_duration_s", "bytes", "failovers",
                      half_up(stability, 2).alias("stability_score"), half_up(F.least(F.lit(1.0), rate / 500), 2).alias("data_rate_score"),
                      half_up(stability * 0.7 + F.least(F.lit(1.0), rate / 500) * 0.3, 2).alias("overall_score"))


def latest(rows: DataFrame, by: str, ties: str, limit: int) -> DataFrame:
    """The ``limit`` newest rows by ``by``, equal ones in the order of ``ties``."""
    return rows.orderBy(F.desc(by), ties).limit(limit)


def latest_sessions(sessions: DataFrame, limit: int = 2000) -> DataFrame:
    return latest(sessions.select("id", "station", "login_time", "fix_rate"), "login_time", "id", limit)
