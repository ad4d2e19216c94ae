"""Station scores, uptime and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.geo import haversine_km
from plumbline.functions.rules import DAY, HOUR, between, clean_sessions, half_up, has_position, has_station, nonzero_position, online, positive


def infer_network(name: Column) -> Column:
    """Network of a station by the form of its name."""
    return (F.when(F.coalesce(name, F.lit("")) == "", "unknown")
            .when(name.startswith("NRBY_") | name.startswith("ONO_") | name.startswith("onocoy_"), "onocoy")
            .when(name.rlike("^[A-Z0-9]{8,12}$"), "geodnet").when(name.rlike("^[A-Z]{4}$"), "cors").otherwise("unknown"))


def station_uptime(status_log: DataFrame, stations: DataFrame, as_of: int, days: int = 7) -> DataFrame:
    """``station, uptime``: online share of the log of the last days, two decimals. Stations without log entries
    take 0.9 if online now, else 0.5. ``status_log`` has ``station_name, status, recorded_at`` (ms)."""
    seen = (status_log.filter(between(as_of - days * DAY, as_of, "recorded_at")).groupBy(F.col("station_name").alias("station"))
            .agg(half_up(F.avg(online().cast("double")), 2).alias("logged")))
    now = stations.select(F.col("name").alias("station"), F.when(online(), 0.9).otherwise(0.5).alias("guess"))
    return now.join(seen, "station", "full_outer").select("station", F.coalesce("logged", "guess").alias("uptime"))


def station_scores(sessions: DataFrame, stations: DataFrame, status_log: DataFrame, as_of: int, days: int = 14) -> DataFrame:
    """One row per station with sessions in the window.

    Quality is 0.4 fix + 0.3 age + 0.3 uptime; reliability is uptime times the share of sessions with a fix
    times ``max(0, 1 - p90 age / 15)``. Percentiles are nearest-rank and read from counts per value, so a
    station with very many sessions never gathers them in one buffer.
    """
    window = sessions.filter(has_station() & between(as_of - days * DAY, as_of))
    uptime = station_uptime(status_log, stations, as_of)
    places = stations.select(F.col("name").alias("station"), F.col("latitude").alias("s_lat"), F.col("longitude").alias("s_lon"))
    fix, age, length = F.coalesce("fix_rate", F.lit(0.0)), positive("avg_age"), F.greatest(F.lit(0), F.coalesce("duration", F.lit(0)))
    km = F.when(nonzero_position() & has_position() & (F.col("s_lat") != 0) & (F.col("s_lon") != 0),
                haversine_km(F.col("latitude"), F.col("longitude"), F.col("s_lat"), F.col("s_lon")))
    rank = lambda p, c: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")
    grouped = (window.join(places, "station", "left").withColumns({"fix": fix, "age": age, "length": length, "km": km})
               .groupBy("station").agg(
                   F.count(F.lit(1)).alias("session_count"), F.count_distinct("username").alias("unique_users"), F.sum("length").alias("seconds"),
                   F.sum(F.col("fix") * F.col("length")).alias("weighted"), F.avg("fix").alias("plain"), rank(0.1, "fix").alias("p10"),
                   rank(0.5, "age").alias("median_age"), rank(0.9, "age").alias("p90_age"), F.avg((F.col("fix") == 0).cast("double")).alias("zero"),
                   F.avg("km").alias("avg_km"), F.max("km").alias("max_km")))
    mean_fix = F.when(F.col("seconds") > 0, F.col("weighted") / F.col("seconds")).otherwise(F.col("plain"))
    up = F.coalesce("uptime", F.lit(0.5))
    age_part = F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("median_age") / 10), F.lit(0.5))
    late_part = F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("p90_age") / 15), F.lit(0.5))
    none = F.lit(0.0)
    return grouped.join(uptime, "station", "left").select(
        "station", infer_network(F.col("station")).alias("network"),
        half_up(0.4 * F.least(F.lit(1.0), mean_fix / 100) + 0.3 * age_part + 0.3 * up, 2).alias("uq_score"),
        half_up(up * (1 - F.col("zero")) * late_part, 2).alias("reliability_score"), "session_count", "unique_users",
        half_up(mean_fix, 1).alias("avg_fix_rate"), half_up("p10", 1).alias("p10_fix_rate"), half_up(F.coalesce("median_age", none), 1).alias("median_correction_age"),
        half_up(F.coalesce("p90_age", none), 1).alias("p90_correction_age"), half_up(F.coalesce("avg_km", none), 1).alias("avg_baseline_km"),
        half_up(F.coalesce("max_km", none), 1).alias("max_baseline_km"), half_up("zero", 3).alias("zero_fix_ratio"),
        half_up(F.col("seconds") / 3600, 1).alias("total_duration_hours"), up.alias("uptime_7d"))


def station_baseline(sessions: DataFrame, start: int, end: int | None, least: int = 1) -> DataFrame:
    """``station, mean_fix, mean_age, n, users`` of a window, noise left out, for stations with ``least`` sessions."""
    return (clean_sessions(sessions).filter(between(start, end)).groupBy("station").agg(
        F.coalesce(F.avg("fix_rate"), F.lit(0.0)).alias("mean_fix"), F.coalesce(F.avg("avg_age"), F.lit(0.0)).alias("mean_age"),
        F.count(F.lit(1)).alias("n"), F.count_distinct("username").alias("users")).filter(F.col("n") >= least))


def station_hourly(sessions: DataFrame, as_of: int, hours: int = 24) -> DataFrame:
    """Mean fix rate, mean positive age and sessions per station and hour."""
    return (sessions.filter(has_station() & between(as_of - hours * HOUR)).groupBy("station", (F.floor(F.col("login_time") / HOUR) * HOUR).alias("hour_ms"))
            .agg(half_up(F.coalesce(F.avg("fix_rate"), F.lit(0.0)), 1).alias("fix_rate"),
                 half_up(F.coalesce(F.avg(positive("avg_age")), F.lit(0.0)), 1).alias("correction_age"), F.count(F.lit(1)).alias("sessions")))
