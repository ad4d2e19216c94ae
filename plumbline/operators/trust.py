"""Trust scores, validation ladders and quality gates of stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.geo import distance_join, haversine_km
from plumbline.functions.rules import DAY, HOUR, between, clean_sessions, half_up, has_position, nonzero_position, settled

DECAY, CYCLE_H = 0.995, 4
STATE = "station string, alpha double, beta double, last_decay long, excluded_at long"


def evidence(sessions: DataFrame, failure: float = 1.5, by: tuple[str, ...] = ("station",)) -> DataFrame:
    """``station, d_alpha, d_beta, n, mean_fix``: successes and failures of each station; the sums combine map-side."""
    fix = F.coalesce("fix_rate", F.lit(0.0))
    part = (fix - 20) / 50
    return sessions.groupBy(*by).agg(
        F.sum(F.when(fix >= 70, 1.0).when(fix <= 20, 0.0).otherwise(part * 0.5)).alias("d_alpha"),
        F.sum(F.when(fix >= 70, 0.0).when(fix <= 20, failure).otherwise((1 - part) * 0.5)).alias("d_beta"), F.count("*").alias("n"), F.avg(fix).alias("mean_fix"))


def certain(x: str) -> Column:
    """``x`` for comparisons with a limit: as it is for stations without new sessions, whose values hold no sum of rows, else settled."""
    return F.when(F.col("n").isNull(), F.col(x)).otherwise(settled(x))


def neighbour_consistency(per_station: DataFrame, stations: DataFrame, km: float = 80.0, least: int = 3) -> DataFrame:
    """``station, consistency``: agreement with the mean fix rates of stations within ``km``; only where both have enough sessions."""
    known = (per_station.filter(F.col("n") >= least).join(stations.filter(has_position()).select(F.col("name").alias("station"), "latitude", "longitude"), "station")
             .select("station", "latitude", "longitude", "mean_fix"))
    other = known.select(F.col("station").alias("r_station"), F.col("latitude").alias("r_latitude"), F.col("longitude").alias("r_longitude"), F.col("mean_fix").alias("r_fix"))
    return (distance_join(known, other, km).filter("station <> r_station").groupBy("station")
            .agg(F.greatest(F.lit(0.0), 1 - F.avg(F.abs(F.col("mean_fix") - F.col("r_fix"))) / 50).alias("consistency")))


def trust_scores(sessions: DataFrame, state: DataFrame, stations: DataFrame, scores: DataFrame, anomaly_counts: DataFrame, as_of: int, hours: int = CYCLE_H) -> DataFrame:
    """One row per station of the old state or with new sessions: updated state, parts, blend and flag.

    The Beta state decays towards its prior by 0.995 per missed cycle, only for stations with new sessions, then
    gains their evidence. Composite = 0.30 quality + 0.20 uptime + 0.20 consistency + 0.15 history + 0.15 distance;
    blend = 0.6 trust + 0.4 composite. Excluded stations return after 24 h at 0.55, or after 6 h at 0.70.
    ``state`` has ``station, alpha, beta, last_decay, excluded_at``; ``anomaly_counts`` has ``station, anomalies``.
    """
    recent = clean_sessions(sessions).filter(between(as_of - hours * HOUR))
    new = evidence(recent)
    meta = stations.filter(has_position()).join(scores, F.col("name") == F.col("station_name"), "left").select(
        F.col("name").alias("station"), F.coalesce("network", F.lit("unknown")).alias("network"), F.col("latitude").alias("s_lat"), F.col("longitude").alias("s_lon"),
        F.coalesce("uq_score", F.lit(0.5)).alias("uq"), F.coalesce("uptime_7d", F.lit(0.5)).alias("uptime"))
    distance = (recent.filter(nonzero_position() & has_position()).join(meta.select("station", "s_lat", "s_lon"), "station")
                .groupBy("station").agg(F.avg(haversine_km(F.col("latitude"), F.col("longitude"), F.col("s_lat"), F.col("s_lon"))).alias("km")))
    c = F.col
    rows = (state.join(new, "station", "full_outer").join(meta, "station", "left").join(neighbour_consistency(new, stations), "station", "left")
            .join(distance, "station", "left").join(anomaly_counts, "station", "left"))
    cycles = F.greatest(F.lit(1.0), half_up((as_of - F.coalesce("last_decay", F.lit(as_of))) / float(hours * HOUR)))
    decay = F.pow(F.lit(DECAY), cycles)
    grow = lambda k: F.when(c("n").isNull(), c(k)).otherwise(1 + (F.coalesce(k, F.lit(1.0)) - 1) * decay + c(f"d_{k}"))
    rows = rows.withColumns({"a": grow("alpha"), "b": grow("beta")})
    total = c("a") + c("b")
    ci = F.when(total > 2, 2 * 1.96 * F.sqrt(c("a") * c("b") / (total * total * (total + 1)))).otherwise(1.0)
    or_half = lambda k: F.when(F.coalesce(k, F.lit(0.0)) == 0, 0.5).otherwise(c(k))
    rows = rows.withColumns({
        "trust": c("a") / total, "samples": total - 2, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ci)), "w_quality": or_half("uq"), "w_uptime": or_half("uptime"),
        "w_consistency": F.coalesce("consistency", F.lit(0.75)), "w_history": F.greatest(F.lit(0.1), 1 - F.coalesce("anomalies", F.lit(0)) * 0.1),
        "w_distance": F.coalesce(F.greatest(F.lit(0.0), 1 - c("km") / 100), F.lit(0.5))})
    rows = rows.withColumn("blend", c("trust") * 0.6 + 0.4 * (
        c("w_quality") * 0.3 + c("w_uptime") * 0.2 + c("w_consistency") * 0.2 + c("w_history") * 0.15 + c("w_distance") * 0.15))
    out_h, few, blend = (as_of - c("excluded_at")) / float(HOUR), certain("samples") < 10, certain("blend")
    back = ((out_h >= 6) & (blend >= 0.7)) | ((out_h >= 24) & (blend >= 0.55))
    flag = (F.when(few, "new").when(c("excluded_at").isNotNull(), F.when(back, "probation").otherwise("excluded")).when(blend < 0.25, "excluded")
            .when(blend >= 0.65, "trusted").when(blend >= 0.4, "probation").otherwise("untrusted"))
    since = (F.when(few, c("excluded_at")).when(c("excluded_at").isNotNull(), F.when(~back, c("excluded_at"))).when(blend < 0.25, F.lit(as_of)))
    return rows.select("station", F.coalesce("network", F.lit("unknown")).alias("network"), half_up("a", 2).alias("alpha"), half_up("b", 2).alias("beta"), half_up("trust", 3).alias("trust_score"),
                       *[half_up(k, 3).alias(k) for k in ("w_quality", "w_uptime", "w_consistency", "w_history", "w_distance")], half_up("blend", 3).alias("composite_score"),
                       half_up("confidence", 3).alias("confidence"), half_up("samples").alias("total_sessions"), flag.alias("flag"), since.alias("excluded_at"))


def trust_scores_v1(sessions: DataFrame, state: DataFrame, stations: DataFrame, as_of: int, hours: int = CYCLE_H) -> DataFrame:
    """The earlier model: failures weigh 1, the score is 0.7 trust + 0.3 consistency (five sessions), there is no exclusion."""
    new = evidence(clean_sessions(sessions).filter(between(as_of - hours * HOUR)), 1.0)
    c = F.col
    rows = state.join(new, "station", "full_outer").join(neighbour_consistency(new, stations, least=5), "station", "left")
    decay = F.pow(F.lit(DECAY), F.greatest(F.lit(1.0), half_up((as_of - F.coalesce("last_decay", F.lit(as_of))) / float(hours * HOUR))))
    grow = lambda k: F.when(c("n").isNull(), c(k)).otherwise(1 + (F.coalesce(k, F.lit(1.0)) - 1) * decay + c(f"d_{k}"))
    rows = rows.withColumns({"a": grow("alpha"), "b": grow("beta"), "consistency": F.coalesce("consistency", F.lit(0.75))})
    rows = rows.withColumns({"trust": c("a") / (c("a") + c("b")), "samples": c("a") + c("b") - 2}).withColumn("combined", c("trust") * 0.7 + c("consistency") * 0.3)
    combined = certain("combined")
    flag = F.when(certain("samples") < 10, "new").when(combined >= 0.7, "trusted").when(combined >= 0.4, "probation").otherwise("untrusted")
    return rows.select("station", half_up("a", 2).alias("alpha"), half_up("b", 2).alias("beta"), half_up("trust", 3).alias("trust_score"), half_up("consistency", 3).alias("consistency"),
                       half_up("combined", 3).alias("combined_score"), flag.alias("flag"))


def trust_order(trust: DataFrame, limit: int | None = None) -> DataFrame:
    """Worst flags first, then lowest score."""
    rank = F.when(F.col("flag") == "excluded", 0).when(F.col("flag") == "untrusted", 1).when(F.col("flag") == "probation", 2).when(F.col("flag") == "new", 3).otherwise(4)
    out = trust.withColumn("rank", rank).orderBy("rank", "composite_score", "station")
    return out if limit is None else out.limit(limit)


def trust_from_logs(performance: DataFrame, state: DataFrame) -> DataFrame:
    """Beta state after caster logs: +0.3 log10(n) to alpha above 0.7 stability, to beta under 0.3, from three sessions on.

    Where over half of more than ten stations are unstable, the cause is systemic and nothing changes.
    """
    breaker = performance.agg(F.coalesce((F.count("*") > 10) & (F.count_if(F.col("stability_score") < 0.3) / F.count("*") > 0.5), F.lit(False)).alias("systemic"))
    step = F.log10(F.greatest(F.lit(1), "sessions").cast("double")) * 0.3
    rows = state.select("station", "alpha", "beta").join(performance.select("station", "sessions", "stability_score"), "station", "full_outer").crossJoin(F.broadcast(breaker))
    use = F.coalesce((F.col("sessions") >= 3) & ~F.col("systemic"), F.lit(False))
    one = F.lit(1.0)
    return rows.filter(F.col("alpha").isNotNull() | use).select(
        "station", half_up(F.coalesce("alpha", one) + F.when(use & (F.col("stability_score") > 0.7), step).otherwise(0.0), 4).alias("alpha"),
        half_up(F.coalesce("beta", one) + F.when(use & (F.col("stability_score") < 0.3), step).otherwise(0.0), 4).alias("beta"))


def overlay_validation(state: DataFrame, fresh: DataFrame, as_of: int) -> DataFrame:
    """Validation ladder: smoothed fix rate (0.6 old, 0.4 new; anew after seven days), session total and status.

    ``state`` has ``station, status, fix_rate, sessions, last_updated``; ``fresh`` has ``station, new_fix, new_sessions``.
    """
    c = F.col
    old = (F.coalesce("fix_rate", F.lit(0.0)) != 0) & (as_of - F.coalesce("last_updated", F.lit(0)) <= 7 * DAY)
    fix = F.when(old, c("fix_rate") * 0.6 + c("new_fix") * 0.4).otherwise(c("new_fix"))
    total = F.coalesce("sessions", F.lit(0)) + c("new_sessions")
    status = (F.when(total >= 50, F.when(fix >= 70, "confirmed").when(fix < 40, "rejected").otherwise("live_testing"))
              .when(total >= 10, F.when(fix >= 80, "confirmed").when(fix < 20, "rejected").otherwise("live_testing")).otherwise("live_testing"))
    seen = c("new_sessions").isNotNull()
    return state.join(fresh, "station", "full_outer").select(
        "station", F.when(seen, status).otherwise(c("status")).alias("status"), F.when(seen, half_up(fix, 1)).otherwise(c("fix_rate")).alias("fix_rate"),
        F.when(seen, total).otherwise(c("sessions")).alias("sessions"), F.when(seen, F.lit(as_of)).otherwise(c("last_updated")).alias("last_updated"))


def qualified_stations(stations: DataFrame, scores: DataFrame, trust: DataFrame, critical: DataFrame, alerts: DataFrame) -> DataFrame:
    """Every station with its tier, cascade priority and the first gate that it fails (null: qualified).

    ``critical`` has ``station`` with an active critical event; ``alerts`` has ``station, indicator, action, confidence``,
    of which the most certain counts per station.
    """
    c = F.col
    first = alerts.groupBy("station").agg(F.min_by("action", F.struct(-c("confidence"), c("indicator"))).alias("alert"))
    t = trust.select("station", "composite_score", "flag")
    rows = (stations.filter(has_position()).withColumnRenamed("name", "station").join(scores.withColumnRenamed("station_name", "station"), "station", "left").join(t, "station", "left")
            .join(critical.select("station", F.lit(True).alias("hit")).distinct(), "station", "left").join(first, "station", "left"))
    score, flag = F.coalesce("composite_score", F.lit(0.6)), F.coalesce("flag", F.lit("new"))
    uq, up, n = (F.coalesce(k, F.lit(0.0)) for k in ("uq_score", "uptime_7d", "session_count"))
    gate = (F.when(flag == "excluded", "excluded").when(score < 0.55, "trust").when(up < 0.5, "uptime").when(uq < 0.3, "quality").when(c("hit"), "critical_event")
            .when((n < 5) & (flag == "new") & (uq < 0.5), "new_low_quality"))
    gate = F.when(c("alert") == "pre_exclude", "predictive").otherwise(gate)
    tier = F.when(score >= 0.85, "platinum").when(score >= 0.7, "gold").otherwise("silver")
    base = F.when(score >= 0.85, half_up((1 - score) * 20 + 1)).when(score >= 0.7, half_up((0.85 - score) * 60 + 11)).otherwise(half_up((0.7 - score) * 60 + 31))
    base = F.least(F.lit(99.0), F.greatest(F.lit(1.0), base))
    priority = (F.when(c("alert") == "pre_downgrade", F.least(F.lit(99.0), base + 20)).when((c("alert") == "pre_promote") & (base > 10), F.greatest(F.lit(1.0), base - 10)).otherwise(base))
    return rows.select("station", F.coalesce("network", F.lit("unknown")).alias("network"), half_up(score, 3).alias("composite_score"), half_up(uq, 3).alias("uq_score"), half_up(up, 3).alias("uptime"),
                       tier.alias("quality_tier"), priority.alias("cascade_priority"), gate.alias("disqualify_reason"), gate.isNotNull().alias("disqualified"))
