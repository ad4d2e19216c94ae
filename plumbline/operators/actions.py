"""Zone actions, overlay zones, ionosphere interpolation and smaller jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.classify import SURVEY, any_of, magnetic_latitude
from plumbline.functions.geo import distance_join
from plumbline.functions.graph import checkpointed, connected_components
from plumbline.functions.greedy import keep_best
from plumbline.functions.rules import HOUR, between, half_up, has_station

DEGRADING = ("exclude", "downgrade")


def zone_actions(zones: DataFrame, trust: DataFrame, anomalies: DataFrame, events: DataFrame, recent: DataFrame, cap: int | None = 20) -> DataFrame:
    """Actions on zones: exclude, downgrade, restore, new fence, and alerts.

    ``zones`` has ``zone_id, enabled, priority, stations``; ``events`` interference with ``classification, stations``;
    ``recent`` zone ids changed in the last six hours, which block new actions but restores and overrides. With more than
    ``cap`` exclusions and downgrades only the first ``cap`` degrading actions stay (by source, then zone, then station)
    and a cascade alert is added; without a cap (None) all stay. Over ten excluded primary and five overlay stations give a dual-outage alert.
    """
    c = F.col
    at = zones.select("zone_id", "enabled", "priority", F.explode("stations").alias("station"))
    pri = lambda add: F.least(F.lit(99), c("priority") + add)
    none = F.lit(None).cast("int")
    row = lambda df, action, after, source: df.select(F.lit(action).alias("action"), "zone_id", "station", c("priority").alias("priority_before"), after.cast("int").alias("priority_after"), F.lit(source).alias("source"))
    by_trust = at.join(trust.select("station", "composite_score", "flag"), "station")
    out = row(by_trust.filter("enabled and (flag = 'excluded' or (flag = 'untrusted' and composite_score < 0.3))"), "exclude", none, 1)
    out = out.unionByName(row(by_trust.filter("flag = 'probation' and composite_score < 0.5"), "downgrade", pri(20), 2))
    spoofed = events.filter("classification in ('jamming', 'spoofing')").select(F.explode("stations").alias("station")).distinct()
    out = out.unionByName(row(at.join(spoofed, "station"), "exclude", F.lit(99), 0))
    critical = anomalies.filter("severity = 'critical'")
    fences = critical.filter("type in ('mass_disconnect', 'interference_cluster', 'jamming_suspect') and region").select(
        F.lit("new_fence").alias("action"), F.lit(None).cast("string").alias("zone_id"), "station", none.alias("priority_before"), F.lit(99).alias("priority_after"), F.lit(3).alias("source"))
    drifts = critical.filter("type in ('cusum_fix_drift', 'ewma_fix_drop', 'fix_rate_drop') and station is not null").select("type", "station")
    out = out.unionByName(fences).unionByName(row(at.join(drifts, "station"), "downgrade", pri(30), 4))
    out = out.unionByName(row(by_trust.filter("flag = 'trusted' and composite_score >= 0.7 and (not enabled or priority > 50)"), "restore", F.lit(10), 5))
    free = (c("source") == 0) | (c("action") == "restore") | c("hit").isNull()
    out = checkpointed(out.join(recent.select("zone_id", F.lit(True).alias("hit")).distinct(), "zone_id", "left").filter(free).drop("hit"))
    alert = lambda df, name: df.select(F.lit(name).alias("action"), F.lit(None).cast("string").alias("zone_id"), F.lit(None).cast("string").alias("station"), none.alias("priority_before"), none.alias("priority_after"), F.lit(9).alias("source"))
    overlay = c("station").startswith("ono") | c("station").contains("ONOCOY")
    dual = trust.filter("flag = 'excluded'").agg(F.count_if(~overlay).alias("p"), F.count_if(overlay).alias("o")).filter("p > 10 and o > 5")
    if cap is None:
        return out.unionByName(alert(dual, "dual_outage"))
    many = out.agg(F.count_if(c("action").isin(*DEGRADING)).alias("degrading"))
    # Degrading actions are numbered only up to the cap: a sorted limit per partition, then one small sort.
    first = (out.filter(c("action") != "restore").orderBy("source", F.col("zone_id").asc_nulls_last(), "station", "priority_after").limit(cap))
    over = c("degrading") > cap
    kept = (out.filter("action = 'restore'").unionByName(first.crossJoin(F.broadcast(many)).filter(over).drop("degrading"))
            .unionByName(out.filter("action <> 'restore'").crossJoin(F.broadcast(many)).filter(~over).drop("degrading")))
    return kept.unionByName(alert(many.filter(over), "cascade_exhaustion")).unionByName(alert(dual, "dual_outage"))


def apply_actions(zones: DataFrame, actions: DataFrame) -> DataFrame:
    """Zones after the actions: the last action that sets a field wins, in the order of ``source``, then station."""
    order = F.struct("source", "station", "action")
    last = lambda names, value: F.max_by(F.when(F.col("action").isin(*names), value), F.when(F.col("action").isin(*names), order))
    sets = actions.filter("zone_id is not null").groupBy("zone_id").agg(
        last(("exclude", "restore"), F.col("action") == "restore").alias("new_enabled"), last(("downgrade", "restore"), F.coalesce("priority_after", F.lit(10))).alias("new_priority"))
    return zones.join(sets, "zone_id", "left").select("zone_id", F.coalesce("new_enabled", "enabled").alias("enabled"), F.coalesce("new_priority", "priority").alias("priority"))


def zone_hardware(receiver: Column, name: Column) -> Column:
    """Hardware class for overlay zones: an empty receiver reads the name; there is no list of professional brands."""
    text = F.upper(F.when(F.coalesce(receiver, F.lit("")) == "", name).otherwise(receiver))
    grade = lambda n, sure: F.struct(F.lit(n).alias("hardware_class"), F.lit(sure).alias("confidence"))
    return (F.when(any_of(text, SURVEY), grade("survey_grade", 0.95)).when(text.contains("SURVEY_GRADE_INFERRED"), grade("survey_grade", 0.75))
            .when(text.contains("PROFESSIONAL_INFERRED"), grade("professional", 0.65)).when(any_of(text, ("CONSUMER_GOOD_INFERRED", "U-BLOX", "UBLOX", "F9P")), grade("consumer", 0.5))
            .when(text.contains("CONSUMER_BASIC_INFERRED"), grade("consumer", 0.3)).otherwise(grade("unknown", 0.2)))


def overlay_candidates(near: DataFrame, validation: DataFrame) -> DataFrame:
    """Circles around overlay stations by the three strategies. ``near`` has ``name, latitude, longitude, receiver_type,
    distance_km`` to the nearest primary station; ``validation`` has ``station, status, fix_rate``."""
    c = F.col
    rows = (near.withColumn("hw", zone_hardware(c("receiver_type"), c("name"))).join(validation.select(c("station").alias("name"), c("status").alias("v_status"), c("fix_rate")), "name", "left")
            .withColumns({"km": F.coalesce("distance_km", F.lit(999.0)), "kind": c("hw.hardware_class"), "sure": c("hw.confidence"), "st": F.coalesce("v_status", F.lit("untested"))}))
    confirmed = c("st") == "confirmed"
    survey = (c("kind") == "survey_grade") & (c("sure") >= 0.7) & (c("st") != "rejected") & ((c("km") > 40) | (confirmed & (F.coalesce("fix_rate", F.lit(0.0)) > 75)))
    pro = (c("kind") == "professional") & (c("sure") >= 0.65) & (c("st") != "rejected") & (c("km") > 60)
    consumer = (c("kind") == "consumer") & (c("sure") >= 0.5) & confirmed & (c("km") > 80)
    clip = lambda factor, top: half_up(F.least(F.lit(float(top)), F.greatest(F.lit(15000.0), c("km") * factor)))
    picked = rows.filter(survey | pro | consumer)
    kind = c("kind")
    return picked.select(
        F.concat(F.lit("ono_"), "name").alias("zone_id"), "name", c("latitude").alias("lat"), c("longitude").alias("lon"), kind.alias("hardware_class"),
        F.when(kind == "survey_grade", F.when(c("km") > 40, "primary_absent").otherwise("overlay_better")).otherwise("primary_absent").alias("reason"),
        F.when(kind == "survey_grade", 5).when((kind == "professional") & confirmed, 5).otherwise(30).alias("priority"),
        F.when(kind == "survey_grade", clip(600, 45000)).when(kind == "professional", clip(400, 45000)).otherwise(clip(300, 25000)).alias("radius_m"),
        half_up(F.when(kind == "consumer", 0.6).when((kind == "survey_grade") & confirmed, F.greatest("sure", F.lit(0.9))).otherwise(c("sure")), 2).alias("confidence"), c("st").alias("validation_status"))


def overlay_zones(near: DataFrame, validation: DataFrame, dedupe_km: float = 5.0) -> DataFrame:
    """Candidates, thinned to the most certain within ``dedupe_km`` (ties by id), each with the smallest id of the group of
    circles that overlap it: overlapping circles form one service area."""
    cand = checkpointed(overlay_candidates(near, validation))
    right = cand.select(F.col("zone_id").alias("r_id"), F.col("lat").alias("r_latitude"), F.col("lon").alias("r_longitude"), F.col("radius_m").alias("r_radius"))
    close = distance_join(cand.select("zone_id", "lat", "lon"), right, dedupe_km, "lat", "lon").filter((F.col("zone_id") < F.col("r_id")) & (F.col("distance_km") < dedupe_km))
    kept = keep_best(cand.select(F.col("zone_id").alias("node"), F.struct((-F.col("confidence")).alias("c"), "zone_id").alias("rank")), close.select(F.col("zone_id").alias("src"), F.col("r_id").alias("dst")))
    left = checkpointed(cand.join(kept.withColumnRenamed("node", "zone_id"), "zone_id"))
    other = left.select(F.col("zone_id").alias("r_id"), F.col("lat").alias("r_latitude"), F.col("lon").alias("r_longitude"), F.col("radius_m").alias("r_radius"))
    touch = (distance_join(left.select("zone_id", "lat", "lon", "radius_m"), other, 100.0, "lat", "lon")
             .filter((F.col("zone_id") < F.col("r_id")) & (F.col("distance_km") * 1000 < F.col("radius_m") + F.col("r_radius"))))
    groups = connected_components(touch.select(F.col("zone_id").alias("src"), F.col("r_id").alias("dst"))).withColumnRenamed("node", "zone_id")
    return left.join(groups, "zone_id", "left").withColumn("area", F.coalesce("component", "zone_id")).drop("component")


# ---- ionosphere -----------------------------------------------------------------------------------------------------

def tec_interpolate(points: DataFrame, tec: DataFrame, lat0: float, dlat: float, n_lat: int, lon0: float, dlon: float, n_lon: int) -> DataFrame:
    """Bilinear content and gradients at ``point_id, lat, lon`` from ``lat_idx, lon_idx, vtec``, clamped to the grid; the four
    corners are one equi join."""
    c = F.col
    fi, fj = (c("lat") - lat0) / dlat, (c("lon") - lon0) / dlon
    low = lambda f, n: F.greatest(F.lit(0), F.least(F.lit(n - 2), F.floor(f).cast("int")))
    part = lambda f, i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), f - i))
    p = points.withColumns({"i": low(fi, n_lat), "j": low(fj, n_lon)}).withColumns({"u": part(fi, c("i")), "v": part(fj, c("j"))})
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    x = p.withColumn("k", F.explode(corners)).withColumns({"lat_idx": c("i") + c("k.a"), "lon_idx": c("j") + c("k.b")}).join(tec.select("lat_idx", "lon_idx", "vtec"), ["lat_idx", "lon_idx"], "left")
    at = lambda a, b: F.coalesce(F.max(F.when((c("k.a") == a) & (c("k.b") == b), c("vtec"))), F.lit(0.0)).alias(f"v{a}{b}")
    g = x.groupBy("point_id", "lat", "lon", "u", "v").agg(*[at(a, b) for a in (0, 1) for b in (0, 1)])
    value = c("v00") * (1 - c("u")) * (1 - c("v")) + c("v01") * (1 - c("u")) * c("v") + c("v10") * c("u") * (1 - c("v")) + c("v11") * c("u") * c("v")
    g = g.withColumns({"ns": ((c("v10") + c("v11")) / 2 - (c("v00") + c("v01")) / 2) / abs(dlat), "ew": ((c("v01") + c("v11")) / 2 - (c("v00") + c("v10")) / 2) / abs(dlon)})
    total = F.sqrt(c("ns") * c("ns") + c("ew") * c("ew"))
    quality = F.when(total < 2, "nominal").when(total < 5, "elevated").when(total < 10, "degraded").otherwise("storm")
    return g.select("point_id", "lat", "lon", half_up(value, 1).alias("vtec"), half_up("ns", 2).alias("gradient_ns"), half_up("ew", 2).alias("gradient_ew"), half_up(total, 2).alias("gradient_total"), quality.alias("quality"))


def tec_grid(maps: DataFrame, lat0: float, dlat: float, n_lat: int, lon0: float, dlon: float, n_lon: int, step: int = 5) -> DataFrame:
    """``lat, lon, vtec, gradient, quality`` on a regular grid (85 south to 85 north) from the newest of the parsed ``maps``
    (``epoch, lat, lon, vtec``); nodes without content are left out. The arguments describe the maps' own grid."""
    c = F.col
    newest = maps.agg(F.max("epoch").alias("epoch"))  # one row
    nearest = lambda v: F.floor(v + 0.5).cast("int")
    tec = maps.join(F.broadcast(newest), "epoch").select(nearest((c("lat") - lat0) / dlat).alias("lat_idx"), nearest((c("lon") - lon0) / dlon).alias("lon_idx"), "vtec")
    nodes = newest.select(F.explode(F.sequence(F.lit(-85), F.lit(85), F.lit(step))).alias("lat")).select("lat", F.explode(F.sequence(F.lit(-180), F.lit(180), F.lit(step))).alias("lon"))
    points = nodes.select(F.concat_ws(":", "lat", "lon").alias("point_id"), c("lat").cast("double").alias("lat"), c("lon").cast("double").alias("lon"))
    out = tec_interpolate(points, tec, lat0, dlat, n_lat, lon0, dlon, n_lon)
    return out.filter("vtec > 0").select("lat", "lon", "vtec", c("gradient_total").alias("gradient"), "quality")


def scintillation(previous: DataFrame, current: DataFrame, minutes: float, kp: float) -> DataFrame:
    """Rate of content change and signal-fading risk at points of two interpolations; points without risk are dropped."""
    c = F.col
    rot = F.abs(c("vtec") - c("p_vtec")) / minutes
    mag = F.abs(magnetic_latitude(c("lat"), c("lon")))
    r = current.join(previous.select("point_id", c("vtec").alias("p_vtec")), "point_id").withColumns({"rot": rot, "type": F.when(mag <= 20, "equatorial").when(mag >= 60, "auroral").otherwise("mid-latitude")})
    s4 = F.least(F.lit(1.0), F.when(c("type") == "equatorial", c("rot") * 0.15).when(c("type") == "auroral", c("rot") * 0.1 + (0.2 if kp > 5 else 0.0)).otherwise(c("rot") * 0.05))
    r = r.withColumn("s4", s4)
    risk = F.when(c("s4") < 0.1, "none").when(c("s4") < 0.3, "low").when(c("s4") < 0.5, "moderate").when(c("s4") < 0.7, "high").otherwise("severe")
    return r.withColumn("risk", risk).filter("risk <> 'none'").select("point_id", half_up("rot", 3).alias("rot"), half_up("s4", 2).alias("s4_proxy"), "risk", "type")


# ---- smaller jobs ---------------------------------------------------------------------------------------------------

def constellation_health(satellites: DataFrame) -> DataFrame:
    """Healthy satellites per constellation: eccentricity under 0.02 and mean motion over 1 (``constellation, name, ecc, motion``)."""
    ok = (F.col("ecc") < 0.02) & (F.col("motion") > 1)
    return satellites.groupBy("constellation").agg(F.count("*").alias("total"), F.count_if(ok).alias("healthy"), F.array_join(F.array_sort(F.collect_list(F.when(~ok, F.col("name")))), ",").alias("alerts"))


def qc_targets(trust: DataFrame, limit: int = 10) -> DataFrame:
    """Stations on probation or untrusted, lowest score first."""
    return trust.filter("flag in ('probation', 'untrusted')").orderBy("composite_score", "station").limit(limit).select("station", "flag", "composite_score")


def latest_hours_status(hourly: DataFrame, baseline: DataFrame, top: int = 50) -> DataFrame:
    """Status of the busiest stations from their last three hourly points against their baseline (``station, mean_fix``)."""
    c = F.col
    k = F.row_number().over(W.partitionBy("station").orderBy(F.desc("hour_ms")))
    s = hourly.withColumn("k", k).groupBy("station").agg(F.sum("sessions").alias("total"), F.avg(F.when(c("k") <= 3, c("fix_rate"))).alias("recent"))
    s = s.orderBy(F.desc("total"), "station").limit(top).join(baseline.select("station", "mean_fix"), "station", "left")
    status = F.when(c("recent") == 0, "outage").when((F.coalesce("mean_fix", F.lit(0.0)) > 50) & (c("recent") < c("mean_fix") * 0.6), "degraded").otherwise("normal")
    return s.select("station", "total", half_up("recent", 2).alias("recent_fix"), status.alias("status"))


def coverage_trend(history: DataFrame, now_pct: float, as_of: int, days: int = 7) -> DataFrame:
    """Green share of the first point younger than the period against now (``ts, green_pct``)."""
    young = F.when(F.col("ts") > as_of - days * 24 * HOUR, F.col("ts"))
    return history.agg(F.min_by(F.when(young.isNotNull(), F.col("green_pct")), young).alias("before")).select("before", F.lit(now_pct).alias("now"), half_up(F.lit(now_pct) - F.col("before"), 1).alias("change"))


def cme_window_join(horizons: DataFrame, arrivals: DataFrame, hours: int = 6) -> DataFrame:
    """Forecast times (``h_id, ts``) with the arrivals (``c_id, arrival_ts``) within some hours: an equi join on slices of time."""
    width = hours * HOUR
    s = F.floor(F.col("ts") / width)
    left = horizons.withColumn("slice", F.explode(F.array(s - 1, s, s + 1)))
    right = arrivals.withColumn("slice", F.floor(F.col("arrival_ts") / width))
    return left.join(right, "slice").filter(F.abs(F.col("ts") - F.col("arrival_ts")) <= width).select("h_id", "c_id", ((F.col("arrival_ts") - F.col("ts")) / HOUR).alias("offset_h"))


def locate_probes(probes: DataFrame, stations: DataFrame, limit: int = 50) -> DataFrame:
    """The latest probe results (``probe_id, station, ts``) with the place of their station."""
    return probes.orderBy(F.desc("ts"), "probe_id").limit(limit).join(stations.select(F.col("name").alias("station"), "latitude", "longitude"), "station")


def job_summary(df: DataFrame, by: str) -> DataFrame:
    """Rows per value of a column, with their share of all in percent."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(F.col(by).alias("value"), "n", half_up(F.col("n") / F.col("total") * 100, 1).alias("pct"))


def probe_receiver_class(messages: Column, receiver: Column) -> Column:
    """Struct ``receiver_class, constellations`` from an array of correction message ids; a receiver name wins."""
    decade = F.transform(messages, lambda m: F.floor(m / 10) * 10)
    names = ((1070, "GPS"), (1080, "GLO"), (1090, "GAL"), (1110, "QZSS"), (1120, "BDS"))
    systems = F.array_compact(F.array(*[F.when(F.array_contains(decade, F.lit(d).cast("bigint")), n) for d, n in names]))
    has = lambda kind: F.exists(messages, lambda m: (m % 10 == kind) & m.between(1071, 1127))
    count = F.size(systems)
    inferred = (F.when(has(7) & (count >= 4), "SURVEY_GRADE_PROBED").when(has(7) & (count >= 3), "PROFESSIONAL_PROBED").when(has(5), "CONSUMER_GOOD_PROBED")
                .otherwise("CONSUMER_BASIC_PROBED"))
    return F.struct(F.when(F.coalesce(receiver, F.lit("")) != "", receiver).otherwise(inferred).alias("receiver_class"), systems.alias("constellations"))


def top_by_sessions(sessions: DataFrame, as_of: int, hours: int = 24, limit: int = 50) -> DataFrame:
    return sessions.filter(between(as_of - hours * HOUR) & has_station()).groupBy("station").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "station").limit(limit)
