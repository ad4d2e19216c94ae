"""Geofences, service zones, gap filling and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.classify import any_of, classify_hardware
from plumbline.functions.geo import DEGREE_KM, distance_join, haversine_km, nearest_join
from plumbline.functions.graph import checkpointed
from plumbline.functions.rules import DAY, HOUR, OVERLAY, PRIMARY, between, clean_sessions, half_up, has_position, online

#: Geofences are met in buckets of one degree, those wider than so many degrees in buckets of the coarse size.
WIDE_DEGREES, COARSE_DEGREES = 30, 15


def in_polygon(lat: Column, lon: Column, points: Column) -> Column:
    """Even-odd rule over an array of ``[latitude, longitude]``; the edge from the last to the first point counts."""
    last = F.element_at(points, -1)
    zero = F.struct(F.lit(False).alias("inside"), last.alias("previous"))

    def edge(acc: Column, p: Column) -> Column:
        yi, xi, yj, xj = p[0], p[1], acc["previous"][0], acc["previous"][1]
        hit = ((yi > lat) != (yj > lat)) & (lon < (xj - xi) * (lat - yi) / (yj - yi) + xi)
        return F.struct((acc["inside"] != F.coalesce(F.when((yi > lat) != (yj > lat), hit), F.lit(False))).alias("inside"), p.alias("previous"))

    return F.aggregate(points, zero, edge, lambda acc: acc["inside"])


def point_in_geofence(points: DataFrame, zones: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Every point with every enabled zone that holds it.

    ``zones`` has ``zone_id, enabled, fence_type ('circle' or 'polygon'), lat, lon, radius_m, points``. Zones are cut
    into buckets of their bounding box, of one degree or, for wide zones, of fifteen, and met by an equi join on them;
    longitudes wrap at the antimeridian. A zone has at most some 900 fine or 288 coarse buckets.
    """
    ring = F.col("points")
    reach = F.col("radius_m") / 1000 / DEGREE_KM
    wide_lon = reach / F.greatest(F.lit(0.05), F.cos(F.radians(F.least(F.lit(89.0), F.abs("lat") + reach))))
    pick = lambda k, f: f(F.transform(ring, lambda p: p[k]))
    circle = F.col("fence_type") == "circle"
    polar = circle & (F.abs("lat") + reach >= 88)  # holds every longitude near a pole
    box = {"_s": F.when(circle, F.col("lat") - reach).otherwise(pick(0, F.array_min)), "_n": F.when(circle, F.col("lat") + reach).otherwise(pick(0, F.array_max)),
           "_w": F.when(polar, -180.0).when(circle, F.col("lon") - wide_lon).otherwise(pick(1, F.array_min)),
           "_e": F.when(polar, 180.0).when(circle, F.col("lon") + wide_lon).otherwise(pick(1, F.array_max))}
    boxed = zones.filter("enabled").withColumns(box).withColumns({"_s": F.greatest(F.lit(-90.0), "_s"), "_n": F.least(F.lit(90.0), "_n")})
    wide = (F.col("_n") - F.col("_s") > WIDE_DEGREES) | (F.col("_e") - F.col("_w") > WIDE_DEGREES)
    fence = [c for c in zones.columns if c != "enabled"]
    inside = F.when(F.col("fence_type") == "circle", haversine_km(F.col(lat), F.col(lon), F.col("lat"), F.col("lon")) * 1000 <= F.col("radius_m")).otherwise(
        F.when(F.size("points") >= 3, in_polygon(F.col(lat), F.col(lon), F.col("points"))).otherwise(False))
    at = lambda x, degrees: F.floor(x / degrees).cast("int")

    def cells(df: DataFrame, degrees: int) -> DataFrame:
        around = 360 // degrees
        west, east = at(F.col("_w"), degrees), at(F.col("_e"), degrees)
        columns = F.array_distinct(F.transform(F.sequence(west, F.least(east, west + around)), lambda c: F.pmod(c + around // 2, F.lit(around))))
        return (df.withColumn("_row", F.explode(F.sequence(at(F.col("_s"), degrees), at(F.col("_n"), degrees)))).withColumn("_column", F.explode(columns))
                .select(*fence, F.lit(degrees).alias("_size"), "_row", "_column"))

    level = lambda degrees: F.struct(F.lit(degrees).alias("size"), at(F.col(lat), degrees).alias("row"),
                                     F.pmod(at(F.col(lon), degrees) + 180 // degrees, F.lit(360 // degrees)).alias("column"))
    usable = boxed.filter("_s <= _n and _w <= _e")
    buckets = cells(usable.filter(~wide), 1).unionByName(cells(usable.filter(wide), COARSE_DEGREES))
    here = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    placed = here.select("*", F.explode(F.array(level(1), level(COARSE_DEGREES))).alias("_at")).select(
        *here.columns, F.col("_at.size").alias("_size"), F.col("_at.row").alias("_row"), F.col("_at.column").alias("_column"))
    return placed.join(buckets, ["_size", "_row", "_column"]).drop("_size", "_row", "_column").filter(inside)


def zone_integrity(zones: DataFrame, sessions: DataFrame, trust: DataFrame, as_of: int) -> DataFrame:
    """Per zone with recent sessions: 40 fix + 30 trust + 20 stations + 10 coherence, and the trend against the day before."""
    rows = clean_sessions(sessions, position=True).filter(between(as_of - 24 * HOUR))
    hits = checkpointed(point_in_geofence(rows.select("id", "station", "username", "fix_rate", "login_time", "latitude", "longitude"), zones))
    fix, late = F.coalesce("fix_rate", F.lit(0.0)), F.col("login_time") >= as_of - 6 * HOUR
    stats = hits.groupBy("zone_id").agg(
        F.count_if(late).alias("active_sessions"), F.avg(F.when(late, fix)).alias("fix"), F.stddev_pop(F.when(late, fix)).alias("spread"),
        F.count_distinct(F.when(late, F.col("username"))).alias("active_users"), F.count_if(~late).alias("n_before"), F.avg(F.when(~late, fix)).alias("before"))
    trusts = (hits.filter(late).select("zone_id", "station").distinct().join(trust.select("station", "composite_score"), "station", "left")
              .groupBy("zone_id").agg(F.avg(F.coalesce("composite_score", F.lit(0.5))).alias("trust"), F.count("*").alias("stations")))
    coherence = F.when(F.col("active_sessions") < 5, 0.75).otherwise(F.greatest(F.lit(0.0), 1 - F.col("spread") / 50))
    score = half_up(F.least(F.lit(1.0), F.col("fix") / 100) * 40 + F.col("trust") * 30 + F.least(F.lit(1.0), F.col("stations") / 5) * 20 + coherence * 10)
    enough = F.col("n_before") >= 10
    trend = F.when(enough & (F.col("fix") > F.col("before") * 1.05), "improving").when(enough & (F.col("fix") < F.col("before") * 0.95), "declining").otherwise("stable")
    return stats.join(trusts, "zone_id").select("zone_id", F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)).alias("integrity_score"), half_up("fix", 1).alias("mean_fix_rate"),
                                                "active_sessions", "active_users", half_up("trust", 3).alias("trust_avg"), trend.alias("trend"))


def stations_in_zones(zone_stations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions of every station of every zone; ``zone_stations`` has ``zone_id, stations array<string>``."""
    return zone_stations.select("zone_id", F.explode("stations").alias("station")).join(sessions, "station")


def session_feedback(zone_stations: DataFrame, sessions: DataFrame, as_of: int, hours: int = 24, least: int = 5) -> DataFrame:
    """Grade, issues and advice for each zone with enough sessions; the p10 is the value at index floor(n / 10)."""
    fix = F.coalesce("fix_rate", F.lit(0.0))
    rows = stations_in_zones(zone_stations, clean_sessions(sessions).filter(between(as_of - hours * HOUR))).withColumn("fix", fix)
    # The p10 counts values: a zone has as many rows in the window as different fix rates.
    values = rows.groupBy("zone_id", "fix").agg(F.count("*").alias("k"))
    zone = W.partitionBy("zone_id")
    upto = values.withColumns({"upto": F.sum("k").over(zone.orderBy("fix")), "of": F.sum("k").over(zone)})
    low = upto.filter(F.col("upto") > F.floor(F.col("of") * 0.1)).groupBy("zone_id").agg(F.min("fix").alias("p10"))
    stats = (rows.groupBy("zone_id").agg(F.count("*").alias("session_count"), F.count_distinct("username").alias("unique_users"), F.avg("fix").alias("mean"))
             .filter(F.col("session_count") >= least).join(low, "zone_id"))
    per = rows.groupBy("zone_id", "station").agg(F.avg("fix").alias("avg"), F.count("*").alias("n"))
    size = W.partitionBy("zone_id")
    halves = (per.withColumns({"k": F.row_number().over(size.orderBy(F.desc("n"), "station")), "of": F.count("*").over(size)})
              .groupBy("zone_id").agg(F.max("of").alias("stations"), F.avg(F.when(F.col("k") <= F.ceil(F.col("of") / 2), F.col("avg"))).alias("core"),
                                      F.avg(F.when(F.col("k") > F.ceil(F.col("of") / 2), F.col("avg"))).alias("edge")))
    j = stats.join(halves, "zone_id", "left")
    c = F.col
    edge_drop = F.coalesce((c("stations") >= 3) & (c("session_count") >= 20) & (c("core") - c("edge") > 20), F.lit(False))
    low10 = c("p10") < 10
    grade = F.when(c("mean") >= 85, "A").when(c("mean") >= 70, "B").when(c("mean") >= 50, "C").when(c("mean") >= 30, "D").otherwise("F")
    issues = F.array_compact(F.array(F.when(c("mean") < 30, "critical").when(c("mean") < 50, "poor"), F.when(low10, "low_p10"), F.when(edge_drop, "edge_drop")))
    advice = F.when(c("mean") < 30, "disable").when(c("mean") < 50, "adjust_priority").when(low10, "investigate").when(edge_drop, "expand_overlap").otherwise("keep")
    return j.select("zone_id", "session_count", "unique_users", half_up("mean", 1).alias("mean_fix_rate"), half_up("p10", 1).alias("p10_fix_rate"), grade.alias("quality_grade"),
                    F.array_join(issues, ",").alias("issues"), advice.alias("recommendation"))


def stations_outside_regions(stations: DataFrame, circles: DataFrame) -> DataFrame:
    """Stations in none of the circles (``c_id, c_lat, c_lon, radius_km``): a distance anti join by buckets."""
    zones = circles.select(F.col("c_id").alias("zone_id"), F.lit(True).alias("enabled"), F.lit("circle").alias("fence_type"), F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"),
                           (F.col("radius_km") * 1000).alias("radius_m"), F.expr("cast(null as array<array<double>>)").alias("points"))
    inside = point_in_geofence(stations.select("name", "latitude", "longitude"), zones).select("name").distinct()
    return stations.join(inside, "name", "left_anti")


def uncovered_sessions(sessions: DataFrame, stations: DataFrame, as_of: int, days: int = 14, km: float = 40.0, least: int = 2) -> DataFrame:
    """One-degree cells of sessions without a station within ``km``; each cell shows its latest session's position.

    The stations' places tell for fine cells whether one of them is near from everywhere in the cell (then all of its sessions are
    covered), or which of them may be near from a part of it; a session of such a cell is compared with these places alone, and
    sessions of all other cells are far from every station. Sessions are read once and meet at most one row of a cell.
    """
    c = F.col
    rows = sessions.filter(between(as_of - days * DAY) & has_position())
    flat = lambda lat, lon, p_lat, p_lon: F.sqrt(F.pow((lat - p_lat) * 111.0, F.lit(2.0)) + F.pow((lon - p_lon) * 111.0 * F.cos(F.radians(lat)), F.lit(2.0)))
    side = km / 111.0 / 8
    places = stations.filter(has_position() & c("longitude").isNotNull()).select(c("latitude").alias("p_lat"), c("longitude").alias("p_lon")).distinct()
    span = lambda x, by: F.sequence(F.floor((x - by) / side) - 1, F.floor((x + by) / side) + 1)
    narrow = F.cos(F.radians(F.least(F.lit(90.0), F.abs("p_lat") + km / 111.0 + 2 * side)))
    # Near a pole a session is near every longitude: columns are bounded by those of the globe.
    wide = F.least(F.lit(360.0), km / 111.0 / F.greatest(narrow, F.lit(1e-9)))
    reached = (places.withColumn("i", F.explode(span(c("p_lat"), F.lit(km / 111.0)))).withColumn("j", F.explode(span(c("p_lon"), wide))))
    # Everywhere in a cell the squared distance is convex in latitude and longitude apart, up to the shrinking of degrees,
    # which is taken at its least and its most.
    south, west = c("i") * side, c("j") * side
    low, high = F.least(F.abs(south), F.abs(south + side)), F.least(F.lit(90.0), F.greatest(F.abs(south), F.abs(south + side)))
    cos_most, cos_least = F.when(south * (south + side) <= 0, 1.0).otherwise(F.cos(F.radians(low))), F.cos(F.radians(high))
    most = lambda x, a: F.greatest(F.abs(x - a), F.abs(x - a - side))
    least_ = lambda x, a: F.greatest(a - x, x - a - side, F.lit(0.0))
    away = lambda f, cos: F.sqrt(F.pow(f(c("p_lat"), south) * 111.0, F.lit(2.0)) + F.pow(f(c("p_lon"), west) * 111.0 * cos, F.lit(2.0)))
    touched = reached.withColumns({"most": away(most, cos_most), "least": away(least_, cos_least)}).filter(c("least") <= km + 1e-6)
    whole = F.max(c("most") <= km - 1e-6)
    inner = touched.groupBy("i", "j").agg(whole.alias("whole"))
    partly = touched.join(inner.filter("not whole").select("i", "j"), ["i", "j"]).groupBy("i", "j").agg(F.collect_list(F.struct("p_lat", "p_lon")).alias("near"))
    cells = checkpointed(inner.join(partly, ["i", "j"], "left"))
    placed = rows.select("id", "login_time", "latitude", "longitude", F.floor(c("latitude") / side).alias("i"), F.floor(c("longitude") / side).alias("j"))
    covered = c("whole") | F.exists("near", lambda p: flat(c("latitude"), c("longitude"), p["p_lat"], p["p_lon"]) <= km)
    far = placed.join(cells, ["i", "j"], "left").filter(~F.coalesce(covered, F.lit(False)))
    latest = F.max(F.struct("login_time", "id", "latitude", "longitude"))
    return (far.groupBy(F.floor("latitude").alias("row"), F.floor("longitude").alias("column")).agg(F.count("*").alias("sessions"), latest.alias("x"))
            .filter(F.col("sessions") >= least).select("row", "column", "sessions", half_up("x.latitude", 4).alias("lat"), half_up("x.longitude", 4).alias("lon")))


def nearest_primary(stations: DataFrame, scores: DataFrame, trust: DataFrame) -> DataFrame:
    """Overlay stations with their nearest primary station and its marks."""
    overlay = stations.filter((F.col("network") == OVERLAY) & has_position())
    primary = (stations.filter((F.col("network") == PRIMARY) & has_position()).join(scores.select(F.col("station_name").alias("name"), "uq_score"), "name", "left")
               .join(trust.select(F.col("station").alias("name"), "composite_score"), "name", "left")
               .select(F.col("name").alias("primary"), F.col("latitude").alias("r_latitude"), F.col("longitude").alias("r_longitude"),
                       F.coalesce("uq_score", F.lit(0.5)).alias("p_uq"), F.coalesce("composite_score", F.lit(0.5)).alias("p_trust")))
    return nearest_join(overlay, primary, "name", "primary").join(primary.select("primary", "p_uq", "p_trust"), "primary", "left")


def gap_candidates(stations: DataFrame, scores: DataFrame, trust: DataFrame, validation: DataFrame) -> DataFrame:
    """Overlay stations that can fill gaps of the primary network, with reason, score, priority and radius.

    A gap is a primary station over 40 km away, or over 15 km away and poor (quality under 0.55) or untrusted (under
    0.40). Unknown hardware and rejected stations are left out. ``validation`` has ``station, status, fix_rate``.
    """
    hardware = classify_hardware(F.when(F.coalesce("receiver_type", F.lit("")) == "", F.col("name")).otherwise(F.col("receiver_type")), F.col("antenna_type"))
    rows = (nearest_primary(stations, scores, trust).withColumn("hw", hardware).filter("hw.hardware_class <> 'unknown'")
            .join(validation.select(F.col("station").alias("name"), F.col("status").alias("v_status"), F.col("fix_rate").alias("v_fix")), "name", "left"))
    c = F.col
    km = F.coalesce("distance_km", F.lit(999.0))
    quality, trusted = F.coalesce("p_uq", F.lit(0.0)), F.coalesce("p_trust", F.lit(0.0))
    reason = F.when(km > 40, "no_primary").when((quality < 0.55) & (km > 15), "primary_poor").when((trusted < 0.4) & (km > 15), "primary_untrusted")
    status = F.coalesce("v_status", F.lit("untested"))
    kind = c("hw.hardware_class")
    priority = (F.when(kind == "survey_grade", F.when(status == "confirmed", 10).when(status == "live_testing", 20).otherwise(15))
                .when(kind == "professional", F.when(status == "confirmed", 15).otherwise(25)).otherwise(F.when(status == "confirmed", 20).otherwise(35)))
    proof = F.when((status == "confirmed") & (F.coalesce("v_fix", F.lit(0.0)) != 0), c("v_fix") / 100 * 0.1).when(status == "live_testing", 0.05).otherwise(0.0)
    severity = F.when(km > 100, 1.0).when(km > 60, 0.8).when(km > 40, 0.6).when(km > 20, 0.3).otherwise(0.1)
    score = half_up(F.least(F.lit(1.0), c("hw.confidence") * 0.4 + severity * 0.3 + (1 - quality) * 0.2 + proof), 2)
    return rows.withColumns({"reason": reason, "status_v": status}).filter(c("reason").isNotNull() & (c("status_v") != "rejected")).select(
        "name", "latitude", "longitude", "primary", half_up(km, 1).alias("primary_km"), "reason", kind.alias("hardware_class"), score.alias("gap_fill_score"), priority.alias("priority"),
        half_up(F.least(F.lit(35000.0), km * 500)).alias("radius_m"), ((score >= 0.6) | (kind == "survey_grade")).alias("enabled"), c("status_v").alias("validation_status"))


def gap_regions(candidates: DataFrame, km: float = 30.0) -> DataFrame:
    """Regions of gap candidates, as a pass in the order of names would form them: a candidate under ``km`` from an earlier
    region's centre joins the first such region, others are the centre of a new one. ``region`` is the centre's name."""
    from plumbline.functions.greedy import keep_best

    c = F.col
    rows = checkpointed(candidates)
    right = rows.select(c("name").alias("r_name"), c("latitude").alias("r_latitude"), c("longitude").alias("r_longitude"))
    close = checkpointed(distance_join(rows.select("name", "latitude", "longitude"), right, km).filter((c("distance_km") < km) & (c("name") != c("r_name"))).select("name", "r_name"))
    centres = checkpointed(keep_best(rows.select(c("name").alias("node"), c("name").alias("rank")), close.filter("name < r_name").select(c("name").alias("src"), c("r_name").alias("dst"))))
    joined = close.join(centres.select(c("node").alias("r_name")), "r_name").groupBy("name").agg(F.min("r_name").alias("region"))
    placed = rows.join(centres.select(c("node").alias("name"), F.lit(True).alias("centre")), "name", "left").join(joined, "name", "left").withColumn(
        "region", F.when(c("centre"), c("name")).otherwise(c("region")))
    own = placed.filter("centre").select("region", "latitude", "longitude", "reason", "primary_km", half_up(F.least(F.lit(40.0), c("primary_km") * 0.6), 1).alias("radius_km"))
    best = F.max(F.struct("gap_fill_score", (-c("priority")).alias("p"), "name"))
    stats = placed.groupBy("region").agg(F.count("*").alias("candidates"), F.max("gap_fill_score").alias("best_score"), F.count_if(F.col("hardware_class") == "survey_grade").alias("survey_grade"),
                                         F.count_if("enabled").alias("enabled_zones"), best["name"].alias("best_candidate"))
    return own.join(stats, "region").withColumn("fillable", c("best_score") >= 0.5)


def probe_targets(stations: DataFrame, scores: DataFrame, trust: DataFrame, kp: float = 0.0, limit: int | None = 50) -> DataFrame:
    """Overlay stations worth a probe: gaps first, farthest first. Storms shorten the distance that counts as a gap."""
    gap = 20.0 if kp >= 7 else 28.0 if kp >= 5 else 34.0 if kp >= 4 else 40.0
    km = F.coalesce("distance_km", F.lit(float("inf")))
    reason = F.when(km > gap, "primary_gap").when((F.coalesce("p_uq", F.lit(0.0)) < 0.4) & (km < 80), "potential_upgrade")
    out = nearest_primary(stations, scores, trust).withColumn("reason", reason).filter("reason is not null").select("name", "reason", half_up("distance_km", 1).alias("primary_km"), "p_uq")
    return out if limit is None else out.orderBy(F.when(F.col("reason") == "primary_gap", 0).otherwise(1), F.desc("primary_km"), "name").limit(limit)


def zone_changes(previous: DataFrame, current: DataFrame, metric: str = "quality", moved: float = 0.05) -> DataFrame:
    """``zone_id, change``: added, removed or updated (the metric moved by more than ``moved``)."""
    p = previous.select("zone_id", F.col(metric).alias("p"), F.lit(True).alias("in_p"))
    q = current.select("zone_id", F.col(metric).alias("q"), F.lit(True).alias("in_q"))
    change = F.when(F.col("in_p").isNull(), "added").when(F.col("in_q").isNull(), "removed").when(F.abs(F.col("p") - F.col("q")) > moved, "updated")
    return p.join(q, "zone_id", "full_outer").withColumn("change", change).filter("change is not null").select("zone_id", "change")


def merge_zones(manual: DataFrame, generated: DataFrame) -> DataFrame:
    """Manual zones and, for all other ids, the generated ones."""
    return manual.unionByName(generated.join(manual.select("zone_id"), "zone_id", "left_anti"))


def coverage_report(cells: DataFrame, stations: DataFrame, km: float = 50.0, least: int = 2, limit: int | None = 50) -> DataFrame:
    """Whole-degree groups of cells without full coverage and what to do: deploy a survey-grade overlay station nearby,
    validate another one, or find a partner; by priority, then by cells concerned."""
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    bad = (cells.filter("zone_tier <> 'full_rtk'").groupBy(whole("latitude").alias("row"), whole("longitude").alias("column"))
           .agg(F.count("*").alias("cells"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.avg("quality_score").alias("quality")).filter(F.col("cells") >= least)
           .withColumn("key", F.concat_ws(":", "row", "column")))
    overlay = stations.filter((F.col("network") == OVERLAY) & online()).select(
        F.col("name").alias("overlay"), F.upper(F.coalesce("receiver_type", F.lit(""))).alias("receiver"), F.col("latitude").alias("r_latitude"), F.col("longitude").alias("r_longitude"))
    near = (distance_join(bad.select("key", "latitude", "longitude"), overlay, km).filter(F.col("distance_km") < km).groupBy("key")
            .agg(F.min(F.struct("distance_km", "overlay", "receiver")).alias("best")))
    survey = any_of(F.col("best.receiver"), ("LEICA", "TRIMBLE", "SEPT", "CHCNAV", "SURVEY_GRADE"))
    none = F.col("best").isNull()
    rank = F.when(F.col("quality") < 0.25, 0).when(none | (F.col("quality") < 0.5), 1).otherwise(2)
    out = bad.join(near, "key", "left").select(
        "row", "column", "cells", half_up("quality", 2).alias("mean_quality"), F.col("best.overlay").alias("overlay"), half_up("best.distance_km", 1).alias("overlay_km"),
        F.when(none, "find_partner").when(survey, "deploy_overlay").otherwise("validate_overlay").alias("action"), rank.alias("priority"))
    return out if limit is None else out.orderBy("priority", F.desc("cells"), "row", "column").limit(limit)


def diversity_cap(zones: DataFrame, limit: int | None = None, step: int = 10) -> DataFrame:
    """Zones with their ``turn``, round-robin over grid cells; within a cell by priority, confidence, id. Without a ``limit`` all
    zones, with one so many of them in the order of turns, then cells."""
    cell = W.partitionBy(F.floor(F.col("lat") / step), F.floor(F.col("lon") / step)).orderBy("priority", F.desc("confidence"), "zone_id")
    turns = zones.withColumn("turn", F.row_number().over(cell))
    return turns if limit is None else turns.orderBy("turn", F.floor(F.col("lat") / step), F.floor(F.col("lon") / step)).limit(limit)
