"""Anomaly detectors: filter, aggregate, compare, emit anomaly rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.geo import DEGREE_KM, distance_join, half_degree_cell, haversine_km, region_by_circle
from plumbline.functions.graph import checkpointed, connected_components
from plumbline.functions.rules import (HOUR, OVERLAY, anomaly_id, between, clean_sessions, half_up, has_position, has_station, nonzero_position,
                                       not_noise, positive)


MINUTE = 60_000


def fix() -> Column:
    return F.coalesce("fix_rate", F.lit(0.0))


def users() -> Column:
    return F.count_distinct("username").alias("affected_users")


def deviation(now: Column, before: Column) -> Column:
    return half_up((now - before) / before * 100, 1)


def _two_windows(sessions: DataFrame, as_of: int) -> DataFrame:
    """Six-hour and seven-day statistics of each station, from one scan and one shuffle."""
    recent = F.col("login_time") >= as_of - 6 * HOUR
    now, old = (lambda v: F.when(recent, v)), (lambda v: F.when(~recent, v))
    return clean_sessions(sessions).filter(between(as_of - 168 * HOUR)).groupBy("station").agg(
        F.count_if(recent).alias("n"), F.avg(now(fix())).alias("fix"), F.avg(now(positive("avg_age"))).alias("age"),
        F.count_distinct(now(F.col("username"))).alias("affected_users"), F.max(now(F.col("login_time"))).alias("last_ms"),
        F.count_if(~recent).alias("b_n"), F.coalesce(F.avg(old(F.col("fix_rate"))), F.lit(0.0)).alias("b_fix"),
        F.coalesce(F.avg(old(F.col("avg_age"))), F.lit(0.0)).alias("b_age"), F.count_distinct(old(F.col("username"))).alias("b_users"))


def fix_rate_drop(sessions: DataFrame, as_of: int) -> DataFrame:
    """Stations whose six-hour mean fell under 60 % of a good seven-day baseline."""
    hit = _two_windows(sessions, as_of).filter((F.col("n") > 0) & (F.col("b_n") >= 10) & (F.col("b_fix") > 50) & (F.col("fix") < F.col("b_fix") * 0.6))
    level = F.when(F.col("fix") < 30, "critical").when(F.col("fix") < 50, "warning").otherwise("info")
    return hit.select(F.lit("fix_rate_drop").alias("type"), level.alias("severity"), "station", "affected_users", half_up("fix", 1).alias("current_value"),
                      half_up("b_fix", 1).alias("baseline_value"), deviation(F.col("fix"), F.col("b_fix")).alias("deviation_pct"), F.col("last_ms").alias("detected_ms"))


def age_spike(sessions: DataFrame, as_of: int) -> DataFrame:
    """Stations whose mean positive correction age is over three times the baseline."""
    hit = _two_windows(sessions, as_of).filter((F.col("b_n") >= 10) & (F.col("b_age") > 0) & (F.col("age") > F.col("b_age") * 3))
    level = F.when(F.col("age") > F.col("b_age") * 5, "critical").otherwise("warning")
    return hit.select(F.lit("age_spike").alias("type"), level.alias("severity"), "station", "affected_users", half_up("age", 1).alias("current_value"),
                      half_up("b_age", 1).alias("baseline_value"), deviation(F.col("age"), F.col("b_age")).alias("deviation_pct"))


def latest_status(log: DataFrame) -> DataFrame:
    """``station, last_status``: the newest entry per station (ties: largest event id)."""
    return log.groupBy(F.col("station_name").alias("station")).agg(F.max_by("status", F.struct("recorded_at", "event_id")).alias("last_status"))


def station_outage(sessions: DataFrame, log: DataFrame, as_of: int, silent_min: int = 30) -> DataFrame:
    """Busy stations that were active within six hours, fell silent, and whose newest status is not online."""
    quiet = (F.col("n") > 0) & (F.col("last_ms") < as_of - silent_min * MINUTE) & (F.col("b_n") >= 20) & (F.col("b_users") >= 3)
    level = F.when(F.col("b_users") >= 10, "critical").otherwise("warning")
    return (_two_windows(sessions, as_of).filter(quiet).join(latest_status(log), "station").filter(~F.col("last_status").isin("ONLINE", "ACTIVE"))
            .select(F.lit("station_outage").alias("type"), level.alias("severity"), "station", F.col("b_users").alias("affected_users"), F.col("b_n").alias("baseline_value")))


def mass_disconnect(sessions: DataFrame, as_of: int, window_min: int = 360, under: float = 30, least: int = 5, critical: int = 10) -> DataFrame:
    """Half-degree cells where many users lost their fix. The short form is ``window_min=5, under=25, least=3, critical=8``."""
    hit = clean_sessions(sessions).filter(between(as_of - window_min * MINUTE) & (fix() < under) & nonzero_position())
    return (hit.groupBy(half_degree_cell("latitude").alias("lat"), half_degree_cell("longitude").alias("lon"))
            .agg(users(), half_up(F.avg(fix()), 1).alias("current_value"), F.max("login_time").alias("detected_ms")).filter(F.col("affected_users") >= least)
            .select(F.lit("mass_disconnect").alias("type"), F.when(F.col("affected_users") >= critical, "critical").otherwise("warning").alias("severity"),
                    "lat", "lon", region_by_circle(F.col("lat"), F.col("lon")).alias("region"), "affected_users", "current_value", "detected_ms"))


def regional_degradation(sessions: DataFrame, as_of: int) -> DataFrame:
    region = region_by_circle(F.col("latitude"), F.col("longitude")).alias("region")
    now = (clean_sessions(sessions).filter(between(as_of - 6 * HOUR) & nonzero_position()).groupBy(region).agg(F.count("*").alias("n"), F.avg(fix()).alias("fix"), users()))
    old = (sessions.filter(between(as_of - 24 * HOUR, as_of - 6 * HOUR) & has_position() & has_station()).groupBy(region)
           .agg(F.count("*").alias("b_n"), F.avg(fix()).alias("b_fix")))
    hit = now.join(old, "region").filter((F.col("n") >= 10) & (F.col("b_n") >= 20) & (F.col("b_fix") > 60) & (F.col("fix") < F.col("b_fix") * 0.7))
    return hit.select(F.lit("regional_degradation").alias("type"), F.when(F.col("fix") < 40, "critical").otherwise("warning").alias("severity"), "region",
                      "affected_users", half_up("fix", 1).alias("current_value"), half_up("b_fix", 1).alias("baseline_value"),
                      deviation(F.col("fix"), F.col("b_fix")).alias("deviation_pct"))


def adaptive_thresholds(kp: Column) -> Column:
    """Detector limits by geomagnetic activity; storms loosen them."""
    names = ("cusum_h", "cusum_k", "ewma_fix", "ewma_age", "drop_ratio")
    band = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(names, v)])
    return (F.when(kp >= 7, band(8.0, 0.75, 30, 5.0, 0.4)).when(kp >= 5, band(6.5, 0.6, 22, 4.0, 0.5))
            .when(kp >= 4, band(5.5, 0.55, 18, 3.5, 0.55)).otherwise(band(5.0, 0.5, 15, 3.0, 0.6)))


def cusum_counters(sessions: DataFrame, as_of: int, kp: float = 0.0, bucket_min: int = 30, hours: int = 6, baseline_h: int = 24, least: int = 3) -> DataFrame:
    """Sequential change detection per station over buckets of the recent hours, as one fold per station.

    The baseline is the mean of the hours before and stays frozen; sigma is ``max(5, 15 %)``. A bucket alarms
    when the lower sum exceeds H from the third bucket on, which resets the sum. The smoothed fix rate alarms
    from the fifth bucket on when it lies more than the threshold under a baseline over 50. A station has as
    many array entries as there are buckets, whatever its number of sessions.
    """
    start, width = as_of - hours * HOUR, bucket_min * MINUTE
    rows = clean_sessions(sessions)
    base = (rows.filter(between(start - baseline_h * HOUR, start)).groupBy("station").agg(F.avg(fix()).alias("base"), F.count("*").alias("b_n"))
            .filter(F.col("b_n") >= least))
    buckets = (rows.filter(between(start, as_of)).groupBy("station", F.floor((F.col("login_time") - start) / width).cast("int").alias("k"))
               .agg(F.avg(fix()).alias("fix")).groupBy("station").agg(F.array_sort(F.collect_list(F.struct("k", "fix"))).alias("series")))
    limits = adaptive_thresholds(F.lit(kp))
    joined = buckets.join(base, "station").withColumn("lim", limits).withColumn("sigma", F.greatest(F.lit(5.0), F.col("base") * 0.15))
    zero = F.struct(F.lit(0.0).alias("low"), F.col("base").alias("ewma"), F.lit(0).alias("count"), F.lit(0).alias("cusum_alarms"), F.lit(0).alias("ewma_alarms"))

    def step(acc: Column, x: Column) -> Column:
        count = acc["count"] + 1
        low = F.greatest(F.lit(0.0), acc["low"] - (x["fix"] - F.col("base")) / F.col("sigma") - F.col("lim.cusum_k"))
        alarm = (low > F.col("lim.cusum_h")) & (count >= 3)
        ewma = x["fix"] * 0.2 + acc["ewma"] * 0.8
        drop = (count >= 5) & (F.col("base") > 50) & (F.col("base") - ewma > F.col("lim.ewma_fix"))
        return F.struct(F.when(alarm, 0.0).otherwise(low).alias("low"), ewma.alias("ewma"), count.alias("count"),
                        (acc["cusum_alarms"] + alarm.cast("int")).alias("cusum_alarms"), (acc["ewma_alarms"] + drop.cast("int")).alias("ewma_alarms"))

    return joined.withColumn("end", F.aggregate("series", zero, step)).select(
        "station", half_up("base", 3).alias("baseline"), F.col("end.count").alias("buckets"), half_up("end.low", 3).alias("s_minus"), half_up("end.ewma", 3).alias("ewma_fix"),
        F.col("end.cusum_alarms").alias("cusum_alarms"), F.col("end.ewma_alarms").alias("ewma_alarms"))


def cusum_counters_v1(sessions: DataFrame, as_of: int, bucket_min: int = 30, hours: int = 6, baseline_h: int = 24, least: int = 20) -> DataFrame:
    """The earlier detector: fix rate as in :func:`cusum_counters` with fixed limits, and an upper sum on the correction age.

    Buckets without a positive age leave the age sums as they are. Age sigma is ``max(0.5, 20 %)``; the smoothed age alarms
    from the fifth bucket on above three times its baseline.
    """
    start, width = as_of - hours * HOUR, bucket_min * MINUTE
    rows = clean_sessions(sessions)
    base = (rows.filter(between(start - baseline_h * HOUR, start)).groupBy("station").agg(
        F.avg(fix()).alias("base"), F.coalesce(F.avg(positive("avg_age")), F.lit(0.0)).alias("age_base"), F.count("*").alias("b_n")).filter(F.col("b_n") >= least))
    buckets = (rows.filter(between(start, as_of)).groupBy("station", F.floor((F.col("login_time") - start) / width).cast("int").alias("k"))
               .agg(F.avg(fix()).alias("fix"), F.coalesce(F.avg(positive("avg_age")), F.lit(0.0)).alias("age")).groupBy("station")
               .agg(F.array_sort(F.collect_list(F.struct("k", "fix", "age"))).alias("series")))
    j = buckets.join(base, "station").withColumns({"sigma": F.greatest(F.lit(5.0), F.col("base") * 0.15), "age_sigma": F.greatest(F.lit(0.5), F.col("age_base") * 0.2)})
    names = ("low", "high", "ewma", "ewma_age", "count", "age_count", "fix_alarms", "age_alarms", "ewma_fix_alarms", "ewma_age_alarms")
    zero = F.struct(*[v.alias(n) for n, v in zip(names, (F.lit(0.0), F.lit(0.0), F.col("base"), F.col("age_base"), *[F.lit(0)] * 6))])

    def step(acc: Column, x: Column) -> Column:
        count, seen = acc["count"] + 1, (x["age"] > 0) & (F.col("age_base") > 0)
        ages = acc["age_count"] + seen.cast("int")
        low = F.greatest(F.lit(0.0), acc["low"] - (x["fix"] - F.col("base")) / F.col("sigma") - 0.5)
        high = F.when(seen, F.greatest(F.lit(0.0), acc["high"] + (x["age"] - F.col("age_base")) / F.col("age_sigma") - 0.5)).otherwise(acc["high"])
        alarm, age_alarm = (low > 5) & (count >= 3), seen & (high > 5) & (ages >= 3)
        ewma, ewma_age = x["fix"] * 0.2 + acc["ewma"] * 0.8, F.when(x["age"] > 0, x["age"] * 0.2 + acc["ewma_age"] * 0.8).otherwise(acc["ewma_age"])
        drop = (count >= 5) & (F.col("base") > 50) & (F.col("base") - ewma > 15)
        spike = (count >= 5) & (F.col("age_base") > 0) & (ewma_age > F.col("age_base") * 3)
        more = lambda n, b: acc[n] + b.cast("int")
        values = (F.when(alarm, 0.0).otherwise(low), F.when(age_alarm, 0.0).otherwise(high), ewma, ewma_age, count, ages, more("fix_alarms", alarm), more("age_alarms", age_alarm),
                  more("ewma_fix_alarms", drop), more("ewma_age_alarms", spike))
        return F.struct(*[v.alias(n) for n, v in zip(names, values)])

    end = j.withColumn("end", F.aggregate("series", zero, step))
    return end.select("station", *[half_up(F.col("end")[n], 3).alias(n) for n in names[:4]], *[F.col("end")[n].alias(n) for n in names[4:]])


def _close_blocks(blocks: DataFrame, km: float, diagonal: float, width: int) -> DataFrame:
    """Pairs ``node, r_node, later, sure`` of blocks that may hold linked points: in the same slice of time, or ``later`` by
    one slice with the nearest times at most ``width`` apart. ``sure`` pairs are so near that all their places are in reach."""
    left = blocks.select("node", "latitude", "longitude", "t1", F.explode(F.array(F.lit(0), F.lit(1))).alias("later"), "slice").withColumn("slice", F.col("slice") + F.col("later"))
    right = blocks.select(F.col("node").alias("r_node"), F.col("latitude").alias("r_latitude"), F.col("longitude").alias("r_longitude"), F.col("t0").alias("r_t0"), "slice")
    near = distance_join(left, right, km + diagonal, on=("slice",))
    in_time = F.when(F.col("later") == 0, F.col("node") < F.col("r_node")).otherwise(F.col("r_t0") - F.col("t1") <= width)
    return near.filter(in_time).select("node", "r_node", "later", (F.col("distance_km") <= km - diagonal).alias("sure"))


def interference_clusters(sessions: DataFrame, as_of: int, window_min: int = 360, km: float = 30.0, minutes: int = 10, neighbours: int = 3,
                          under: float = 25.0, least_users: int = 3) -> DataFrame:
    """Space-time clusters of degraded sessions.

    A cluster is a connected component of the graph of points at most ``km`` and ``minutes`` apart that has a
    point with at least ``neighbours`` neighbours; single points are noise. ``cluster`` is the smallest session id.

    Points are gathered in blocks, squares far smaller than the radius within one slice of time, all of whose points are
    linked; blocks are linked to blocks near enough for certain. Points themselves meet only across pairs of blocks at
    the edge of the radius that are not connected otherwise, and in components whose blocks hold too few points to tell
    the number of neighbours. So a jammed city costs as many pairs as it has blocks, however many points they hold.
    """
    c, width = F.col, minutes * MINUTE
    side = km / DEGREE_KM / 16
    diagonal = side * 2**0.5 * 111.2
    block = {"slice": F.floor(c("login_time") / width), "si": F.floor(c("latitude") / side), "sj": F.floor(c("longitude") / side)}
    points = checkpointed(clean_sessions(sessions).filter(between(as_of - window_min * MINUTE) & (fix() < under) & has_position() & c("longitude").isNotNull())
                          .select("id", "username", "login_time", "latitude", "longitude", fix().alias("fix")).withColumns(block)
                          .withColumn("node", F.concat_ws(":", "slice", "si", "sj")))
    blocks = checkpointed(points.groupBy("node", "slice", "si", "sj").agg(F.count("*").alias("n"), F.min("login_time").alias("t0"), F.max("login_time").alias("t1")).select(
        "node", "slice", "n", "t0", "t1", ((c("si") + 0.5) * side).alias("latitude"), ((c("sj") + 0.5) * side).alias("longitude")))
    pairs = checkpointed(_close_blocks(blocks, km, diagonal, width))
    groups = connected_components(pairs.filter("sure").select(c("node").alias("src"), c("r_node").alias("dst")))
    labels = checkpointed(blocks.select("node", "n").join(groups, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"))
    label = lambda name, part: labels.select(c("node").alias(name), c("part").alias(part))
    own = points.select("node", "id", "login_time", "latitude", "longitude")
    other = own.select(*(c(x).alias(f"r_{x}") for x in own.columns))
    linked = (haversine_km(c("latitude"), c("longitude"), c("r_latitude"), c("r_longitude")) <= km) & (F.abs(c("login_time") - c("r_login_time")) <= width)
    apart = pairs.filter("not sure").join(label("node", "part"), "node").join(label("r_node", "r_part"), "r_node").filter("part <> r_part")
    bridges = apart.join(own, "node").join(other, "r_node").filter(linked).select(F.least("part", "r_part").alias("src"), F.greatest("part", "r_part").alias("dst")).distinct()
    joined = connected_components(bridges).withColumnRenamed("node", "part")
    parts = checkpointed(labels.join(joined, "part", "left").select("node", "n", F.coalesce("component", "part").alias("cluster")))
    # Neighbours that a block's points have for certain: those in it, and in sure blocks of the same slice.
    sizes = parts.select(c("node").alias("r_node"), c("n").alias("r_n"))
    both = pairs.filter("sure and later = 0").select("node", "r_node")
    beside = both.unionByName(both.select(c("r_node").alias("node"), c("node").alias("r_node"))).join(sizes, "r_node").groupBy("node").agg(F.sum("r_n").alias("beside"))
    counted = parts.join(beside, "node", "left").groupBy("cluster").agg((F.max(c("n") + F.coalesce("beside", F.lit(0))) - 1).alias("certain"))
    counted = checkpointed(counted)
    few = parts.join(counted.filter(c("certain") < neighbours).select("cluster"), "cluster", "left_semi").select("node")
    within = few.select("node", c("node").alias("r_node")).unionByName(pairs.join(few, "node", "left_semi").select("node", "r_node"))
    met = within.join(own, "node").join(other, "r_node").filter(linked & (c("id") != c("r_id")))
    ends = met.select("node", "id").unionByName(met.filter("node <> r_node").select(c("r_node").alias("node"), c("r_id").alias("id")))
    full = ends.groupBy("node", "id").agg(F.count("*").alias("degree")).filter(c("degree") >= neighbours).join(parts, "node").select("cluster")
    core = counted.filter(c("certain") >= neighbours).select("cluster").unionByName(full).distinct()
    members = checkpointed(points.join(parts.select("node", "cluster").join(core, "cluster"), "node"))
    centre = members.groupBy("cluster").agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    return (members.join(centre, "cluster").withColumn("km", haversine_km(c("latitude"), c("longitude"), c("lat"), c("lon"))).groupBy(c("cluster").alias("part")).agg(
                F.min("id").alias("cluster"), F.count("*").alias("points"), users(), half_up(F.avg("fix"), 1).alias("mean_fix"), half_up(F.first("lat"), 4).alias("lat"),
                half_up(F.first("lon"), 4).alias("lon"), half_up(F.greatest(F.lit(5.0), F.max("km")), 2).alias("radius_km"))
            .filter(c("affected_users") >= least_users).drop("part"))


def with_network(sessions: DataFrame, stations: DataFrame) -> DataFrame:
    """Sessions with the network of their station, 'unknown' where there is none."""
    return sessions.join(stations.select(F.col("name").alias("station"), F.coalesce("network", F.lit("unknown")).alias("network")), "station", "left").withColumn(
        "network", F.coalesce("network", F.lit("unknown")))


def cross_network_inconsistency(sessions: DataFrame, stations: DataFrame, as_of: int, window_min: int = 360) -> DataFrame:
    """One-degree cells where the mean fix rates of two networks with three sessions each differ by over 30."""
    rows = with_network(clean_sessions(sessions, position=True).filter(between(as_of - window_min * MINUTE)), stations).filter("network <> 'unknown'")
    cells = (rows.groupBy(F.floor("latitude").alias("lat"), F.floor("longitude").alias("lon"), "network").agg(F.count("*").alias("n"), F.avg(fix()).alias("fix"))
             .filter(F.col("n") >= 3))
    b = cells.select("lat", "lon", F.col("network").alias("network_b"), F.col("n").alias("n_b"), F.col("fix").alias("fix_b"))
    pairs = cells.join(b, ["lat", "lon"]).filter((F.col("network") < F.col("network_b")) & (F.abs(F.col("fix") - F.col("fix_b")) > 30))
    low, high = F.least("fix", "fix_b"), F.greatest("fix", "fix_b")
    return pairs.select("lat", "lon", F.when(F.col("fix") < F.col("fix_b"), F.col("network")).otherwise(F.col("network_b")).alias("worse"),
                        F.when(high - low > 50, "warning").otherwise("info").alias("severity"), (F.col("n") + F.col("n_b")).alias("affected_users"),
                        half_up(low, 1).alias("current_value"), half_up(high, 1).alias("baseline_value"), deviation(low, high).alias("deviation_pct"))


KINDS = ("jamming", "spoofing", "iono", "station_fault", "multipath", "network")


def classify_interference(sessions: DataFrame, stations: DataFrame, trust: DataFrame, as_of: int, kp: float = 0.0, hour: int = 0, window_min: int = 360,
                          radius_km: float = 30.0) -> DataFrame:
    """Half-degree clusters of degraded sessions, each with the cause whose rules score most (ties: first listed).

    Confidence is the winner's share of all points, at most 0.95; clusters under 0.2 or with one user are left out.
    """
    start = as_of - window_min * MINUTE
    bad = with_network(sessions.filter(between(start) & has_station() & has_position() & (F.col("fix_rate") < 40)), stations)
    bad = bad.join(trust.select("station", "composite_score"), "station", "left").withColumns(
        {"lat": half_degree_cell("latitude"), "lon": half_degree_cell("longitude")})
    cell = ["lat", "lon"]
    known = bad.filter("network <> 'unknown'").groupBy(*cell, "network").agg(F.avg(fix()).alias("fix")).groupBy(*cell).agg(
        F.count("*").alias("networks"), (F.max("fix") - F.min("fix")).alias("gap"))
    trusts = bad.groupBy(*cell, "station").agg(F.first(F.coalesce("composite_score", F.lit(0.5))).alias("t")).groupBy(*cell).agg(F.avg("t").alias("trust_avg"), F.count("*").alias("stations"))
    stats = bad.groupBy(*cell).agg(users(), F.count("*").alias("n"), F.avg(fix()).alias("fix"), F.var_pop(fix()).alias("variance"), F.avg(positive("avg_age")).alias("age"),
                                   ((F.max("login_time") - F.min("login_time")) / MINUTE).alias("span"))
    total = bad.agg(F.count("*").alias("total"))
    base = sessions.filter(between(start - 6 * HOUR, start) & has_station()).agg(F.coalesce(F.avg(positive("avg_age")), F.lit(2.0)).alias("base_age"))
    f = (stats.join(trusts, cell).join(known, cell, "left").crossJoin(F.broadcast(base)).crossJoin(F.broadcast(total)).filter((F.col("total") >= 3) & (F.col("affected_users") >= 2))
         .withColumns({"networks": F.coalesce("networks", F.lit(0)), "ratio": F.coalesce("age", F.lit(0.0)) / F.col("base_age"), "onset": F.greatest(F.lit(1.0), F.col("span")),
                       "same": F.coalesce(F.col("networks") < 2, F.lit(True)) | (F.col("gap") < 20), "single": F.col("stations") == 1}))
    storm, commute = kp >= 5, 7 <= hour <= 9 or 17 <= hour <= 19
    pts = lambda *rules: sum((F.when(c, p).otherwise(0) for c, p in rules), F.lit(0))
    col = F.col
    marks = {
        "jamming": pts((col("onset") < 2, 3), (col("fix") < 10, 2), (F.lit(radius_km < 30) & (col("affected_users") >= 3), 2), (col("ratio") > 3, 1), (F.lit(commute), 1), (F.lit(not storm), 1)),
        "spoofing": pts(((col("fix") > 50) & (col("variance") < 100), 2), (col("ratio") < 1.5, 1), (F.lit(radius_km < 10), 1)),
        "iono": pts((F.lit(storm), 4), (F.lit(radius_km > 200), 2), (col("onset") > 30, 1), (col("same"), 2), (col("networks") > 1, 1)),
        "station_fault": pts((col("single"), 4), (col("trust_avg") < 0.4, 2), (~col("same") & (col("networks") == 1), 1)),
        "multipath": pts((col("single") & F.lit(6 <= hour <= 8 or 16 <= hour <= 18), 2), ((col("variance") > 400) & col("single"), 1)),
        "network": pts(((col("ratio") > 5) & (col("fix") > 30), 3), ((col("stations") > 10) & (col("networks") == 1), 2)),
    }
    f = f.withColumns({f"m_{k}": v for k, v in marks.items()}).withColumn("marks", F.array(*[f"m_{k}" for k in KINDS]))
    best = F.array_max("marks")
    names = F.array(*[F.lit(k) for k in KINDS])
    all_marks = F.aggregate("marks", F.lit(0), lambda a, x: a + x)
    f = f.withColumns({"classification": F.when(best > 0, F.get(names, (F.array_position("marks", best) - 1).cast("int"))).otherwise("unknown"),
                       "confidence": F.when(all_marks > 0, half_up(F.least(F.lit(0.95), best / all_marks), 2)).otherwise(0.0)})
    level = F.when((col("affected_users") >= 8) | (col("classification") == "jamming"), "critical").when(col("affected_users") >= 4, "warning").otherwise("info")
    return f.filter("confidence >= 0.2").select("lat", "lon", "classification", "confidence", level.alias("severity"), "affected_users", "stations", half_up("span").alias("duration_min"))


def predictive_alerts(sessions: DataFrame, as_of: int, recent_h: float = 1, kp_now: float = 0.0, kp_3h: float = 0.0, limit: int | None = 50) -> DataFrame:
    """Stations that got worse or better in the last hour against the five hours before, most certain first."""
    cut = as_of - int(recent_h * HOUR)
    late = F.col("login_time") >= cut
    zero = (F.col("fix_rate") == 0).cast("double")
    stats = sessions.filter(between(as_of - 6 * HOUR) & has_station()).groupBy("station").agg(
        *[F.avg(F.when(w, v)).alias(f"{p}_{n}") for p, w in (("r", late), ("o", ~late)) for n, v in (("fix", F.col("fix_rate")), ("age", F.col("avg_age")), ("zero", zero))],
        F.count_if(late).alias("r_n"), F.count_if(~late).alias("o_n")).filter((F.col("r_n") >= 3) & (F.col("o_n") >= 3))
    c = F.col

    def alert(rule: Column, name: str, trend: Column, now: Column, before: Column, change: Column, action: Column, sure: Column) -> Column:
        return F.when(rule, F.struct(F.lit(name).alias("indicator"), trend.alias("trend"), now.alias("current_value"), before.alias("previous_value"),
                                     change.alias("change_pct"), action.alias("action"), half_up(sure, 4).alias("confidence")))

    def graded(worse: Column) -> Column:
        return F.when(worse, "critical").otherwise("degrading")

    change = F.when(c("o_fix") != 0, (c("r_fix") - c("o_fix")) / c("o_fix") * 100)
    alerts = F.array_compact(F.array(
        alert((c("o_fix") > 50) & (c("r_fix") < c("o_fix") * 0.7), "fix_rate_declining", graded(c("r_fix") < 30), half_up("r_fix", 1), half_up("o_fix", 1), half_up(change, 1),
              F.when(c("r_fix") < 30, "pre_exclude").otherwise("pre_downgrade"), F.least(F.lit(0.9), c("r_n") / 20)),
        alert((c("o_age") < 5) & (c("r_age") > c("o_age") * 2), "correction_age_rising", graded(c("r_age") > 10), half_up("r_age", 2), half_up("o_age", 2),
              half_up((c("r_age") - c("o_age")) / F.greatest(F.lit(0.1), c("o_age")) * 100), F.when(c("r_age") > 10, "pre_downgrade").otherwise("monitor"), F.least(F.lit(0.8), c("r_n") / 15)),
        alert((c("o_zero") < 0.1) & (c("r_zero") > 0.3), "zero_fix_increasing", graded(c("r_zero") > 0.5), half_up(c("r_zero") * 100), half_up(c("o_zero") * 100),
              half_up((c("r_zero") - c("o_zero")) * 100), F.when(c("r_zero") > 0.5, "pre_exclude").otherwise("pre_downgrade"), F.least(F.lit(0.85), c("r_n") / 10)),
        alert((c("o_fix") < 60) & (c("r_fix") > c("o_fix") * 1.3) & (c("r_fix") > 70), "fix_rate_improving", F.lit("improving"), half_up("r_fix", 1), half_up("o_fix", 1),
              F.coalesce(half_up(change), F.lit(float("inf"))), F.lit("pre_promote"), F.least(F.lit(0.7), c("r_n") / 20))))
    rows = stats.select("station", F.explode(alerts).alias("a")).select("station", "a.*")
    worse = F.count_if(c("trend").isin("degrading", "critical")).alias("worse")
    counts = rows.agg(worse, F.count_if(c("trend") == "improving").alias("better"))
    system = lambda name, trend, now, before, action, sure: [F.lit("SYSTEM").alias("station"), F.lit(name).alias("indicator"), F.lit(trend).alias("trend"), now.alias("current_value"),
                                                            before.alias("previous_value"), F.lit(0.0).alias("change_pct"), F.lit(action).alias("action"), F.lit(sure).alias("confidence")]
    rising = int(kp_3h >= 5 and kp_3h > kp_now + 1)
    cascade = counts.withColumn("worse", c("worse") + rising).filter((c("worse") > 10) & (c("worse") > c("better") * 3)).select(
        *system("cascade_exhaustion_warning", "critical", c("worse").cast("double"), c("better").cast("double"), "investigate_systemic", 0.9))
    out = rows.unionByName(cascade)
    if rising:
        out = out.unionByName(counts.select(*system("kp_forecast_rising", "critical" if kp_3h >= 7 else "degrading", F.lit(kp_now), F.lit(kp_now), "pre_downgrade", 0.7)))
    return out if limit is None else out.orderBy(F.desc("confidence"), "station", "indicator").limit(limit)


def cross_validate_networks(sessions: DataFrame, stations: DataFrame, as_of: int, step: int = 10) -> tuple[DataFrame, DataFrame]:
    """Cells where both networks have two stations: means, agreement and winner; and stations 20 under the cell's mean."""
    per = (sessions.filter(between(as_of - 6 * HOUR) & F.col("station").isNotNull() & F.col("fix_rate").isNotNull() & not_noise()).groupBy("station")
           .agg(F.sum("fix_rate").alias("sum"), F.count("*").alias("n")))
    cell = [(F.floor(F.col(c) / step) * step).alias(a) for c, a in (("latitude", "lat"), ("longitude", "lon"))]
    placed = stations.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("network").isNotNull()).select(
        F.col("name").alias("station"), F.when(F.lower("network").contains(OVERLAY), "o").otherwise("p").alias("side"), *cell).join(per, "station", "left")
    side = lambda s, v: F.sum(F.when(F.col("side") == s, v))
    regions = placed.groupBy("lat", "lon").agg(
        F.count_if(F.col("side") == "p").alias("p_stations"), F.count_if(F.col("side") == "o").alias("o_stations"),
        *[F.coalesce(side(s, F.col(v)), F.lit(0)).alias(f"{s}_{v}") for s in "po" for v in ("sum", "n")]).filter(
            (F.col("p_stations") >= 2) & (F.col("o_stations") >= 2) & (F.col("p_n") + F.col("o_n") > 0))
    fix = {s: F.when(F.col(f"{s}_n") > 0, F.col(f"{s}_sum") / F.col(f"{s}_n")).otherwise(0.0) for s in "po"}
    delta = fix["p"] - fix["o"]
    mean = (F.col("p_sum") + F.col("o_sum")) / (F.col("p_n") + F.col("o_n"))
    compared = regions.select("lat", "lon", half_up(fix["p"], 1).alias("primary_fix"), half_up(fix["o"], 1).alias("overlay_fix"), half_up(delta, 1).alias("delta"),
                              half_up(1 - F.least(F.lit(1.0), F.abs(delta) / 50), 2).alias("agreement"),
                              F.when(F.abs(delta) < 5, "tie").when(delta > 0, "primary").otherwise("overlay").alias("winner"))
    off = F.col("sum") / F.col("n") - F.col("mean")
    flags = placed.join(regions.select("lat", "lon", mean.alias("mean")), ["lat", "lon"]).filter((F.col("n") >= 3) & (off < -20)).select(
        "station", half_up(F.col("sum") / F.col("n")).alias("fix_rate"), half_up("mean").alias("region_mean"),
        F.when(off < -40, "exclude").when(off < -30, "downgrade").otherwise("investigate").alias("recommendation"))
    return compared, flags


def clone_pairs(stations: DataFrame) -> DataFrame:
    """Stations of one network within 50 m and in one 0.001 degree cell; the second by name is the suspect."""
    a = stations.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "name", "network", "latitude", "longitude", F.floor(F.col("latitude") * 1000 + 0.5).alias("row"), F.floor(F.col("longitude") * 1000 + 0.5).alias("column"))
    b = a.select(F.col("name").alias("suspect"), F.col("network").alias("n2"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"), "row", "column")
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2"))
    return (a.join(b, ["row", "column"]).filter((F.col("name") < F.col("suspect")) & F.col("network").eqNullSafe(F.col("n2"))).withColumn("km", km).filter("km < 0.05")
            .select("name", "suspect", "network", half_up(1 - F.col("km") / 0.05, 2).alias("similarity"), F.when(F.col("km") < 0.01, 0.95).otherwise(0.7).alias("confidence"),
                    F.when(F.col("km") < 0.01, "exclude").otherwise("downgrade").alias("recommendation")))


def stations_with_scores(stations: DataFrame, scores: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """Stations with the scores of the same name; null where there are none, or the job's ``defaults``."""
    out = stations.join(scores.withColumnRenamed("station_name", "name"), "name", "left")
    return out.fillna(defaults) if defaults else out


def quality_gaming(stations: DataFrame, scores: DataFrame) -> DataFrame:
    """Good score but bad fixes; or mostly no fix although online. A station can be hit by both."""
    c = F.col
    uq, fix, n, zero = (F.coalesce(k, F.lit(0)) for k in ("uq_score", "avg_fix_rate", "session_count", "zero_fix_ratio"))
    rules = F.array_compact(F.array(
        F.when((uq > 0.7) & (fix < 40) & (n >= 10), F.struct(F.lit("score").alias("rule"), half_up(F.least(F.lit(0.3), (0.7 - fix / 100) * 0.5) + 0.6, 3).alias("confidence"), F.lit("investigate").alias("recommendation"))),
        F.when((zero > 0.5) & (c("status") == "ONLINE") & (n >= 5), F.struct(F.lit("zero_fix").alias("rule"), half_up(zero * 0.3 + 0.5, 3).alias("confidence"),
               F.when(zero > 0.8, "exclude").otherwise("downgrade").alias("recommendation")))))
    return (stations_with_scores(stations, scores).filter((uq != 0) & (fix != 0)).select("name", "network", F.explode(rules).alias("r"))
            .select("name", "network", "r.*"))


def zombie_stations(stations: DataFrame, scores: DataFrame, uptime: float = 0.2, sessions: int = 1) -> DataFrame:
    idle = (F.coalesce("uptime_7d", F.lit(0.0)) < uptime) & (F.coalesce("session_count", F.lit(0)) <= sessions) & (F.col("status") == "ONLINE")
    return stations_with_scores(stations, scores).filter(idle).select("name", "network", F.lit(0.7).alias("confidence"), F.lit("downgrade").alias("recommendation"))


def position_spoofing(qc: DataFrame) -> DataFrame:
    """``qc`` has ``station, position_offset_m``; offsets over 100 m are suspect."""
    off = F.col("position_offset_m")
    return qc.filter(off > 100).select("station", half_up(F.least(F.lit(0.95), off / 1000 + 0.5), 3).alias("confidence"), F.when(off > 500, "exclude").otherwise("investigate").alias("recommendation"))


def dedupe_anomalies(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per station (or 'global') and type; rows of ``first`` win. Both have ``type, severity, station``."""
    both = first.select("type", "severity", "station", F.lit(0).alias("pass")).unionByName(second.select("type", "severity", "station", F.lit(1).alias("pass")))
    order = W.partitionBy(F.coalesce("station", F.lit("global")), "type").orderBy("pass", "severity")
    return both.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k", "pass")


def with_ids(anomalies: DataFrame, as_of: int) -> DataFrame:
    return anomalies.withColumn("id", anomaly_id(F.col("type"), F.col("station"), as_of))
