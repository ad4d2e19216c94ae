"""Spatial statistics and coverage cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.geo import DEGREE_KM, EARTH_KM, distance_join, haversine_km, nearest_k
from plumbline.functions.geodesic import cell_centre, cell_disk, cell_of
from plumbline.functions.graph import checkpointed
from plumbline.functions.rules import DAY, between, half_up, has_position, online, positive

# Square boxes (name, latitude, longitude, half side in degrees) for summaries of a surface.
SURFACE_BOXES = (
    ("EU Central", 50, 10, 15), ("EU West", 48, -2, 12), ("EU North", 60, 15, 12), ("US East", 38, -78, 15), ("US West", 38, -118, 15),
    ("US Central", 40, -95, 12), ("Australia", -28, 135, 20), ("South America", -15, -50, 20),
)


# ---- coverage cells -------------------------------------------------------------------------------------------------

def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d, a, b = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    return F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def bearing_gap(bearings: Column) -> Column:
    """Largest gap between neighbouring directions, the wrap included; 360 for a single one."""
    b = F.array_sort(bearings)
    gaps = F.zip_with(F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))), F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))), lambda x, y: x - y)
    wrap = F.lit(360.0) - F.element_at(b, -1) + F.element_at(b, 1)
    return F.greatest(F.coalesce(F.array_max(gaps), F.lit(0.0)), wrap)


def geometry_score(close: Column, any_station: Column, bearings: Column) -> Column:
    """Redundancy and angular spread of the stations within 35 km; ``close`` counts them, ``any_station`` all in range."""
    ratio = bearing_gap(bearings) / (F.lit(360.0) / close)
    score = F.greatest(F.lit(0.0), 1 - (ratio - 1) / 3) * 0.6 + F.least(F.lit(1.0), close / 4) * 0.4
    return (F.when(any_station == 0, 0.0).when(any_station == 1, 0.3).when(close == 0, 0.1).when(close == 1, 0.3)
            .otherwise(half_up(F.least(F.lit(1.0), score), 2)))


def coverage_cells(stations: DataFrame, scores: DataFrame, sessions: DataFrame, as_of: int, days: int = 180, km: float = 50.0) -> DataFrame:
    """Quality of every cell near an online station (two rings) or with sessions.

    Score = 0.35 baseline exp(-(d/20)^2) + 0.20 geometry + 0.20 weighted uptime + 0.15 freshness + 0.10 fix rate.
    Cells are those of the geodesic grid (``cell_id`` is their id as text), of about 253 square kilometres.
    Cells with 20 sessions are observed, with 3 hybrid, else modelled. Users are summed over 0.1 degree squares.
    """
    c = F.col
    base = (stations.filter(online() & has_position() & c("longitude").isNotNull()).join(scores.select(F.col("station_name").alias("name"), "uptime_7d", "median_correction_age"), "name", "left")
            .select("name", F.coalesce("network", F.lit("unknown")).alias("network"), c("latitude").alias("r_latitude"), c("longitude").alias("r_longitude"),
                    F.coalesce("uptime_7d", F.lit(0.5)).alias("uptime"), F.coalesce("median_correction_age", F.lit(2.0)).alias("age")))
    length = F.when(c("duration") > 0, c("duration")).otherwise(1)
    squares = (sessions.filter(between(as_of - days * DAY) & has_position() & (F.abs("longitude") > 0.1)).groupBy(half_up("latitude", 1).alias("lat"), half_up("longitude", 1).alias("lon")).agg(
        F.count("*").alias("n"), F.count_distinct("username").alias("users"), F.sum(c("fix_rate") * length).alias("fix"), F.sum(length).alias("seconds"), F.avg(positive("avg_age")).alias("mean_age")))
    seen = squares.withColumn("cell", cell_of(c("lat"), c("lon"))).groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum("users").alias("users"), F.sum("fix").alias("fix"), F.sum("seconds").alias("seconds"),
        (F.sum(c("mean_age") * c("n")) / F.sum(F.when(c("mean_age") > 0, c("n")))).alias("seen_age"))
    rings = base.select(cell_of(c("r_latitude"), c("r_longitude")).alias("own")).select(F.explode(cell_disk(c("own"), 2)).alias("cell"))
    seen = checkpointed(seen)
    cells = checkpointed(rings.unionByName(seen.select("cell")).distinct().withColumn("centre", cell_centre(c("cell"))).select("cell", c("centre.lat").alias("latitude"), c("centre.lon").alias("longitude")))
    near = distance_join(cells, base, km).withColumn("w", F.exp(-F.pow(c("distance_km") / 20, F.lit(2.0))))
    rank = F.row_number().over(W.partitionBy("cell").orderBy("distance_km", "name"))
    close = c("distance_km") <= 35
    around = near.withColumn("k", rank).groupBy("cell").agg(
        F.count("*").alias("in_range"), F.count_if(close).alias("close"), F.collect_list(F.when(close, bearing(c("latitude"), c("longitude"), c("r_latitude"), c("r_longitude")))).alias("bearings"),
        (F.sum(c("uptime") * c("w")) / F.sum("w")).alias("uptime"), F.min(F.when(c("k") <= 3, F.when(c("age") == 0, 5.0).otherwise(c("age")))).alias("best_age"),
        F.min("distance_km").alias("nearest_km"), F.min(F.struct("distance_km", "name"))["name"].alias("nearest"), F.count_distinct(F.when(c("network") != "unknown", c("network"))).alias("redundancy"))
    zero = F.lit(0)
    r = cells.join(around, "cell", "left").join(seen, "cell", "left").withColumns({"in_range": F.coalesce("in_range", zero), "close": F.coalesce("close", zero), "n": F.coalesce("n", zero)})
    baseline = F.when(c("in_range") > 0, F.exp(-F.pow(c("nearest_km") / 20, F.lit(2.0)))).otherwise(0.0)
    fresh = F.when((c("n") >= 20) & (c("seen_age") > 0), F.greatest(F.lit(0.0), 1 - c("seen_age") / 10)).when(c("in_range") > 0, F.greatest(F.lit(0.0), 1 - c("best_age") / 10)).otherwise(0.5)
    r = r.withColumns({"baseline": baseline, "fresh": fresh, "fix_part": F.when(c("n") >= 3, c("fix") / c("seconds") / 100).otherwise(baseline), "up": F.coalesce("uptime", F.lit(0.0)),
                       "geometry": geometry_score(c("close"), c("in_range"), c("bearings"))})
    r = r.withColumn("quality_score", half_up(c("baseline") * 0.35 + c("geometry") * 0.2 + c("up") * 0.2 + c("fresh") * 0.15 + c("fix_part") * 0.1, 2))
    tier = F.when(c("quality_score") >= 0.75, "full_rtk").when(c("quality_score") >= 0.5, "degraded_rtk").when(c("quality_score") >= 0.25, "float_dgps").otherwise("no_coverage")
    source = F.when(c("n") >= 20, "observed").when(c("n") >= 3, "hybrid").otherwise("modeled")
    return r.select(c("cell").cast("string").alias("cell_id"), half_up("latitude", 5).alias("latitude"), half_up("longitude", 5).alias("longitude"), "quality_score",
                    half_up("baseline", 2).alias("baseline"), "geometry", half_up("up", 2).alias("uptime"), half_up("fresh", 2).alias("freshness"), half_up("fix_part", 2).alias("fix_rate"),
                    c("n").alias("session_count"), F.coalesce("users", zero).alias("unique_users"), half_up(F.when(c("n") >= 3, F.least(F.lit(1.0), c("n") / 50)).otherwise(0.0), 2).alias("confidence"),
                    source.alias("data_source"), tier.alias("zone_tier"), F.coalesce("redundancy", zero).alias("redundancy"), F.coalesce("nearest", F.lit("")).alias("nearest_station"),
                    half_up(F.coalesce("nearest_km", F.lit(999.0)), 1).alias("nearest_km"), c("in_range").alias("stations_in_range"))


# ---- variogram, autocorrelation, kriging ----------------------------------------------------------------------------

def _pairs(points: DataFrame, km: float) -> DataFrame:
    right = points.select(F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("value").alias("r_value"))
    return distance_join(points, right, km, "lat", "lon", "r_lat", "r_lon", spread=True)


#: Sides of the blocks of points, in kilometres, each a fourth of the one before.
BLOCKS_KM = (16.0, 4.0, 1.0)


def _blocks(points: DataFrame) -> DataFrame:
    """``points`` with the keys ``b0, b1, b2`` of their blocks, which lie within each other, and ``b3``, their own."""
    fine = BLOCKS_KM[-1] / DEGREE_KM
    row = F.floor(F.col("lat") / fine)
    steps = [int(side / BLOCKS_KM[-1]) for side in BLOCKS_KM]
    # Columns of all blocks of a large row are as wide, so that blocks stay within each other.
    wide = fine / F.greatest(F.lit(0.05), F.cos(F.radians((F.floor(row / steps[0]) + 0.5) * steps[0] * fine)))
    column = F.floor(F.col("lon") / wide)
    keys = {f"b{i}": F.struct(F.floor(row / n).alias("r"), F.floor(column / n).alias("c"), F.lit("").alias("p")) for i, n in enumerate(steps)}
    return points.withColumns(keys | {"b3": F.struct(row.alias("r"), column.alias("c"), F.col("id").cast("string").alias("p"))})


def empirical_variogram(points: DataFrame, max_km: float = 500.0, bins: int = 15, least: int = 3) -> DataFrame:
    """Semivariance of all pairs (``id, lat, lon, value``) under ``max_km`` in equal distance bins.

    Exact without meeting all pairs: pairs of blocks, so far apart that all their points fall into one bin, add the product of
    their counts and the squares from their sums. Only block pairs across the edge of a bin are taken apart, into blocks of
    a fourth of the side and, at last, into points.
    """
    c, width = F.col, max_km / bins
    placed = checkpointed(_blocks(points.filter("lat is not null and lon is not null and value is not null")))

    def level(i: int) -> DataFrame:
        """Blocks with their sums, and a middle from which no point is further than ``r``."""
        up = [f"b{i - 1}"] if i else []
        sums = placed.groupBy(f"b{i}", *up).agg(
            F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(c("value") * c("value")).alias("q"),
            F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
        mid = sums.withColumns({"lat": (c("south") + c("north")) / 2, "lon": (c("west") + c("east")) / 2})
        corners = [haversine_km(c("lat"), c("lon"), c(a), c(b)) for a in ("south", "north") for b in ("west", "east")]
        # A box may bulge between its corners: its middle meridian is the longest way to a side, and no further than half its height.
        reach = F.greatest(*corners, haversine_km(c("lat"), c("lon"), c("south"), c("lon")))
        return mid.select(c(f"b{i}").alias("b"), *([c(up[0]).alias("up")] if up else []), "n", "s", "q", "lat", "lon", F.when((c("south") == c("north")) & (c("west") == c("east")), 0.0).otherwise(reach * 1.000001 + 1e-6).alias("r"))

    def other(blocks: DataFrame) -> DataFrame:
        return blocks.select(*(c(k).alias(f"r_{k}") for k in blocks.columns))

    near = c("distance_km") - c("r") - c("r_r")
    far = c("distance_km") + c("r") + c("r_r")
    same = c("b") == c("r_b")
    found, blocks = [], level(0)
    pairs = distance_join(blocks, other(blocks), max_km + 2 * BLOCKS_KM[0], "lat", "lon", "r_lat", "r_lon").filter(c("b") <= c("r_b"))
    for i in range(len(BLOCKS_KM) + 1):
        met = pairs.filter(near < max_km)
        low, high = F.floor(F.greatest(F.lit(0.0), near) / width), F.floor(far / width)
        met = checkpointed(met.withColumns({"bin": low.cast("int"), "one": (low == high) & (far < max_km)}))
        count = F.when(same, c("n") * (c("n") - 1) / 2).otherwise(c("n") * c("r_n"))
        square = F.when(same, c("n") * c("q") - c("s") * c("s")).otherwise(c("r_n") * c("q") + c("n") * c("r_q") - 2 * c("s") * c("r_s"))
        found.append(met.filter("one").groupBy("bin").agg(F.sum(count).alias("count"), F.sum(square).alias("square")))
        if i == len(BLOCKS_KM):
            break
        rest, below = met.filter("not one").select(c("b").alias("up"), c("r_b").alias("r_up")), level(i + 1)
        once = (c("up") != c("r_up")) | (c("b") <= c("r_b"))  # within one block every pair of its parts stands once
        pairs = rest.join(below, "up").join(other(below), "r_up").filter(once).withColumn("distance_km", haversine_km(c("lat"), c("lon"), c("r_lat"), c("r_lon")))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return (every.groupBy("bin").agg(F.sum("count").cast("long").alias("count"), F.sum("square").alias("square")).filter(c("count") >= least)
            .select("bin", ((c("bin") + 0.5) * width).alias("distance"), (c("square") / (2 * c("count"))).alias("semivariance"), "count"))


def variogram_value(model: str, h: Column, nugget: Column, sill: Column, reach: Column) -> Column:
    part, x = sill - nugget, h / reach
    if model == "spherical":
        return F.when(h == 0, 0.0).when(x >= 1, sill).otherwise(nugget + part * (1.5 * x - 0.5 * F.pow(x, F.lit(3.0))))
    return F.when(h == 0, 0.0).otherwise(nugget + part * (1 - F.exp(-3 * (F.pow(x, F.lit(2.0)) if model == "gaussian" else x))))


def fit_variogram(bins: DataFrame, model: str = "exponential") -> DataFrame:
    """Best of 5 x 5 x 5 candidate nuggets, sills and ranges by R squared (ties: first in that order). One row."""
    ends = bins.agg(F.max("semivariance").alias("hi"), F.min("semivariance").alias("lo"), F.max("distance").alias("far"), F.avg("semivariance").alias("mean"), F.count("*").alias("n")).filter("n >= 3")
    grid = lambda name, values: F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias(f"{name}_i", f"{name}_f")
    tries = ends.select("*", grid("nugget", (0, 0.25, 0.5, 0.75, 1))).select("*", grid("sill", (0.5, 0.75, 1, 1.25, 1.5))).select("*", grid("range", (0.15, 0.25, 0.35, 0.5, 0.7)))
    c = F.col
    tries = tries.select(*[f"{k}_i" for k in ("nugget", "sill", "range")], "mean", (c("lo") * c("nugget_f")).alias("nugget"), (c("hi") * c("sill_f")).alias("sill"), (c("far") * c("range_f")).alias("range")).filter("sill > nugget")
    miss = bins.crossJoin(F.broadcast(tries)).withColumn("e", c("semivariance") - variogram_value(model, c("distance"), c("nugget"), c("sill"), c("range")))
    keys = ["nugget_i", "sill_i", "range_i", "nugget", "sill", "range"]
    total = F.sum(F.pow(c("semivariance") - c("mean"), F.lit(2.0)))
    r2 = miss.groupBy(*keys).agg(F.when(total == 0, 0.0).otherwise(1 - F.sum(F.pow("e", F.lit(2.0))) / total).alias("r2"))
    best = r2.agg(F.min(F.struct(-half_up("r2", 9), "nugget_i", "sill_i", "range_i", "nugget", "sill", "range", "r2")).alias("b")).filter("b is not null")
    return best.select(F.lit(model).alias("model"), half_up("b.nugget", 3).alias("nugget"), half_up("b.sill", 3).alias("sill"), half_up("b.range", 1).alias("range"), half_up("b.r2", 3).alias("r_squared"))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution for x >= 0, by Abramowitz and Stegun's approximation 26.2.17."""
    # The coefficients of that formula.
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 1 - 0.3989422804014327 * F.exp(-x * x / 2) * poly


def morans_i(points: DataFrame, km: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """Global and local spatial autocorrelation with inverse-distance weights. Coincident points have no weight.

    Weights are symmetric, so their sums are one aggregate per point over the distance join.
    """
    c = F.col
    points = checkpointed(points)
    stats = points.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("s2"))
    fourth = points.crossJoin(F.broadcast(stats)).agg(F.avg(F.pow(c("value") - c("mean"), F.lit(4.0))).alias("s4"))
    one = F.broadcast(stats.crossJoin(fourth))
    w = _pairs(points, km).filter((c("id") != c("r_id")) & (c("distance_km") > 0)).withColumn("w", 1 / c("distance_km")).crossJoin(F.broadcast(stats))
    rows = checkpointed(w.groupBy("id").agg(F.sum("w").alias("row"), F.sum(F.pow("w", F.lit(2.0))).alias("sq"), F.sum(c("w") * (c("r_value") - c("mean"))).alias("lag")))
    joined = points.join(rows, "id").crossJoin(one)
    g = joined.agg(F.first("n").alias("n"), F.first("s2").alias("s2"), F.first("s4").alias("s4"), F.sum("row").alias("W"), (F.sum("sq") * 2).alias("sum1"),
                   F.sum(F.pow(2 * c("row"), F.lit(2.0))).alias("sum2"), F.sum((c("value") - c("mean")) * c("lag")).alias("num")).filter("n >= 5 and s2 > 0 and W > 0")
    n, w2, b2 = c("n").cast("double"), c("W") * c("W"), c("s4") / (c("s2") * c("s2"))
    expected = -1 / (n - 1)
    var = (n * ((n * n - 3 * n + 3) * c("sum1") - n * c("sum2") + 3 * w2) - b2 * ((n * n - n) * c("sum1") - 2 * n * c("sum2") + 6 * w2)) / ((n - 1) * (n - 2) * (n - 3) * w2) - expected * expected
    g = g.withColumns({"I": c("num") / (c("W") * c("s2")), "expected": expected, "var": var}).withColumn("z", F.when(c("var") > 0, (c("I") - c("expected")) / F.sqrt("var")).otherwise(0.0))
    g = g.withColumn("p", 2 * (1 - normal_cdf(F.abs("z"))))
    verdict = F.when(c("p") > 0.05, "random").when(c("I") > 0, "clustered").otherwise("dispersed")
    overall = g.select(half_up("I", 3).alias("global_i"), half_up("expected", 3).alias("expected_i"), half_up("z", 2).alias("z_score"), half_up("p", 4).alias("p_value"), verdict.alias("interpretation"))
    dev = c("value") - c("mean")
    local = joined.crossJoin(F.broadcast(g.select("var"))).withColumn("i", dev / c("s2") * c("lag")).withColumn("z", c("i") / F.sqrt(F.greatest("var", F.lit(1e-10))))
    kind = F.when((dev > 0) & (c("lag") > 0), "high-high").when((dev < 0) & (c("lag") < 0), "low-low").when((dev > 0) & (c("lag") < 0), "high-low").otherwise("low-high")
    return overall, local.filter(F.abs("z") > 1.96).select("id", half_up("i", 3).alias("local_i"), half_up("z", 2).alias("z_score"), kind.alias("cluster_type"))


def _gamma(model: str, nugget: float, sill: float, reach: float) -> Callable[[np.ndarray], np.ndarray]:
    def value(h: np.ndarray) -> np.ndarray:
        x = h / reach
        if model == "spherical":
            y = np.where(x >= 1, sill, nugget + (sill - nugget) * (1.5 * x - 0.5 * x**3))
        else:
            y = nugget + (sill - nugget) * (1 - np.exp(-3 * (x**2 if model == "gaussian" else x)))
        return np.where(h == 0, 0.0, y)

    return value


def _km(lat1, lon1, lat2, lon2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, a)))


def solve_kriging(lat: np.ndarray, lon: np.ndarray, value: np.ndarray, dist: np.ndarray, model: str, nugget: float, sill: float, reach: float) -> tuple[float, float, str]:
    """Ordinary kriging from the given neighbours; inverse-distance mean where the system is singular."""
    gamma, n = _gamma(model, nugget, sill, reach), len(value)
    k = np.ones((n + 1, n + 1))
    k[:n, :n] = gamma(_km(lat[:, None], lon[:, None], lat[None], lon[None])) + 1e-6 * np.eye(n)
    k[n, n] = 0
    rhs = np.append(gamma(dist), 1.0)
    try:
        w = np.linalg.solve(k, rhs)
    except np.linalg.LinAlgError:
        inverse = 1 / np.maximum(dist, 0.1)
        return float((inverse * value).sum() / inverse.sum()), sill * 0.5, "low"
    variance = max(0.0, float(w[:n] @ rhs[:n] + w[n]))
    share = variance / max(sill, 1e-6)
    return float(w[:n] @ value), variance, "high" if share < 0.3 else "medium" if share < 0.7 else "low"


SURFACE = "lat double, lon double, predicted double, variance double, confidence string, n_stations int"


def kriging_surface(points: DataFrame, model: DataFrame, step: float = 2.0, neighbours: int = 30, least: int = 3, max_km: float | None = None) -> DataFrame:
    """Ordinary kriging on a grid: each node uses its nearest points within twice the range of the fitted model.

    Nodes come from the points themselves (all grid nodes in reach of a point, whatever its latitude), so empty regions
    cost nothing. Twice the fitted range is the radius of the join, at most ``max_km`` if given. Each group holds one
    node's neighbours, at most ``neighbours`` rows.
    """
    fit = model.select("model", "nugget", "sill", "range").first()  # one row
    if fit is None:
        return points.sparkSession.createDataFrame([], SURFACE)
    max_km = fit["range"] * 2 if max_km is None else min(max_km, fit["range"] * 2)
    one = F.broadcast(model.select("model", "nugget", "sill", "range"))
    reach = int(max_km / DEGREE_KM / step) + 1
    snap = lambda v: (F.floor(F.col(v) / step)).cast("int")
    cells = points.select(snap("lat").alias("i0"), snap("lon").alias("j0")).distinct().select(F.explode(F.sequence(F.col("i0") - reach, F.col("i0") + reach)).alias("i"), "i0", "j0")
    # Degrees of longitude shrink towards the poles: the row of nodes nearest to one tells how many the radius spans.
    edge = F.least(F.lit(90.0), (F.greatest(F.abs("i"), F.abs("i0")) + 1) * step)
    half = F.when(edge >= 89, F.lit(int(180 / step))).otherwise(F.least(F.lit(int(180 / step)), F.ceil(max_km / DEGREE_KM / F.cos(F.radians(edge)) * 1.6 / step) + 1)).cast("int")
    around = F.lit(int(360 / step))
    nodes = (cells.groupBy("i", "j0").agg(F.max(half).alias("half")).select("i", F.explode(F.sequence(F.col("j0") - F.col("half"), F.col("j0") + F.col("half"))).alias("j"))
             .select("i", (F.pmod(F.col("j") + around / 2, around) - around / 2).cast("int").alias("j")).distinct()
             .select((F.col("i") * step).alias("g_lat"), (F.col("j") * step).alias("g_lon")).filter("abs(g_lat) <= 90 and abs(g_lon) <= 180"))
    near = nearest_k(nodes, points.select(F.col("id").alias("p_id"), "lat", "lon", "value"), "g_lat", "p_id", neighbours, max_km, "g_lat", "g_lon", "lat", "lon")
    top = near.withColumnRenamed("rank", "k").crossJoin(one)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < min(least, neighbours):
            return pd.DataFrame()
        pdf = pdf.sort_values("k")
        r = pdf.iloc[0]
        p, v, sure = solve_kriging(*(pdf[x].to_numpy(float) for x in ("lat", "lon", "value", "distance_km")), r.model, r.nugget, r.sill, r["range"])
        half = lambda x, d: np.floor(x * 10**d + 0.5) / 10**d
        return pd.DataFrame([(r.g_lat, r.g_lon, half(p, 2), half(v, 3), sure, len(pdf))], columns=["lat", "lon", "predicted", "variance", "confidence", "n_stations"])

    return top.groupBy("g_lat", "g_lon").applyInPandas(solve, SURFACE)


def surface_regions(surface: DataFrame, local: DataFrame, boxes=SURFACE_BOXES) -> DataFrame:
    """Nodes, mean prediction and variance of the ``surface`` strictly inside each named box, and the most common type of
    ``local`` clusters (``lat, lon, cluster_type``) there: ties go to the first name, none is ``not-significant``. Boxes
    may overlap; they are literal columns, so both sides are read once."""
    inside = F.array_compact(F.array(*[
        F.when((F.abs(F.col("lat") - la) < h) & (F.abs(F.col("lon") - lo) < h), F.struct(F.lit(name).alias("region"), F.lit(float(la)).alias("lat_center"), F.lit(float(lo)).alias("lon_center")))
        for name, la, lo, h in boxes]))
    nodes = surface.select(F.explode(inside).alias("r"), "predicted", "variance").groupBy("r.region", "r.lat_center", "r.lon_center").agg(
        F.count("*").alias("n_points"), half_up(F.avg("predicted"), 1).alias("mean_predicted"), half_up(F.avg("variance"), 3).alias("mean_variance"))
    kinds = local.select(F.explode(inside).alias("r"), "cluster_type").groupBy("r.region", "cluster_type").agg(F.count("*").alias("k"))
    most = kinds.groupBy("region").agg(F.min(F.struct((-F.col("k")).alias("k"), "cluster_type"))["cluster_type"].alias("moran_type"))
    return nodes.join(most, "region", "left").withColumn("moran_type", F.coalesce("moran_type", F.lit("not-significant")))
