"""Fix-rate forecasts and the state of the satellite constellations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.geo import distance_join
from plumbline.functions.rules import HOUR, half_up

# Nominal satellites and weight of each constellation.
NOMINAL = {"gps": 31, "glonass": 24, "galileo": 28, "beidou": 45}
WEIGHT = {"gps": 1.5, "galileo": 1.0, "glonass": 0.8}


def kp_impact(kp: Column) -> Column:
    return F.when(kp <= 3, 0.0).when(kp <= 4, -5.0).when(kp <= 5, -12.0).when(kp <= 6, -25.0).otherwise(-40.0)


def kp_risk(kp: Column) -> Column:
    return F.when(kp <= 3, "nominal").when(kp <= 5, "elevated").when(kp <= 7, "degraded").otherwise("storm")


def constellation_quality(health: DataFrame, latitude: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """Impact per constellation (``constellation, healthy, total``), and one row with the total and the dilution factor."""
    c = F.col
    nominal = F.coalesce(*[F.when(c("constellation") == k, v) for k, v in NOMINAL.items()], F.when(c("total") > 0, c("total")), F.lit(30))
    missing = F.greatest(F.lit(0), nominal - c("healthy"))
    weight = F.coalesce(*[F.when(c("constellation") == k, v) for k, v in WEIGHT.items()], F.when(c("constellation") == "beidou", 0.7 if abs(latitude) < 60 else 0.3), F.lit(1.0))
    rows = health.withColumns({"nominal": nominal, "loss": missing * 5}).withColumn("impact", F.least(F.lit(30.0), c("loss") * weight * 0.3))
    share = c("healthy") / c("nominal")
    advice = F.when(share < 0.7, "degraded").when(share < 0.9, "reduced").when(c("total") > c("healthy"), "minor").otherwise("nominal")
    each = rows.select("constellation", "nominal", "healthy", half_up(share * 100, 1).alias("availability_pct"), half_up(c("loss").cast("double"), 1).alias("pdop_degradation_pct"), half_up("impact", 1).alias("fix_rate_impact_pct"), advice.alias("state"))
    factor = F.product(1 + c("loss") / 100)
    overall = rows.agg(half_up(F.least(F.lit(50.0), F.sum("impact")), 1).alias("total_impact_pct"), half_up(factor, 3).alias("pdop_multiplier"), half_up(F.greatest(F.lit(0.0), (factor - 1) * 0.02), 4).alias("sigma_contribution"))
    return each, overall


def current_quality(points: DataFrame, surface: DataFrame, scores: DataFrame, km: float = 200.0) -> DataFrame:
    """``current`` per point (``point_id, lat, lon``): the nearest surface value under ``km``, else the mean of all stations (70 without any).

    Places are sought, not rows: points of one place share a value, and of a place of the surface only the smallest counts.
    """
    at = ["lat", "lon"]
    right = surface.groupBy(F.col("lat").alias("r_latitude"), F.col("lon").alias("r_longitude")).agg(F.min("predicted").alias("predicted"))
    near = (distance_join(points.select(*at).dropna().distinct(), right, km, *at).filter(F.col("distance_km") < km).groupBy(*at)
            .agg(F.min(F.struct("distance_km", "r_latitude", "r_longitude", "predicted"))["predicted"].alias("near")))
    mean = scores.agg(F.coalesce(F.nullif(F.avg("avg_fix_rate"), F.lit(0.0)), F.lit(70.0)).alias("mean"))
    return points.join(near, at, "left").select(*points.columns, "near").crossJoin(F.broadcast(mean)).withColumn("current", F.coalesce("near", "mean")).drop("near", "mean")


def forecast(points: DataFrame, horizons: tuple[int, ...], as_of: int, arrivals: DataFrame, kp: float = 0.0, kp_3h: float = 0.0, tropo_risk: str = "low", alerts: int = 0) -> DataFrame:
    """One row per point (``point_id, lat, lon, current``) and horizon in hours, with a band that grows with its square root.

    ``arrivals`` has ``arrival_ts, kp``: those within six hours of a horizon count. They meet by slices of six hours, and a
    horizon's arrivals are one small aggregate.
    """
    c = F.col
    spark = points.sparkSession
    h = spark.createDataFrame([(x,) for x in horizons], "h int").withColumn("at", F.lit(as_of) + c("h").cast("long") * HOUR)
    width = 6 * HOUR
    slice_ = F.floor(c("at") / width)
    met = (h.withColumn("slice", F.explode(F.array(slice_ - 1, slice_, slice_ + 1))).join(arrivals.withColumn("slice", F.floor(c("arrival_ts") / width)), "slice")
           .filter(F.abs(c("arrival_ts") - c("at")) <= width).select("h", "kp"))
    hits = h.select("h").join(met, "h", "left").groupBy("h").agg(F.max(c("kp")).alias("c_kp"), F.coalesce(F.sum(kp_impact(c("kp"))), F.lit(0.0)).alias("c_impact"))
    rows = points.crossJoin(F.broadcast(hits))
    soon = (c("h") <= 3) & F.lit(kp_3h > 0)
    expected = F.greatest(F.lit(float(kp)), F.coalesce("c_kp", F.lit(0.0)), F.when(soon, float(kp_3h)).otherwise(0.0))
    rising = F.when(soon & F.lit(kp_3h > kp + 1), kp_impact(F.lit(kp_3h)) - kp_impact(F.lit(kp))).otherwise(0.0)
    hour = (as_of // HOUR) % 24
    local = ((F.lit(hour) + c("h")) % 24 + F.floor(c("lon") / 15 + 0.5)) % 24
    rows = rows.withColumns({"kp_expected": expected, "local": local})
    place = (F.when((F.abs("lat") < 20) & ((c("local") >= 20) | (c("local") <= 2)), -5.0).when((F.abs("lat") > 60) & (c("kp_expected") >= 4), -8.0).otherwise(0.0))
    value = c("current") + c("c_impact") + rising + place - (3 if tropo_risk == "high" else 0) - 2 * alerts
    rows = rows.withColumns({"p": F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)), "grow": F.sqrt(c("h").cast("double")) * 3})
    return rows.select("point_id", "h", half_up("p", 1).alias("predicted"), F.greatest(F.lit(0.0), half_up(c("p") - c("grow") - 10, 1)).alias("low"),
                       F.least(F.lit(100.0), half_up(c("p") + c("grow") + 5, 1)).alias("high"), "kp_expected", kp_risk(c("kp_expected")).alias("iono_risk"))
