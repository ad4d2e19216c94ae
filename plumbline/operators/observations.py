"""Raw-signal checks on observation rows, and grades of stations.

Wide rows have ``file_id, prn, epoch_s, c1, c2, l1, l2, s1``; zero or null counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.rules import half_up

LIGHT, L1_HZ, L2_HZ = 299792458.0, 1575.42e6, 1227.60e6


def wide_observations(long: DataFrame) -> DataFrame:
    """Wide rows from ``file_id, prn, epoch_s, obs map<code, value>``: the first code present of each family wins."""
    first = lambda *codes: F.coalesce(*[F.nullif(F.col("obs")[c], F.lit(0.0)) for c in codes])
    l2 = lambda k: first(f"{k}2W", f"{k}2C", f"{k}2X", f"{k}5Q", f"{k}5X")
    return long.select("file_id", "prn", "epoch_s", first("C1C", "C1W", "C1X").alias("c1"), l2("C").alias("c2"), first("L1C", "L1W", "L1X").alias("l1"), l2("L").alias("l2"),
                       first("S1C", "S1W", "S1X").alias("s1"))


def _have(*cols: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.coalesce(F.col(c) != 0, F.lit(False))
    return out


def slip_events(obs: DataFrame, mw_limit: float = 2.0, gf_limit: float = 0.15) -> DataFrame:
    """Cycle slips per satellite: a Melbourne-Wuebbena jump, else a geometry-free jump, against the last complete epoch."""
    l1m, l2m = F.col("l1") * (LIGHT / L1_HZ), F.col("l2") * (LIGHT / L2_HZ)
    wide = LIGHT / (L1_HZ - L2_HZ)
    mw = (l1m * L1_HZ - l2m * L2_HZ) / (L1_HZ - L2_HZ) / wide - (F.col("c1") * L1_HZ + F.col("c2") * L2_HZ) / (L1_HZ + L2_HZ) / wide
    order = W.partitionBy("file_id", "prn").orderBy("epoch_s")
    rows = obs.filter(_have("c1", "c2", "l1", "l2")).withColumns({"mw": mw, "gf": l1m - l2m})
    rows = rows.withColumns({"d_mw": F.abs(F.col("mw") - F.lag("mw").over(order)), "d_gf": F.abs(F.col("gf") - F.lag("gf").over(order))})
    kind = F.when(F.col("d_mw") > mw_limit, "MW").when(F.col("d_gf") > gf_limit, "GF")
    return rows.withColumn("type", kind).filter("type is not null").select(
        "file_id", "prn", "epoch_s", "type", F.when(F.col("type") == "MW", half_up("d_mw", 2)).otherwise(half_up("d_gf", 3)).alias("jump"))


def cycle_slips(obs: DataFrame) -> DataFrame:
    """Slips per file and constellation, the rate per satellite-hour, and the quality class."""
    span = obs.groupBy("file_id").agg(((F.max("epoch_s") - F.min("epoch_s")) / 3600).alias("hours"))
    system = F.substring("prn", 1, 1).alias("constellation")
    sats = obs.groupBy("file_id", system).agg(F.count_distinct("prn").alias("satellites"))
    slips = slip_events(obs).groupBy("file_id", system).agg(F.count("*").alias("slips"))
    j = sats.join(slips, ["file_id", "constellation"], "left").join(span, "file_id").withColumn("slips", F.coalesce("slips", F.lit(0)))
    hours = F.col("satellites") * F.col("hours")
    rate = F.when(hours > 0, F.col("slips") / hours).otherwise(0.0)
    quality = F.when(rate < 0.1, "excellent").when(rate < 1, "good").when(rate < 5, "acceptable").when(rate < 15, "poor").otherwise("unusable")
    return j.select("file_id", "constellation", "satellites", "slips", half_up(hours, 2).alias("satellite_hours"), half_up(rate, 2).alias("slip_rate_per_hour"), quality.alias("quality"))


def multipath(obs: DataFrame, least_epochs: int = 10, least_values: int = 5) -> DataFrame:
    """Code-minus-carrier noise per file: RMS on both bands, RMS in four bins of signal strength, class and high-elevation flag."""
    sat = W.partitionBy("file_id", "prn")
    per = W.partitionBy("file_id", "prn", "ok2")
    rows = obs.withColumns({"ok1": _have("c1", "l1"), "ok2": _have("c2", "l2"), "cmc1": F.col("c1") - F.col("l1") * (LIGHT / L1_HZ), "cmc2": F.col("c2") - F.col("l2") * (LIGHT / L2_HZ),
                            "snr": F.when(_have("s1"), F.col("s1")).otherwise(30.0)})
    one = rows.filter("ok1").withColumns({"r": F.col("cmc1") - F.avg("cmc1").over(sat), "k": F.count("*").over(sat)}).filter(F.col("k") >= least_values)
    two = rows.filter("ok2").withColumns({"r": F.col("cmc2") - F.avg("cmc2").over(per), "k": F.count("*").over(per)}).filter(F.col("k") >= least_values)
    rms = lambda when=None: F.sqrt(F.avg(F.pow("r", F.lit(2.0)) if when is None else F.when(when, F.pow("r", F.lit(2.0)))))
    s = F.col("snr")
    bins = (s < 25, (s >= 25) & (s < 35), (s >= 35) & (s < 45), s >= 45)
    first = one.groupBy("file_id").agg(rms().alias("mp1"), *[half_up(F.coalesce(rms(b), F.lit(0.0)), 3).alias(f"rms_bin{i}") for i, b in enumerate(bins)],
                                       *[F.count_if(b).alias(f"n_bin{i}") for i, b in enumerate(bins)])
    second = two.groupBy("file_id").agg(rms().alias("mp2"))
    counts = obs.groupBy("file_id").agg(F.count_distinct("epoch_s").alias("epochs"), F.count_distinct(F.when(_have("c1", "l1"), F.col("prn"))).alias("satellites"))
    m = F.col("mp1")
    quality = F.when(m < 0.3, "excellent").when(m < 0.5, "good").when(m < 1, "acceptable").when(m < 2, "poor").otherwise("unusable")
    high = (F.col("rms_bin3") > 0.5) & ((F.col("rms_bin0") == 0) | (F.col("rms_bin3") / F.greatest("rms_bin0", F.lit(0.01)) > 0.5))
    return (counts.filter(F.col("epochs") >= least_epochs).join(first, "file_id").join(second, "file_id", "left")
            .select("file_id", half_up("mp1", 3).alias("mp1_rms"), half_up(F.coalesce("mp2", "mp1"), 3).alias("mp2_rms"), quality.alias("quality"), *[f"rms_bin{i}" for i in range(4)],
                    *[f"n_bin{i}" for i in range(4)], "satellites", "epochs", high.alias("high_elevation_multipath")))


def observation_summary(obs: DataFrame) -> DataFrame:
    """Span, epochs, satellites and bands per file. Epochs and satellites are counted apart, each from groups of one row, so rows
    are not repeated for either."""
    bands = ("c1", "c2", "l1", "l2", "s1")
    epochs = obs.groupBy("file_id", "epoch_s").agg(F.count("*").alias("n"), *[F.max(_have(c)).alias(c) for c in bands]).groupBy("file_id").agg(
        (F.max("epoch_s") - F.min("epoch_s")).alias("duration_s"), F.count("epoch_s").alias("epochs"), F.sum("n").alias("n"), *[F.max(c).alias(c) for c in bands])
    satellites = obs.groupBy("file_id", "prn").agg(F.lit(1)).groupBy("file_id").agg(F.count("prn").alias("satellites"))
    seen = [F.when(F.max(c), F.lit(c.upper())) for c in bands]
    return epochs.unionByName(satellites, allowMissingColumns=True).groupBy("file_id").agg(
        F.max("duration_s").alias("duration_s"), F.max("epochs").alias("epochs"), F.max("satellites").alias("satellites"), F.max("n").alias("n"),
        F.array_join(F.array_sort(F.array_compact(F.array(*seen))), ",").alias("bands")).withColumn("mean_satellites", half_up(F.col("n") / F.col("epochs"), 1)).drop("n")


def station_qc_grade(constellations: Column, frequencies: Column, snr_l1: Column, snr_l2: Column, completeness: Column) -> Column:
    """Points for constellations, bands, signal strength and completeness, as a letter."""
    steps = lambda v, hi, lo: F.when(v >= hi, 2).when(v >= lo, 1).otherwise(0)
    points = F.least(F.lit(4), constellations) + F.when(frequencies >= 2, 2).otherwise(0) + steps(snr_l1, 35, 25) + steps(snr_l2, 30, 20) + steps(completeness, 0.95, 0.8)
    return F.when(points >= 11, "A").when(points >= 8, "B").when(points >= 5, "C").when(points >= 3, "D").otherwise("F")


# Systems and bands by the letters and digits of observation codes.
SYSTEMS = {"G": "GPS", "R": "GLONASS", "E": "Galileo", "C": "BeiDou", "J": "QZSS"}
BAND_CODES = "^[CLS][125]"


def observation_headers(files: DataFrame, text: str = "value") -> DataFrame:
    """The columns of ``files`` but its ``text`` of an observation file, with what the header tells of the receiver: ``receiver_type,
    firmware_version, antenna_type`` (``unknown`` where not told), ``x, y, z`` and the position on a simplified ellipsoid
    (``latitude, longitude, height``; null without three numbers), and arrays ``constellations`` and ``frequencies`` in the
    order of their first mention. Lines after the end of the header are not read; of repeated lines the last counts.
    """
    c = F.col
    lines = F.split(F.substring_index(c(text), "END OF HEADER", 1), "\r?\n")
    of = lambda label: F.filter("_lines", lambda x: x.contains(label))
    last = lambda label: F.try_element_at(of(label), F.lit(-1))
    field = lambda line, begin: F.coalesce(F.nullif(F.trim(F.substring(line, begin, 20)), F.lit("")), F.lit("unknown"))
    words = lambda line, begin, n: F.split(F.trim(F.substring(line, begin, n)), "\\s+")
    names = F.create_map(*[F.lit(x) for pair in SYSTEMS.items() for x in pair])
    types = of("SYS / # / OBS TYPES")
    systems = F.array_distinct(F.array_compact(F.transform(types, lambda x: names[F.substring(x, 1, 1)])))
    bands = F.flatten(F.transform(types, lambda x: F.transform(F.filter(words(x, 8, 53), lambda w: w.rlike(BAND_CODES)), lambda w: F.concat(F.lit("L"), F.substring(w, 2, 1)))))
    receiver, antenna, xyz = last("REC # / TYPE / VERS"), last("ANT # / TYPE"), words(last("APPROX POSITION XYZ"), 1, 60)
    number = lambda k: F.when(F.size(xyz) >= 3, F.get(xyz, F.lit(k))).try_cast("double")
    plane = F.sqrt(c("x") * c("x") + c("y") * c("y"))
    lat = F.atan2("z", plane * (1 - 0.00669437999))
    return files.withColumn("_lines", lines).withColumns({
        "receiver_type": field(receiver, 21), "firmware_version": field(receiver, 41), "antenna_type": field(antenna, 21), "x": number(0), "y": number(1), "z": number(2),
        "constellations": F.coalesce(systems, F.array().cast("array<string>")), "frequencies": F.coalesce(F.array_distinct(bands), F.array().cast("array<string>"))}).withColumns({
            "latitude": half_up(F.degrees(lat), 6), "longitude": half_up(F.degrees(F.atan2("y", "x")), 6), "height": half_up(plane / F.cos(lat) - 6378137.0, 1)}).drop("_lines", text)


def measured_position(headers: DataFrame) -> DataFrame:
    """Latitude, longitude and height of ``x, y, z`` on a simplified ellipsoid."""
    a, e2 = 6378137.0, 0.00669437999014
    p = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    lat = F.atan2(F.col("z"), p * (1 - e2))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(lat), F.lit(2.0)))
    return headers.withColumns({"latitude": half_up(F.degrees(lat), 6), "longitude": half_up(F.degrees(F.atan2("y", "x")), 6), "height": half_up(p / F.cos(lat) - n, 2)})
