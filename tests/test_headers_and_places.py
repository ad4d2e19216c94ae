"""Headers of observation files, names of places, and the neighbours of a surface."""

import random

from pyspark.sql import functions as F

from plumbline.functions.geo import PLACE_BOXES, place_name
from plumbline.operators import observations, spatial


def line(text, label):
    return f"{text:<60}{label}"


def test_observation_headers(spark):
    full = "\n".join([
        line("1234                SEPT POLARX5        5.3.2", "REC # / TYPE / VERS"), line("77                  LEIAR25.R4      LEIT", "ANT # / TYPE"),
        line("  3970667.1000  1018998.2000  4870369.3000", "APPROX POSITION XYZ"), line("E   14 C1X L1X S1X C5X L5X S5X C7X", "SYS / # / OBS TYPES"),
        line("       C2X", "SYS / # / OBS TYPES"), line("G    2 C1C L1C", "SYS / # / OBS TYPES"), line("G    2 C2W L2W", "SYS / # / OBS TYPES"), line("X    1 D1C", "SYS / # / OBS TYPES"),
        line("", "END OF HEADER"), line("J    1 C1C", "SYS / # / OBS TYPES")])
    files = spark.createDataFrame([("a", full), ("crlf", full.replace("\n", "\r\n")), ("b", ""), ("c", None), ("d", line(" 1.0 x", "APPROX POSITION XYZ")),
                                   ("e", line("1 oops 3", "APPROX POSITION XYZ") + "\n" + line("", "REC # / TYPE / VERS"))], "file_id string, value string")
    got = {r.file_id: r for r in observations.observation_headers(files).collect()}
    for name in ("a", "crlf"):
        r = got[name]
        assert (r.receiver_type, r.firmware_version, r.antenna_type) == ("SEPT POLARX5", "5.3.2", "LEIAR25.R4      LEIT")
        assert r.constellations == ["Galileo", "GPS"] and r.frequencies == ["L1", "L5", "L2"]
        assert (r.x, r.y, r.z) == (3970667.1, 1018998.2, 4870369.3) and 50 < r.latitude < 50.2 and 14.3 < r.longitude < 14.4
    for name in "bcde":
        r = got[name]
        assert r.receiver_type == r.firmware_version == r.antenna_type == "unknown" and r.constellations == r.frequencies == []
        assert r.latitude is None and r.height is None
    assert got["d"].x is None and (got["e"].x, got["e"].y, got["e"].z) == (1.0, None, 3.0)
    assert "PythonUDF" not in observations.observation_headers(files)._jdf.queryExecution().toString()


def test_place_names_at_the_edges_of_boxes(spark):
    rows = [(55.0, 0.0), (55.1, 0.0), (89.0, 29.9), (45.0, 19.9), (45.0, 20.0), (35.0, 20.0), (-10.0, 150.0), (-10.0, -50.0), (20.0, 100.0), (-0.5, -150.0), (2.5, -150.5), (None, 1.0)]
    table = spark.createDataFrame(rows, "lat double, lon double")
    got = {(r.lat, r.lon): r for r in table.select("lat", "lon", *(place_name(F.col("lat"), F.col("lon"), s).alias(s) for s in PLACE_BOXES)).collect()}
    say = {k: (r.coverage, r.zone, r.overlay, r.gap_fill) for k, r in got.items()}
    assert say[55.0, 0.0] == ("Central Europe", "Central Europe", "C-EU", "C-Europe") and say[55.1, 0.0] == ("Northern Europe", "Northern Europe", "N-EU", "N-Europe")
    assert say[89.0, 29.9][0] == "Northern Europe" and say[45.0, 19.9][1] == "Southern Europe" and say[45.0, 20.0] == ("45°N 20°E", "Eastern Europe", "45N20E", "45N-20E")
    assert say[35.0, 20.0][1] == "Africa" and say[-10.0, 150.0][0] == "Australia" and say[-10.0, -50.0][1] == "South America" and say[20.0, 100.0][1] == "Southeast Asia"
    assert say[-0.5, -150.0] == ("0°N -150°E", "Region 0N -150E", "0N-150E", "0N--150E") and say[2.5, -150.5][0] == "3°N -150°E" and say[None, 1.0] == (None,) * 4


def test_surface_keeps_the_nearest_of_each_node_before_the_shuffle(spark):
    rng = random.Random(4)
    points = spark.createDataFrame([(f"p{k:03}", rng.uniform(44, 50), rng.uniform(2, 9), rng.uniform(40, 90)) for k in range(120)], "id string, lat double, lon double, value double")
    model = spark.createDataFrame([("spherical", 1.0, 90.0, 150.0)], "model string, nugget double, sill double, range double")
    surface = spatial.kriging_surface(points, model, neighbours=8)
    assert surface._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    wide = {(r.lat, r.lon): r.n_stations for r in spatial.kriging_surface(points, model, neighbours=500).collect()}
    assert {(r.lat, r.lon): r.n_stations for r in surface.collect()} == {k: min(n, 8) for k, n in wide.items()} and min(wide.values()) >= 3
