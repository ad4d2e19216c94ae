"""Values that are a limit themselves, whatever the order of the rows that they are summed from."""

import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions.outlines import convex_hull
from plumbline.operators import areas, reports, sequential, trust
from plumbline.plans.fixtures import AS_OF
from plumbline.streaming import stateful


def test_correlation_without_variance_is_zero(spark):
    """all hours have the same Kp (or fix rate)."""
    for rows in ([(9.0, 50.0 + i) for i in range(8)], [(float(i), 50.0) for i in range(8)], []):
        got = reports.kp_fix_correlation(spark.createDataFrame(rows, "kp double, fix_rate double")).first()
        assert (got.correlation_kp_fix, got.data_points) == (0.0, len(rows))
    line = spark.createDataFrame([(float(i), 90.0 - i) for i in range(8)], "kp double, fix_rate double")
    assert reports.kp_fix_correlation(line).first().correlation_kp_fix == -1.0


def test_ten_samples_are_enough_in_any_order(spark):
    """twenty middling sessions add a half each, so no station is new, however their parts round."""
    rng = random.Random(3)
    rates = {f"s{i}": [rng.randrange(201, 700) / 10 for _ in range(20)] for i in range(200)}
    rows = [(f"{s}-{i}", f"u{i}", s, AS_OF - 1000 - i, fix, 300) for s, all_ in rates.items() for i, fix in enumerate(all_)]
    sessions = spark.createDataFrame(rows, "id string, username string, station string, login_time long, fix_rate double, duration int")
    stations = spark.createDataFrame([], "name string, latitude double, longitude double")
    got = trust.trust_scores_v1(sessions, spark.createDataFrame([], trust.STATE), stations, AS_OF).collect()
    assert len(got) == 200 and not [r.station for r in got if r.flag == "new"]
    parts = {s: [(f - 20) / 50 for f in all_] for s, all_ in rates.items()}
    for p in parts.values():
        _, row = stateful.trust_step((1.0, 1.0, None, None), AS_OF, (sum(x * 0.5 for x in p), sum((1 - x) * 0.5 for x in p)), 0.5, 0.25)
        assert row["flag"] != "new"


def test_means_at_a_limit(spark):
    """a mean of 60 in floating numbers is no warning, one of 30 not critical."""
    thirty, sixty = sum([29.9, 30.1, 29.7, 30.3, 29.8, 30.2]) / 6 - 4e-15, 60 - 7e-15
    assert thirty < 30 and sixty < 60
    row = spark.range(1).select(*(sequential.level(F.lit(x)) for x in (thirty, sixty, 29.9, 59.9, 60.1))).first()
    assert list(row) == ["warning", "info", "critical", "warning", "info"]


def test_visited_cells_do_not_pass_through_the_driver(spark):
    from plumbline.functions.geo import distance_join

    left = spark.createDataFrame([(1, 50.0, 8.0), (2, 50.0, 8.0)], "id int, latitude double, longitude double")
    right = spark.createDataFrame([(7, 50.1, 8.0)], "r_id int, r_latitude double, r_longitude double")
    pairs = distance_join(left, right, 20.0)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.r_id) for r in pairs.collect()) == [(1, 7), (2, 7)]


def test_current_quality_seeks_places(spark):
    from plumbline.operators.forecast import current_quality

    points = spark.createDataFrame([("a", 50.0, 8.0), ("b", 50.0, 8.0), ("c", -50.0, 8.0), ("d", None, None)], "point_id string, lat double, lon double")
    surface = spark.createDataFrame([(50.1, 8.0, 60.0), (50.1, 8.0, 40.0), (50.9, 8.0, 10.0)], "lat double, lon double, predicted double")
    found = current_quality(points, surface, spark.createDataFrame([(80.0,)], "avg_fix_rate double"))
    assert found.columns == ["point_id", "lat", "lon", "current"]
    assert {r.point_id: r.current for r in found.collect()} == {"a": 40.0, "b": 40.0, "c": 80.0, "d": 80.0}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 4  # the surface's places, the points' places, the nearest, the mean


def test_stations_that_come_back_from_zero(spark):
    from plumbline.operators.detectors import predictive_alerts

    rows = [("Z", AS_OF - 1000 * k, 90.0, 1.0) for k in range(1, 5)] + [("Z", AS_OF - 3 * 3_600_000 - k, 0.0, 1.0) for k in range(4)]
    found = predictive_alerts(spark.createDataFrame(rows, "station string, login_time long, fix_rate double, avg_age double"), AS_OF).collect()
    assert [(r.indicator, r.change_pct) for r in found] == [("fix_rate_improving", float("inf"))]


def test_merged_overlays_returns_all_zones(spark):
    """more than 500 areas, each of them in the result."""
    rows = [(f"ono_{i:04d}", f"ono_{i:04d}", 10.0 + i % 30, -100.0 + i // 30, 5, 0.9, "survey_grade", "primary_absent", 20000.0, "untested") for i in range(620)]
    circles = spark.createDataFrame(rows, "zone_id string, area string, lat double, lon double, priority int, confidence double, hardware_class string, reason string, radius_m double, validation_status string")
    zones = areas.merged_overlays(circles)
    assert sorted(r.zone_id for r in zones.collect()) == [r[0] for r in rows]
    assert areas.overlay_stats(zones).first().zones == 620


def test_circles_on_one_line_are_no_polygon(spark):
    """the third place is off the line through the others in its last digit only."""
    rows = [(f"o{i}", "o0", lat, lon, 5, 0.9, "survey_grade", "primary_absent", 20000.0, "untested") for i, (lat, lon) in enumerate([(44.1, 2.1), (44.2, 2.2), (44.300000000000004, 2.3000000000000003), (44.4, 2.4)])]
    schema = "zone_id string, area string, lat double, lon double, priority int, confidence double, hardware_class string, reason string, radius_m double, validation_status string"
    assert len(convex_hull(np.array([r[2:4] for r in rows]))) > 2
    flat, wide = (areas.merged_overlays(spark.createDataFrame(x, schema)).first() for x in (rows, rows + [("o9", "o0", 44.2, 2.3, *rows[0][4:])]))
    assert (flat.fence_type, flat.points, flat.radius_m) == ("circle", None, 45000.0) and (wide.fence_type, wide.radius_m) == ("polygon", 0.0)


def test_stations_without_sessions_compare_as_their_sql(spark):
    """0.25 * 0.7 + 0.75 * 0.3 is under 0.4 in floating numbers, in any order of rows, for there are none."""
    sessions = spark.createDataFrame([], "id string, username string, station string, login_time long, fix_rate double, duration int")
    stations = spark.createDataFrame([], "name string, latitude double, longitude double")
    state = spark.createDataFrame([("S", 7.0, 21.0, AS_OF, None)], trust.STATE)
    row = trust.trust_scores_v1(sessions, state, stations, AS_OF).first()
    assert 0.25 * 0.7 + 0.75 * 0.3 < 0.4 and (row.combined_score, row.flag) == (0.4, "untrusted")
