"""Block and square sums against all pairs, on dense and sparse points; summaries of small tables; plans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.functions.geo import nearest_join
from plumbline.operators import ml, reports, spatial, summaries


def km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, x)))


def field(seed):
    rng = random.Random(seed)
    towns = [(rng.uniform(40, 43), rng.uniform(0, 4)) for _ in range(5)]
    points = [(a + rng.gauss(0, 0.05), b + rng.gauss(0, 0.05)) for a, b in towns for _ in range(40)]
    return points + [(rng.uniform(38, 45), rng.uniform(-2, 6)) for _ in range(60)] + [points[0]] * 3


@pytest.mark.parametrize("max_km, bins", [(500.0, 15), (60.0, 4)])
def test_variogram_equals_all_pairs(spark, max_km, bins):
    rng = random.Random(1)
    rows = [(f"p{i}", a, b, rng.uniform(0, 100)) for i, (a, b) in enumerate(field(2))]
    rows += [("none", None, 1.0, 5.0), ("novalue", 40.0, 1.0, None)]
    got = {r.bin: r for r in spatial.empirical_variogram(spark.createDataFrame(rows, "id string, lat double, lon double, value double").repartition(3), max_km, bins).collect()}
    want = {}
    known = [r for r in rows if None not in r]
    for i, (_, a, b, v) in enumerate(known):
        for _, c, d, w in known[i + 1:]:
            dist = km(a, b, c, d)
            if dist < max_km:
                want.setdefault(int(dist // (max_km / bins)), []).append((v - w) ** 2)
    want = {k: x for k, x in want.items() if len(x) >= 3}
    assert {k: r["count"] for k, r in got.items()} == {k: len(x) for k, x in want.items()}
    assert all(math.isclose(got[k].semivariance, sum(x) / 2 / len(x), rel_tol=1e-9) for k, x in want.items())


def test_points_of_a_town_meet_as_blocks(spark):
    """4000 points within a kilometre, and as many 100 km away: no join of the plan sees the 16 million pairs."""
    rng = random.Random(3)
    rows = [(f"a{i}", 40 + rng.uniform(0, 0.005), 1 + rng.uniform(0, 0.005), float(i % 7)) for i in range(4000)]
    rows += [(f"b{i}", 40.9 + rng.uniform(0, 0.005), 1 + rng.uniform(0, 0.005), float(i % 5)) for i in range(4000)]
    got = {r.bin: r["count"] for r in spatial.empirical_variogram(spark.createDataFrame(rows, "id string, lat double, lon double, value double")).collect()}
    assert got == {0: 2 * 4000 * 3999 // 2, 3: 4000 * 4000} or sum(got.values()) == 8000 * 7999 // 2


def test_box_means_equal_all_pairs(spark):
    rng = random.Random(5)
    points = [(k, rng.uniform(40, 43), rng.uniform(0, 4)) for k in range(25)] + [(99, 80.0, 80.0), (98, 41.0, 2.0)]
    rows = [(a, b, rng.uniform(0, 100)) for a, b in field(6)] + [(41.5, 2.5, 10.0), (40.5, 1.5, 20.0), (41.500001, 2.0, 30.0)]
    got = {r.point_id: r["mean"] for r in ml.box_means(spark.createDataFrame(points, "point_id int, lat double, lon double"), spark.createDataFrame(rows, "latitude double, longitude double, value double").repartition(3), 0.5).collect()}
    want = {}
    for k, a, b in points:
        held = [v for c, d, v in rows if abs(c - a) <= 0.5 and abs(d - b) <= 0.5]
        if held:
            want[k] = sum(held) / len(held)
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_nearest_k_keeps_k_before_the_shuffle(spark):
    points = spark.createDataFrame([(k, 40.0 + k / 100, 1.0) for k in range(50)], "point_id int, lat double, lon double")
    right = spark.createDataFrame([(f"s{k:03d}", 40.0 + k / 90, 1.01) for k in range(60)], "name string, r_latitude double, r_longitude double")
    df = ml.nearest_k(points, right, "point_id", "name", 4, 100.0)
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    for p in points.collect():
        want = sorted(((km(p.lat, p.lon, r.r_latitude, r.r_longitude), r["name"]) for r in right.collect()))[:4]
        assert [r["name"] for r in sorted((r for r in rows if r.point_id == p.point_id), key=lambda r: r["rank"])] == [n for _, n in want]


def test_summaries_of_small_tables(spark):
    sampled = spark.createDataFrame([("a", 0.9, 0.8), ("b", 0.1, 0.3), ("c", 0.5, 0.5)], "station string, sampled double, blended double")
    assert tuple(summaries.exploration_summary(sampled).first()) == (3, 1, 33.0)
    assert tuple(summaries.exploration_summary(sampled.limit(0)).first()) == (0, 0, 0.0)
    done = spark.createDataFrame([("exclude",), ("restore",)], "action string")
    asked = spark.createDataFrame([("exclude",)] * 5, "action string")
    row = summaries.action_summary(done, asked).first()
    assert (row.total_actions, row.excludes, row.restores, row.blocked) == (2, 1, 1, 3)
    none = spark.createDataFrame([], "flag string, composite_score double")
    assert tuple(summaries.trust_summary(none).first()) == (0, 0, 0, 0, 0, 0, 0.0)
    probes = spark.createDataFrame([(True, "gap_fill", 10), (True, "quality_compare", 21), (False, "gap_fill", 900)], "success boolean, probe_type string, latency_ms int")
    assert tuple(summaries.probe_summary(probes).first()) == (3, 2, 1, 2, 1, 16.0)


def test_station_page(spark):
    hour = 3_600_000
    rows = [(f"s{k}", "username", "A", 100 * 24 * hour - k * hour, 50.0, 2.0, 90) for k in range(1, 70)] + [("x", "abc", "B", 100 * 24 * hour - 1, 1.0, 1.0, 1)]
    sessions = spark.createDataFrame(rows, "id string, username string, station string, login_time long, fix_rate double, avg_age double, duration int")
    shown = reports.station_sessions(sessions, 100 * 24 * hour, "A").collect()
    assert [r.id for r in shown] == [f"s{k}" for k in range(1, 25)] and {r.user for r in shown} == {"use***"}
    assert tuple(reports.station_week(sessions, 100 * 24 * hour, "A").first()) == (69, 1, 50.0, 2.0, 2.0)
    assert tuple(reports.station_week(sessions, 100 * 24 * hour, "none").first()) == (0, 0, 0.0, 0.0, 0.0)
    log = spark.createDataFrame([("A", "ONLINE", 99 * 24 * hour + m * 600_000) for m in range(9)] + [("A", "OFFLINE", 1)], "station_name string, status string, recorded_at long")
    assert sorted(tuple(r) for r in reports.station_status_history(log, 100 * 24 * hour, "A").collect()) == [(99 * 24 * hour, "ONLINE", 6), (99 * 24 * hour + hour, "ONLINE", 3)]


def test_nearest_rows_of_repeated_places(spark):
    """Many rows at one place, and places of any density, give what comparing all with all gives."""
    rng = random.Random(7)
    spots = [(48 + rng.uniform(-0.05, 0.05), 9 + rng.uniform(-0.05, 0.05)) for _ in range(4)] + [(48.5, 9.0), (50.0, 12.0), (30.0, -60.0), (48.3, 9.3)]
    right = [(f"s{i:03}", *rng.choice(spots)) for i in range(60)]
    left = [(i, *rng.choice([*spots, (48.2, 9.1), (48.9, 9.6), (52.0, 20.0), (-40.0, 100.0), (48.01, 9.01)])) for i in range(80)] + [(900, None, 1.0)]
    d = lambda a, b: 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1]))
                                                    * math.sin(math.radians(b[2] - a[2]) / 2) ** 2))
    points = spark.createDataFrame(left, "id int, latitude double, longitude double")
    base = spark.createDataFrame([*right, ("a", None, None)], "s string, r_latitude double, r_longitude double")
    order = {p[0]: sorted((round(d(p, r), 6), r[0]) for r in right) for p in left[:-1]}
    got = {r.id: r.s for r in nearest_join(points, base, "id", "s").collect()}
    assert got == {i: o[0][1] for i, o in order.items()} | {900: None}
    for k in (1, 5, 30):
        rows = ml.nearest_k(points, base, "id", "s", k, 100.0, "latitude", "longitude").select("id", "rank", "s").collect()
        assert sorted(map(tuple, rows)) == sorted((i, n + 1, s) for i, o in order.items() for n, (km, s) in enumerate(o[:k]) if km <= 100)


def test_nearest_join_meets_places_not_rows(spark, monkeypatch):
    """200 points and 200 stations at one place are one pair."""
    met = []
    real = geo.distance_join
    monkeypatch.setattr(geo, "distance_join", lambda *a, **k: met.append(real(*a, **k)) or met[-1])
    points = spark.range(200).selectExpr("id", "48e0 AS latitude", "9e0 AS longitude")
    right = spark.range(200).selectExpr("id AS s", "48e0 AS r_latitude", "9e0 AS r_longitude")
    assert geo.nearest_join(points, right, "id", "s").filter("s = 0").count() == 200
    assert [m.count() for m in met] == [1]


def test_box_means_are_sought_by_place_and_shuffled(spark, monkeypatch):
    from plumbline.operators import ml as module

    seen, sought = [], module.box_means
    monkeypatch.setattr(module, "box_means", lambda points, rows, half: seen.append(points.count()) or sought(points, rows, half))
    at = 1706659200000
    points = spark.createDataFrame([("a", 50.0, 8.0), ("b", 50.0, 8.0), ("c", 10.0, 8.0), ("d", None, 8.0)], "point_id string, lat double, lon double")
    stations = spark.createDataFrame([("S", 50.1, 8.0, "ONLINE")], "name string, latitude double, longitude double, status string")
    scores = spark.createDataFrame([("S", 0.9, 0.9, 55.0)], "station_name string, uq_score double, uptime_7d double, avg_fix_rate double")
    trust = spark.createDataFrame([("S", 0.9)], "station string, composite_score double")
    rows = [(f"i{k}", "u", "S", at - 1000 * k - 1000, 60.0 + k, 1.0, 600, 50.0, 8.0 + k / 10) for k in range(10)]
    sessions = spark.createDataFrame(rows, "id string, username string, station string, login_time long, fix_rate double, avg_age double, duration long, latitude double, longitude double")
    found = {r.point_id: r for r in module.protection_levels(points, stations, scores, trust, sessions, at).collect()}
    assert seen == [2]
    assert [found[k].expected_fix_rate for k in "abcd"] == [62.5, 62.5, 0.0, 0.0]
    assert [found[k].station_count for k in "abcd"] == [1, 1, 0, 0] and found["a"].hpl_m == found["b"].hpl_m
