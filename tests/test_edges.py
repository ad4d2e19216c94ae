"""Hand-made edge cases and plain-Python twins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geodesic
from plumbline.functions.geo import distance_join, nearest_join
from plumbline.functions.graph import connected_components
from plumbline.functions.greedy import keep_best
from plumbline.functions.rules import DAY, HOUR, half_up
from plumbline.operators import actions, areas, detectors, ml, spatial, trust, zones
from plumbline.plans import registry, signal_queries
from plumbline.plans.fixtures import AS_OF, Tables
from plumbline.sources import tables
from plumbline.streaming import jobs


def km(a, b, c, d):
    x = np.sin(np.radians(c - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(c)) * np.sin(np.radians(d - b) / 2) ** 2
    return 2 * 6371 * np.arcsin(np.sqrt(min(1, x)))


def test_half_up(spark):
    row = spark.range(1).select(half_up(F.lit(-0.25), 1), half_up(F.lit(0.25), 1), half_up(F.lit(2.5)), half_up(F.lit(-2.5))).first()
    assert list(row) == [-0.2, 0.3, 3.0, -2.0]


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    for n, m in ((30, 20), (60, 70)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(100, 140)]
        root = {}

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == {v: find(v) for e in edges for v in e}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("reach", [5.0, 80.0, 1000.0, 6000.0])
def test_distance_join_is_exact(spark, reach):
    rng = random.Random(int(reach))
    pts = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)] + [(100, 60.0, 10.0), (101, 60.0, 11.4), (102, 10.0, 179.99), (103, 10.0, -179.99), (104, 89.9, 0.0), (105, 89.9, 180.0), (106, -90.0, 5.0),
                                                                                         (107, 10.0, 180.0), (108, 10.0, -180.0), (109, 60.0, 10.0), (110, 0.0, 0.0), (111, 0.0001, 359.9999 - 360)]
    left = spark.createDataFrame(pts, "id int, latitude double, longitude double")
    right = spark.createDataFrame([*pts, (999, None, None)], "r_id int, r_latitude double, r_longitude double")
    got = sorted((r.id, r.r_id) for r in distance_join(left, right, reach).collect())
    assert got == sorted((a[0], b[0]) for a in pts for b in pts if km(a[1], a[2], b[1], b[2]) <= reach)


def test_nearest_join(spark):
    rng = random.Random(3)
    left = [(i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(40)]
    right = [(f"s{i}", rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(9)] + [("a", 0.0, 0.0), ("b", 0.0, 0.0)]
    got = {r.id: r.s for r in nearest_join(spark.createDataFrame([*left, (77, 0.0, 0.1)], "id int, latitude double, longitude double"), spark.createDataFrame(right, "s string, r_latitude double, r_longitude double"), "id", "s").collect()}
    assert got[77] == "a" and all(got[i] == min(right, key=lambda s: (km(la, lo, s[1], s[2]), s[0]))[0] for i, la, lo in left)


def test_bearing_gap(spark):
    gap = lambda *b: spark.range(1).select(spatial.bearing_gap(F.array(*[F.lit(float(x)) for x in b]))).first()[0]
    assert gap(10) == 360 and gap(0, 180) == 180 and gap(-170, 170) == 340 and gap(-120, 0, 120) == 120


def test_keep_best_equals_the_sequential_pass(spark):
    rng = random.Random(12)
    for n, m in ((12, 10), (40, 90)):
        ranks = list(range(n))
        rng.shuffle(ranks)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        near = {k: {b for a, b in edges if a == k} | {a for a, b in edges if b == k} for k in range(n)}
        kept = set()
        for k in sorted(range(n), key=lambda k: ranks[k]):
            if not near[k] - {k} & kept:
                kept.add(k)
        got = keep_best(spark.createDataFrame(list(enumerate(ranks)), "node long, rank long"), spark.createDataFrame(edges, "src long, dst long"))
        assert {r.node for r in got.collect()} == kept


def test_overlay_zones_thin_and_merge(spark):
    near = spark.createDataFrame([("A", 50.0, 5.0, "LEICA", 60.0), ("B", 50.01, 5.0, "SURVEY_GRADE_INFERRED", 60.0), ("C", 50.5, 5.0, "TRIMBLE", 60.0), ("D", 60.0, 5.0, "LEICA", None), ("E", 40.0, 5.0, "U-BLOX", 100.0)],
                                 "name string, latitude double, longitude double, receiver_type string, distance_km double")
    validation = spark.createDataFrame([("E", "confirmed", 80.0)], "station string, status string, fix_rate double")
    rows = {r.name: r for r in actions.overlay_zones(near, validation).collect()}
    assert set(rows) == {"A", "C", "D", "E"} and rows["C"].area == "ono_A" and rows["D"].area == "ono_D" and rows["E"].radius_m == 25000


def sessions(spark, rows):
    return spark.createDataFrame([(str(i), "u%d" % (i % 7), *r) for i, r in enumerate(rows)], "id string, username string, station string, login_time long, fix_rate double, avg_age double, duration long, latitude double, longitude double")


def test_clusters_need_a_core_and_time(spark):
    place = lambda k, minute: ("S", AS_OF - (100 - minute) * 60_000, 10.0, 1.0, 100, 50.0, 10.0 + k)
    chain = [place(0.3 * k, 0) for k in range(5)]  # linked pairwise, none has three neighbours
    star = [place(20.0, 0), place(20.1, 1), place(20.2, 2), place(20.15, 3), place(20.5, 9)]  # the last is absorbed
    late = [place(40.0, 0), place(40.0, 11), place(40.0, 22), place(40.0, 33)]  # one place, too far apart in time
    rows = detectors.interference_clusters(sessions(spark, chain + star + late), AS_OF).collect()
    assert len(rows) == 1 and rows[0].points == 5


def test_cusum_twin(spark):
    rng = random.Random(8)
    rows, start = [], AS_OF - 6 * HOUR
    for s in range(6):
        rows += [(f"S{s}", start - rng.randrange(1, 20 * HOUR), 80 + rng.random(), 1.0, 500, 1.0, 1.0) for _ in range(10)]
        rows += [(f"S{s}", start + b * 1_800_000 + 5, rng.choice([5.0, 40.0, 85.0]) if s else 5.0, 1.0, 500, 1.0, 1.0) for b in range(12)]
    got = {r.station: r for r in detectors.cusum_counters(sessions(spark, rows), AS_OF).collect()}
    for s in range(6):
        own = [r for r in rows if r[0] == f"S{s}"]
        base = np.mean([r[2] for r in own if r[1] < start])
        low, ewma, alarms, drops = 0.0, base, 0, 0
        for k, r in enumerate(sorted((r for r in own if r[1] >= start), key=lambda r: r[1]), 1):
            low = max(0, low - (r[2] - base) / max(5, base * 0.15) - 0.5)
            if low > 5 and k >= 3:
                alarms, low = alarms + 1, 0.0
            ewma = 0.2 * r[2] + 0.8 * ewma
            drops += k >= 5 and base > 50 and base - ewma > 15
        assert (got[f"S{s}"].cusum_alarms, got[f"S{s}"].ewma_alarms) == (alarms, drops) and abs(got[f"S{s}"].s_minus - low) < 0.01


def test_trust_hysteresis(spark):
    cases = {"a": (5.98, 200.0), "b": (6.0, 200.0), "c": (23.9, 30.0), "d": (24.0, 30.0), "e": (48.0, 2.0)}
    state = spark.createDataFrame([(k, al, 20.0 if al == 30 else 1.0 if al == 200 else 50.0, AS_OF, int(AS_OF - h * HOUR)) for k, (h, al) in cases.items()], trust.STATE)
    none = sessions(spark, []) if False else spark.createDataFrame([], sessions(spark, [("S", 0, 0.0, 0.0, 0, 0.0, 0.0)]).schema)
    stations = spark.createDataFrame([], "name string, latitude double, longitude double, network string")
    scores = spark.createDataFrame([], "station_name string, uq_score double, uptime_7d double")
    counts = spark.createDataFrame([], "station string, anomalies long")
    rows = {r.station: r for r in trust.trust_scores(none, state, stations, scores, counts, AS_OF).collect()}
    assert rows["a"].flag == "excluded" and rows["b"].flag == "probation" and rows["c"].flag == "excluded" and rows["d"].flag == "probation" and rows["e"].flag == "excluded"
    assert rows["d"].excluded_at is None and rows["c"].alpha == 30.0  # no sessions, no decay


def test_validation_ladder(spark):
    fresh = spark.createDataFrame([("n9", 90.0, 9), ("n10", 80.0, 10), ("n10b", 19.9, 10), ("n49", 70.0, 49), ("n50", 70.0, 50), ("stale", 90.0, 60)], "station string, new_fix double, new_sessions long")
    old = spark.createDataFrame([("stale", "live_testing", 10.0, 5, AS_OF - 7 * DAY - 1), ("kept", "confirmed", 88.0, 70, AS_OF)], "station string, status string, fix_rate double, sessions long, last_updated long")
    rows = {r.station: r for r in trust.overlay_validation(old, fresh, AS_OF).collect()}
    assert [rows[k].status for k in ("n9", "n10", "n10b", "n49", "n50", "stale", "kept")] == ["live_testing", "confirmed", "rejected", "live_testing", "confirmed", "confirmed", "confirmed"]
    assert rows["stale"].fix_rate == 90.0


def test_geofences(spark):
    pts = spark.createDataFrame([("in", 0.25, 0.5), ("notch", 0.5, 0.9), ("far", 60.0, 170.0), ("edge", 0.0, 0.0)], "name string, latitude double, longitude double")
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.5, 0.5], [0.0, 1.0]]
    fence = spark.createDataFrame([("poly", True, "polygon", None, None, None, ring), ("off", False, "circle", 0.0, 0.0, 1e9, None), ("world", True, "circle", 0.0, 0.0, 2.1e7, None), ("near", True, "circle", 0.0, 0.0, 50_000.0, None)],
                                  "zone_id string, enabled boolean, fence_type string, lat double, lon double, radius_m double, points array<array<double>>")
    got = {(r.name, r.zone_id) for r in zones.point_in_geofence(pts, fence).collect()}
    assert ("in", "poly") in got and ("notch", "poly") not in got and ("edge", "near") in got and not any(z == "off" for _, z in got)
    assert {n for n, z in got if z == "world"} == {"in", "notch", "far", "edge"}


def test_alert_throttle(spark):
    minute = 60_000
    events = [(1, "interference", "warning", 0), (2, "interference", "warning", 15 * minute - 1000), (3, "interference", "warning", 15 * minute), (4, "interference", "info", 0), (5, "anomaly", "warning", 0), (6, "anomaly", "critical", 5)]
    sent = jobs.throttled_alerts(spark.createDataFrame(events, "event_id long, type string, severity string, ts_ms long"))
    assert sorted(r.event_id for r in sent.collect()) == [1, 3, 6]


RINEX = "\n".join([
    f"{'     3.04           OBSERVATION DATA    M':<60}RINEX VERSION / TYPE", f"{'G    4 C1C L1C S1C C2W':<60}SYS / # / OBS TYPES", f"{'':<60}END OF HEADER",
    "> 2024 01 31 00 00  0.0000000  0  2", "G01  22000000.000   115000000.000 8        45.000          0.000", "G02  23000000.000",
    "> 2024 01 31 00 00 30.0000000  4  1", "some special record", "> 2024 01 31 00 01  0.0000000  0  1", "G01  22000001.000", ""])


def test_observation_files(spark, tmp_path):
    (tmp_path / "a.rnx").write_text(RINEX)
    rows = tables.parse_observations(spark, str(tmp_path)).collect()
    assert [(r.prn, sorted(r.obs)) for r in rows] == [("G01", ["C1C", "L1C", "S1C"]), ("G02", ["C1C"]), ("G01", ["C1C"])]
    assert rows[2].epoch_s - rows[0].epoch_s == 60 and tables.parse_observations(spark, str(tmp_path), 1).count() == 2


def test_ionosphere_maps(spark, tmp_path):
    row = "".join(f"{v:5d}" for v in range(10, 26))
    text = "\n".join([f"{'    -1':<60}EXPONENT", f"{'':<60}END OF HEADER", f"{'     1':<60}START OF TEC MAP", f"{'  2024     1    31     0     0     0':<60}EPOCH OF CURRENT MAP",
                      f"{'    87.5-180.0 -90.0   5.0 450.0':<60}LAT/LON1/LON2/DLON/H", row, "   99  999 9999", f"{'     1':<60}END OF TEC MAP"])
    (tmp_path / "m.inx").write_text(text)
    rows = tables.parse_iono_maps(spark, str(tmp_path)).orderBy("lon").collect()
    assert len(rows) == 18 and rows[0].vtec == 1.0 and abs(rows[15].vtec - 2.5) < 1e-9 and abs(rows[17].vtec - 99.9) < 1e-9 and rows[0].lat == 87.5


def test_streams_equal_batch(spark, tmp_path):
    rng = random.Random(6)
    data = sessions(spark, [(f"S{i % 3}", AS_OF - rng.randrange(2 * HOUR), float(rng.randrange(100)), 1.0, 300, 1.0, 1.0) for i in range(200)])
    data.unionByName(data.limit(50)).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    for name, frame, mode in (("dedup", jobs.deduplicated(stream).select("id"), "append"), ("windows", jobs.window_stats(stream, "30 minutes"), "complete")):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("dedup").count() == 200
    batch = jobs.window_stats(spark.read.parquet(str(tmp_path / "in")), "30 minutes")
    key = lambda df: sorted((r.start_ms, r.station, r.sessions, round(r.mean_fix, 6)) for r in df.collect())
    assert key(spark.table("windows")) == key(batch)


def test_stream_detector_keeps_state_between_batches(spark, tmp_path):
    values = [80.0] * 5 + [80.0, 20.0, 20.0, 20.0, 20.0, 85.0]
    for k, x in enumerate(values):
        spark.createDataFrame([("S", k * 300_000, x), ("T", k * 300_000, 80.0)], "station string, start_ms long, mean_fix double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("station string, start_ms long, mean_fix double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.cusum_stream(stream).writeStream.format("memory").queryName("cusum").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    rows = spark.table("cusum").collect()
    want, low, ewma = [], 0.0, 80.0
    for k, x in enumerate(values[5:], 1):
        low = max(0, low - (x - 80) / 12 - 0.5)
        ewma = 0.2 * x + 0.8 * ewma
        alarm = low > 5 and k >= 3
        want.append((alarm, k >= 5 and 80 - ewma > 15))
        low = 0.0 if alarm else low
    assert [(r.cusum_alarm, r.ewma_alarm) for r in sorted((r for r in rows if r.station == "S"), key=lambda r: r.start_ms)] == want and any(a for a, _ in want)
    assert not any(r.cusum_alarm or r.ewma_alarm for r in rows if r.station == "T")


def test_coverage_zones(spark):
    rng = random.Random(4)
    near = lambda c: [int(x) for x in geodesic.around(np.array([c]), 5)[0] if x >= 0]
    field = {int(geodesic.locate(np.array([61.0]), np.array([-179.9]), 5)[0])}
    for _ in range(7):
        field |= {x for c in field for x in near(c)}
    ids = {c for c in sorted(field) if rng.random() < 0.45}
    gone = int(geodesic.locate(np.array([1.0]), np.array([1.0]), 5)[0])
    cells = spark.createDataFrame([(c,) for c in ids | {gone}], "cell long").withColumn("m", geodesic.cell_centre(F.col("cell"))).select(
        F.col("cell").cast("string").alias("cell_id"), F.col("m.lat").alias("latitude"), F.col("m.lon").alias("longitude"), F.lit(0.8).alias("quality_score"), F.when(F.col("cell") == gone, "no_coverage").otherwise("full_rtk").alias("zone_tier"))
    stations = spark.createDataFrame([], "name string, network string, latitude double, longitude double")
    cells = cells.filter("longitude > 0 or zone_tier = 'no_coverage'")  # a zone's mean longitude is not that of one across the antimeridian
    here = {int(r.cell_id) for r in cells.collect()}
    rows = areas.coverage_zones(cells, stations, spark.createDataFrame([], "station string, composite_score double")).collect()
    parts = [p for p in split_groups(ids & here, near) if len(p) >= 3]
    assert sorted(r.cells for r in rows) == sorted(map(len, parts)) and max(map(len, parts)) >= 7
    where = {r.cell_id: (r.latitude, r.longitude) for r in cells.collect()}
    for r in rows:
        group = next(g for g in parts if int(r.zone_id) in g)
        assert r.zone_id == min(map(str, group)) and (r.fence_type == "circle") == (len(group) < 7)
        if r.points:
            inside = spark.createDataFrame([where[str(c)] for c in group], "lat double, lon double").select(zones.in_polygon(F.col("lat"), F.col("lon"), F.array(*[F.array(*map(F.lit, p)) for p in r.points])).alias("y"))
            assert len(r.points) <= 40 and all(x.y for x in inside.collect())


def split_groups(cells, near):
    """The connected parts of a set of cells."""
    left, out = set(cells), []
    while left:
        part, stack = set(), [next(iter(left))]
        while stack:
            c = stack.pop()
            if c in left and c not in part:
                part.add(c)
                stack += near(c)
        left -= part
        out.append(part)
    return out


def test_kriging_reproduces_points():
    rng = np.random.default_rng(1)
    lat, lon, value = rng.uniform(40, 42, 12), rng.uniform(0, 2, 12), rng.uniform(0, 100, 12)
    for k in range(12):
        d = np.array([km(lat[k], lon[k], a, b) for a, b in zip(lat, lon)])
        p, v, sure = spatial.solve_kriging(lat, lon, value, d, "exponential", 0.0, 100.0, 200.0)
        assert abs(p - value[k]) < 0.1 and v < 0.1 and sure == "high"


def test_alert_jobs_gather_no_key_in_one_task(spark):
    rng, rows, minute = random.Random(4), [], 60_000
    for kind in ("interference", "anomaly"):
        at = -50 * 60 * minute
        for i in range(1500):
            at += rng.choice([0, 1, 20_000, minute, 4 * minute, 15 * minute - 1, 15 * minute, 9 * 60 * minute if rng.random() < 0.05 else 3 * minute])
            rows.append((rng.randrange(10**6), kind, "critical", at))
    rows += [(1, "sync", "critical", 0), (2, "anomaly", "warning", 0), (3, "anomaly", "critical", None), (4, "interference", "info", 0), (5, None, "critical", 0)]
    want = []
    for kind in ("interference", "anomaly"):
        last = -(2**62)
        for ts, i in sorted((r[3], r[0]) for r in rows if r[1] == kind and r[2] == "critical" and r[3] is not None):
            if ts - last >= 15 * minute:
                last = ts
                want.append((kind, "critical", i, ts))
    events = spark.createDataFrame(rows, "event_id long, type string, severity string, ts_ms long").repartition(7)
    sent = jobs.throttled_alerts(events)
    assert sorted(map(tuple, sent.collect())) == sorted(want)
    history = jobs.recent_history(events.select(F.col("type").alias("key"), "ts_ms"), rows[1499][3], keep=50, days=1)
    for r in history.collect():
        newest = sorted((x[3] for x in rows if x[1] == r.key and x[3] is not None), reverse=True)[:50]
        assert r.held == len(newest) and r.recent == sum(t > rows[1499][3] - 86_400_000 for t in newest)
    for df in (sent, history):
        assert "collect_list" not in df._jdf.queryExecution().toString()


def test_nearest_join_far_from_everything(spark):
    """Rows in every part of the globe and at its edges, with a right side in a few places only; nothing is compared with all."""
    rng = random.Random(11)
    left = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(120)] + [(900, None, 3.0), (901, 90.0, 0.0), (902, 0.0, 180.0), (903, 0.0, -180.0)]
    right = [(f"r{i}", rng.uniform(-60, -40) if i % 2 else rng.uniform(40, 50), rng.uniform(150, 180) if i % 3 else rng.uniform(-180, -170)) for i in range(60)]
    schemas = "id int, latitude double, longitude double", "r string, r_latitude double, r_longitude double"
    out = nearest_join(spark.createDataFrame(left, schemas[0]), spark.createDataFrame(right, schemas[1]), "id", "r")
    for row in out.collect():
        if row.latitude is None:
            assert row.r is None
        else:
            assert abs(row.distance_km - min(km(row.latitude, row.longitude, a, b) for _, a, b in right)) < 1e-6
    assert nearest_join(spark.createDataFrame(left, schemas[0]), spark.createDataFrame([], schemas[1]), "id", "r").filter("r is null").count() == len(left)


@pytest.mark.parametrize("name", ["nearest_join", "gap_fill", "probe_targets", "overlay_candidates", "point_in_geofence"])
def test_plans_hold_no_cross_product(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_geofences_of_every_width(spark):
    rng = random.Random(12)
    fences = [(f"c{i}", True, "circle", rng.uniform(-88, 88), rng.uniform(-180, 180), 10 ** rng.uniform(3, 7.2), None) for i in range(25)]
    fences += [("w", True, "circle", 10.0, 179.5, 300_000.0, None), ("pole", True, "circle", 89.5, 0.0, 400_000.0, None), ("all", True, "circle", 0.0, 0.0, 2.1e7, None), ("off", False, "circle", 0.0, 0.0, 2.1e7, None),
               ("square", True, "polygon", None, None, None, [[-40.0, -100.0], [50.0, -100.0], [50.0, 120.0], [-40.0, 120.0]]), ("line", True, "polygon", None, None, None, [[0.0, 0.0], [1.0, 1.0]])]
    spots = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(500, 10.0, -179.6), (501, 90.0, 5.0), (502, -90.0, 0.0), (503, 0.0, 180.0), (504, 0.0, -180.0), (505, None, 1.0)]
    table = spark.createDataFrame(fences, "zone_id string, enabled boolean, fence_type string, lat double, lon double, radius_m double, points array<array<double>>")
    got = {(r.id, r.zone_id) for r in zones.point_in_geofence(spark.createDataFrame(spots, "id int, latitude double, longitude double"), table).collect()}
    want = {(i, f[0]) for i, a, b in spots if a is not None for f in fences if f[1] and f[2] == "circle" and km(a, b, f[3], f[4]) * 1000 <= f[5]}
    want |= {(i, "square") for i, a, b in spots if a is not None and -40 < a < 50 and -100 < b < 120}
    assert got == want


def test_clusters_of_a_jammed_city(spark):
    """Very many points of one place cost few pairs, and the clusters equal brute force."""
    rng = random.Random(13)
    rows = [("S", AS_OF - rng.randrange(60) * 60_000, 10.0, 1.0, 100, 50.0 + rng.gauss(0, 0.02), 10.0 + rng.gauss(0, 0.02)) for _ in range(400)]
    rows += [("S", AS_OF - rng.randrange(300) * 60_000, 10.0, 1.0, 100, 50.0 + rng.uniform(-2, 2), 10.0 + rng.uniform(-2, 2)) for _ in range(250)]
    table = sessions(spark, rows)
    points = [(str(i), r[1], r[5], r[6]) for i, r in enumerate(rows)]
    edges = {i: set() for i, *_ in points}
    for i, t, a, b in points:
        for j, u, c, d in points:
            if i < j and abs(t - u) <= 600_000 and km(a, b, c, d) <= 30:
                edges[i].add(j)
                edges[j].add(i)
    seen, want = set(), {}
    for i in edges:
        if i in seen:
            continue
        group, stack = set(), [i]
        while stack:
            k = stack.pop()
            if k not in group:
                group.add(k)
                stack += edges[k]
        seen |= group
        if max(len(edges[k]) for k in group) >= 3 and len({int(k) % 7 for k in group}) >= 3:
            want[min(group)] = len(group)
    got = {r.cluster: r.points for r in detectors.interference_clusters(table, AS_OF).collect()}
    assert got == want and max(want.values()) > 300 and len(want) > 1


def test_kriging_surface_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    lat, lon, value = np.r_[rng.uniform(50, 54, 30), rng.uniform(84, 88, 6)], np.r_[rng.uniform(-3, 3, 30), rng.uniform(170, 190, 6) % 360 - 180 * 0], rng.uniform(0, 100, 36)
    lon = np.where(lon > 180, lon - 360, lon)
    points = spark.createDataFrame([(f"p{k:02d}", float(a), float(b), float(v)) for k, (a, b, v) in enumerate(zip(lat, lon, value))], "id string, lat double, lon double, value double")
    model = spark.createDataFrame([("exponential", 5.0, 900.0, 120.0)], "model string, nugget double, sill double, range double")
    got = {(r.lat, r.lon): r for r in spatial.kriging_surface(points, model, 2.0, neighbours=8).collect()}
    want = {}
    for g_lat in np.arange(-90, 91, 2.0):
        for g_lon in np.arange(-180, 180, 2.0):
            d = np.array([km(g_lat, g_lon, a, b) for a, b in zip(lat, lon)])
            near = np.lexsort((np.arange(36), d))[:8]
            near = near[d[near] <= 240]
            if (d <= 240).sum() >= 3:
                want[g_lat, g_lon] = spatial.solve_kriging(lat[near], lon[near], value[near], d[near], "exponential", 5.0, 900.0, 120.0)
    assert set(want) <= set(got) and all(abs(x) == 180 for _, x in set(got) - set(want))
    assert all(abs(got[k].predicted - p) < 0.011 and abs(got[k].variance - v) < 0.0011 and got[k].confidence == sure for k, (p, v, sure) in want.items())


def test_sample_priorities_follow_the_distribution(spark):
    state = spark.createDataFrame([(f"S{k}", 8.0, 4.0, None) for k in range(4000)] + [("X", 8.0, 4.0, "excluded")], "station string, alpha double, beta double, flag string")
    rows = ml.sample_priorities(state).collect()
    mean, drawn = 8 / 12, np.array([r.sampled for r in rows])
    assert len(rows) == 4000 and max(drawn) <= mean + 0.15 + 1e-12 and len(set(drawn)) > 3000
    reference = np.minimum(np.random.default_rng(0).beta(8, 4, 200_000), mean + 0.15)
    assert abs(drawn.mean() - reference.mean()) < 0.01 and abs(drawn.std() - reference.std()) < 0.01
    assert all(abs(r.blended - (0.7 * r.sampled + 0.3 * mean)) < 1e-9 for r in rows)
    again = {r.station: r.sampled for r in ml.sample_priorities(state.orderBy(F.desc("station")).repartition(5)).collect()}
    assert again == {r.station: r.sampled for r in rows}


def test_models_learn_and_stop(spark):
    rng = np.random.default_rng(3)
    rows = [(str(k), float(10 * a + b), float(a), float(b), float(c)) for k, (a, b, c) in enumerate(rng.uniform(0, 1, (1500, 3)))]
    features = spark.createDataFrame(rows, "id string, label double, strong double, weak double, noise double")
    assert ml.train_forest(features.limit(99)) is None and ml.model_report(None, features).count() == 0
    report = {r.feature: r for r in ml.model_report(ml.train_forest(features), features).collect()}
    assert report["strong"].importance > 0.9 and report["noise"].importance < 0.05 and report["strong"].r2 > 0.95 and report["strong"].trees == 50
    train, test = ml.split(features)
    boosted = {r.feature: r for r in ml.model_report(ml.train_boosted(train, test, rounds=25), test).collect()}
    assert boosted["strong"].importance > 0.5 and boosted["strong"].r2 > 0.6 and boosted["strong"].trees <= 25
    stopped = ml.train_boosted(train, test, rounds=25, tolerance=0.5)
    assert stopped.getNumTrees < 25


def test_pseudonyms_count_on_beyond_four_digits(spark):
    rows = spark.range(12_000).select(F.col("id"), F.concat(F.lit("name"), F.col("id") % 11_000).alias("station"))
    got = {r.station for r in tables.pseudonymize(rows).select("station").distinct().collect()}
    assert got == {f"STN-{k:04d}" for k in range(1, 11_001)}


def test_models_read_their_rows_once(spark, sf):
    """Sessions are joined and grouped once; training, errors and predictions read the stored features."""
    t = Tables(spark, sf)
    rows = signal_queries.f15(t)
    scored = signal_queries.predictions(t)
    assert not any(x in scored._jdf.queryExecution().optimizedPlan().toString() for x in ("Join", "Aggregate"))
    held = {r.id for r in ml.split(rows)[1].select("id").collect()}
    got = {r.id: r.held for r in scored.select("id", "held").collect()}
    assert len(got) == rows.count() and {k for k, v in got.items() if v} == held and 0 < len(held) < len(got)
