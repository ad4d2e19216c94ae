"""Work that must not grow faster than its input."""

import os
import random

from pyspark.sql import functions as F

from plumbline.functions.geo import distance_join, nearest_k
from plumbline.operators import observations, zones
from plumbline.plans import fixtures, io_queries, version_queries
from plumbline.plans.fixtures import AS_OF, Tables
from plumbline.sources import tables
from plumbline.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_dealt_to_all_tasks(spark):
    """the optimizer merges tasks by the bytes of their rows, not by the pairs that these give."""
    rng = random.Random(1)
    left = spark.createDataFrame([(i, 50 + rng.random(), 8 + rng.random()) for i in range(60)], "id int, latitude double, longitude double")
    right = left.toDF("r_id", "r_latitude", "r_longitude")
    pairs = distance_join(left, right, 60.0, spread=True)
    assert plan(pairs).count("REPARTITION_BY_NUM") >= 2
    assert sorted(pairs.select("id", "r_id").collect()) == sorted(distance_join(left, right, 60.0).select("id", "r_id").collect())


def test_sparse_places_open_few_cells(spark):
    """a place outside a dense area does not meet all of its rows."""
    rng = random.Random(2)
    base = spark.createDataFrame([(f"s{i:04}", 50 + rng.random() * 2, 8 + rng.random() * 2) for i in range(2000)], "s string, r_latitude double, r_longitude double")
    points = spark.createDataFrame([(k, 50.0 + k, 13.0) for k in range(3)], "p int, lat double, lon double")
    got = nearest_k(points, base, "p", "s", 5, 500.0)
    met = distance_join(points, base, 500.0, "lat", "lon")
    assert met.count() > 5000
    want = {p: [r.s for r in sorted(met.filter(F.col("p") == p).collect(), key=lambda r: (r.distance_km, r.s))[:5]] for p in range(3)}
    assert {p: [r.s for r in sorted(got.filter(F.col("p") == p).collect(), key=lambda r: r["rank"])] for p in range(3)} == want
    assert "_cell" in plan(got)


def test_uncovered_sessions_equal_brute_force(spark):
    """sessions meet one row of a cell; borders, poles, null longitudes and cells partly covered included."""
    rng = random.Random(3)
    at = [(rng.uniform(-3, 3) + base, rng.uniform(-3, 3)) for base in (0.0, 50.0, 86.0) for _ in range(300)] + [(50.0, None), (50.0, None)]
    sessions = spark.createDataFrame([(f"i{k}", AS_OF - 1000 - k, la, lo) for k, (la, lo) in enumerate(at)], "id string, login_time long, latitude double, longitude double")
    place = [(rng.uniform(-3, 3) + base, rng.uniform(-3, 3)) for base in (0.0, 50.0, 86.0) for _ in range(40)]
    stations = spark.createDataFrame(place, "latitude double, longitude double")
    found = zones.uncovered_sessions(sessions, stations, AS_OF, km=40.0, least=1)
    assert "_part" not in found.columns and plan(found).count("Scan ExistingRDD[id") == 1
    got = {(r.row, r.column): r.sessions for r in found.collect()}
    sql = """SELECT floor(latitude) AS i, floor(longitude) AS j, count(*) AS n FROM ses s WHERE abs(latitude) > 0.1 AND NOT EXISTS (SELECT 1 FROM sta p WHERE abs(p.latitude) > 0.1 AND
      sqrt(pow((s.latitude - p.latitude) * 111, 2) + pow((s.longitude - p.longitude) * 111 * cos(radians(s.latitude)), 2)) <= 40) GROUP BY 1, 2"""
    sessions.createOrReplaceTempView("ses")
    stations.createOrReplaceTempView("sta")
    assert got == {(r.i, r.j): r.n for r in spark.sql(sql).collect()}


def test_sliding_windows_are_added_up_from_slots(spark):
    """sessions are not repeated for each window."""
    rng = random.Random(4)
    rows = [(f"i{k}", "a" if k % 3 else "b", rng.randrange(0, 4_000_000), float(rng.randrange(1, 100)) if k % 7 else None, float(rng.randrange(-1, 5)), 300) for k in range(300)]
    sessions = spark.createDataFrame(rows, "id string, station string, login_time long, fix_rate double, avg_age double, duration int")
    found = jobs.window_stats(sessions, "25 minutes", "10 minutes")
    assert "Expand" not in plan(found)
    kept = jobs.with_event_time(jobs.clean_sessions(sessions))
    want = kept.groupBy(F.window("ts", "25 minutes", "10 minutes").alias("w"), "station").agg(
        F.count("*").alias("n"), F.avg("fix_rate").alias("fix"), F.avg(F.when(F.col("avg_age") > 0, F.col("avg_age"))).alias("age")).select(F.unix_millis("w.start").alias("start_ms"), "station", "n", "fix", "age")
    tidy = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert tidy(found) == tidy(want)


def test_sessions_of_all_cycles_are_read_once(spark, sf):
    """F38, F39"""
    t = Tables(spark, sf)
    days = version_queries.proposals(t, version_queries.AT)
    assert len(days) == 6 and all("lineitem" not in plan(df) and "Exchange" not in plan(df) for _, df in days)


def test_observations_are_grouped_in_tasks_of_bounded_size(spark, sf, monkeypatch):
    """no row is repeated to count distinct values, rows are shuffled once, and tasks grow in number, not in size."""
    found = observations.observation_summary(Tables(spark, sf).fx_obs)
    assert "Expand" not in plan(found)
    before = found.collect()
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 500)
    small = Tables(spark, sf).fx_obs
    assert small.rdd.getNumPartitions() > 10 and sorted(observations.observation_summary(small).collect()) == sorted(before)
    rows = [(1, "G01", 5, 1.0, None), (1, None, 5, 0.0, None), (1, "G01", None, 1.0, None), (None, "G02", 7, None, 0.0), (None, "G03", 9, None, 2.0)]
    odd = spark.createDataFrame(rows, "file_id int, prn string, epoch_s int, c1 double, s1 double").selectExpr("*", "cast(null as double) as c2", "c2 as l1", "c2 as l2")
    got = {r.file_id: (r.duration_s, r.epochs, r.satellites, r.bands, r.mean_satellites) for r in observations.observation_summary(odd).collect()}
    assert got == {1: (0, 1, 1, "C1", 3.0), None: (2, 2, 2, "S1", 1.0)}


def test_observation_files_lie_in_few_folders(spark, sf, tmp_path, monkeypatch):
    """one folder for each ``file_id``, not for each file; long files leave a task in parts."""
    monkeypatch.setattr(io_queries, "EPOCHS_PER_FILE", 100)
    path = str(tmp_path / "files")
    io_queries.observation_files(Tables(spark, sf), path)
    found = [(where, [n for n in names if n.endswith(".txt")]) for where, _, names in os.walk(path) if "file_id=" in where]
    parts = Tables(spark, sf).fx_obs.select("file_id", F.floor(F.col("epoch_s") / 100)).distinct().count()
    assert len(found) == 10 and sum(len(names) for _, names in found) == parts > 50
    assert tables.parse_observations(spark, f"{path}/*").count() == Tables(spark, sf).fx_obs.count()
