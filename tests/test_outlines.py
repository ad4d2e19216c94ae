"""The geodesic grid and outlines of groups, against brute force on small inputs."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geodesic as g
from plumbline.functions import outlines as o
from plumbline.plans import grid_sql


def globe(n):
    """Points spread evenly over the globe, and the poles and the antimeridian."""
    k = np.arange(n)
    lat, lon = np.degrees(np.arcsin(2 * (k + 0.5) / n - 1)), (k * 222.49223594996212) % 360 - 180
    edge = np.linspace(-89.9, 89.9, 37)
    return np.concatenate([lat, [90, -90, 90, -90], edge, edge]), np.concatenate([lon, [0, 0, 180, -77], np.full(37, 180.0), np.full(37, -180.0)])


def vectors(lat, lon):
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=-1)


@pytest.mark.parametrize("resolution", [0, 1, 2, 3])
def test_cells_divide_the_globe(resolution):
    lat, lon = globe(60 * g.cell_count(resolution))
    ids = np.unique(g.locate(lat, lon, resolution))
    assert len(ids) == g.cell_count(resolution)
    near = g.around(ids, resolution)
    assert (near < 0).sum() == 12
    pairs = {(a, b) for a, row in zip(ids.tolist(), near.tolist()) for b in row if b >= 0}
    assert all((b, a) in pairs and a != b for a, b in pairs) and {b for _, b in pairs} == set(ids.tolist())
    la, lo = g._positions(g._directions(*g._face_weights(resolution, ids)))
    assert (g.locate(la, lo, resolution) == ids).all() and np.abs(lo).max() <= 180 and np.abs(la).max() <= 90
    assert abs(g.areas_km2(ids, resolution).sum() / (4 * math.pi * 6371**2) - 1) < 1e-8
    corners, _ = g.sides(ids, resolution)
    assert len(np.unique(corners[corners >= 0])) == 2 * len(ids) - 4  # Euler
    below = g.finer(ids, resolution)
    assert len(np.unique(below[below >= 0])) == g.cell_count(resolution + 1) == (below >= 0).sum()
    assert all((g.coarser(row[row >= 0], resolution + 1) == k).all() for k, row in zip(ids, below))


@pytest.mark.parametrize("resolution", [1, 2, 5])
def test_points_lie_in_the_outline_of_their_cell_only(resolution):
    """By the sides of great circles: inside the polygon of the own cell, outside those around it."""
    lat, lon = globe(3000)
    ids, p = g.locate(lat, lon, resolution), vectors(lat, lon)

    def inside(cells):
        ring, filled = g.outlines(cells, resolution)
        winding = np.zeros(len(cells))
        last = np.array([np.flatnonzero(f)[-1] for f in filled])
        before = ring[np.arange(len(cells)), last]
        for k in range(12):
            now = np.where(filled[:, k, None], ring[:, k], before)
            u, v = before - p * (before * p).sum(1, keepdims=True), now - p * (now * p).sum(1, keepdims=True)
            winding += np.arctan2((p * np.cross(u, v)).sum(1), (u * v).sum(1))
            before = now
        return np.abs(winding) > math.pi

    assert inside(ids).all()
    near = g.around(ids, resolution)
    for k in range(5):
        assert not inside(near[:, k]).any()


def test_columns_equal_arrays_and_sql(spark):
    lat, lon = globe(400)
    cells = g.locate(lat, lon, 5)
    c = F.col
    rows = spark.createDataFrame([*zip(lat.tolist(), lon.tolist()), (None, 1.0), (1.0, None)], "lat double, lon double").repartition(3)
    got = rows.withColumn("c", g.cell_of(c("lat"), c("lon"))).select(
        "lat", "lon", "c", g.cell_centre(c("c")).alias("m"), g.neighbours(c("c")).alias("n"), g.cell_disk(c("c"), 2).alias("d"), g.cell_area_km2(c("c")).alias("a"),
        g.parent(c("c"), 5).alias("p"), g.cell_outline(c("c")).alias("o")).collect()
    want = dict(zip(zip(lat.tolist(), lon.tolist()), cells.tolist()))
    for r in got:
        if r.lat is None or r.lon is None:
            assert (r.c, r.m, r.n, r.d, r.a, r.p, r.o) == (None,) * 7
            continue
        assert r.c == want[r.lat, r.lon] and len(r.d) == len(set(r.d)) == 19 and set(r.n) < set(r.d) and 100 < r.a < 400 and 6 <= len(r.o) <= 12
        assert r.p == g.coarser(np.array([r.c]), 5)[0] and abs(r.m.lon) <= 180
    con = duckdb.connect()
    con.register("pts", __import__("pandas").DataFrame({"la": lat, "lo": lon, "i": range(len(lat))}))
    assert [x[0] for x in con.sql(f"SELECT cell FROM {grid_sql.located('pts', 'la', 'lo')} ORDER BY i").fetchall()] == cells.tolist()
    con.register("cells", __import__("pandas").DataFrame({"cell": np.concatenate([cells, list(g.pentagons(5))])}))
    near = con.sql(f"SELECT cell, near FROM {grid_sql.neighbours('cells')}").fetchall()
    ids = np.unique(np.concatenate([cells, list(g.pentagons(5))]))
    assert sorted(near) == sorted((a, b) for a, row in zip(ids.tolist(), g.around(ids, 5).tolist()) for b in row if b >= 0)


def test_outlines_of_groups(spark):
    """Rings close, keep their cells to the left, leave out holes, and hold the area of the cells; across the antimeridian and at pentagons too."""
    rng = random.Random(4)
    groups = {}
    for name, lat, lon in (("line", 10.0, 179.9), ("pole", 89.8, 0.0), ("five", *(float(x[0]) for x in g._positions(g._directions(*g._face_weights(5, np.array([list(g.pentagons(5))[0]])))))), ("lone", -3.0, 7.0)):
        held = {int(g.locate(np.array([lat]), np.array([lon]), 5)[0])}
        while len(held) < (1 if name == "lone" else 60):
            held.add(rng.choice([x for x in g.around(np.array([rng.choice(sorted(held))]), 5)[0].tolist() if x >= 0]))
        groups[name] = held
    middle = int(g.locate(np.array([40.0]), np.array([5.0]), 5)[0])
    first = {x for x in g.around(np.array([middle]), 5)[0].tolist()}
    groups["hole"] = first  # a ring of six cells around one that is missing
    cells = spark.createDataFrame([(k, x) for k, held in groups.items() for x in held], "name string, cell long").repartition(4)
    outlines = o.group_outlines(cells, "name").cache()
    areas = {}
    for r in o.ring_areas(outlines, "name").collect():
        areas.setdefault(r["name"], []).append(r.area_km2)
    for name, held in groups.items():
        assert abs(sum(areas[name]) / g.areas_km2(np.array(sorted(held)), 5).sum() - 1) < 1e-6
    assert len(areas["hole"]) == 2 and min(areas["hole"]) < 0 < max(areas["hole"])
    by = {}
    for r in outlines.collect():
        by.setdefault((r["name"], r.ring), []).append((r.place, r.a, r.b))
    for rows in by.values():
        rows.sort()
        assert [p for p, _, _ in rows] == list(range(len(rows))) and rows[0][1] == min(a for _, a, _ in rows)
        assert all(rows[k][2] == rows[(k + 1) % len(rows)][1] for k in range(len(rows)))
    assert o.outline_points(outlines, "name").filter("lat is null or abs(lon) > 180").isEmpty()
    assert o.group_outlines(cells.limit(0), "name").count() == 0


def rdp(points, tolerance):
    """The recursion as it is usually written."""
    if len(points) <= 2:
        return points
    (x0, y0), (x1, y1) = points[0], points[-1]
    size = math.hypot(x1 - x0, y1 - y0)
    off = [abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / size if size else math.hypot(x - x0, y - y0) for x, y in points[1:-1]]
    k = max(range(len(off)), key=lambda i: (off[i], -i)) + 1
    if off[k - 1] <= tolerance:
        return [points[0], points[-1]]
    return rdp(points[:k + 1], tolerance)[:-1] + rdp(points[k:], tolerance)


def test_simplified_lines(spark):
    rng = random.Random(7)
    lines = {f"walk{n}": [(sum(rng.uniform(-1, 1) for _ in range(3)) + k / 9, rng.uniform(-0.2, 0.2)) for k in range(n)] for n in (3, 12, 60, 150)}
    lines["ring"] = [(math.cos(k / 10), math.sin(k / 10)) for k in range(62)] + [(1.0, 0.0)]
    lines["flat"] = [(float(k), 0.0) for k in range(50)]
    lines["pair"], lines["same"] = [(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0)] * 30
    rows = spark.createDataFrame([(k, i, *p) for k, line in lines.items() for i, p in enumerate(line)], "name string, place long, x double, y double").repartition(3)
    got = {}
    for r in o.simplified(rows, "name", "place", "x", "y", 20).collect():
        got.setdefault(r["name"], []).append((r.place, r.x, r.y))
    for name, line in lines.items():
        kept = [(x, y) for _, x, y in sorted(got[name])]
        tolerance, want = 0.001, line
        if len(line) > 20:
            want = rdp(line, tolerance)
            while len(want) > 20 and tolerance < 1:
                tolerance *= 1.5
                want = rdp(line, tolerance)
        assert kept == want, name


def naive_concave(points, longest):
    """Triangles by their empty circles, then the same rule on a plain list."""
    pts = sorted(set(points))
    triangles = []
    for i in range(len(pts)):
        for j in range(len(pts)):
            for k in range(max(i, j) + 1, len(pts)) if i != j else ():
                a, b, c = pts[i], pts[j], pts[k]
                d = 2 * ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
                if d <= 1e-12:
                    continue
                bb, cc = (b[0] - a[0])**2 + (b[1] - a[1])**2, (c[0] - a[0])**2 + (c[1] - a[1])**2
                ox, oy = ((c[1] - a[1]) * bb - (b[1] - a[1]) * cc) / d, ((b[0] - a[0]) * cc - (c[0] - a[0]) * bb) / d
                if all((p[0] - a[0] - ox)**2 + (p[1] - a[1] - oy)**2 >= ox * ox + oy * oy - 1e-9 for p in pts):
                    triangles.append((i, j, k))
    third = {}
    for t in triangles:
        for k in range(3):
            third[t[k], t[(k + 1) % 3]] = t[(k + 2) % 3]
    rim = [(a, b) for a, b in third if (b, a) not in third]
    while True:
        far = [(math.dist(pts[a], pts[b]), a, b) for a, b in rim if math.dist(pts[a], pts[b]) > longest and third[a, b] not in {x for e in rim for x in e}]
        if not far:
            return {(pts[a], pts[b]) for a, b in rim}
        _, a, b = max(far)
        rim.remove((a, b))
        rim += [(a, third[a, b]), (third[a, b], b)]


def shoelace(ring):
    return sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def holds(ring, p):
    """Inside, or on the ring."""
    odd = False
    for a, b in zip(ring, [*ring[1:], ring[0]]):
        cross = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        if abs(cross) < 1e-9 and min(a[0], b[0]) - 1e-9 <= p[0] <= max(a[0], b[0]) + 1e-9 and min(a[1], b[1]) - 1e-9 <= p[1] <= max(a[1], b[1]) + 1e-9:
            return True
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


@pytest.mark.parametrize("seed", range(6))
def test_concave_hull_equals_brute_force(seed):
    rng = random.Random(seed)
    points = [(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(14)]
    for longest in (0.25, 0.5, 9.0):
        ring = [tuple(p) for p in o.concave_hull(np.array(points), longest).tolist()]
        assert set(zip(ring, [*ring[1:], ring[0]])) == naive_concave(points, longest)
        hull = o.convex_hull(np.array(points)).tolist()
        assert all(holds(ring, p) for p in points) and 0 < shoelace(ring) <= shoelace(hull) + 1e-12
        assert (len(ring) == len(hull)) == (longest == 9.0 or abs(shoelace(ring) - shoelace(hull)) < 1e-12)


def test_concave_hull_of_few_or_straight_points():
    for points in ([(0, 0)], [(0, 0), (1, 1)], [(0, 0), (1, 0), (0, 1), (0.1, 0.1)], [(float(k), 2.0 * k) for k in range(9)], [(0, 0)] * 9):
        got = o.concave_hull(np.array(points, float), 0.01)
        assert got.tolist() == o.convex_hull(np.array(points, float)).tolist()
    grid = np.array([(float(i), float(j)) for i in range(7) for j in range(7) if not (2 <= i <= 4 and j >= 2)])
    ring = [tuple(p) for p in o.concave_hull(grid, 1.6).tolist()]
    assert all(holds(ring, tuple(p)) for p in grid.tolist()) and shoelace(ring) < 30  # the bay is open


def test_concave_outlines_leave_out_only_what_is_within(spark):
    rng = random.Random(11)
    bay = [(rng.uniform(40, 44), rng.uniform(0, 4)) for _ in range(1500)]
    bay = [p for p in bay if not (41 < p[0] and 1 < p[1] < 3)]
    few = [(10.0, 179.0), (10.5, 179.5), (11.0, 179.2)]
    rows = spark.createDataFrame([("bay", *p) for p in bay] + [("few", *p) for p in few], "name string, latitude double, longitude double").repartition(4)
    got = {r["name"]: [tuple(p) for p in r.corners] for r in o.concave_outlines(rows, "name", 60.0).collect()}
    scale = math.cos(math.radians(sum(p[0] for p in bay) / len(bay)))
    whole = o.concave_hull(np.array(bay), 60 / 111, scale).tolist()
    assert set(got["bay"]) == set(map(tuple, whole)) and all(holds(got["bay"], p) for p in bay)
    assert shoelace(got["bay"]) < 0.75 * shoelace(o.convex_hull(np.array(bay)).tolist())
    assert len(got["few"]) == 3
