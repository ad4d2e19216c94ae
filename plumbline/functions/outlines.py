"""Outlines of groups: rings from the sides of cells, simplified lines, concave hulls. No group has to fit into one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .geo import EARTH_KM
from .geodesic import DEFAULT_RESOLUTION, cell_edges, corner_position
from .graph import checkpointed, measured


# ---- rings ----------------------------------------------------------------------------------------------------------

def trace_rings(edges: DataFrame, key: str) -> DataFrame:
    """``edges`` (``key, a, b`` and more) with ``ring``, the smallest ``a`` of its ring, and ``place``, its steps from there.

    Within a key every ``a`` must be the start of one edge and the end of another, so that edges form rings. Each node looks
    1, 2, 4 ... steps ahead (pointer jumping) for the smallest node and how far it is; the loop ends when no node finds a
    smaller one, after a logarithmic number of rounds. Rings of any length stay spread over all tasks.
    """
    ahead, _ = measured(edges.select(key, "a", F.col("b").alias("at"), F.col("a").alias("least"), F.lit(0).cast("long").alias("off")))
    reach = 1
    while True:
        there = ahead.select(key, F.col("a").alias("at"), F.col("at").alias("at2"), F.col("least").alias("least2"), (F.col("off") + reach).alias("off2"))
        best = F.least(F.struct("least", "off"), F.struct(F.col("least2").alias("least"), F.col("off2").alias("off")))
        ahead, moved = measured(ahead.hint("merge").join(there, [key, "at"]).select(
            key, "a", F.col("at2").alias("at"), best["least"].alias("least"), best["off"].alias("off"), (F.col("least2") < F.col("least")).alias("moved")), "moved")
        reach *= 2
        if not moved:
            break
    size = ahead.groupBy(key, "least").agg((F.max("off") + 1).alias("size"))
    placed = ahead.join(size, [key, "least"]).select(key, "a", F.col("least").alias("ring"), F.when(F.col("off") > 0, F.col("size") - F.col("off")).otherwise(0).alias("place"))
    return edges.join(placed, [key, "a"])


def group_outlines(cells: DataFrame, key: str, cell: str = "cell", resolution: int = DEFAULT_RESOLUTION) -> DataFrame:
    """``key, ring, place, a, b, bend``: the sides of each group of cells of the geodesic grid, outer rings counter-clockwise,
    holes clockwise.

    A side that two cells of a group share stands twice, once in each direction; it is cancelled by counting, map-side
    first. What is left forms rings, for at every corner three cells meet.
    """
    sides = cells.select(key, F.explode(cell_edges(F.col(cell), resolution)).alias("s")).select(key, "s.a", "s.b", "s.bend")
    once = sides.groupBy(key, F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("a", "b", "bend")).alias("side")).filter("n = 1")
    return trace_rings(checkpointed(once.select(key, "side.a", "side.b", "side.bend")), key)


def outline_points(outlines: DataFrame, key: str, resolution: int = DEFAULT_RESOLUTION) -> DataFrame:
    """``key, ring, place, lat, lon``: the points of :func:`group_outlines` in order of place: the start of each side (even
    places) and its bend, if it has one."""
    at = outlines.withColumn("p", corner_position(F.col("a"), resolution))
    both = F.array(F.struct((F.col("place") * 2).alias("place"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon")),
                   F.struct((F.col("place") * 2 + 1).alias("place"), F.col("bend.lat").alias("lat"), F.col("bend.lon").alias("lon")))
    return at.select(key, "ring", F.explode(both).alias("q")).select(key, "ring", "q.*").filter("lat is not null")


def _unit(p: Column) -> Column:
    a, o = F.radians(p["lat"]), F.radians(p["lon"])
    return F.struct((F.cos(a) * F.cos(o)).alias("x"), (F.cos(a) * F.sin(o)).alias("y"), F.sin(a).alias("z"))


def triangle_excess(a: Column, b: Column, c: Column) -> Column:
    """Signed area of a spherical triangle (unit sphere) between three points ``lat, lon``."""
    a, b, c = _unit(a), _unit(b), _unit(c)
    dot = lambda u, v: u["x"] * v["x"] + u["y"] * v["y"] + u["z"] * v["z"]
    triple = a["x"] * (b["y"] * c["z"] - b["z"] * c["y"]) + a["y"] * (b["z"] * c["x"] - b["x"] * c["z"]) + a["z"] * (b["x"] * c["y"] - b["y"] * c["x"])
    return 2 * F.atan2(triple, 1 + dot(a, b) + dot(b, c) + dot(c, a))


def ring_areas(outlines: DataFrame, key: str, resolution: int = DEFAULT_RESOLUTION) -> DataFrame:
    """``key, ring, sides, area_km2`` of :func:`group_outlines`: positive for outer rings, negative for holes.

    Every side adds its triangle with the ring's first corner, so sides are summed wherever they are.
    """
    rows = outlines.withColumns({"p": corner_position(F.col("a"), resolution), "q": corner_position(F.col("b"), resolution), "o": corner_position(F.col("ring"), resolution)})
    p, q, o = F.col("p"), F.col("q"), F.col("o")
    area = F.when(F.col("bend").isNull(), triangle_excess(o, p, q)).otherwise(triangle_excess(o, p, F.col("bend")) + triangle_excess(o, F.col("bend"), q))
    return rows.groupBy(key, "ring").agg(F.count(F.lit(1)).alias("sides"), (F.sum(area) * (EARTH_KM * EARTH_KM)).alias("area_km2"))


# ---- simplified lines -----------------------------------------------------------------------------------------------

#: The first tolerance (degrees), and by what it is raised until few enough corners are left.
TOLERANCE, RAISE = 0.001, 1.5


def significance(points: DataFrame, key: str, place: str, x: str, y: str, least: float = TOLERANCE) -> DataFrame:
    """``points`` with ``weight``: the tolerance up to which a point of its line (``key``, in order of ``place``) is kept.

    Ramer-Douglas-Peucker: of the points between two kept ones the one furthest from their chord (ties: the first) is kept if it is
    further off than the tolerance, and splits the line. The splits do not depend on the tolerance, only how deep they
    go; so a point is kept up to the least deviation of its own split and those above. Each round splits all lines at
    once, by one aggregate over the points between; it ends when no point is further off than ``least``. First and last points
    weigh infinitely.
    """
    c = F.col
    ends = points.groupBy(key).agg(F.min(F.struct(place, x, y)).alias("p"), F.max(F.struct(place, x, y)).alias("q"))
    start = points.join(ends, key)
    inner = (c(place) > c("p")[place]) & (c(place) < c("q")[place])
    settled = checkpointed(start.filter(~inner).select(*points.columns, F.lit(float("inf")).alias("weight")))
    open_ = checkpointed(start.filter(inner).withColumn("above", F.lit(float("inf"))))
    done = []
    while not open_.isEmpty():
        dx, dy = c("q")[x] - c("p")[x], c("q")[y] - c("p")[y]
        length = F.sqrt(dx * dx + dy * dy)
        off = F.when(length == 0, F.sqrt((c(x) - c("p")[x]) * (c(x) - c("p")[x]) + (c(y) - c("p")[y]) * (c(y) - c("p")[y]))).otherwise(
            F.abs(dx * (c(y) - c("p")[y]) - dy * (c(x) - c("p")[x])) / length)
        far = F.max(F.struct(off.alias("off"), (-c(place)).alias("first"), c(x).alias("x"), c(y).alias("y"), "above")).alias("far")
        split = open_.groupBy(key, c("p")[place].alias("from")).agg(far).select(
            key, "from", F.least("far.off", "far.above").alias("deep"), F.struct((-c("far.first")).alias(place), c("far.x").alias(x), c("far.y").alias(y)).alias("s")).filter(c("deep") > least)
        met, _ = measured(open_.withColumn("from", c("p")[place]).join(split, [key, "from"]))
        done.append(met.filter(c(place) == c("s")[place]).select(*points.columns, c("deep").alias("weight")))
        before = c(place) < c("s")[place]
        open_ = met.filter(c(place) != c("s")[place]).select(
            *points.columns, F.when(before, c("p")).otherwise(c("s")).alias("p"), F.when(before, c("s")).otherwise(c("q")).alias("q"), c("deep").alias("above"))
    for part in done:
        settled = settled.unionByName(part)
    return settled


def simplified(points: DataFrame, key: str, place: str, x: str, y: str, most: int, tolerance: float = TOLERANCE, raise_by: float = RAISE) -> DataFrame:
    """The points of each line that are left at its tolerance: none are dropped from lines of at most ``most`` points; of others
    the tolerance starts at ``tolerance`` and is raised by ``raise_by`` until at most ``most`` points remain, or it reaches 1."""
    sizes = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    marked = points.join(sizes, key)
    short = marked.filter(F.col("n") <= most).select(*points.columns)
    weighed = checkpointed(significance(marked.filter(F.col("n") > most).select(*points.columns), key, place, x, y, tolerance))
    steps = [tolerance]
    while steps[-1] < 1:
        steps.append(steps[-1] * raise_by)
    # A point outlasts the tolerances under its weight; counting points by how many they outlast takes one row per step.
    outlasts = sum((F.when(F.col("weight") > s, 1).otherwise(0) for s in steps[1:]), F.when(F.col("weight") > steps[0], 1).otherwise(0))
    counts = weighed.groupBy(key, outlasts.alias("lasts")).agg(F.count(F.lit(1)).alias("n"))
    at_least = F.sum("n").over(W.partitionBy(key).orderBy(F.desc("lasts")))
    fits = counts.withColumn("kept", at_least).filter(F.col("kept") <= most).groupBy(key).agg(F.min("lasts").alias("needed"))
    rest = weighed.withColumn("lasts", outlasts).join(fits, key, "left").filter(F.col("lasts") >= F.coalesce("needed", F.lit(len(steps))))
    return short.unionByName(rest.select(*points.columns))


# ---- concave outlines -----------------------------------------------------------------------------------------------

def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull of rows ``(x, y)``, counter-clockwise in that plane, collinear points left out."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts).reshape(-1, 2)

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(reversed(pts)))


def triangulated(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles of different points, counter-clockwise, by inserting one point after another into a large triangle."""
    n = len(points)
    low, size = points.min(0), float(np.ptp(points, axis=0).max()) or 1.0
    p = np.concatenate([(points - low) / size, [[-1e4, -1e4], [1e4 + 1, -1e4], [0.5, 2e4]]])
    tri = np.array([[n, n + 1, n + 2]])

    def circles(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
        u, v = b - a, c - a
        d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
        uu, vv = (u * u).sum(1), (v * v).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            o = np.stack([(v[:, 1] * uu - u[:, 1] * vv) / d, (u[:, 0] * vv - v[:, 0] * uu) / d], axis=1)
        return a + o, np.where(d > 0, (o * o).sum(1), np.inf)

    centre, square = circles(tri)
    for k in np.lexsort((p[:n, 1], p[:n, 0])).tolist():
        with np.errstate(invalid="ignore"):
            hit = ~(((centre - p[k]) ** 2).sum(1) > square * (1 + 1e-12))
        inside = tri[hit]
        sides = np.concatenate([inside[:, [0, 1]], inside[:, [1, 2]], inside[:, [2, 0]]])
        code, back = sides[:, 0] * (n + 3) + sides[:, 1], sides[:, 1] * (n + 3) + sides[:, 0]
        rim = sides[~np.isin(code, back)]
        new = np.concatenate([rim, np.full((len(rim), 1), k)], axis=1)
        c, s = circles(new)
        tri, centre, square = np.concatenate([tri[~hit], new]), np.concatenate([centre[~hit], c]), np.concatenate([square[~hit], s])
    return tri[(tri < n).all(1)]


def concave_hull(points: np.ndarray, longest: float, scale: float = 1.0) -> np.ndarray:
    """Outline of rows ``(x, y)`` whose sides of over ``longest`` are opened as far as the points allow, counter-clockwise.

    From the hull's triangulation the triangle behind the longest side on the rim goes, again and again, unless its third corner
    is on the rim already (so the outline stays one simple ring around all points). ``scale`` stretches y for lengths. Up to
    four points, or points on one line, give the hull itself.
    """
    pts = np.array(sorted(set(map(tuple, points.tolist()))))
    hull = convex_hull(points)
    if len(pts) <= 4 or len(hull) < 3:
        return hull
    flat = pts * [1.0, scale]
    length = lambda a, b: float(np.hypot(*(flat[a] - flat[b])))
    third = {}
    for a, b, c in triangulated(flat).tolist():
        third[a, b], third[b, c], third[c, a] = c, a, b
    after = {a: b for a, b in third if (b, a) not in third}
    if len(after) != len({b for b in after.values()}) or not after:
        return hull
    waiting = sorted(((length(a, b), a, b) for a, b in after.items()), reverse=True)
    while waiting:
        far, a, b = waiting.pop(0)
        c = third.get((a, b))
        if far <= longest:
            break
        if c is None or c in after or after.get(a) != b:
            continue
        after[a], after[c] = c, b
        waiting = sorted(waiting + [(length(a, c), a, c), (length(c, b), c, b)], reverse=True)
    ring, at = [], min(after)
    while not ring or at != ring[0]:
        ring.append(at)
        at = after[at]
    return pts[ring]


def concave_outlines(points: DataFrame, key: str, longest_km: float, lat: str = "latitude", lon: str = "longitude", km_a_degree: float = 111.0) -> DataFrame:
    """``key, corners``: a concave outline (arrays of ``lat, lon``) of the points of every key, sides over ``longest_km`` opened.

    Only the rim needs triangles: points whose own square and all eight around it (a sixth of ``longest_km`` wide) hold points of
    the key lie behind sides that are never opened, and are left out before any group is gathered; so a group grows with the
    length of its rim, not with its points. Corners of the convex hull always stay.
    """
    kind = points.schema[key].dataType.simpleString()
    side = longest_km / 6 / km_a_degree
    c = F.col
    rows = points.select(key, c(lat).cast("double").alias("y"), c(lon).cast("double").alias("x")).distinct()
    mid = rows.groupBy(key).agg(F.avg("y").alias("mid"))
    placed = checkpointed(rows.join(mid, key).withColumns({"row": F.floor(c("y") / side), "column": F.floor(c("x") * F.greatest(F.lit(0.05), F.cos(F.radians("mid"))) / side)}))
    squares = placed.select(key, "row", "column").distinct()
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    seen = squares.withColumn("d", F.explode(steps)).select(key, (c("row") + c("d.i")).alias("row"), (c("column") + c("d.j")).alias("column"))
    within = seen.groupBy(key, "row", "column").agg(F.count(F.lit(1)).alias("n")).filter("n = 9").drop("n")
    rim = placed.join(within, [key, "row", "column"], "left_anti")

    def outline(pdf: pd.DataFrame) -> pd.DataFrame:
        scale = max(0.05, float(np.cos(np.radians(pdf["mid"].iloc[0]))))
        ring = concave_hull(pdf[["y", "x"]].to_numpy(float), longest_km / km_a_degree, scale)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "corners": [ring.tolist()]})

    return rim.select(key, "y", "x", "mid").groupBy(key).applyInPandas(outline, f"{key} {kind}, corners array<array<double>>")
