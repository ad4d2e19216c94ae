"""Distances, regions, and joins by distance that never form a cross product."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

EARTH_KM = 6371.0
#: Kilometres of one degree of latitude, a little under the true value so that buckets never miss a pair.
DEGREE_KM = 111.0

# Named circles (name, latitude, longitude, radius in km).
REGION_CIRCLES = (
    ("EU Central", 50.0, 10.0, 1500.0), ("EU West", 48.0, -2.0, 1000.0), ("EU North", 60.0, 15.0, 1200.0), ("US East", 38.0, -78.0, 1500.0),
    ("US West", 37.0, -120.0, 1500.0), ("US Central", 40.0, -95.0, 1500.0), ("Canada", 50.0, -100.0, 2000.0), ("Australia", -28.0, 135.0, 2000.0),
    ("South America", -15.0, -55.0, 3000.0), ("Asia Pacific", 25.0, 120.0, 3000.0),
)
# Named boxes (name, south, north, west, east), first match wins, all bounds exclusive.
USAGE_BOXES = (
    ("Europe", 35, 60, -10, 30), ("North America", 25, 50, -130, -60), ("Australia", -45, -10, 110, 180), ("Asia", 20, 50, 60, 140),
    ("South America", -60, 15, -80, -30), ("Africa/ME", -10, 35, -20, 55),
)

# Place names by scheme (name, south, north, west, east), first match wins. South is exclusive, north inclusive
# (none is no bound), west and east are exclusive, but for the west of INCLUSIVE_WEST. Beyond them a place is named by its degrees.
PLACE_BOXES = {
    "coverage": (
        ("Northern Europe", 55, None, -10, 30), ("Central Europe", 45, 55, -10, 20), ("Southern Europe", 35, 45, -10, 20),
        ("North America", 25, 50, -130, -60), ("Australia", -45, -10, 110, 180), ("Asia", 20, 50, 60, 140),
    ),
    "zone": (
        ("Northern Europe", 55, None, -10, 30), ("Central Europe", 45, 55, -10, 20), ("Southern Europe", 35, 45, -10, 20),
        ("Eastern Europe", 35, 55, 20, 45), ("North America", 25, 50, -130, -60), ("Central America", -10, 25, -120, -60),
        ("South America", -60, -10, -80, -30), ("Australia", -45, -10, 110, 180), ("Asia", 20, 50, 60, 140),
        ("Southeast Asia", -10, 20, 90, 140), ("Africa", -40, 35, -20, 55),
    ),
    "overlay": (
        ("N-EU", 55, None, -10, 30), ("C-EU", 45, 55, -10, 20), ("S-EU", 35, 45, -10, 20),
        ("N-AM", 25, 55, -130, -60), ("AU", -45, -10, 110, 180), ("Asia", 20, 50, 60, 140),
    ),
    "gap_fill": (
        ("N-Europe", 55, None, -10, 30), ("C-Europe", 45, 55, -10, 20), ("S-Europe", 35, 45, -10, 20),
        ("N-America", 25, 50, -130, -60), ("Australia", -45, -10, 110, 180), ("Asia", 20, 50, 60, 140),
    ),
}
PLACE_ELSE = {"coverage": "%s°N %s°E", "zone": "Region %sN %sE", "overlay": "%sN%sE", "gap_fill": "%sN-%sE"}
INCLUSIVE_WEST = ("Eastern Europe",)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    rad = F.radians
    a = F.pow(F.sin(rad(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(rad(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def region_by_circle(lat: Column, lon: Column, circles=REGION_CIRCLES, other: str = "Other") -> Column:
    """The nearest circle that holds the point (ties: first listed); no join, only literal columns."""
    hits = [F.when((d := haversine_km(lat, lon, F.lit(la), F.lit(lo))) < r, F.struct(d.alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")))
            for i, (name, la, lo, r) in enumerate(circles)]
    return F.coalesce(F.least(*hits)["name"], F.lit(other))


def region_by_box(lat: Column, lon: Column, boxes=USAGE_BOXES, other: str = "Other") -> Column:
    out = F.lit(other)
    for name, south, north, west, east in reversed(boxes):
        out = F.when((lat > south) & (lat < north) & (lon > west) & (lon < east), F.lit(name)).otherwise(out)
    return out


def place_name(lat: Column, lon: Column, scheme: str = "coverage") -> Column:
    """The name of the first box of the scheme that holds the point, else its whole degrees in the scheme's wording."""
    whole = lambda x: F.floor(x + 0.5).cast("string")
    out = F.format_string(PLACE_ELSE[scheme], whole(lat), whole(lon))
    for name, south, north, west, east in reversed(PLACE_BOXES[scheme]):
        inside = (lat > south) & (lon >= west if name in INCLUSIVE_WEST else lon > west) & (lon < east)
        out = F.when(inside if north is None else inside & (lat <= north), F.lit(name)).otherwise(out)
    return F.when(lat.isNotNull() & lon.isNotNull(), out)


def half_degree_cell(col: str) -> Column:
    """Centre of the half-degree cell of a coordinate, rounding halves up."""
    return F.floor(F.col(col) * 2 + 0.5).cast("double") / 2.0


def _span(lat: Column, km: float) -> Column:
    """Longitude degrees that ``km`` cover at most near a latitude; everything at the poles."""
    edge = F.least(F.lit(90.0), F.abs(lat) + km / DEGREE_KM)
    ratio = F.sin(F.lit(km / (2 * EARTH_KM) * 1.001)) / F.cos(F.radians(edge))
    return F.when((edge >= 89.0) | (ratio >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), ratio))) * 2 + 1e-6)


#: Parts of the visitors of a cell in a distance join that is spread.
SPREAD = 8


def distance_join(left: DataFrame, right: DataFrame, km: float, lat: str = "latitude", lon: str = "longitude",
                  right_lat: str = "r_latitude", right_lon: str = "r_longitude", on: tuple[str, ...] = (), spread: bool = False) -> DataFrame:
    """All pairs within ``km`` (inclusive) with their ``distance_km``.

    Column names of the two sides must differ. Right rows go to one grid cell of about ``km`` each; left rows
    visit the cells that their radius can reach, with longitude wrapped at the antimeridian and widened towards
    the poles. So the join is an equi join on cells. It shuffles and sorts, unless the caller marks the right side for broadcast: the
    optimizer does not see how many cells a left row visits and would send them all through the driver.
    Rows without coordinates have no partner. ``on`` names further columns that both sides must share. ``spread`` is for joins of very many
    pairs: it deals them to all shuffle partitions, which are else merged by the bytes of the rows, however many pairs these give.
    """
    step = max(0.05, min(10.0, km / DEGREE_KM))
    columns = int(-(-360 // step))
    row = lambda x: F.floor(x / step).cast("int")
    column = lambda x: F.floor(F.pmod(x + 180.0, F.lit(360.0)) / step).cast("int")
    reach = F.lit(km / DEGREE_KM)
    span = _span(F.col(lat), km)
    rows = F.sequence(row(F.col(lat) - reach), row(F.col(lat) + reach))
    west = F.floor((F.col(lon) + 180.0 - span) / step).cast("int")
    east = F.floor((F.col(lon) + 180.0 + span) / step).cast("int")
    cells = F.when(east - west >= columns, F.sequence(F.lit(0), F.lit(columns - 1))).otherwise(
        F.array_distinct(F.concat(F.transform(F.sequence(west, east), lambda c: F.pmod(c, F.lit(columns))),
                                  F.transform(F.sequence(west, east), lambda c: F.floor(F.pmod(c * step, F.lit(360.0)) / step).cast("int")))))
    probe = (left.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("_row", F.explode(rows))
             .withColumn("_column", F.explode(cells)))
    base = right.filter(F.col(right_lat).isNotNull() & F.col(right_lon).isNotNull()).withColumns(
        {"_row": row(F.col(right_lat)), "_column": column(F.col(right_lon))})
    if spread:
        # A cell's visitors are dealt to parts, each of which meets all of the cell.
        tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        probe = probe.withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.lit(SPREAD)).cast("int"))
        base = base.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        on = (*on, "_part")
        probe, base = (x.repartition(tasks, "_row", "_column", *on) for x in (probe, base))
    d = haversine_km(F.col(lat), F.col(lon), F.col(right_lat), F.col(right_lon))
    pairs = probe.hint("merge").join(base, ["_row", "_column", *on]).withColumn("distance_km", d)
    return pairs.filter(F.col("distance_km") <= km).drop("_row", "_column", "_part")


#: Cells in which the right side is sought for rows far from all of it: degrees of a coarse and of a fine cell.
COARSE_DEGREES, FINE_DEGREES = 10, 1


def _cells(df: DataFrame, lat: str, lon: str, degrees: int, names: tuple[str, str]) -> DataFrame:
    east = F.pmod(F.col(lon) + 180.0, F.lit(360.0)) - 180.0
    return df.withColumns({names[0]: F.floor(F.col(lat) / degrees).cast("int"), names[1]: F.floor(east / degrees).cast("int")})


def _to_centre(lat: Column, lon: Column, row: Column, column: Column, degrees: int) -> Column:
    return haversine_km(lat, lon, (row + 0.5) * degrees, (column + 0.5) * degrees)


def _nearest_far(left: DataFrame, right: DataFrame, key: str, right_key: str, lat: str, lon: str, right_lat: str, right_lon: str) -> DataFrame:
    """``key, best`` like one round of :func:`nearest_join`, without a radius and without comparing all with all.

    A cell's points lie within half its diagonal of its centre, so only cells whose centre is at most a whole
    diagonal further than the nearest centre can hold the nearest point. At most 648 occupied coarse cells are
    literals of the plan, the fine cells of the chosen ones and then the points of the chosen fine cells are met by
    equi joins.
    """
    diagonal = lambda degrees: degrees * 2**0.5 * 111.2
    spots = _cells(right, right_lat, right_lon, FINE_DEGREES, ("_fi", "_fj"))
    fine = spots.select("_fi", "_fj").distinct().withColumns({"_ci": F.floor(F.col("_fi") * FINE_DEGREES / COARSE_DEGREES).cast("int"),
                                                             "_cj": F.floor(F.col("_fj") * FINE_DEGREES / COARSE_DEGREES).cast("int")})
    occupied = sorted(map(tuple, fine.select("_ci", "_cj").distinct().collect()))  # at most 648 rows
    if not occupied:
        return left.select(key, F.lit(None).cast(f"struct<distance_km: double, {right_key}: {right.schema[right_key].dataType.simpleString()}>").alias("best")).limit(0)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in occupied])
    at = lambda x: F.struct(_to_centre(F.col(lat), F.col(lon), x["i"], x["j"], COARSE_DEGREES).alias("km"), x["i"].alias("i"), x["j"].alias("j"))
    placed = left.withColumn("_at", F.transform(cells, at))
    near = F.filter("_at", lambda x: x["km"] <= F.array_min(F.transform("_at", lambda y: y["km"])) + diagonal(COARSE_DEGREES))
    coarse = placed.withColumn("_at", F.explode(near)).select(key, lat, lon, F.col("_at.i").alias("_ci"), F.col("_at.j").alias("_cj"))
    seen = coarse.join(fine, ["_ci", "_cj"]).withColumn("_km", _to_centre(F.col(lat), F.col(lon), F.col("_fi"), F.col("_fj"), FINE_DEGREES))
    least = F.min("_km").over(Window.partitionBy(key))
    chosen = seen.withColumn("_least", least).filter(F.col("_km") <= F.col("_least") + diagonal(FINE_DEGREES)).select(key, lat, lon, "_fi", "_fj")
    d = haversine_km(F.col(lat), F.col(lon), F.col(right_lat), F.col(right_lon))
    return chosen.join(spots, ["_fi", "_fj"]).withColumn("distance_km", d).groupBy(key).agg(F.min(F.struct("distance_km", right_key)).alias("best"))


#: Radii in kilometres in which a nearest row is sought, one after the other; the first ones keep dense places cheap.
NEAREST_KM = (DEGREE_KM / 16, DEGREE_KM / 4, DEGREE_KM, 4 * DEGREE_KM)


def nearest_join(left: DataFrame, right: DataFrame, key: str, right_key: str, lat: str = "latitude", lon: str = "longitude",
                 right_lat: str = "r_latitude", right_lon: str = "r_longitude") -> DataFrame:
    """Every left row with its nearest right row (ties: smallest ``right_key``) and ``distance_km``.

    Places are joined, not rows: a place of the right side stands for its smallest key, and all left rows of a place share
    one result. Places are first joined within a few kilometres, those without a partner within wider radii, and what is
    then left is narrowed down over coarse and fine cells of the globe, so no round compares all with all. Null where there is
    no right row or no position.
    """
    at = ["_lat", "_lon"]
    best = F.min(F.struct("distance_km", right_key)).alias("best")
    place = left.select(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).filter("_lat is not null and _lon is not null").distinct()
    waiting = checkpointed(place.withColumn("_place", F.struct(*at)))
    spots = checkpointed(right.filter(F.col(right_lat).isNotNull() & F.col(right_lon).isNotNull()).groupBy(right_lat, right_lon).agg(F.min(right_key).alias(right_key)))
    found = []
    for km in NEAREST_KM:
        found.append(checkpointed(distance_join(waiting, spots, km, *at, right_lat, right_lon).groupBy("_place").agg(best)))
        waiting = checkpointed(waiting.join(found[-1], "_place", "left_anti"))
        if waiting.isEmpty():
            break
    else:
        found.append(_nearest_far(waiting, spots, "_place", right_key, *at, right_lat, right_lon))
    # A place has one round; naming it keeps a projection between the union and the checkpoints, whose constraints may
    # name columns of before that a union does not know.
    rounds = [near.select("_place", "best", F.lit(k).alias("round")) for k, near in enumerate(found)]
    every = reduce(DataFrame.unionByName, rounds).groupBy("_place").agg(F.min_by("best", "round").alias("best"))
    results = every.select(F.col("_place._lat").alias("_lat"), F.col("_place._lon").alias("_lon"), "best")
    met = left.join(results, (left[lat] == results["_lat"]) & (left[lon] == results["_lon"]), "left").drop(*at)
    return met.withColumns({right_key: F.col("best")[right_key], "distance_km": F.col("best.distance_km")}).drop("best")


#: Parts of the radius of :func:`nearest_k` that are searched before all of it.
NEAR_PARTS = (1 / 16, 1 / 4)


def _near_cells(places: DataFrame, base: DataFrame, k: int, km: float, at: list[str], right_lat: str, right_lon: str) -> DataFrame:
    """``places`` with all rows of ``base`` within ``km`` that can be among their ``k`` nearest, and ``distance_km``.

    Rows are counted in cells of a sixteenth of ``km``. The cells that end nearest to a place and hold ``k`` rows together bound
    its distance to the last of them, and only cells that begin within that bound are opened.
    """
    c, side = F.col, max(0.05, km / DEGREE_KM / 16)
    placed = base.withColumn("_cell", F.struct(F.floor(c(right_lat) / side).alias("i"), F.floor(c(right_lon) / side).alias("j")))
    cells = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.min(right_lat).alias("_s"), F.max(right_lat).alias("_t"), F.min(right_lon).alias("_w"), F.max(right_lon).alias("_e"))
    cells = cells.withColumns({"_mlat": (c("_s") + c("_t")) / 2, "_mlon": (c("_w") + c("_e")) / 2})
    # A box may bulge between its corners: its middle meridian is the longest way to a side, and no further than half its height.
    reach = F.greatest(*[haversine_km(c("_mlat"), c("_mlon"), c(a), c(b)) for a in ("_s", "_t") for b in ("_w", "_e")], haversine_km(c("_mlat"), c("_mlon"), c("_s"), c("_mlon")))
    cells = cells.select("_cell", "_n", "_mlat", "_mlon", (reach * 1.000001 + 1e-6).alias("_r"))
    seen = distance_join(places, cells, km + side * 112, *at, "_mlat", "_mlon").withColumns({"_near": c("distance_km") - c("_r"), "_far": c("distance_km") + c("_r")}).filter(c("_near") <= km)
    upto = F.sum("_n").over(Window.partitionBy(*at).orderBy("_far", "_cell"))
    bound = F.min(F.when(c("_upto") >= k, c("_far"))).over(Window.partitionBy(*at))
    opened = seen.withColumn("_upto", upto).withColumn("_bound", F.coalesce(bound, F.lit(float(km)))).filter(c("_near") <= c("_bound")).select(*at, "_cell")
    d = haversine_km(c(at[0]), c(at[1]), c(right_lat), c(right_lon))
    return checkpointed(opened).join(placed, "_cell").withColumn("distance_km", d).filter(c("distance_km") <= km).drop("_cell")


def nearest_k(points: DataFrame, right: DataFrame, key: str, right_key: str, k: int, km: float, lat: str = "lat", lon: str = "lon",
              right_lat: str = "r_latitude", right_lon: str = "r_longitude") -> DataFrame:
    """The ``k`` nearest right rows within ``km`` of every point, ranked from 1 (ties by ``right_key``).

    Points of one place share one search, and of a place of the right side only the first ``k`` rows can count. Where a small
    radius holds ``k`` rows they are the nearest ones. Points in sparse places count the rows of cells within ``km`` and meet the
    rows of those cells only that can hold one of the ``k`` nearest, so a far dense place is not sorted for each of them.
    """
    at = ["_lat", "_lon"]
    first = F.row_number().over(Window.partitionBy(right_lat, right_lon).orderBy(right_key))
    base = checkpointed(right.filter(F.col(right_lat).isNotNull() & F.col(right_lon).isNotNull()).withColumn("_k", first).filter(F.col("_k") <= k).drop("_k"))
    place = points.select(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).filter("_lat is not null and _lon is not null").distinct()
    waiting, found = checkpointed(place), []
    order = Window.partitionBy(*at).orderBy("distance_km", right_key)
    for part in NEAR_PARTS:
        met = checkpointed(distance_join(waiting, base, km * part, *at, right_lat, right_lon).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        full = met.filter(F.col("rank") == k).select(*at)
        found.append(met.join(full, at, "left_semi"))
        waiting = checkpointed(waiting.join(full, at, "left_anti"))
    met = _near_cells(waiting, base, k, km, at, right_lat, right_lon)
    found.append(met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    # As above, a projection stands between the union and the checkpoints.
    columns = [*at, *base.columns, "distance_km", "rank"]
    every = reduce(DataFrame.unionByName, [f.select(*columns, F.lit(i).alias("_round")) for i, f in enumerate(found)]).drop("_round")
    return points.join(every, (points[lat] == every["_lat"]) & (points[lon] == every["_lon"])).drop(*at)
