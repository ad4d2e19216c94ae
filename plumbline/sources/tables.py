"""Reading, merging, keeping and exporting the domain tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from plumbline.functions.graph import checkpointed
from plumbline.functions.geodesic import DEFAULT_RESOLUTION, cell_outline
from plumbline.functions.rules import DAY

SESSION = ("id string, username string, mountpoint string, station string, status string, total_gga int, rtk_fixed int, rtk_float int, duration long, login_time long, synced_at long, "
           "fix_rate double, avg_age double, max_age double, latitude double, longitude double, ip string")
#: Days that each table is kept, by table name.
RETENTION_DAYS = {"status_log": 14, "sessions": 180, "sync_log": 30, "audit": 90}
STAMP = r"(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})"


def keep_first(raw: DataFrame, key: str = "id", order: tuple[str, ...] = ("synced_at",)) -> DataFrame:
    """The earliest version of every key."""
    k = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return raw.withColumn("_k", k).filter("_k = 1").drop("_k")


def ingest_sessions(raw: DataFrame, target: DataFrame | None = None, order: tuple[str, ...] = ("synced_at",)) -> DataFrame:
    """New sessions only: missing text is '', missing numbers 0, first version of an id wins, known ids are ignored."""
    text = [f.name for f in raw.schema if f.dataType.simpleString() == "string"]
    number = [f.name for f in raw.schema if f.dataType.simpleString() in ("int", "bigint", "double")]
    new = keep_first(raw.fillna("", text).fillna(0, number), "id", order)
    return new if target is None else new.join(target.select("id"), "id", "left_anti")


def incremental_load(raw: DataFrame, held: DataFrame, least_held: int = 1_000_000, order: tuple[str, ...] = ("synced_at",)) -> tuple[DataFrame, DataFrame]:
    """Rows at or past the newest held login time (all if few are held), and the advanced mark as one row."""
    mark = held.agg(F.when(F.count("*") >= least_held, F.max("login_time")).otherwise(0).alias("mark"))
    fresh = raw.crossJoin(F.broadcast(mark)).filter(F.col("login_time") >= F.col("mark")).drop("mark")
    new = ingest_sessions(fresh, held, order)
    return new, held.select("login_time").unionByName(new.select("login_time")).agg(F.max("login_time").alias("mark"))


def upsert_stations(target: DataFrame, batch: DataFrame, untouched: tuple[str, ...] = ()) -> DataFrame:
    """Batch values win by name (the last of repeated names by ``last_synced``); ``untouched`` columns keep held values."""
    last = W.partitionBy("name").orderBy(F.desc("last_synced"))
    b = batch.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k").select("name", *[F.col(c).alias(f"b_{c}") for c in batch.columns if c != "name"])
    value = lambda c: F.col(c) if c not in batch.columns else F.coalesce(c, f"b_{c}") if c in untouched else F.coalesce(f"b_{c}", c)
    return target.join(b, "name", "full_outer").select("name", *[value(c).alias(c) for c in target.columns if c != "name"])


def parse_sourcetable(lines: DataFrame) -> DataFrame:
    """Stations of ``STR;`` lines of column ``value`` with at least eleven fields and a position other than 0, 0."""
    p = F.split(F.col("value"), ";")
    f = lambda i: F.trim(F.get(p, F.lit(i)))
    rows = lines.filter(F.col("value").startswith("STR;") & (F.size(p) >= 11)).select(
        f(1).alias("name"), f(4).alias("format_details"), f(5).try_cast("int").alias("carrier"), f(6).alias("nav_system"), f(8).alias("country"),
        f(9).try_cast("double").alias("latitude"), f(10).try_cast("double").alias("longitude"), F.coalesce(f(13), F.lit("")).alias("generator"))
    return rows.filter("latitude is not null and longitude is not null and not (latitude = 0 and longitude = 0) and name <> ''")


def parse_access_log(lines: DataFrame) -> DataFrame:
    """Caster sessions from lines of column ``value``: six or more comma fields, or the space-separated form; others are dropped."""
    v = F.col("value")
    p = F.split(v, ",")
    f = lambda i: F.trim(F.get(p, F.lit(i)))
    m = STAMP + r"\s+(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\d+)"
    csv, spaced = F.size(p) >= 6, v.rlike(m)
    pick = lambda i, g: F.when(csv, f(i)).otherwise(F.regexp_extract(v, m, g))
    number = lambda c, kind: F.coalesce(c.try_cast(kind), F.lit(0).cast(kind))
    blank = lambda c: F.when(c != "", c)
    return lines.filter((F.trim(v) != "") & ~v.startswith("#") & (csv | spaced)).select(
        pick(0, 1).alias("timestamp"), pick(1, 2).alias("client_ip"), pick(2, 3).alias("username"), pick(3, 4).alias("mountpoint"), number(pick(4, 5), "double").alias("duration_s"),
        number(pick(5, 6), "long").alias("bytes_transferred"), F.when(csv, F.coalesce(f(6), F.lit(""))).otherwise("").alias("user_agent"), F.when(csv, blank(f(7))).alias("backend_source"),
        F.when(csv, F.nullif(f(8).try_cast("double"), F.lit(0.0))).alias("gga_lat"), F.when(csv, F.nullif(f(9).try_cast("double"), F.lit(0.0))).alias("gga_lon"),
        F.when(csv, number(f(10), "int")).otherwise(0).alias("failover_count"), F.when(csv, blank(f(11))).alias("disconnect_reason"))


def parse_failover_log(lines: DataFrame) -> DataFrame:
    """Switchovers and source disconnects of an operational log; one line can give one of each."""
    v = F.col("value")
    switch = r"(?i)" + STAMP + r".*(?:switchover|failover|trying next).*?(\S+)\s*(?:->|to)\s*(\S+)"
    lost = r"(?i)" + STAMP + r".*source\s+(\S+).*(?:disconnect|lost|timeout)"
    reason = F.when(v.contains("lost"), "source_lost").when(v.contains("timeout"), "timeout").otherwise("switchover")
    event = lambda p, to, why: F.when(v.rlike(p), F.struct(F.regexp_extract(v, p, 1).alias("timestamp"), F.regexp_extract(v, p, 2).alias("from_source"), to.alias("to_source"), why.alias("reason")))
    both = F.array_compact(F.array(event(switch, F.regexp_extract(v, switch, 3), reason), event(lost, F.lit(""), F.lit("source_disconnect"))))
    return lines.select(F.explode(both).alias("e")).select("e.*")


@lru_cache(4096)
def _minute(*at: int) -> float:
    return pd.Timestamp(*at).timestamp()


def _parse_file(text: str, max_epochs: int | None) -> Iterator[tuple[float, str, dict[str, float]]]:
    """Epoch seconds, satellite and its non-zero values of one observation file in the fixed-column text format."""
    lines, types, i, epochs = text.split("\n"), {}, 0, 0
    for i, line in enumerate(lines):
        label = line[60:].strip()
        if label.startswith("SYS / # / OBS TYPES"):
            system = line[:1].strip() or system  # noqa: F821 - continuation lines repeat the system above
            types.setdefault(system, []).extend(line[7:60].split())
        if label == "END OF HEADER":
            break
    i += 1
    while i < len(lines) and (max_epochs is None or epochs < max_epochs):
        line = lines[i]
        i += 1
        part = line[2:35].split() if line.startswith(">") and len(line) >= 35 else []
        if len(part) < 6:
            continue
        try:
            at = _minute(*map(int, part[:5])) + float(part[5])
            flag, count = int(part[6]) if len(part) > 6 else 0, int(part[7]) if len(part) > 7 else 0
        except ValueError:
            continue
        block, i = lines[i:i + count], i + count
        found = False
        for row in block if flag <= 1 else ():
            values = {}
            for k, code in enumerate(types.get(row[:1], ())):
                try:
                    value = float(row[3 + 16 * k:17 + 16 * k])
                except ValueError:
                    continue
                if value:
                    values[code] = value
            if values:
                found = True
                yield at, row[:3].strip(), values
        epochs += found


#: Rows of observations that leave a task at once.
ROWS_AT_ONCE = 20_000


def parse_observations(spark: SparkSession, path: str, max_epochs: int | None = None) -> DataFrame:
    """``file_id, epoch_s, prn, constellation, obs`` of observation files, one file per row of work, parsed in tasks."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), "value")
    schema = StructType.fromDDL("file_id string, epoch_s double, prn string, constellation string, obs map<string, double>")
    types = [to_arrow_type(f.dataType) for f in schema]

    def table(file_id: str, rows: tuple) -> pa.RecordBatch:
        at, prn, values = zip(*rows)
        ends = pa.array([0, *accumulate(map(len, values))], pa.int32())
        codes, numbers = pa.array([c for v in values for c in v], types[4].key_type), pa.array([x for v in values for x in v.values()], types[4].item_type)
        columns = [pa.array([file_id] * len(rows), types[0]), pa.array(at, types[1]), pa.array(prn, types[2]), pa.array([x[:1] for x in prn], types[3]),
                   pa.MapArray.from_arrays(ends, codes, numbers, type=types[4])]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for rows in batched(_parse_file(text, max_epochs), ROWS_AT_ONCE):
                    yield table(file_id, rows)

    return files.mapInArrow(run, schema)


def _parse_maps(text: str) -> Iterator[tuple[str, float, float, float]]:
    exponent, epoch, values, grid = -1, "", [], None
    for line in text.split("\n"):
        label = line[60:].strip()
        if label == "EXPONENT":
            exponent = int(line[:6])
        elif label == "EPOCH OF CURRENT MAP":
            p = line[:60].split()
            epoch = f"{int(p[0]):04d}-{int(p[1]):02d}-{int(p[2]):02d} {int(p[3]):02d}:{int(p[4]):02d}:{int(float(p[5])):02d}"
        elif label == "LAT/LON1/LON2/DLON/H":
            lat, west, east, step = (float(line[2 + 6 * k:8 + 6 * k]) for k in range(4))
            grid, values = (lat, west, step, round((east - west) / step) + 1), []
        elif label.startswith("END OF TEC MAP"):
            grid = None
        elif grid and len(values) < grid[3] and not label.startswith(("START OF", "END OF")):
            values += [line[k:k + 5] for k in range(0, len(line.rstrip()), 5)]  # by position: full rows reach past column 60
            if len(values) >= grid[3]:
                for k, v in enumerate(values[:grid[3]]):
                    if v.strip() and int(v) != 9999:
                        yield epoch, grid[0], grid[1] + k * grid[2], int(v) * 10.0**exponent


def parse_iono_maps(spark: SparkSession, path: str) -> DataFrame:
    """``file_id, epoch, lat, lon, vtec`` of ionosphere map files; missing values (9999) are left out."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file_id, text in zip(pdf["file_id"], pdf["value"]):
                rows = [(file_id, pd.Timestamp(e), la, lo, v) for e, la, lo, v in _parse_maps(text)]
                yield pd.DataFrame(rows, columns=["file_id", "epoch", "lat", "lon", "vtec"])

    return files.mapInPandas(run, "file_id string, epoch timestamp_ntz, lat double, lon double, vtec double")


def read_env_history(env: DataFrame, keep: int = 336) -> DataFrame:
    """The newest ``keep`` readings by ``ts``."""
    return env.orderBy(F.desc("ts")).limit(keep)


def latest_and_next(feed: DataFrame, as_of: int, default: float) -> DataFrame:
    """One row: the newest value at or before ``as_of`` and the first one after it; ``default`` where there is none."""
    before, after = F.col("ts") <= as_of, F.col("ts") > as_of
    return feed.agg(F.coalesce(F.max_by(F.when(before, F.col("value")), F.when(before, F.col("ts"))), F.lit(default)).alias("latest"),
                    F.coalesce(F.min_by(F.when(after, F.col("value")), F.when(after, F.col("ts"))),
                               F.max_by(F.when(before, F.col("value")), F.when(before, F.col("ts"))), F.lit(default)).alias("next"))


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a snapshot; Spark's committer publishes it only when whole."""
    df.write.mode("overwrite").format(fmt).save(path)


def zone_table(zones: DataFrame, existing: DataFrame) -> DataFrame:
    """Zones with manual overrides as they are, and the new ones for all other ids."""
    manual = existing.filter("manual_override = 1")
    return manual.unionByName(zones.join(manual.select("zone_id"), "zone_id", "left_anti"))


def export_geojson(zones: DataFrame) -> DataFrame:
    """``feature``: one GeoJSON feature per zone (``zone_id, fence_type, lat, lon, points``), coordinates as lon, lat, rings closed."""
    ring = F.transform(F.concat("points", F.slice("points", 1, 1)), lambda p: F.array(p[1], p[0]))
    props = F.struct("zone_id").alias("properties")
    point = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), props)
    polygon = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), props)
    return zones.select("zone_id", F.when(F.col("fence_type") == "circle", F.to_json(point)).otherwise(F.to_json(polygon)).alias("feature"))


def export_cells(cells: DataFrame, resolution: int = DEFAULT_RESOLUTION) -> DataFrame:
    """``cell_id, feature``: one GeoJSON polygon per cell of the geodesic grid (``cell_id`` as text), coordinates as lon, lat, the
    ring closed; the cell's other columns are its properties. Rings across the antimeridian go on beyond 180 degrees."""
    outline = cell_outline(F.col("cell_id").cast("long"), resolution)
    near = lambda lon, first: lon + F.when(lon - first > 180, -360.0).when(lon - first < -180, 360.0).otherwise(0.0)
    ring = F.transform("outline", lambda p: F.array(near(p["lon"], F.col("outline")[0]["lon"]), p["lat"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.concat("ring", F.slice("ring", 1, 1))).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*cells.columns).alias("properties")))
    return cells.withColumn("outline", outline).withColumn("ring", ring).select("cell_id", feature.alias("feature"))


def append_audit(entries: DataFrame, stamp: str) -> DataFrame:
    """Audit rows with their states as JSON text and a timestamp."""
    blob = lambda c: F.to_json(c).alias(c)
    return entries.select("event_type", "actor", "entity_type", "entity_id", "action", blob("before_state"), blob("after_state"), F.lit(stamp).alias("timestamp"))


def query_audit(audit: DataFrame, since: str | None = None, until: str | None = None, limit: int | None = None, **equal: str) -> DataFrame:
    """Newest first; every keyword is an equality filter on the column of that name."""
    for column, value in equal.items():
        audit = audit.filter(F.col(column) == value)
    if since is not None:
        audit = audit.filter(F.col("timestamp") >= since)
    if until is not None:
        audit = audit.filter(F.col("timestamp") < until)
    out = audit.orderBy(F.desc("timestamp"), "entity_id")
    return out if limit is None else out.limit(limit)


def export_audit(audit: DataFrame, path: str, since: str | None = None, until: str | None = None) -> None:
    """A time range as CSV in time order, quotes doubled."""
    query_audit(audit, since, until).orderBy("timestamp", "entity_id").write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def snapshot_status(stations: DataFrame, held: DataFrame, as_of: int, keep_days: int = 14) -> DataFrame:
    """The status log with one more entry per station with a status, without repeats and without expired entries."""
    new = stations.filter("status is not null").select(F.col("name").alias("station_name"), "status", F.lit(as_of).cast("long").alias("recorded_at"))
    new = new.join(held.select("station_name", "recorded_at"), ["station_name", "recorded_at"], "left_anti")
    return held.unionByName(new).filter(F.col("recorded_at") >= as_of - keep_days * DAY)


def apply_retention(table: DataFrame, kind: str, as_of: int, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and one row with the number of those kept and deleted."""
    keep = F.col(column) >= as_of - RETENTION_DAYS[kind] * DAY
    counts = table.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("deleted")).withColumn("table_name", F.lit(kind))
    return table.filter(keep), counts


def pseudonymize(df: DataFrame, column: str = "station", order: str = "id") -> DataFrame:
    """Stations as STN-0001 and so on, in the order of their first row.

    Names are numbered within ranges of that order, and a range's numbers start after those of the ranges before it, so
    no task sorts all names.
    """
    first = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"))
    ranged = checkpointed(first.repartitionByRange("_first", column).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))  # one row per range
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_part").orderBy("_first", column))
    code = F.format_string("STN-%04d", F.col("_rank") + F.col("_before"))
    names = ranged.withColumn("_rank", rank).join(F.broadcast(before), "_part").select(column, code.alias("_code"))
    return df.join(names, column, "left").withColumn(column, F.col("_code")).drop("_code")
