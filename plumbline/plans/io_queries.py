"""Registered round trips: files are built from the tables in a new folder, written, read back by the library and compared.

The folder lies beside the checkpoints, which driver and executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.graph import checkpointed
from plumbline.functions.rules import half_up
from plumbline.operators import actions
from plumbline.sources import tables
from plumbline.streaming import jobs

from .fixtures import AS_OF, Tables, oracle
from .signal_queries import AUDIT, audit
from .sql import D7, STATION, rnd

DAY_MS = 86_400_000


def folder(t: Tables, name: str) -> str:
    checkpointed(t.spark.range(0))  # makes sure that a shared folder is set
    return f"{t.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def label(text: str, name: str) -> str:
    return f"{text:<60}{name}"


# ---- observation files ----------------------------------------------------------------------------------------------

OBS_CODES = {"C1C": "c1", "C2W": "c2", "L1C": "l1", "L2W": "l2", "S1C": "s1"}
EPOCHS_PER_FILE = 2000


def observation_files(t: Tables, path: str) -> None:
    """One file for each 2,000 seconds of the observations, so their number grows with the table. A folder holds all files of
    a ``file_id``; tasks move their own files there, for the driver would move one after the other."""
    value = lambda c: F.format_string("%14.3f  ", F.col(c))
    line = F.concat("prn", *(value(c) for c in OBS_CODES.values()))
    at = F.timestamp_seconds(F.col("epoch_s"))
    epochs = t.fx_obs.groupBy("file_id", "epoch_s").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    head = F.concat(F.lit("> "), F.date_format(at, "yyyy MM dd HH mm ss"), F.format_string(".0000000  0 %2d", F.size("lines")))
    block = F.concat_ws("\n", F.array(head), "lines")
    header = "\n".join((label(f"G    {len(OBS_CODES)} {' '.join(OBS_CODES)}", "SYS / # / OBS TYPES"), label("", "END OF HEADER")))
    files = epochs.groupBy("file_id", F.floor(F.col("epoch_s") / EPOCHS_PER_FILE).alias("part")).agg(F.array_sort(F.collect_list(F.struct("epoch_s", block.alias("b")))).alias("blocks"))
    text = F.concat_ws("\n", F.lit(header), F.transform("blocks", lambda b: b["b"]))
    (files.select("file_id", text.alias("value")).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2)
     .partitionBy("file_id").text(path))


def parse_observations(t: Tables) -> DataFrame:
    path = folder(t, "observations")
    observation_files(t, path)
    rows = tables.parse_observations(t.spark, f"{path}/*")
    number = F.regexp_extract("file_id", r"file_id=(\d+)", 1).cast("int")
    return rows.select(number.alias("file_id"), "epoch_s", "prn", "constellation", *(F.coalesce(F.col("obs")[code], F.lit(0.0)).alias(c) for code, c in OBS_CODES.items()))


OBSERVATIONS = """
SELECT CAST(file_id AS int) AS file_id, CAST(epoch_s AS double) AS epoch_s, prn, left(prn, 1) AS constellation, round(c1, 3) AS c1, round(c2, 3) AS
   c2, round(l1, 3) AS l1,
       round(l2, 3) AS l2, round(s1, 3) AS s1
FROM fx_obs"""

# ---- ionosphere maps ------------------------------------------------------------------------------------------------

N_LAT, N_LON = 71, 73
GRID = {"lat0": 87.5, "dlat": -2.5, "n_lat": N_LAT, "lon0": -180.0, "dlon": 5.0, "n_lon": N_LON}
NODES = f"""
SELECT c_nationkey % 3 AS map, CAST(c_custkey % {N_LAT} AS int) AS i, CAST(c_custkey // 7 % {N_LON} AS int) AS j, CAST(sum(c_custkey % 90) AS int) %
   1000 AS v
FROM customer GROUP BY 1, 2, 3"""


def map_files(t: Tables, path: str) -> None:
    """Three maps in one file each, in tenths; nodes without customers are missing."""
    c = F.col
    nodes = t.customer.groupBy((c("c_nationkey") % 3).alias("map"), (c("c_custkey") % N_LAT).cast("int").alias("i"), (F.floor(c("c_custkey") / 7) % N_LON).cast("int").alias("j")).agg(
        (F.sum(c("c_custkey") % 90) % 1000).cast("int").alias("v"))
    rows = nodes.groupBy("map", "i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("at"))
    values = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(N_LON - 1)), lambda j: F.format_string("%5d", F.coalesce(c("at")[j], F.lit(9999)))))
    head = F.concat(F.rpad(F.format_string("  %6.1f-180.0 180.0   5.0 450.0", 87.5 - 2.5 * c("i")), 60, " "), F.lit("LAT/LON1/LON2/DLON/H\n"))
    lines = F.concat(head, F.regexp_replace(values, "(.{80})", "$1\n"))
    body = rows.groupBy("map").agg(F.array_sort(F.collect_list(F.struct("i", lines.alias("l")))).alias("rows"))
    top = F.concat(F.lit(label("    -1", "EXPONENT") + "\n" + label("", "END OF HEADER") + "\n" + label("     1", "START OF TEC MAP") + "\n"),
                   F.rpad(F.format_string("  2024     1    31 %5d     0     0", c("map").cast("int") * 2), 60, " "), F.lit("EPOCH OF CURRENT MAP"))
    text = F.concat_ws("\n", top, F.transform("rows", lambda r: r["l"]), F.lit(label("     1", "END OF TEC MAP")))
    body.select("map", text.alias("value")).write.partitionBy("map").text(path)


def maps(t: Tables) -> DataFrame:
    path = folder(t, "maps")
    map_files(t, path)
    return tables.parse_iono_maps(t.spark, f"{path}/*")


IONO = f"""
SELECT map * 2 AS hour, 875e-1 - 25e-1 * i AS lat, -180 + 5e0 * j AS lon, {rnd("v / 1e1", 1)} AS vtec FROM no"""
TEC_GRID = f"""
SELECT lat, lon, {rnd("value", 1)} AS vtec, {rnd("sqrt(ns * ns + ew * ew)", 2)} AS gradient,
       CASE WHEN sqrt(ns * ns + ew * ew) < 2 THEN 'nominal' WHEN sqrt(ns * ns + ew * ew) < 5 THEN 'elevated'
          WHEN sqrt(ns * ns + ew * ew) < 10 THEN 'degraded' ELSE 'storm' END AS quality
FROM (
  SELECT lat, lon, v00 * (1 - u) * (1 - w) + v01 * (1 - u) * w + v10 * u * (1 - w) + v11 * u * w AS value, ((v10 + v11) / 2 - (v00 + v01) / 2) / 25e-1
     AS ns,
         ((v01 + v11) / 2 - (v00 + v10) / 2) / 5e0 AS ew
  FROM (
    SELECT p.lat, p.lon, p.fi - p.i AS u, p.fj - p.j AS w,
       {", ".join(f"coalesce((SELECT v / 1e1 FROM la n WHERE n.i = p.i + {a} AND n.j = p.j + {b}), 0e0) AS v{a}{b}" for a in (0, 1) for b in (0, 1))}
    FROM (SELECT *, CAST(greatest(0, least({N_LAT - 2}, floor(fi))) AS int) AS i, CAST(greatest(0, least({N_LON - 2}, floor(fj))) AS int) AS j FROM (
            SELECT a * 5e0 - 85 AS lat, b * 5e0 - 180 AS lon, (a * 5e0 - 85 - 875e-1) / -25e-1 AS fi, (b * 5e0) / 5e0 AS fj
               FROM range(35) x(a), range(73) y(b))) p))
WHERE {rnd("value", 1)} > 0"""

# ---- snapshots, audit, streams --------------------------------------------------------------------------------------


def snapshot(t: Tables) -> DataFrame:
    path = folder(t, "snapshot")
    tables.write_snapshot(t.fx_trust.filter("alpha > 1e9"), path)
    tables.write_snapshot(t.fx_trust, path)  # replaces the first
    return t.spark.read.parquet(path)


def entries(t: Tables) -> DataFrame:
    state = lambda c: F.struct(F.col(c).alias("score"))
    return t.fx_trust.select(F.lit("trust_change").alias("event_type"), F.lit("system").alias("actor"), F.lit("station").alias("entity_type"), F.col("station").alias("entity_id"),
                             F.col("flag").alias("action"), state("alpha").alias("before_state"), state("beta").alias("after_state"))


def exported_audit(t: Tables) -> DataFrame:
    path = folder(t, "audit")
    tables.export_audit(audit(t).select("event_type", "actor", "entity_id", "timestamp"), path, "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    return t.spark.read.option("header", True).csv(path)


def streamed(t: Tables, rows: DataFrame, name: str, job) -> DataFrame:
    """``rows`` as files, run through a streaming job until they are used up, and the sink read back."""
    path = folder(t, name)
    rows.write.parquet(f"{path}/in")
    source = t.spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    query = job(source).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.read.parquet(f"{path}/out")


def deduplicated(t: Tables) -> DataFrame:
    """A third of the sessions arrives twice."""
    rows = t.fx_sessions.filter(F.col("login_time") >= D7).select("id", "station", "login_time", "fix_rate")
    return streamed(t, rows.unionByName(rows.filter("crc32(id) % 3 = 0")), "dedup", jobs.deduplicated).select("id", "station", "login_time")


def half_days(t: Tables) -> DataFrame:
    start = F.floor(F.col("login_time") / (DAY_MS // 2)) * (DAY_MS // 2)
    rows = t.fx_sessions.filter("station is not null and station <> ''").groupBy("station", start.alias("start_ms"))
    return rows.agg(half_up(F.avg("fix_rate"), 3).alias("mean_fix"))


def stream_cusum(t: Tables) -> DataFrame:
    out = streamed(t, half_days(t), "cusum", jobs.cusum_stream)
    return out.select("station", "start_ms", "cusum_alarm", "ewma_alarm", half_up("s_minus", 3).alias("s_minus"), half_up("ewma", 3).alias("ewma"))


BUCKETS = f"""
SELECT station, start_ms, fix, row_number() OVER w AS i, avg(fix) FILTER (k <= 5) OVER (PARTITION BY station) AS base FROM (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY start_ms) AS k FROM (
    SELECT station, CAST(floor(login_time / 432e5) AS bigint) * 43200000 AS start_ms, {rnd("avg(fix_rate)", 3)} AS fix FROM fx_sessions
       WHERE {STATION} GROUP BY 1, 2))
WINDOW w AS (PARTITION BY station ORDER BY start_ms)"""
STREAM_CUSUM = f"""
SELECT station, start_ms, hit AS cusum_alarm, i >= 10 AND base > 50
   AND base - ew > 15 AS ewma_alarm, {rnd("lo", 3)} AS s_minus, {rnd("ew", 3)} AS ewma FROM (
  WITH RECURSIVE f(station, i, start_ms, base, low, lo, ew, hit) AS (
    SELECT station, i, start_ms, base, 0e0, 0e0, base, false FROM bu WHERE i = 5
    UNION ALL
    SELECT s.station, s.i, s.start_ms, s.base, CASE WHEN x.lo > 5 AND s.i >= 8 THEN 0e0 ELSE x.lo END, x.lo, s.fix * 2e-1 + f.ew * 8e-1, x.lo > 5
       AND s.i >= 8
    FROM f JOIN bu s ON s.station = f.station AND s.i = f.i + 1, LATERAL (SELECT greatest(0e0, f.low - (s.fix - s.base) / greatest(5e0, s.base *
       15e-2) - 5e-1) AS lo) x)
  SELECT * FROM f WHERE i > 5)"""

IO_TABLE = {
    "parse_observations": (parse_observations, oracle(OBSERVATIONS)),
    "parse_iono_maps": (lambda t: maps(t).select(F.hour("epoch").alias("hour"), "lat", "lon", half_up("vtec", 1).alias("vtec")), oracle(IONO, no=NODES)),
    "tec_grid": (lambda t: actions.tec_grid(maps(t), **GRID), oracle(TEC_GRID, no=NODES, la="SELECT * FROM no WHERE map = 2")),
    "write_snapshot": (snapshot, oracle("SELECT * FROM fx_trust")),
    "append_audit": (
        lambda t: tables.append_audit(entries(t), "2024-01-30 12:00:00").withColumns({c: F.get_json_object(c, "$.score").cast("double") for c in ("before_state", "after_state")}),
        oracle("""SELECT 'trust_change' AS event_type, 'system' AS actor, 'station' AS entity_type, station AS entity_id, flag AS action, alpha AS
           before_state, beta AS after_state,
         '2024-01-30 12:00:00' AS timestamp FROM fx_trust""")),
    "export_audit": (
        exported_audit,
        oracle("""SELECT event_type, actor, entity_id, timestamp FROM au WHERE timestamp >= '2024-01-10 00:00:00'
           AND timestamp < '2024-01-20 00:00:00'""", au=AUDIT)),
    "stream_deduplicated": (deduplicated, oracle(f"SELECT id, station, login_time FROM fx_sessions WHERE login_time >= {D7}")),
    "stream_cusum": (stream_cusum, oracle(STREAM_CUSUM, bu=BUCKETS)),
}
