"""Registered queries of the public feed and of tables kept by day, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import half_up
from plumbline.operators import feed
from plumbline.sources import dated

from .fixtures import AS_OF, Tables, oracle
from .io_queries import folder
from .sql import rnd

RECENT = AS_OF - 5 * 86_400_000
FIRST_KEPT = "2024-01-24"  # seven days before the evaluation time

# ---- feed -----------------------------------------------------------------------------------------------------------

#: Anomaly texts from the status log: the station, another one, a name of each network, and both networks' names.
FEED_ROWS = """
SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE station_name END AS station,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('Check ', station_name, ' on Geodnet, see ST', lpad(CAST(event_id * 7 % 90 AS string), 6, '0'),
         CASE WHEN event_id % 3 = 0 THEN concat('; onocoy: ONO_x', CAST(event_id % 40 AS string), ' or NRBY_y', CAST(event_id % 30 AS string), '_z') ELSE '.' END) END AS text
FROM fx_status_log"""
NAMES = r"'\b[A-Z0-9]{8,12}\b|NRBY_\w+|ONO_\w+'"
FEED_PARTS = {
    "fr": FEED_ROWS,
    "pc": rf"""SELECT id, unnest(range(len(plain))) AS pos, regexp_replace(unnest(plain), '(?i)geodnet|onocoy', 'network', 'g') AS plain, unnest(list_append(names, NULL)) AS raw
               FROM (SELECT id, regexp_split_to_array(text, {NAMES}) AS plain, regexp_extract_all(text, {NAMES}) AS names FROM fr WHERE text IS NOT NULL)""",
    "pn": """SELECT *, CASE WHEN raw LIKE 'NRBY\\_%' ESCAPE '\\' OR raw LIKE 'ONO\\_%' ESCAPE '\\' THEN regexp_replace(raw, '(?i)geodnet|onocoy', 'network', 'g') ELSE raw END AS name,
                CASE WHEN raw LIKE 'NRBY\\_%' ESCAPE '\\' THEN 2 WHEN raw LIKE 'ONO\\_%' ESCAPE '\\' THEN 3 ELSE 1 END AS kind FROM pc""",
    "cd": """SELECT name, printf('STN-%04d', row_number() OVER (ORDER BY first, name)) AS code FROM (
               SELECT name, min((id, kind, pos)) AS first FROM (
                 SELECT name, id, kind, pos FROM pn WHERE name IS NOT NULL UNION ALL SELECT station, id, 0, 0 FROM fr WHERE station IS NOT NULL) GROUP BY 1)""",
    "tx": "SELECT id, string_agg(concat(plain, coalesce(code, '')), '' ORDER BY pos) AS clean FROM pn LEFT JOIN cd USING (name) GROUP BY 1",
}
FEED = "SELECT fr.id, cd.code AS station, tx.clean AS text FROM fr LEFT JOIN cd ON cd.name = fr.station LEFT JOIN tx ON tx.id = fr.id"


def feed_rows(t: Tables) -> DataFrame:
    t.fx_status_log  # registers the view
    return t.spark.sql(FEED_ROWS)


# ---- tables by day --------------------------------------------------------------------------------------------------

def loaded(t: Tables) -> tuple[str, DataFrame]:
    """The sessions in two loads, the second of which brings a part of the first again, and what it did."""
    path = folder(t, "dated")
    rows = t.fx_sessions.select("id", "station", "login_time", "fix_rate")
    turn = (F.floor(F.col("login_time") / 1000) % 4).cast("int")
    dated.load_days(rows.filter(turn < 2), path, "id", "login_time").count()
    return path, dated.load_days(rows.filter((turn > 0) & (F.col("login_time") >= RECENT)), path, "id", "login_time")


def kept_days(t: Tables) -> DataFrame:
    path, _ = loaded(t)
    dropped = dated.drop_days(t.spark, path, AS_OF, 7)
    mark = dated.high_water(t.spark, path, "login_time")
    held = dated.read_dated(t.spark, path).groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.sum("fix_rate").alias("fix")).withColumn("state", F.lit("held"))
    gone = dropped.select("day", F.col("deleted").alias("rows"), F.lit(0.0).alias("fix"), F.lit("dropped").alias("state"))
    return held.unionByName(gone).select(F.col("day").cast("string").alias("day"), "rows", half_up("fix", 1).alias("fix"), "state", F.lit(mark).alias("mark"))


TURN = "(login_time // 1000) % 4"
DAYS = f"SELECT *, strftime(make_timestamp(CAST(login_time AS bigint) * 1000), '%Y-%m-%d') AS day, {TURN} < 2 AS early, {TURN} > 0 AND login_time >= {RECENT} AS late FROM fx_sessions"
KEPT = f"""
SELECT day, count(*) AS rows, CASE WHEN day >= '{FIRST_KEPT}' THEN {rnd("sum(fix_rate)", 1)} ELSE 0e0 END AS fix,
       CASE WHEN day >= '{FIRST_KEPT}' THEN 'held' ELSE 'dropped' END AS state, (SELECT max(login_time) FROM dy WHERE early OR late) AS mark
FROM dy WHERE early OR late GROUP BY 1"""

FEEDS = {
    "public_feed": (lambda t: feed.public_feed(feed_rows(t)), oracle(FEED, **FEED_PARTS)),
    "dated_load": (
        lambda t: loaded(t)[1].select(F.col("day").cast("string").alias("day"), "added", "held"),
        oracle("SELECT day, count(*) FILTER (late AND NOT early) AS added, count(*) FILTER (early OR late) AS held FROM dy GROUP BY 1 HAVING added > 0", dy=DAYS)),
    "dated_retention": (kept_days, oracle(KEPT, dy=DAYS)),
}
