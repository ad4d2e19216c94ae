"""Fixture views: the domain tables derived from the benchmark tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The evaluation time of all registered queries: 2024-01-31 00:00 UTC in milliseconds.
AS_OF = 1706659200000

#: In order of dependence.
VIEWS: dict[str, str] = {
    "fx_site": """
SELECT s_suppkey, s_nationkey, concat('ST', lpad(cast(s_suppkey AS string), 6, '0')) AS name,
       44e0 + ((s_suppkey - CASE WHEN s_suppkey % 20 = 19 THEN 3 ELSE 0 END) * 37 % 240) / 4e1
            + CASE WHEN s_suppkey % 20 = 19 THEN 2e-4 ELSE 0e0 END AS latitude,
       2e0 + ((s_suppkey - CASE WHEN s_suppkey % 20 = 19 THEN 3 ELSE 0 END) * 53 % 380) / 4e1
            + CASE WHEN s_suppkey % 25 = 10 THEN 25e0 ELSE 0e0 END AS longitude
FROM supplier
""",
    "fx_stations": """
SELECT name, latitude, longitude,
       (s_suppkey * 13 % 900) * 1e0 AS height,
       CASE WHEN s_suppkey % 11 = 5 THEN 'OFFLINE' WHEN s_suppkey % 2 = 0 THEN 'ONLINE' ELSE 'ACTIVE' END AS status,
       CASE WHEN s_suppkey % 17 = 9 THEN NULL WHEN s_suppkey % 3 = 1 THEN 'onocoy' ELSE 'geodnet' END AS network,
       CASE s_suppkey % 6 WHEN 0 THEN 'LEICA GR25' WHEN 1 THEN 'SURVEY_GRADE_INFERRED' WHEN 2 THEN 'PROFESSIONAL_INFERRED'
            WHEN 3 THEN 'U-BLOX ZED-F9P' WHEN 4 THEN 'CONSUMER_BASIC_INFERRED' ELSE '' END AS receiver_type,
       '' AS antenna_type,
       concat('C', cast(s_nationkey AS string)) AS country,
       CASE s_suppkey % 3 WHEN 0 THEN 'GPS+GLO+GAL+BDS' WHEN 1 THEN 'GPS+GLO+GAL' ELSE 'GPS' END AS nav_system
FROM fx_site
""",
    "fx_sessions_raw": """
SELECT concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', cast(l_partkey AS string)) AS id,
       concat('u', cast(l_partkey % 400 AS string)) AS username,
       CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_partkey % 97 = 1 THEN ''
            ELSE p.name END AS station,
       1705449600000 + ((l_orderkey * 86413 + l_partkey * 7919 + l_linenumber * 104729) % 1209600) * 1000 AS login_time,
       floor(greatest(0e0, 1e2 - (l_quantity - 1) * (l_quantity - 1) / 2401e-2 - (l_suppkey % 7) * 5e0)
             * CASE WHEN l_suppkey % 10 = 3 AND (l_orderkey * 86413 + l_partkey * 7919 + l_linenumber * 104729) % 1209600 >= 1188000
                    THEN 4e-1 ELSE 1e0 END * 1e1 + 5e-1) / 1e1 AS fix_rate,
       floor(l_discount * 1e2 + 5e-1) / 4e0
             * CASE WHEN l_suppkey % 10 = 7 AND (l_orderkey * 86413 + l_partkey * 7919 + l_linenumber * 104729) % 1209600 >= 1188000
                    THEN 4e0 ELSE 1e0 END AS avg_age,
       CASE WHEN l_linenumber = 7 AND l_partkey % 5 = 0 THEN -1
            ELSE cast(floor(l_extendedprice) AS bigint) % 7200 END AS duration,
       CASE WHEN l_partkey % 89 = 0 THEN 0e0 ELSE p.latitude + ((l_partkey % 81) - 40) / 1e2 END AS latitude,
       CASE WHEN l_partkey % 89 = 0 THEN 0e0 ELSE p.longitude + ((l_orderkey % 81) - 40) / 1e2 END AS longitude
FROM lineitem JOIN fx_site p ON p.s_suppkey = l_suppkey
""",
    "fx_sessions": """
SELECT id, min(username) AS username, min(station) AS station, min(login_time) AS login_time, min(fix_rate) AS fix_rate,
       min(avg_age) AS avg_age, min(duration) AS duration, min(latitude) AS latitude, min(longitude) AS longitude
FROM fx_sessions_raw GROUP BY id
""",
    "fx_status_log": """
SELECT s.name AS station_name, CASE WHEN e.event_type = 'error' THEN 'OFFLINE' ELSE 'ONLINE' END AS status,
       e.event_id AS event_id, e.ts AS recorded_ts
FROM events e JOIN fx_site s ON s.s_suppkey = e.user_id
""",
    "fx_env_history": """
SELECT date_trunc('hour', ts) AS hour_ts, least(9e0, floor(max(value) / 4e1)) AS kp,
       floor(min(value) * 1e1 + 5e-1) / 1e1 - 1e1 AS bz
FROM events GROUP BY date_trunc('hour', ts)
""",
    "fx_station_scores": """
SELECT concat('ST', lpad(cast(s_suppkey AS string), 6, '0')) AS station_name,
       (s_suppkey * 29 % 101) / 1e2 AS uq_score, (s_suppkey * 31 % 101) / 1e2 AS uptime_7d,
       (s_suppkey * 23 % 1001) / 1e1 AS avg_fix_rate, (s_suppkey * 19 % 101) / 1e2 AS zero_fix_ratio,
       s_suppkey * 7 % 60 AS session_count, (s_suppkey * 3 % 80) / 1e1 AS median_correction_age,
       (s_suppkey * 43 % 101) / 1e2 AS reliability_score
FROM supplier WHERE s_suppkey % 13 <> 4
""",
    "fx_trust": """
SELECT concat('ST', lpad(cast(s_suppkey AS string), 6, '0')) AS station,
       1e0 + s_suppkey * 17 % 50 AS alpha, 1e0 + s_suppkey * 5 % 30 AS beta,
       (s_suppkey * 41 % 1001) / 1e3 AS composite_score,
       CASE WHEN s_suppkey * 41 % 1001 < 250 THEN 'excluded' WHEN s_suppkey * 41 % 1001 < 400 THEN 'untrusted'
            WHEN s_suppkey * 41 % 1001 < 650 THEN 'probation' WHEN s_suppkey % 9 = 0 THEN 'new' ELSE 'trusted' END AS flag
FROM supplier WHERE s_suppkey % 7 <> 6
""",
    "fx_cells": """
SELECT concat('c', cast(c_custkey AS string)) AS cell_id, 435e-1 + (c_custkey * 17 % 280) / 4e1 AS latitude,
       15e-1 + (c_custkey * 29 % 430) / 4e1 AS longitude, (c_custkey * 37 % 100) / 1e2 AS quality_score,
       CASE WHEN c_custkey * 37 % 100 >= 75 THEN 'full_rtk' WHEN c_custkey * 37 % 100 >= 50 THEN 'degraded_rtk'
            WHEN c_custkey * 37 % 100 >= 25 THEN 'float_dgps' ELSE 'no_coverage' END AS zone_tier
FROM customer
""",
    "fx_zones": """
SELECT concat('z', cast(n_nationkey AS string)) AS zone_id, 44e0 + n_nationkey * 25e-2 AS lat, 2e0 + n_nationkey * 4e-1 AS lon,
       60000 + n_nationkey * 4000 AS radius_m, 10 + n_nationkey * 4 AS priority, n_nationkey % 8 <> 7 AS enabled,
       CASE WHEN n_nationkey % 2 = 0 THEN 'circle' ELSE 'polygon' END AS fence_type
FROM nation
""",
    "fx_caster_log": """
SELECT o_orderdate AS ts, concat('u', cast(o_custkey AS string)) AS username,
       CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE concat('ST', lpad(cast(o_custkey % 50 AS string), 6, '0')) END AS backend_source,
       cast(floor(o_totalprice) AS bigint) % 3600 AS duration_s, cast(floor(o_totalprice) AS bigint) * 3 AS bytes_transferred,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS failover_count
FROM orders
""",
    "fx_obs": """
SELECT l_suppkey % 10 AS file_id, concat('G', lpad(cast(l_linenumber AS string), 2, '0')) AS prn, l_orderkey AS epoch_s,
       min(22000000e0 + l_quantity) AS c1, min(22000001e0 + l_quantity * 1.1e0) AS c2,
       min((22000000e0 + l_discount + (l_orderkey % 50) * 1e-3) / (299792458e0 / 157542e4)) AS l1,
       min((22000000e0 + l_discount + (CASE WHEN l_orderkey % 40 = 0 THEN 3e-1 ELSE 0e0 END)) / (299792458e0 / 12276e5)) AS l2,
       min(20e0 + l_quantity / 2) AS s1
FROM lineitem GROUP BY l_suppkey % 10, concat('G', lpad(cast(l_linenumber AS string), 2, '0')), l_orderkey
""",
}
BASE = ("supplier", "lineitem", "events", "customer", "nation", "orders")
#: Rows of observations that one task groups, about; the number of tasks grows with the table.
ROWS_PER_TASK = 1_200_000


def needed(names: set[str]) -> list[str]:
    """``names`` and the views below them, in order."""
    wanted = set(names)
    for name in reversed(VIEWS):
        if name in wanted:
            wanted |= {v for v in VIEWS if re.search(rf"\b{v}\b", VIEWS[name])}
    return [v for v in VIEWS if v in wanted]


def by_epoch(lineitem: DataFrame) -> DataFrame:
    """The rows dealt by epoch: all groups of observations hold the epoch, so they are formed without a further shuffle."""
    tasks = max(int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions")), lineitem.count() // ROWS_PER_TASK + 1)
    return lineitem.repartition(tasks, "l_orderkey")


class Tables:
    """The views over one directory, as DataFrames: ``Tables(spark, path).fx_sessions``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        order = needed({name})
        for base in BASE:
            if any(re.search(rf"\b{base}\b", VIEWS[v]) for v in order):
                rows = self.spark.read.parquet(f"{self.sf_dir}/{base}.parquet")
                (by_epoch(rows) if name == "fx_obs" else rows).createOrReplaceTempView(base)
        for view in order:
            self.spark.sql(VIEWS[view]).createOrReplaceTempView(view)
        return self.spark.table(name)


def oracle(sql: str, **more: str) -> str:
    """``sql`` with the fixture views that it names, and ``more`` expressions, as leading common table expressions."""
    text = sql + " ".join(more.values())
    parts = [f"{v} AS ({VIEWS[v].strip()})" for v in needed({v for v in VIEWS if re.search(rf"\b{v}\b", text)})]
    parts += [f"{k} AS ({v.strip()})" for k, v in more.items()]
    return f"WITH {', '.join(parts)} {sql.strip()}" if parts else sql.strip()
