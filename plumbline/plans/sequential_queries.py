"""Registered sequential detectors and their SQL twins.

Sessions of the fixtures are sparse, so a cycle takes hours here instead of five minutes; the windows are so many cycles.
"""

from __future__ import annotations

from plumbline.operators import sequential as q

from .fixtures import AS_OF, oracle
from .report_queries import SEEN
from .sql import STATION, rnd

HOURS = 14 * 24
START = AS_OF - HOURS * 3_600_000
CYCLE_MIN = 120


def cycles_sql(where: str) -> str:
    return f"""
SELECT station, CAST(floor((login_time - {START}) / {CYCLE_MIN * 60_000}e0) AS int) AS k, sum(coalesce(fix_rate, 0e0)) AS fs, count(*) AS n,
       sum(CASE WHEN avg_age > 0 THEN avg_age END) AS ages, count(CASE WHEN avg_age > 0 THEN 1 END) AS an, count(DISTINCT username) AS users
FROM fx_sessions WHERE {where} AND login_time >= {START} AND login_time < {AS_OF} GROUP BY 1, 2"""


def windowed_sql(method: str, window: tuple[int, int], least: int) -> str:
    frame = f"OVER (PARTITION BY station ORDER BY k RANGE BETWEEN {window[0]} PRECEDING AND {window[1]} PRECEDING)"
    return f"""
SELECT *, row_number() OVER (PARTITION BY station ORDER BY k) AS i, first_value(base) OVER (PARTITION BY station ORDER BY k) AS fz,
       first_value(ab) OVER (PARTITION BY station ORDER BY k) AS fa
FROM (
  SELECT '{method}' AS method, station, k, users, fs / n AS fix, coalesce(ages / an, 0e0) AS age, sum(n) {frame} AS bn, sum(fs) {frame} / sum(n)
     {frame} AS base,
         coalesce(sum(ages) {frame} / nullif(sum(an) {frame}, 0), 0e0) AS ab
  FROM cy) WHERE bn >= {least}"""


SERIES = " UNION ALL ".join(f"SELECT * FROM ({windowed_sql(name, w, 3)})" for name, w in q.WINDOWS.items())
LEVEL = "CASE WHEN fix < 30 THEN 'critical' WHEN fix < 60 THEN 'warning' ELSE 'info' END"


def alarm_sql(kind: str, level: str, current: str, baseline: str, when: str, method: str = "") -> str:
    return f"""SELECT '{kind}' AS type, {level} AS severity, station, {method} users AS affected_users, {rnd(current, 1)} AS current_value,
       {rnd(baseline, 1)} AS baseline_value,
 {rnd(f"({current} - {baseline}) / {baseline} * 1e2", 1)} AS deviation_pct, {START} + (CAST(k AS bigint) + 1) * {CYCLE_MIN * 60_000} AS detected_ms
    FROM fo WHERE {when}"""


FOLD_V2 = """
SELECT * FROM (
  WITH RECURSIVE f(station, method, i, low, ew, k, users, fix, base, fz, hit) AS (
    SELECT station, method, CAST(0 AS bigint), 0e0, base, 0, CAST(0 AS bigint), 0e0, base, fz, false FROM ser WHERE i = 1
    UNION ALL
    SELECT s.station, s.method, s.i, CASE WHEN x.lo > 5 AND s.i >= 3 THEN 0e0
       ELSE x.lo END, s.fix * 2e-1 + f.ew * 8e-1, s.k, s.users, s.fix, s.base, s.fz, x.lo > 5 AND s.i >= 3
    FROM f JOIN ser s ON s.station = f.station AND s.method = f.method AND s.i = f.i + 1,
         LATERAL (SELECT greatest(0e0, f.low - (s.fix - s.fz) / greatest(5e0, s.base * 15e-2) - 5e-1) AS lo) x)
  SELECT * FROM f WHERE i > 0)"""
V2 = " UNION ALL ".join((
    alarm_sql("cusum_fix_drift", LEVEL, "fix", "fz", "hit", "method,"),
    alarm_sql("ewma_fix_drop", "CASE WHEN ew < 30 THEN 'critical' ELSE 'warning' END", "ew", "base", "method = '5m' AND i >= 5 AND base > 50 AND base - ew > 15", "method,")))
FOLD_V1 = """
SELECT * FROM (
  WITH RECURSIVE f(station, i, low, high, za, ew, ea, c, k, users, fix, age, base, ab, fz, hit, old) AS (
    SELECT station, CAST(0 AS bigint), 0e0, 0e0, 0e0, base, ab, 0, 0, CAST(0 AS bigint), 0e0, 0e0, base, ab, fz, false, false FROM ser WHERE i = 1
    UNION ALL
    SELECT s.station, s.i, CASE WHEN x.lo > 5 AND s.i >= 3 THEN 0e0 ELSE x.lo END, CASE WHEN x.seen AND x.hi > 5 AND f.c + 1 >= 3 THEN 0e0
       ELSE x.hi END,
           CASE WHEN x.seen AND f.c = 0 THEN s.ab ELSE f.za END, s.fix * 2e-1 + f.ew * 8e-1, CASE WHEN s.age > 0 THEN s.age * 2e-1 + f.ea * 8e-1
              ELSE f.ea END,
           f.c + CASE WHEN x.seen THEN 1 ELSE 0 END, s.k, s.users, s.fix, s.age, s.base, s.ab, s.fz, x.lo > 5 AND s.i >= 3, x.seen AND x.hi > 5
              AND f.c + 1 >= 3
    FROM f JOIN ser s ON s.station = f.station AND s.i = f.i + 1,
         LATERAL (SELECT s.age > 0 AND s.ab > 0 AS seen, greatest(0e0, f.low - (s.fix - s.fz) / greatest(5e0, s.base * 15e-2) - 5e-1) AS lo,
                         CASE WHEN s.age > 0 AND s.ab > 0 THEN greatest(0e0, f.high + (s.age - s.ab) / greatest(5e-1, s.ab * 2e-1) - 5e-1)
                            ELSE f.high END AS hi) x)
  SELECT * FROM f WHERE i > 0)"""
V1 = " UNION ALL ".join((
    alarm_sql("cusum_fix_drift", LEVEL, "fix", "fz", "hit"),
    alarm_sql("cusum_age_drift", "CASE WHEN age > ab * 5 THEN 'critical' ELSE 'warning' END", "age", "za", "old"),
    alarm_sql("ewma_fix_drop", "CASE WHEN ew < 30 THEN 'critical' ELSE 'warning' END", "ew", "base", "i >= 5 AND base > 50 AND base - ew > 15"),
    alarm_sql("ewma_age_spike", "'warning'", "ea", "ab", "i >= 5 AND ab > 0 AND ea > ab * 3")))

SEQUENTIAL = {
    "cusum_ewma_v2": (
        lambda t: q.cusum_ewma_v2(t.fx_sessions, AS_OF, cycle_min=CYCLE_MIN, hours=HOURS),
        oracle(V2, cy=cycles_sql(SEEN), ser=SERIES, fo=FOLD_V2)),
    "cusum_ewma_v1": (
        lambda t: q.cusum_ewma_v1(t.fx_sessions, AS_OF, cycle_min=CYCLE_MIN, hours=HOURS),
        oracle(V1, cy=cycles_sql(STATION), ser=windowed_sql("", q.HOUR_WINDOW, 20), fo=FOLD_V1)),
}
