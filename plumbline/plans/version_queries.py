"""Registered queries of zone versions, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.graph import checkpointed
from plumbline.operators import versions

from .fixtures import AS_OF, Tables, oracle

CYCLES, STEP_MS = 6, 4 * 3_600_000
AT = [AS_OF - (CYCLES - 1 - k) * STEP_MS for k in range(CYCLES)]
LIMITS = {"share": 0.2, "least": 5}


def proposals(t: Tables, times: list[int]) -> list[tuple[int, DataFrame]]:
    """For each cycle one zone per station with sessions on the day before; its grade is the mean fix rate in steps of ten.

    The days of cycles overlap: sessions are read once and counted for each cycle whose day they fall on."""
    c = F.col
    day = lambda at: (c("login_time") >= at - 86_400_000) & (c("login_time") < at)
    cycles = F.filter(F.array(*[F.lit(at).cast("long") for at in times]), day)
    seen = t.fx_sessions.filter((c("login_time") >= min(times) - 86_400_000) & (c("login_time") < max(times)) & F.expr("station IS NOT NULL AND station <> ''"))
    every = checkpointed(seen.select(c("station").alias("zone_id"), "fix_rate", F.explode(cycles).alias("at")).groupBy("at", "zone_id").agg(
        F.concat(F.lit("grade "), F.floor(F.avg("fix_rate") / 10).cast("string")).alias("body"), (F.count(F.lit(1)) % 4).cast("int").alias("priority")))
    return [(at, every.filter(c("at") == at).drop("at")) for at in times]


def proposal(t: Tables, as_of: int) -> DataFrame:
    return proposals(t, [as_of])[0][1]


def chain(t: Tables) -> tuple[DataFrame, DataFrame]:
    empty = t.spark.createDataFrame([], versions.STATE)
    return versions.version_chain(proposals(t, AT), empty, **LIMITS)


def _proposal_sql(at: int) -> str:
    return f"""
SELECT station AS zone_id, concat('grade ', CAST(floor(avg(fix_rate) / 10) AS bigint)) AS body, CAST(count(*) % 4 AS int) AS priority
FROM fx_sessions WHERE login_time >= {at - 86_400_000} AND login_time < {at} AND station IS NOT NULL AND station <> '' GROUP BY 1"""


def _cycle_sql(k: int) -> dict[str, str]:
    """The ranked rows of one cycle, and the state after it."""
    before = f"st{k - 1}" if k else """(SELECT NULL::VARCHAR AS zone_id, NULL::VARCHAR AS body, NULL::INT AS priority, NULL::BIGINT AS created_ms,
     NULL::BIGINT AS changed_ms, NULL::INT AS changes, NULL::BIGINT AS waiting_ms WHERE false)"""
    ranked = f"""
SELECT *, change IS NOT NULL AND free AND row_number() OVER (PARTITION BY change IS NOT NULL AND free ORDER BY since, coalesce(n_priority, priority), zone_id)
          <= greatest(5, ceil(count(body) OVER () * 2e-1)) AS made
FROM (
  SELECT zone_id, o.body, o.priority, created_ms, changed_ms, changes, n.body AS n_body, n.priority AS n_priority, coalesce(waiting_ms, {AT[k]}) AS since,
         NOT coalesce(o.body IS NOT NULL AND created_ms > {AT[k] - versions.REST_MS}, false) AS free,
         CASE WHEN o.body IS NULL AND n.body IS NOT NULL THEN 'added' WHEN o.body IS NOT NULL AND n.body IS NULL THEN 'removed'
              WHEN o.body IS NOT NULL AND (o.body <> n.body OR o.priority <> n.priority) THEN 'updated' END AS change
  FROM {before} o FULL JOIN ({_proposal_sql(AT[k])}) n USING (zone_id))"""
    after = f"""
SELECT zone_id, CASE WHEN made THEN n_body ELSE body END AS body, CASE WHEN made THEN n_priority ELSE priority END AS priority,
       CASE WHEN made AND change = 'added' THEN {AT[k]} ELSE created_ms END AS created_ms, CASE WHEN made THEN {AT[k]} ELSE changed_ms END AS changed_ms,
       coalesce(changes, 0) + CASE WHEN made THEN 1 ELSE 0 END AS changes, CASE WHEN change IS NOT NULL AND NOT made THEN since END AS waiting_ms
FROM rk{k} WHERE NOT (made AND change = 'removed') AND (body IS NOT NULL OR n_body IS NOT NULL)"""
    return {f"rk{k}": ranked, f"st{k}": after}


PARTS = {name: sql for k in range(CYCLES) for name, sql in _cycle_sql(k).items()}
LOG = " UNION ALL ".join(f"SELECT {AT[k]} AS at_ms, zone_id, change FROM rk{k} WHERE made" for k in range(CYCLES))

VERSIONS = {
    "zone_versions": (lambda t: chain(t)[0].fillna("", ["body"]).fillna(-1), oracle(
        f"""SELECT zone_id, coalesce(body, '') AS body, coalesce(priority, -1) AS priority, coalesce(created_ms, -1) AS created_ms,
         coalesce(changed_ms, -1) AS changed_ms, changes, coalesce(waiting_ms, -1) AS waiting_ms FROM st{CYCLES - 1}""", **PARTS)),
    "zone_version_log": (lambda t: chain(t)[1], oracle(LOG, **PARTS)),
}
