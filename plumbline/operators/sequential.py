"""Sequential change detection per station: cumulative sums and smoothed means against rolling baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.rules import HOUR, between, clean_sessions, half_up, has_station, positive, settled

from .detectors import MINUTE, adaptive_thresholds, deviation, fix

#: Baseline windows in cycles before the current one (first, last); at five minutes a cycle they are 5-30 min, 30 min-2 h, 2-6 h.
WINDOWS = {"5m": (5, 1), "30m": (23, 6), "2h": (71, 24)}
#: The one window of the earlier detector: the hour up to five minutes ago.
HOUR_WINDOW = (11, 1)
ALARM = "array<struct<type: string, severity: string, k: int, affected_users: bigint, current: double, baseline: double>>"


def cycles(sessions: DataFrame, as_of: int, cycle_min: int, hours: int) -> DataFrame:
    """``station, k, fix, n, age, users`` and the sums behind them, per station and cycle of the last ``hours``; one shuffle."""
    width = cycle_min * MINUTE
    start = as_of - hours * HOUR
    k = F.floor((F.col("login_time") - start) / width).cast("int")
    return sessions.filter(between(start, as_of)).groupBy("station", k.alias("k")).agg(
        F.sum(fix()).alias("fix_sum"), F.count("*").alias("n"), F.sum(positive("avg_age")).alias("age_sum"), F.count(positive("avg_age")).alias("age_n"),
        F.count_distinct("username").alias("users")).withColumns({"fix": F.col("fix_sum") / F.col("n"), "age": F.coalesce(F.col("age_sum") / F.col("age_n"), F.lit(0.0))})


def with_baselines(rows: DataFrame, windows: dict[str, tuple[int, int]], least: int) -> DataFrame:
    """Cycles and, by window, the mean fix rate ``base_<name>`` and age ``age_<name>`` of the sessions before them; null where there
    are fewer than ``least``. All windows come from one sort. A station has as many rows as cycles."""
    out = {}
    for name, (first, last) in windows.items():
        before = W.partitionBy("station").orderBy("k").rangeBetween(-first, -last)
        total = lambda c, before=before: F.sum(c).over(before)
        enough = total("n") >= least
        out[f"base_{name}"] = F.when(enough, total("fix_sum") / total("n"))
        out[f"age_{name}"] = F.when(enough, F.coalesce(total("age_sum") / total("age_n"), F.lit(0.0)))
    return rows.withColumns(out)


def alarm(when: Column, kind: str, level: Column, x: Column, current: Column, baseline: Column) -> Column:
    row = F.struct(F.lit(kind).alias("type"), level.alias("severity"), x["k"].alias("k"), x["users"].alias("affected_users"), current.alias("current"), baseline.alias("baseline"))
    return F.when(when, F.array(row)).otherwise(F.array().cast(ALARM))


def level(current: Column) -> Column:
    return F.when(settled(current) < 30, "critical").when(settled(current) < 60, "warning").otherwise("info")


def _rows(ended: DataFrame, as_of: int, cycle_min: int, hours: int, *more: str) -> DataFrame:
    c = F.col
    out = ended.select("station", *more, F.explode("end.alarms").alias("a")).select("station", *more, "a.*")
    at = F.lit(as_of - hours * HOUR) + (c("k").cast("long") + 1) * (cycle_min * MINUTE)
    return out.select("type", "severity", "station", *more, "affected_users", half_up("current", 1).alias("current_value"), half_up("baseline", 1).alias("baseline_value"),
                      deviation(c("current"), c("baseline")).alias("deviation_pct"), at.alias("detected_ms"))


def cusum_ewma_v2(sessions: DataFrame, as_of: int, kp: float = 0.0, cycle_min: int = 5, hours: int = 24) -> DataFrame:
    """One row per alarm of the three baseline windows of every station, with the window as ``method``.

    Every cycle with sessions is compared with the mean of each window before it (three sessions at least). A window's
    baseline is frozen at its first cycle; its lower sum of the deviations in sigmas (``max(5, 15 %)`` of the current
    mean) alarms above H from the third cycle on and starts anew. The smoothed fix rate follows the first window
    only and alarms from the fifth cycle on when it lies the threshold under a current mean over 50. Geomagnetic
    storms loosen the limits. The fold runs over one entry per cycle, whatever the number of sessions.
    """
    c = F.col
    rows = cycles(clean_sessions(sessions), as_of, cycle_min, hours)
    bases = [f"base_{name}" for name in WINDOWS]
    whole = with_baselines(rows, WINDOWS, 3).groupBy("station").agg(F.array_sort(F.collect_list(F.struct("k", "fix", "users", *bases))).alias("whole"))

    def own(name: str) -> Column:
        known = F.filter("whole", lambda x: x[f"base_{name}"].isNotNull())
        return F.struct(F.lit(name).alias("method"), F.transform(known, lambda x: F.struct(x["k"].alias("k"), x["fix"].alias("fix"), x["users"].alias("users"), x[f"base_{name}"].alias("base"))).alias("series"))

    series = whole.select("station", F.explode(F.array(*map(own, WINDOWS))).alias("m")).select("station", "m.*").filter(F.size("series") > 0)
    series = series.withColumns({"frozen": c("series")[0]["base"], "lim": adaptive_thresholds(F.lit(kp))})
    zero = F.struct(F.lit(0.0).alias("low"), c("frozen").alias("ewma"), F.lit(0).alias("count"), F.array().cast(ALARM).alias("alarms"))

    def step(acc: Column, x: Column) -> Column:
        count = acc["count"] + 1
        low = F.greatest(F.lit(0.0), acc["low"] - (x["fix"] - c("frozen")) / F.greatest(F.lit(5.0), x["base"] * 0.15) - c("lim.cusum_k"))
        hit = (settled(low) > c("lim.cusum_h")) & (count >= 3)
        ewma = x["fix"] * 0.2 + acc["ewma"] * 0.8
        drop = (c("method") == "5m") & (count >= 5) & (settled(x["base"]) > 50) & (settled(x["base"] - ewma) > c("lim.ewma_fix"))
        new = F.concat(acc["alarms"], alarm(hit, "cusum_fix_drift", level(x["fix"]), x, x["fix"], c("frozen")),
                       alarm(drop, "ewma_fix_drop", F.when(settled(ewma) < 30, "critical").otherwise("warning"), x, ewma, x["base"]))
        return F.struct(F.when(hit, 0.0).otherwise(low).alias("low"), ewma.alias("ewma"), count.alias("count"), new.alias("alarms"))

    return _rows(series.withColumn("end", F.aggregate("series", zero, step)), as_of, cycle_min, hours, "method")


def cusum_ewma_v1(sessions: DataFrame, as_of: int, cycle_min: int = 5, hours: int = 24) -> DataFrame:
    """The earlier detector: one row per alarm against the hour before (twenty sessions at least), fixed limits.

    Besides the lower sum of the fix rate there is an upper sum of the correction age (sigma ``max(0.5, 20 %)``), which only
    cycles with an age on both sides move, and a smoothed age that alarms above three times the current mean.
    """
    c = F.col
    rows = cycles(sessions.filter(has_station()), as_of, cycle_min, hours)
    known = with_baselines(rows, {"hour": HOUR_WINDOW}, 20).filter("base_hour is not null")
    entry = F.struct("k", "fix", "age", "users", c("base_hour").alias("base"), c("age_hour").alias("age_base"))
    series = known.groupBy("station").agg(F.array_sort(F.collect_list(entry)).alias("series"))
    start = F.lit(0.0)
    names = ("low", "high", "frozen_age", "ewma", "ewma_age", "count", "ages", "alarms")
    series = series.withColumns({"frozen": c("series")[0]["base"], "first_age": c("series")[0]["age_base"]})
    zero = F.struct(*[v.alias(n) for n, v in zip(names, (start, start, start, c("frozen"), c("first_age"), F.lit(0), F.lit(0), F.array().cast(ALARM)))])

    def step(acc: Column, x: Column) -> Column:
        count, seen = acc["count"] + 1, (x["age"] > 0) & (x["age_base"] > 0)
        ages = acc["ages"] + seen.cast("int")
        frozen_age = F.when(seen & (acc["ages"] == 0), x["age_base"]).otherwise(acc["frozen_age"])
        low = F.greatest(F.lit(0.0), acc["low"] - (x["fix"] - c("frozen")) / F.greatest(F.lit(5.0), x["base"] * 0.15) - 0.5)
        high = F.when(seen, F.greatest(F.lit(0.0), acc["high"] + (x["age"] - x["age_base"]) / F.greatest(F.lit(0.5), x["age_base"] * 0.2) - 0.5)).otherwise(acc["high"])
        hit, old = (settled(low) > 5) & (count >= 3), seen & (settled(high) > 5) & (ages >= 3)
        ewma, ewma_age = x["fix"] * 0.2 + acc["ewma"] * 0.8, F.when(x["age"] > 0, x["age"] * 0.2 + acc["ewma_age"] * 0.8).otherwise(acc["ewma_age"])
        drop = (count >= 5) & (settled(x["base"]) > 50) & (settled(x["base"] - ewma) > 15)
        spike = (count >= 5) & (x["age_base"] > 0) & (settled(ewma_age - x["age_base"] * 3) > 0)
        new = F.concat(acc["alarms"], alarm(hit, "cusum_fix_drift", level(x["fix"]), x, x["fix"], c("frozen")),
                       alarm(old, "cusum_age_drift", F.when(settled(x["age"] - x["age_base"] * 5) > 0, "critical").otherwise("warning"), x, x["age"], frozen_age),
                       alarm(drop, "ewma_fix_drop", F.when(settled(ewma) < 30, "critical").otherwise("warning"), x, ewma, x["base"]),
                       alarm(spike, "ewma_age_spike", F.lit("warning"), x, ewma_age, x["age_base"]))
        values = (F.when(hit, 0.0).otherwise(low), F.when(old, 0.0).otherwise(high), frozen_age, ewma, ewma_age, count, ages, new)
        return F.struct(*[v.alias(n) for n, v in zip(names, values)])

    return _rows(series.withColumn("end", F.aggregate("series", zero, step)), as_of, cycle_min, hours)
