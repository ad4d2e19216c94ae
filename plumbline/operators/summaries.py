"""Summaries that the jobs write about their results: one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import half_up

# The classes, flags, tiers and grades that are counted.
CAUSES = ("jamming", "spoofing", "iono", "station_fault", "multipath", "network")
FLAGS = ("trusted", "probation", "untrusted", "excluded", "new")
ACTIONS = {"downgrades": "downgrade", "excludes": "exclude", "restores": "restore", "new_fences": "new_fence", "cascade_exhaustion": "cascade_exhaustion", "dual_outage": "dual_outage"}
TIERS = ("platinum", "gold", "silver")
GRADES = ("A", "B", "C", "D", "F")


def _count(column: str, value: str, name: str | None = None) -> Column:
    return F.count_if(F.col(column) == value).alias(name or value)


def _mean(column: str, name: str, digits: int, where: Column | None = None) -> Column:
    value = F.col(column) if where is None else F.when(where, F.col(column))
    return half_up(F.coalesce(F.avg(value), F.lit(0.0)), digits).alias(name)


def trust_summary(trust: DataFrame) -> DataFrame:
    """Stations by flag, and their mean composite score."""
    return trust.agg(F.count("*").alias("total"), *(_count("flag", f) for f in FLAGS), _mean("composite_score", "avg_trust", 3))


def interference_summary(events: DataFrame) -> DataFrame:
    """Interference events by cause."""
    return events.agg(*(_count("classification", cause) for cause in CAUSES))


def action_summary(done: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Zone actions by kind; with the actions asked for, also how many the guards against flapping held back."""
    out = done.agg(F.count("*").alias("total_actions"), *(_count("action", kind, name) for name, kind in ACTIONS.items()))
    if asked is None:
        return out
    wanted = asked.agg(F.count("*").alias("asked"))
    return out.crossJoin(F.broadcast(wanted)).withColumn("blocked", F.col("asked") - F.col("total_actions")).drop("asked")


def qualified_summary(gates: DataFrame) -> DataFrame:
    """Stations that pass the quality gates by tier, their mean score, and how many of which network (a map)."""
    passed = ~F.col("disqualified")
    networks = gates.filter(passed).groupBy("network").agg(F.count("*").alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("network", "n")))).alias("networks"))  # one entry a network
    tiers = (F.count_if(passed & (F.col("quality_tier") == tier)).alias(tier) for tier in TIERS)
    return gates.agg(F.count("*").alias("total_evaluated"), F.count_if(passed).alias("qualified_count"), F.count_if(~passed).alias("disqualified_count"), *tiers,
                     _mean("composite_score", "avg_composite", 3, passed)).crossJoin(networks)


def gap_summary(candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """Gap regions, how many of them can be filled, and the candidates behind them by hardware."""
    found = candidates.agg(_count("hardware_class", "survey_grade"), _count("hardware_class", "consumer"), F.count_if("enabled").alias("zones_created"))
    return regions.agg(F.count("*").alias("total_gaps"), F.count_if("fillable").alias("gaps_fillable")).crossJoin(F.broadcast(found))


def probe_summary(probes: DataFrame) -> DataFrame:
    """Probes (``success, probe_type, latency_ms``) by outcome and kind, and the mean latency of those that succeeded."""
    ok = F.col("success")
    return probes.agg(F.count("*").alias("total_probed"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), _count("probe_type", "gap_fill", "gap_fills"),
                      _count("probe_type", "quality_compare", "quality_compares"), _mean("latency_ms", "avg_latency_ms", 0, ok))


def grade_summary(graded: DataFrame) -> DataFrame:
    """Checked stations by grade."""
    return graded.agg(F.count("*").alias("total_downloaded"), *(_count("grade", g, f"grade_{g.lower()}") for g in GRADES))


def exploration_summary(sampled: DataFrame) -> DataFrame:
    """Stations whose draw lies above what is known of them (``sampled, blended``), and their share in percent."""
    explored = F.count_if(F.col("sampled") > F.col("blended"))
    return sampled.agg(F.count("*").alias("total_stations"), explored.alias("explored"), half_up(explored / F.greatest(F.count("*"), F.lit(1)) * 100).alias("exploration_rate"))
