"""Rules that every job shares: filters, half-up rounding, severity, time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000, 86_400_000
PRIMARY, OVERLAY = "geodnet", "onocoy"


def half_up(x: Column | str, digits: int = 0) -> Column:
    """Round half towards positive infinity, as a double. Values a ten-millionth under the half, as sums in another
    order may give, count as the half."""
    x = F.col(x) if isinstance(x, str) else x
    p = float(10**digits)
    return F.floor(x * p + 0.5000001).cast("double") / F.lit(p)


def settled(x: Column | str) -> Column:
    """``x`` to nine digits, for comparisons with a limit: sums of floating numbers end in digits that the order of their rows
    decides, which must not tell on which side of the limit a value lies that is the limit itself."""
    return half_up(x, 9)


def not_noise() -> Column:
    """Sessions without a fix that lasted under a minute are noise; live sessions (duration -1) are not."""
    return ~((F.col("fix_rate") == 0) & (F.col("duration") >= 0) & (F.col("duration") < 60))


def has_station() -> Column:
    return F.col("station").isNotNull() & (F.col("station") != "")


def has_position() -> Column:
    return F.col("latitude").isNotNull() & (F.abs("latitude") > 0.1)


def nonzero_position() -> Column:
    """The looser test of some jobs: both coordinates present and not zero."""
    return F.coalesce(F.col("latitude") != 0, F.lit(False)) & F.coalesce(F.col("longitude") != 0, F.lit(False))


def online(col: str = "status") -> Column:
    return F.col(col).isin("ONLINE", "ACTIVE")


def clean_sessions(sessions: DataFrame, noise: bool = True, station: bool = True, position: bool = False) -> DataFrame:
    """Sessions without noise, without missing stations and, if asked for, without missing positions."""
    for use, rule in ((noise, not_noise), (station, has_station), (position, has_position)):
        if use:
            sessions = sessions.filter(rule())
    return sessions


def between(start: int, end: int | None = None, col: str = "login_time") -> Column:
    """Half-open window on an epoch-millisecond column."""
    out = F.col(col) >= start
    return out if end is None else out & (F.col(col) < end)


def positive(col: str) -> Column:
    """The value if above zero, else null: averages and percentiles then skip it."""
    return F.when(F.col(col) > 0, F.col(col))


def share_of(total: Column, part: Column, digits: int = 1) -> Column:
    """``part`` of ``total`` in percent, rounded; a total below 1 counts as 1."""
    return half_up(part / F.greatest(total, F.lit(1)) * 100, digits)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def severity_rank(col: str = "severity") -> Column:
    return F.when(F.col(col) == "critical", 0).when(F.col(col) == "warning", 1).otherwise(2)


def anomaly_id(kind: Column, station: Column, ts: Column | int) -> Column:
    """Identity of an anomaly: equal for the same type and station within five minutes."""
    bucket = F.floor((F.lit(ts) if isinstance(ts, int) else ts) / 300_000).cast("string")
    return F.concat(F.lit("anom_"), F.md5(F.concat_ws("_", kind, F.coalesce(station, F.lit("global")), bucket)))


def one_row(spark: SparkSession) -> DataFrame:
    return spark.range(1).drop("id")
