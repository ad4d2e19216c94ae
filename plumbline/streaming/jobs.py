"""Structured Streaming forms of the five-minute jobs, and the batch twin of the alert throttle."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.functions.graph import checkpointed
from plumbline.functions.rules import clean_sessions, positive

LATE = "6 hours"
THROTTLE_MS = 15 * 60_000
#: Alerts are throttled in slices of so long, each a task's group of its own.
SLICE_MS = 6 * 3_600_000


def with_event_time(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("ts", F.timestamp_millis("login_time"))


def deduplicated(sessions: DataFrame, late: str = LATE) -> DataFrame:
    """Late re-deliveries dropped: state holds ids only as long as the watermark needs them."""
    return with_event_time(sessions).withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def window_stats(sessions: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Mean fix rate, mean positive age and sessions per station and tumbling (or sliding) window, for streams and tables.

    Sliding windows of a table are added up from slots that fit both the width and the slide, so sessions are counted once
    and only the slots are repeated for each of their windows."""
    rows = with_event_time(clean_sessions(sessions))
    if slide and not rows.isStreaming:
        return _slotted_stats(rows, width, slide)
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(span.alias("w"), "station").agg(
        F.count("*").alias("sessions"), F.avg("fix_rate").alias("mean_fix"), F.avg(F.when(F.col("avg_age") > 0, F.col("avg_age"))).alias("mean_age")).select(
            F.unix_millis("w.start").alias("start_ms"), "station", "sessions", "mean_fix", "mean_age")


def _slotted_stats(rows: DataFrame, width: str, slide: str) -> DataFrame:
    c = F.col
    wide, step = (int(pd.Timedelta(x) / pd.Timedelta(milliseconds=1)) for x in (width, slide))
    slot = gcd(wide, step)
    slots = rows.groupBy((F.floor(c("login_time") / slot) * slot).alias("slot"), "station").agg(
        F.count("*").alias("n"), F.sum("fix_rate").alias("fix"), F.count("fix_rate").alias("fixes"), F.sum(positive("avg_age")).alias("age"), F.count(positive("avg_age")).alias("ages"))
    # A station's slots meet in one task, at most one row for each slot, and are repeated there only; the tasks are not merged by the bytes of the slots.
    dealt = slots.filter("slot is not null").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "station")
    last = F.floor(c("slot") / step) * step
    first = F.floor((c("slot") - wide) / step) * step + step
    return dealt.withColumn("start_ms", F.explode(F.sequence(first, last, F.lit(step).cast("long")))).groupBy("start_ms", "station").agg(
        F.sum("n").alias("sessions"), F.try_divide(F.sum("fix"), F.sum("fixes")).alias("mean_fix"), F.try_divide(F.sum("age"), F.sum("ages")).alias("mean_age"))


def wanted(kind: Column, severity: Column) -> Column:
    """Which throttled events are sent at all."""
    return (kind == "interference") | (kind.isin("anomaly", "environment", "trust_change") & (severity == "critical"))


def slice_exits(ts: np.ndarray, start: int) -> tuple[list[int], list[int]]:
    """``upto, exit``: a slice whose first sent time is the first of ``ts`` (ascending) not under x sends last at the exit of
    the first ``upto`` not under x. Only times of the first 15 minutes, and the next one, can be sent first."""
    after = np.searchsorted(ts, ts + THROTTLE_MS).tolist()
    last = list(range(len(ts)))
    for i in range(len(ts) - 1, -1, -1):
        if after[i] < len(ts):
            last[i] = last[after[i]]
    first = np.array(last[: int(np.searchsorted(ts, start + THROTTLE_MS)) + 1], np.int64)
    ends = np.append(np.flatnonzero(np.diff(first)), len(first) - 1)
    return ts[ends].tolist(), ts[first[ends]].tolist()


def throttled_alerts(events: DataFrame) -> DataFrame:
    """Events (``event_id, type, severity, ts_ms``) that get through: no info events, at most one per type and severity
    in 15 minutes, and then only the wanted types.

    A key's events are dealt to slices of time. Each slice tells for the times at which it may be entered when it sends
    last, a fold over these short lists finds the entry of every slice, and each slice sends from there. No task holds
    all events of a key."""
    key = ["type", "severity"]
    times = checkpointed(
        events.filter((F.col("severity") != "info") & wanted(F.col("type"), F.col("severity")) & F.col("ts_ms").isNotNull()).withColumn("ts_ms", F.col("ts_ms").cast("long"))
        .groupBy(*key, "ts_ms").agg(F.min(F.struct("event_id")).alias("id")).withColumn("slice", F.floor(F.col("ts_ms") / SLICE_MS).cast("long")))

    def exits(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        upto, end = slice_exits(np.sort(pdf["ts_ms"].to_numpy()), int(k[2]) * SLICE_MS)
        return pd.DataFrame([(*k, upto, end)], columns=[*key, "slice", "upto", "exit"])

    def entries(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, free = [], -(2**62)
        for number, upto, end in pdf.sort_values("slice")[["slice", "upto", "exit"]].itertuples(index=False):
            rows.append((*k, number, free))
            i = int(np.searchsorted(upto, free))
            free = int(end[i]) + THROTTLE_MS if i < len(upto) else free
        return pd.DataFrame(rows, columns=[*key, "slice", "free"])

    def send(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_ms")
        ts, taken = pdf["ts_ms"].to_numpy(), []
        i = int(np.searchsorted(ts, pdf["free"].iloc[0]))
        while i < len(ts):
            taken.append(i)
            i = int(np.searchsorted(ts, ts[i] + THROTTLE_MS))
        return pdf.iloc[taken][[*key, "event_id", "ts_ms"]]

    named, kind = "type string, severity string", events.schema["event_id"].dataType.simpleString()
    begun = (times.groupBy(*key, "slice").applyInPandas(exits, f"{named}, slice long, upto array<long>, exit array<long>")
             .groupBy(*key).applyInPandas(entries, f"{named}, slice long, free long"))
    rows = times.join(begun, [*key, "slice"]).select(*key, "slice", "ts_ms", "free", "id.event_id")
    return rows.groupBy(*key, "slice").applyInPandas(send, f"{named}, event_id {kind}, ts_ms long")


def recent_history(anomalies: DataFrame, as_of: int, keep: int = 50, days: int = 7) -> DataFrame:
    """Per key the number of anomalies of the last days, out of the newest ``keep``. Rows are cut to ``keep`` a key in two
    steps, so a hot key is no group of rows."""
    salted = anomalies.select("key", "ts_ms", F.spark_partition_id().alias("salt"))
    for by in (["key", "salt"], ["key"]):
        newest = Window.partitionBy(*by).orderBy(F.desc_nulls_last("ts_ms"))
        salted = salted.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= keep).drop("rank")
    late = F.count_if(F.col("ts_ms") > as_of - days * 86_400_000)
    return salted.groupBy("key").agg(late.cast("int").alias("recent"), F.count("ts_ms").cast("int").alias("held"))


CUSUM_OUT = "station string, start_ms long, current double, baseline double, s_minus double, ewma double, cusum_alarm boolean, ewma_alarm boolean"
CUSUM_STATE = "base double, low double, ewma double, count int, warm int"


def cusum_stream(buckets: DataFrame, warm: int = 5, h: float = 5.0, k: float = 0.5, drop: float = 15.0) -> DataFrame:
    """Keyed-state form of the sequential detector for streams of bucket means (``station, start_ms, mean_fix``).

    The first ``warm`` buckets of a station set its baseline, which then stays frozen; every later bucket updates the lower
    sum and the smoothed rate and gives one row. State is five numbers a station, whatever its history.
    """

    def update(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, low, ewma, count, seen = state.get if state.exists else (0.0, 0.0, 0.0, 0, 0)
        rows = []
        for start, x in pd.concat(batches).sort_values("start_ms")[["start_ms", "mean_fix"]].itertuples(index=False):
            if seen < warm:
                seen += 1
                base += (x - base) / seen
                ewma = base
                continue
            count += 1
            low = max(0.0, low - (x - base) / max(5.0, base * 0.15) - k)
            ewma = 0.2 * x + 0.8 * ewma
            alarm = low > h and count >= 3
            rows.append((key[0], start, x, base, low, ewma, alarm, count >= 5 and base > 50 and base - ewma > drop))
            low = 0.0 if alarm else low
        state.update((float(base), float(low), float(ewma), int(count), int(seen)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CUSUM_OUT.split(", ")])

    return buckets.groupBy("station").applyInPandasWithState(update, CUSUM_OUT, CUSUM_STATE, "append", GroupStateTimeout.NoTimeout)
