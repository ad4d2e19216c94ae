"""Versions of a set of zones: young zones rest, and only a share of the zones may change in a cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.graph import checkpointed
from plumbline.functions.ranks import numbered
from plumbline.functions.rules import HOUR

# Share of the zones that may change in a cycle, how many may in any case, and how old a zone must be first.
CHANGE_SHARE, LEAST_CHANGES, REST_MS = 0.05, 5, 6 * HOUR
STATE = "zone_id string, body string, priority int, created_ms long, changed_ms long, changes int, waiting_ms long"


def next_version(state: DataFrame, proposed: DataFrame, as_of: int, share: float = CHANGE_SHARE, least: int = LEAST_CHANGES, rest_ms: int = REST_MS) -> tuple[DataFrame, DataFrame]:
    """The next version of ``state``, and the changes ``zone_id, change`` that it made.

    ``state`` has the columns of ``STATE``; ``proposed`` is what the zones should be: ``zone_id, body, priority``, where
    ``body`` is whatever describes a zone. A zone is added, removed or updated (body or priority differ). Zones created less
    than ``rest_ms`` ago stay as they are. Of the other changes those that have waited longest go first, then lower priority
    numbers, then ids; at most ``share`` of the zones held (rounded up), but at least ``least`` changes, are made. The rest
    waits: ``waiting_ms`` tells since when, and a zone still to be added is held with an empty body. A change that is no
    longer asked for is forgotten.
    """
    c = F.col
    asked = proposed.select("zone_id", c("body").alias("n_body"), c("priority").cast("int").alias("n_priority"))
    held = c("body").isNotNull()
    differs = (c("body") != c("n_body")) | ~c("priority").eqNullSafe(c("n_priority"))
    kind = F.when(~held & c("n_body").isNotNull(), "added").when(held & c("n_body").isNull(), "removed").when(held & differs, "updated")
    rows = checkpointed(state.join(asked, "zone_id", "full_outer").withColumn("change", kind).withColumn(
        "since", F.when(c("change").isNotNull(), F.coalesce("waiting_ms", F.lit(as_of).cast("long")))))
    quota = max(least, rows.agg(F.ceil(F.count_if(held) * share)).first()[0])
    free = rows.filter(c("change").isNotNull() & ~(held & (c("created_ms") > as_of - rest_ms)))
    order = [c("since"), F.coalesce("n_priority", "priority"), c("zone_id")]
    made = checkpointed(numbered(free, order, "rank").filter(c("rank") <= quota).select("zone_id", F.lit(True).alias("made")))
    now = F.lit(as_of).cast("long")
    new = rows.join(made, "zone_id", "left").withColumn("made", F.coalesce("made", F.lit(False)))
    pick = lambda new_value, old: F.when(c("made"), new_value).otherwise(old)
    kept = new.filter(~(c("made") & (c("change") == "removed")) & (held | c("n_body").isNotNull()))
    out = kept.select(
        "zone_id", pick(c("n_body"), c("body")).alias("body"), pick(c("n_priority"), c("priority")).alias("priority"),
        F.when(c("made") & (c("change") == "added"), now).otherwise(c("created_ms")).alias("created_ms"), pick(now, c("changed_ms")).alias("changed_ms"),
        pick(F.coalesce("changes", F.lit(0)) + 1, F.coalesce("changes", F.lit(0))).alias("changes"), F.when(~c("made"), c("since")).alias("waiting_ms"))
    return out, new.filter("made").select("zone_id", "change")


def version_chain(proposals: list[tuple[int, DataFrame]], state: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """The state after all cycles ``(as_of, proposed)`` in turn, and all changes with the cycle's time as ``at_ms``."""
    log = None
    for as_of, proposed in proposals:
        state, made = next_version(state, proposed, as_of, **limits)
        state, made = checkpointed(state), made.withColumn("at_ms", F.lit(as_of).cast("long"))
        log = made if log is None else log.unionByName(made)
    return state, log
