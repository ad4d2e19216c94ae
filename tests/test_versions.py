"""Zone versions: bounded change over ten cycles, against a plain-Python twin."""

import math
import random

from pyspark.sql import functions as F

from plumbline.functions.ranks import numbered
from plumbline.operators import versions
from plumbline.plans import version_queries
from plumbline.plans.fixtures import AS_OF, Tables

HOUR = 3_600_000


def plain_cycle(state, proposed, as_of, share, least, rest):
    """``state``: id -> [body, priority, created, changed, changes, waiting]; ``proposed``: id -> (body, priority)."""
    quota = max(least, math.ceil(share * sum(s[0] is not None for s in state.values())))
    asked, made = [], []
    for z in set(state) | set(proposed):
        old, new = state.get(z), proposed.get(z)
        held = old is not None and old[0] is not None
        kind = "added" if new and not held else "removed" if held and not new else "updated" if held and new and (old[0], old[1]) != new else None
        if kind is None:
            if held:
                old[5] = None
            else:
                state.pop(z, None)
            continue
        since = old[5] if old and old[5] is not None else as_of
        state.setdefault(z, [None, None, None, None, 0, None])[5] = since
        if not (held and old[2] > as_of - rest):
            asked.append((since, new[1] if new else old[1], z, kind))
    for _, _, z, kind in sorted(asked)[:quota]:
        made.append((z, kind))
        if kind == "removed":
            del state[z]
            continue
        s = state[z]
        s[0], s[1] = proposed[z]
        s[2] = as_of if kind == "added" else s[2]
        s[3], s[4], s[5] = as_of, s[4] + 1, None
    return made


def test_ten_cycles_equal_the_plain_twin(spark):
    rng = random.Random(9)
    spark_state, state = spark.createDataFrame([], versions.STATE), {}
    proposed = {}
    for k in range(10):
        as_of = k * 4 * HOUR
        if k < 4:  # then the proposals stay the same, and every change must arrive
            proposed = {f"z{i}": (f"b{rng.randrange(3)}", rng.randrange(4)) for i in range(24) if rng.random() < 0.7}
        df = spark.createDataFrame([(z, b, p) for z, (b, p) in proposed.items()], "zone_id string, body string, priority int").repartition(3)
        spark_state, made = versions.version_chain([(as_of, df)], spark_state, share=0.25, least=4, rest_ms=6 * HOUR)
        before = sum(s[0] is not None for s in state.values())
        want = plain_cycle(state, proposed, as_of, 0.25, 4, 6 * HOUR)
        assert sorted((r.zone_id, r.change) for r in made.collect()) == sorted(want)
        assert len(want) <= max(4, math.ceil(0.25 * before))
        assert sorted(map(tuple, spark_state.collect()), key=str) == sorted(((z, *s) for z, s in state.items()), key=str)
    assert {z: (s[0], s[1]) for z, s in state.items()} == proposed


def test_ten_cycles_of_the_given_tables(spark, sf):
    """At most the allowed share changes in each of ten cycles, and all changes arrive once the proposals rest."""
    t = Tables(spark, sf)
    cycles = [AS_OF - k * 24 * HOUR for k in range(4, 0, -1)]
    days = {at: version_queries.proposal(t, at).cache() for at in cycles}
    state, held = spark.createDataFrame([], versions.STATE), 0
    for k in range(10):
        now = cycles[0] + k * 24 * HOUR
        proposed = days[cycles[min(k, 3)]]
        state, made = versions.version_chain([(now, proposed)], state, share=0.3, least=3)
        assert made.count() <= max(3, math.ceil(0.3 * held))
        held = state.filter("body is not null").count()
    want = {tuple(r) for r in days[cycles[3]].select("zone_id", "body", "priority").collect()}
    assert {tuple(r) for r in state.select("zone_id", "body", "priority").collect()} == want and len(want) > 5


def test_numbered_places(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").repartition(5)
    got = sorted((r.place_, r.k, r.id) for r in numbered(rows, [F.col("k"), F.col("id")], "place_").collect())
    assert [(k, i) for _, k, i in got] == sorted((i % 7, i) for i in range(1000)) and [p for p, _, _ in got] == list(range(1, 1001))
    assert numbered(rows.limit(0), [F.col("id")], "place_").count() == 0
