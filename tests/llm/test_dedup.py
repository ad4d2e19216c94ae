import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, sharding, simhash

CLASH = ["uid", "best", "fp", "text_sha256", "component_id", "_digest2", "virtual_slot", "size"]


def test_exact_dedup_edge_cases(docs):
    rows = exact_dedup.exact_dedup(docs((1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "ÄB"), (6, "äb"), (7, "x"), (7, "x"), extra=CLASH)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].keep_id == 2 and not by[1][0].kept and by[2][0].kept and by[1][0].group_size == 2
    assert by[3][0].keep_id == 4 and by[3][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[5][0].group_size == 1  # only A-Z are lowered
    assert sorted(r.kept for r in by[7]) == [False, True]  # of repeated rows exactly one stays


def test_exact_dedup_empty_and_null_ids(docs, spark):
    assert exact_dedup.exact_dedup(docs()).count() == 0
    rows = exact_dedup.exact_dedup(docs((None, "a"), (None, "a"), (5, "a"))).collect()
    assert [r.kept for r in sorted(rows, key=lambda r: r.doc_id or -1)] == [False, False, True] and {r.keep_id for r in rows} == {5}


def test_heavy_split_equals_plain_grouping(docs):
    rng = random.Random(1)
    texts = ["hot"] * 150 + [rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(150)]
    rng.shuffle(texts)
    rows = exact_dedup.exact_dedup(docs(*texts).repartition(7), tracked=8).collect()
    last = {t: i for i, t in enumerate(texts)}
    assert len(rows) == 300 and all(r.keep_id == last[texts[r.doc_id]] and r.group_size == texts.count(texts[r.doc_id]) and r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_drop_exact_duplicates_keeps_columns(docs):
    table = docs((1, "a"), (2, "A"), (3, "b"), (3, "b"), (4, None), (4, "a"), extra=["text_sha256", "_k"])
    kept = exact_dedup.drop_exact_duplicates(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(3, "b"), (4, ""), (4, "a")]


def plain_simhash(text: str) -> int:
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in text).split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    out = 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    for b in range(64):
        if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes):
            out |= 1 << b
    return out


def test_fingerprint_rule():
    for text in ["", " ", "a", "a b", "a b c", "a\tb\nc d", "x " * 500, "é è ü ß 日本 語", "w" * 50_000]:
        assert simhash.fingerprint(text) == plain_simhash(text)


def test_grid_join_finds_every_link(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    every = set(base)
    for f in base:
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << b
            every.add(f)
    signed = [int(np.uint64(f).astype(np.int64)) for f in every]
    found = {(r.src, r.dst) for r in simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert found == want and len(want) > 50


def test_near_duplicates_edge_cases(docs):
    text = " ".join(f"word{i}" for i in range(400))
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs((3, text), (9, text.upper()), (5, text + " tail"), (1, None), (2, ""), (7, "other words here"), extra=CLASH)).collect()}
    assert rows[3].fingerprint == rows[9].fingerprint and rows[9].component_id == 3
    assert rows[1].fingerprint == "0" * 16 and rows[2].component_id == 1
    assert rows[7].component_id == 7
    assert simhash.near_duplicates(docs()).count() == 0


def test_drop_near_duplicates(docs):
    text = " ".join(f"w{i}" for i in range(300))
    table = docs((1, text), (2, text), (4, "quite another text"), extra=["component_id"])
    kept = simhash.drop_near_duplicates(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_sharding_law_bytes(docs):
    rng = random.Random(3)
    table = docs(*["x" * rng.randint(0, 300) for _ in range(2000)], (None, None), (None, "é"), (5, "repeat"), extra=CLASH)
    rows = sharding.shard_documents(table).collect()
    assert len(rows) == 2003
    loads, slots = {}, {}
    for r in rows:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(loads) == set(range(8)) and max(loads.values()) < 1.02 * min(loads.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.size for r in rows if r.doc_id is None} == {1, 3}
    assert sharding.shard_documents(docs()).count() == 0


def test_slot_map_versions_and_rebalancing(spark, docs, tmp_path):
    weights = {v: 100 + v % 7 for v in range(sharding.VIRTUAL_SLOTS)}
    first = sharding.balanced_map(weights)
    grown = sharding.rebalanced_map(first, weights, 9)
    loads = [sum(weights[v] for v, s in enumerate(grown) if s == k) for k in range(9)]
    assert max(loads) <= 1.02 * min(loads) and sum(a != b for a, b in zip(first, grown)) < 1.1 * len(first) / 9
    path, table = str(tmp_path / "maps"), docs(*["x" * (i % 50) for i in range(3000)])
    one = {r.doc_id: r for r in sharding.shard_documents(table, path).collect()}
    two = {r.doc_id: r for r in sharding.shard_documents(table, path, shards=9, held=1).collect()}
    assert {r.map_version for r in one.values()} == {1} and {r.map_version for r in two.values()} == {2}
    moved = {i for i in one if one[i].shard != two[i].shard}
    assert len(moved) < 0.15 * len(one) and {two[i].shard for i in moved} == {8}  # only into the shard that is new
    slots = {}
    for r in two.values():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.map_version for r in sharding.shard_documents(table, path, shards=9, held=2).collect()} == {2}  # nothing to move
    stored = [sharding.load_map(spark, path, v)[1].orderBy("virtual_slot").collect() for v in (1, 2)]
    assert [r.shard for r in stored[0]] != [r.shard for r in stored[1]] and all(len(s) == sharding.VIRTUAL_SLOTS for s in stored)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sharding.save_map(spark, first, path, 2)


def test_registered_native_plan_has_no_python(spark, sf, monkeypatch):
    stages = []
    keep = exact_dedup.checkpointed
    monkeypatch.setattr(exact_dedup, "checkpointed", lambda df: (stages.append(df), keep(df))[1])
    plan = exact_dedup.op6_exact_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    plans = [plan, *(df._jdf.queryExecution().executedPlan().toString() for df in stages)]
    assert len(plans) == 3 and not any("Python" in p or "Arrow" in p for p in plans)
    assert exact_dedup.op6_exact_dedup(spark, sf).agg(F.count_if("kept") == F.count_distinct("text_sha256")).first()[0]


def test_embedding_bounds_the_bit_difference(spark):
    """Manhattan distance of the counts, by the unary codes, against plain counting."""
    rng = random.Random(31)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randrange(6)):
            b ^= 1 << rng.randrange(64)
        pairs.append((a, b))
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    counts = lambda f: [bin(f >> 2 * i & 3).count("1") for i in range(simhash.SEGMENTS)]
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
    got = df.select(F.bit_count(simhash.embedding("a").bitwiseXOR(simhash.embedding("b")))).collect()
    for (a, b), (d,) in zip(pairs, got):
        assert d == sum(abs(x - y) for x, y in zip(counts(a), counts(b))) <= bin(a ^ b).count("1")
