"""Importance resampling: hashed features, weights, bracket and ranks against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_features(text):
    w = WORD.findall(low(text))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(rows, target, percent=25, min_words=20):
    """The contract on plain lists."""
    found = [plain_features(t) for _, t in rows]
    s, t = (Counter(bucket(f) for fs in many for f in fs) for many in ([f for _, f in found], [plain_features(x)[1] for x in target]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in set(s) | set(t)}
    out = []
    for (doc_id, _), (words, fs) in zip(rows, found):
        weight = math.floor(sum(gain[bucket(f)] for f in fs) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[:percent * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBz09 .\n{`é€_\u0080"), max_size=80), max_size=5), st.integers(1, 30), st.booleans())
def test_features_equal_plain_checksums(texts, chunk, long):
    texts = [t * (40 if long else 1) for t in texts]
    before, importance.CHUNK_BYTES = importance.CHUNK_BYTES, chunk
    try:
        parts = list(importance.features([t.encode() for t in texts]))
    finally:
        importance.CHUNK_BYTES = before
    got = Counter(x for b, k, _ in parts for x in zip(k.tolist(), b.tolist()))
    assert got == Counter((k, bucket(f)) for k, t in enumerate(texts) for f in plain_features(t)[1])
    assert sum((w for _, _, w in parts), np.zeros(len(texts), int)).tolist() == [len(plain_features(t)[0]) for t in texts]


@pytest.fixture
def corpus(docs):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)] + ["Éa", "x" * 70, "Ab9"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, rows[5][1]), (None, None), (900, ""), (901, "?!"), (902, "long word " * 9000)]
    rows += [(i, rows[9][1]) for i in range(300, 330)]
    return rows, docs(*rows, extra=["uid", "rank", "part", "n", "a.b"])


TARGET = ["w1 w2 w3 w4 Ab9", "w5 w6", None, ""]


@pytest.mark.parametrize("error", [importance.SKETCH_ERROR, 0.3])
def test_resampling_equals_brute_force(spark, corpus, monkeypatch, error):
    rows, table = corpus
    monkeypatch.setattr(importance, "SKETCH_ERROR", error)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = sorted((tuple(r) for r in importance.resample(table, target).collect()), key=str)
    assert got == plain(rows, TARGET) and sum(r[4] is not None for r in got) > 20


@pytest.mark.parametrize("percent, min_words", [(0, 20), (100, 0), (1, 59), (25, 10**9)])
def test_edges_of_the_share(spark, corpus, percent, min_words):
    rows, table = corpus
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.resample(table, target, percent, min_words).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, TARGET, percent, min_words)


def test_brackets_that_miss_are_widened(spark):
    """A sketch far off, and one score on most rows: the counts outside tell, and the cutoff stays exact."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, 5).otherwise(F.col("id") % 7).cast("long").alias("score"),
                                    F.lit(1).cast("long").alias("n_features"), F.col("id").alias("uid"))
    want = sorted(((-r.score, r.doc_id) for r in rows.collect()))

    class Off:
        """The table with quantiles of its lowest rows only, until the bracket spans everything."""

        def __getattr__(self, name):
            return (lambda *a: [0.0, 1.0]) if name == "approxQuantile" else getattr(rows, name)

    for draw in (1, 137, 1000, 3500, 4000):
        for table in (rows, Off()):
            last = importance.cutoff(table, 4000, draw)
            assert (-last.score, last.doc_id) == want[draw - 1]
    assert importance.cutoff(rows, 4000, 0) is None


def test_hot_rows_are_numbered_in_many_tasks(spark):
    rows = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("score"), F.lit(1).cast("long").alias("n_features"), F.col("id").alias("uid"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        out = importance.numbered(rows, importance.best_first(), "rank").withColumn("task", F.spark_partition_id())
        places, tasks = zip(*out.select("rank", "task").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(places) == list(range(1, 40_001)) and max(Counter(tasks).values()) < 20_000


def test_empty_tables(spark, corpus):
    rows, table = corpus
    none = spark.createDataFrame([], "text string")
    assert importance.resample(table.limit(0), none).count() == 0
    assert sorted((tuple(r) for r in importance.resample(table, none).collect()), key=str) == plain(rows, [])
