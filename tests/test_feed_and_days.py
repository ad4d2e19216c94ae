"""The public feed against plain replacing, and tables by day: what is read, written and dropped."""

import os
import random
import re

from pyspark.sql import functions as F

from plumbline.operators import feed
from plumbline.sources import dated

DAY = 86_400_000


def plain_feed(rows):
    """Row by row with a dictionary, as a program without Spark would."""
    codes, out = {}, []

    def code(name):
        if not name:
            return None
        return codes.setdefault(name, f"STN-{len(codes) + 1:04d}")

    for i, station, text in sorted(rows):
        shown = code(station)
        if text is not None:
            text = re.sub(r"\b[A-Z0-9]{8,12}\b", lambda m: code(m[0]), text)
            text = re.sub("(?i)geodnet|onocoy", "network", text)
            text = re.sub(r"NRBY_\w+", lambda m: code(m[0]), text)
            text = re.sub(r"ONO_\w+", lambda m: code(m[0]), text)
        out.append((i, shown, text))
    return out


def test_feed_equals_plain_replacing(spark):
    rng = random.Random(3)
    names = ["STATION01", "ABCDEFGH", "12345678", "ONO_a1", "NRBY_b_2", "ABCDEFGHIJKLM", "short", "ONO_geodnet7", "GEODNET1", "HOTSTATION"]
    words = [*names, "GeodNet", "onocoy.", "on", "(x)", "é", "NRBY_", "network", "HOTSTATION", "HOTSTATION"]
    rows = [(i, rng.choice([*names, None, "", "HOTSTATION", "HOTSTATION"]), rng.choice([None, "", *(" ".join(rng.choice(words) + rng.choice(["", ",", "-"]) for _ in range(rng.randrange(9))) for _ in range(9))]))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id int, station string, text string").withColumn("code", F.lit("kept")).repartition(4)
    got = feed.public_feed(df)
    assert got.columns == df.columns
    assert sorted((r.id, r.station, r.text) for r in got.collect()) == plain_feed(rows)
    assert feed.public_feed(df.limit(0)).count() == 0


def tree(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("day=")}


def test_days(spark, tmp_path):
    path = str(tmp_path / "t")
    start = 19_700 * DAY  # a whole day
    rows = lambda ids: spark.createDataFrame([(f"k{i}", start + i * DAY // 4, float(i)) for i in ids], "id string, at long, x double").repartition(3)
    assert dated.held_days(spark, path) == [] and dated.high_water(spark, path, "at") is None
    first = dated.load_days(rows(range(20)).unionByName(rows(range(5))), path, "id", "at")
    assert sum(r.added for r in first.collect()) == 20 and len(dated.held_days(spark, path)) == 5
    before = tree(path)
    # Day 3 gains one row, day 1 is only delivered again, day 6 is new: two folders are written, the others are not touched.
    again = rows([4, 5, 12, 13, 24]).unionByName(spark.createDataFrame([("new", start + 3 * DAY + 1, 9.0)], "id string, at long, x double"))
    log = {str(r.day): (r.added, r.held) for r in dated.load_days(again, path, "id", "at").collect()}
    after, days = tree(path), dated.held_days(spark, path)
    assert log == {days[3]: (1, 5), days[5]: (1, 1)}
    assert [d for d in before if before[d] != after[d]] == [f"day={days[3]}"] and len(days) == 6
    assert dated.read_dated(spark, path).count() == 22 and dated.high_water(spark, path, "at") == start + 6 * DAY
    # Only the asked days are scanned.
    plan = dated.read_dated(spark, path).filter(F.col("day") == F.lit(days[3]).cast("date"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    files = dated.read_dated(spark, path).filter(F.col("day") == F.lit(days[3]).cast("date")).select(F.input_file_name()).distinct().collect()
    assert all(f"day={days[3]}" in f[0] for f in files)
    dropped = {str(r.day): r.deleted for r in dated.drop_days(spark, path, start + 6 * DAY + 5, 4).collect()}
    assert dropped == {days[0]: 4, days[1]: 4} and dated.held_days(spark, path) == days[2:] and tree(path) == {d: f for d, f in after.items() if d[4:] in days[2:]}
    assert dated.drop_days(spark, path, start, 4).count() == 0
    assert dated.load_days(rows([]).limit(0), path, "id", "at").count() == 0


def test_late_rows_do_not_replace_the_first_version(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda x: spark.createDataFrame([("a", 5 * DAY + 1, x)], "id string, at long, x double")
    dated.load_days(row(1.0), path, "id", "at").collect()
    assert dated.load_days(row(2.0), path, "id", "at").count() == 0
    assert [r.x for r in dated.read_dated(spark, path).collect()] == [1.0]
