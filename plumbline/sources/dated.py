"""Tables kept in one folder per day: only the days that a change touches are read and written, and whole days are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.graph import checkpointed
from plumbline.functions.rules import DAY

DAY_COLUMN = "day"


def day_of(column: str) -> Column:
    """The UTC day of a time in milliseconds, as a date."""
    return F.to_date(F.timestamp_seconds(F.floor(F.col(column) / DAY) * (DAY // 1000)))


def read_dated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def held_days(spark: SparkSession, path: str) -> list[str]:
    """The days held, from the names of the folders alone."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    names = [x.getPath().getName() for x in files.listStatus(where) if x.isDirectory()]
    return sorted(n.removeprefix(f"{DAY_COLUMN}=") for n in names if n.startswith(f"{DAY_COLUMN}="))


def write_days(rows: DataFrame, path: str) -> None:
    """Write the days of ``rows`` (which has a column ``day``), each replacing the one held; other days are not touched."""
    (rows.repartition(DAY_COLUMN, F.pmod(F.xxhash64(*[c for c in rows.columns if c != DAY_COLUMN]), F.lit(8)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY_COLUMN).parquet(path))


def load_days(batch: DataFrame, path: str, key: str, time: str) -> DataFrame:
    """Add the rows of ``batch`` whose ``key`` is not held yet on their day, and return ``day, added, held``.

    Of several rows of one key the earliest stays (ties: any). Only the days in the batch are read, found by the
    partition filter, and only days that gain rows are written again.
    """
    spark = batch.sparkSession
    columns = F.struct(*batch.columns)
    new = checkpointed(batch.withColumn(DAY_COLUMN, day_of(time)).groupBy(DAY_COLUMN, key).agg(F.min(F.struct(F.col(time).alias("_at"), columns.alias("row"))).alias("first"))
                       .select(DAY_COLUMN, "first.row.*"))
    days = [r[0] for r in new.select(DAY_COLUMN).distinct().collect()]  # one row per day
    known = set(held_days(spark, path))
    touched = [d for d in days if str(d) in known]
    if touched:
        held = read_dated(spark, path).filter(F.col(DAY_COLUMN).isin(touched))
        new = checkpointed(new.join(held.select(DAY_COLUMN, key), [DAY_COLUMN, key], "left_anti"))
        gaining = [r[0] for r in new.select(DAY_COLUMN).distinct().collect()]
        rows = checkpointed(new.unionByName(held.filter(F.col(DAY_COLUMN).isin(gaining)).select(*new.columns)))
    else:
        rows = new
    added = checkpointed(new.groupBy(DAY_COLUMN).agg(F.count(F.lit(1)).alias("added")))
    if not rows.isEmpty():
        write_days(rows, path)
    return added.join(rows.groupBy(DAY_COLUMN).agg(F.count(F.lit(1)).alias("held")), DAY_COLUMN)


def high_water(spark: SparkSession, path: str, time: str) -> int | None:
    """The newest time held: the folders' names tell the last day, and only that one is read."""
    days = held_days(spark, path)
    if not days:
        return None
    return read_dated(spark, path).filter(F.col(DAY_COLUMN) == F.lit(days[-1]).cast("date")).agg(F.max(time)).first()[0]


def drop_days(spark: SparkSession, path: str, as_of: int, keep_days: int) -> DataFrame:
    """Drop the folders of all days that ended ``keep_days`` before ``as_of``; ``day, deleted`` per dropped day.

    Rows are counted by the footers of the dropped files; no row is read or written.
    """
    last = spark.range(1).select(day_of_value(as_of - keep_days * DAY)).first()[0]
    gone = [d for d in held_days(spark, path) if d < str(last)]
    if not gone:
        return spark.createDataFrame([], f"{DAY_COLUMN} date, deleted long")
    counts = checkpointed(read_dated(spark, path).filter(F.col(DAY_COLUMN).isin([F.lit(d).cast("date") for d in gone])).groupBy(DAY_COLUMN).agg(F.count(F.lit(1)).alias("deleted")))
    jvm = spark.sparkContext._jvm
    for day in gone:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{DAY_COLUMN}={day}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return counts


def day_of_value(ms: int) -> Column:
    return F.to_date(F.timestamp_seconds(F.lit(ms // DAY * (DAY // 1000))))
